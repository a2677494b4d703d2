"""Registered queries of manifest statistics and review jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import manifests
from .catalog import _BOXES, labelled, query, rounded, table


def _shown(counts: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey % 4 AS q, c_nationkey IS NOT NULL AS gone FROM orders
  LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 5) ON o_custkey = c_custkey WHERE o_orderstatus = 'O')
SELECT count(*) AS original_refs, CAST(sum(q) AS BIGINT) AS original_queries, count(DISTINCT o_custkey) AS original_images,
  count(DISTINCT o_custkey) FILTER (gone) AS protected_images, count(*) FILTER (gone) AS excluded_refs, CAST(sum(q) FILTER (gone) AS BIGINT) AS excluded_queries,
  count(*) FILTER (NOT gone) AS retained_refs, CAST(sum(q) FILTER (NOT gone) AS BIGINT) AS retained_queries, count(DISTINCT o_custkey) FILTER (NOT gone) AS retained_images FROM r"""
)
def reference_stats(spark, sf_dir):
    said = F.array_repeat(F.lit("said"), (F.col("o_orderkey") % 4).cast("int"))
    refs = table(spark, sf_dir, "orders").withColumn("sentences", said)
    protected = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return manifests.reference_stats(refs, protected, "o_custkey", "sentences", F.col("o_orderstatus") == "O")


def _sql_counts(column: str, of: str) -> str:
    return f"(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT {column} AS v, count(*) AS n FROM {of} WHERE {column} IS NOT NULL GROUP BY 1))"


@query(
    f"""SELECT count(*) AS queries, count(DISTINCT l_orderkey) AS unique_images, count(DISTINCT (l_orderkey, l_partkey)) AS unique_targets,
  {_sql_counts('l_returnflag', 'lineitem')} AS dataset_queries, {_sql_counts('l_linestatus', 'lineitem')} AS category_queries,
  round(count(*) FILTER (l_linestatus = 'F') / count(*), 9) AS watched_rate FROM lineitem"""
)
def selection_stats(spark, sf_dir):
    out = manifests.selection_stats(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "F")
    return rounded(out.withColumns({c: _shown(F.col(c)) for c in ("dataset_queries", "category_queries")}))


@query(
    _BOXES
    + """, a AS (SELECT l_returnflag, coalesce(action, 'excluded') AS v, count(*) AS n FROM s GROUP BY ALL),
x AS (SELECT l_returnflag, exclusion AS v, count(*) AS n FROM s WHERE exclusion IS NOT NULL GROUP BY ALL)
SELECT l_returnflag, count(*) AS records, (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM a WHERE a.l_returnflag = s.l_returnflag) AS actions,
  (SELECT coalesce(string_agg(v || '=' || n, ',' ORDER BY v), '') FROM x WHERE x.l_returnflag = s.l_returnflag) AS exclusions,
  round(avg(b_iou), 9) AS baseline_miou, round(avg(c_iou), 9) AS challenger_miou, round(avg(oracle), 9) AS two_box_oracle_miou,
  round(avg(oracle) - avg(b_iou), 9) AS oracle_gain, count(*) FILTER (b_iou = 0) AS baseline_zero, count(*) FILTER (b_iou = 0 AND c_iou > 0) AS recovered_zero
FROM s GROUP BY l_returnflag"""
)
def selector_stats(spark, sf_dir):
    out = manifests.selector_stats(labelled(spark, sf_dir), ["l_returnflag"])
    return rounded(out.withColumns({c: _shown(F.col(c)) for c in ("actions", "exclusions")}))


@query(
    """WITH r AS (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, coalesce(string_agg(l_linenumber, ',' ORDER BY k), '') AS kept FROM r WHERE k <= 3 GROUP BY 1"""
)
def best_proposals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("score")))).alias("p"))
    out = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce(F.array_join(F.transform(manifests.best_proposals(F.col("p"), 3), lambda p: p["l_linenumber"].cast("string")), ","), F.lit("")).alias("kept"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def dataset_slice(spark, sf_dir):
    return manifests.dataset_slice(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT c_custkey AS key, c.c_nationkey AS audited, CASE WHEN event_id % 3 <> 0 THEN event_id END AS reviewed FROM customer c
LEFT JOIN e ON user_id = c_custkey AND k = 1 WHERE c_nationkey < 12 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"""
)
def review_requests(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey"))
    out = manifests.review_requests(
        c.select("key"), c.where("c_nationkey < 12").select("key", "c_nationkey"), table(spark, sf_dir, "events").withColumn("key", F.col("user_id")),
        table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey")), "key", "event_id", F.col("event_id") % 3 != 0, F.col("o_orderstatus") == "P",
    )
    return out.select("key", F.col("audit.c_nationkey").alias("audited"), F.col("review.event_id").alias("reviewed"))
