"""Registered queries of the grounding operators and their SQL counterparts.

The operators work on named columns; each query adapts a table to them with the
arithmetic that its SQL states too. Means and ratios are rounded to nine places on
both sides, as the order of a sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import hashing, text
from ..operators import boxes, decisions, isolation, joins, logs, metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selector_metrics(spark, sf_dir)


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a truth box and two shifted candidates, the baseline absent on line 7."""
    li = table(spark, sf_dir, "lineitem")
    q, t = F.col("l_quantity"), F.col("l_tax")

    def moved(dx):
        return F.array(q + dx, 100 * t, q + 10 + 100 * F.col("l_discount") + dx, 100 * t + 20)

    base = F.when(F.col("l_linenumber") != 7, moved((2 * (F.col("l_partkey") % 21 - 10)).cast("double")))
    score = (((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 101) - 50) / 100
    return li.select("*", moved(F.lit(0.0)).alias("gt"), base.alias("baseline"), moved((F.col("l_suppkey") % 25 - 12).cast("double")).alias("challenger"), score.alias("score"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.selector_columns(box_rows(spark, sf_dir), "gt", "baseline", "challenger")


_BOXES = """
WITH b AS (
  SELECT *, l_quantity AS gx1, 100 * l_tax AS y1, l_quantity + 10 + 100 * l_discount AS gx2, 100 * l_tax + 20 AS y2,
    CASE WHEN l_linenumber <> 7 THEN CAST(2 * (l_partkey % 21 - 10) AS DOUBLE) END AS bs,
    CAST(l_suppkey % 25 - 12 AS DOUBLE) AS cs, (((l_orderkey * 7 + l_linenumber) % 101) - 50) / 100.0 AS score
  FROM lineitem
), i AS (
  SELECT *, greatest(least(gx2, gx2 + bs) - greatest(gx1, gx1 + bs), 0.0) * (y2 - y1) AS bi,
    greatest(least(gx2, gx2 + cs) - greatest(gx1, gx1 + cs), 0.0) * (y2 - y1) AS ci,
    (gx2 - gx1) * (y2 - y1) AS ga, ((gx2 + bs) - (gx1 + bs)) * (y2 - y1) AS ba, ((gx2 + cs) - (gx1 + cs)) * (y2 - y1) AS ca
  FROM b
), u AS (
  SELECT *, CASE WHEN bs IS NULL THEN 0.0 ELSE bi / (ga + ba - bi) END AS b_iou, ci / (ga + ca - ci) AS c_iou FROM i
), s AS (
  SELECT *, bs IS NOT NULL AS eligible,
    CASE WHEN bs IS NULL THEN 'baseline_null_locked_stage1' END AS exclusion,
    CASE WHEN bs IS NOT NULL THEN CASE WHEN c_iou - b_iou >= 0.05 THEN 'switch' ELSE 'keep' END END AS action,
    CASE WHEN bs IS NOT NULL THEN greatest(b_iou, c_iou) ELSE b_iou END AS oracle,
    CASE WHEN bs IS NOT NULL THEN c_iou ELSE b_iou END AS kept,
    bs IS NOT NULL AND score > 0 AS switched
  FROM u
), m AS (SELECT *, CASE WHEN switched THEN c_iou ELSE b_iou END AS s_iou FROM s)
"""


@query(
    _BOXES
    + """
SELECT count(*) AS n, count(*) FILTER (eligible) AS scored_eligible, count(*) FILTER (switched) AS switches,
  round(avg(b_iou), 9) AS baseline_miou, round(avg(c_iou), 9) AS raw_challenger_miou, round(avg(kept), 9) AS challenger_miou,
  round(avg(s_iou), 9) AS selector_miou, round(avg(oracle), 9) AS oracle_miou,
  round(greatest(avg(b_iou), avg(kept)), 9) AS strongest_fixed_miou, round(avg(oracle) - avg(b_iou), 9) AS oracle_gap,
  round(avg(s_iou) - avg(b_iou), 9) AS gap_captured, round((avg(s_iou) - avg(b_iou)) / (avg(oracle) - avg(b_iou)), 9) AS capture,
  round(avg(oracle) - greatest(avg(b_iou), avg(kept)), 9) AS gap_from_strongest, round(avg(s_iou) - greatest(avg(b_iou), avg(kept)), 9) AS gain_over_strongest,
  round((avg(s_iou) - greatest(avg(b_iou), avg(kept))) / (avg(oracle) - greatest(avg(b_iou), avg(kept))), 9) AS capture_from_strongest,
  round(count(*) FILTER (switched) / count(*), 9) AS switch_rate, round(count(*) FILTER (s_iou >= 0.5) / count(*), 9) AS hit_rate,
  count(*) FILTER (s_iou >= 0.5) AS hits_at_half, count(*) FILTER (b_iou <= 1e-12) AS baseline_zero,
  count(*) FILTER (s_iou <= 1e-12) AS selector_zero, count(*) FILTER (b_iou > 1e-12 AND s_iou <= 1e-12) AS regressions,
  count(*) FILTER (eligible AND b_iou > 1e-12 AND c_iou <= 1e-12) AS unconditional_regressions,
  count(*) FILTER (b_iou <= 1e-12 AND s_iou > 1e-12) AS recoveries, count(*) FILTER (s_iou - b_iou > 1e-12) AS improved,
  count(*) FILTER (s_iou - b_iou < -1e-12) AS degraded, count(*) FILTER (abs(s_iou - b_iou) <= 1e-12) AS tied,
  round(avg(CASE WHEN eligible THEN CAST((action = 'switch') = switched AS INT) END), 9) AS action_accuracy
FROM m
"""
)
def selector_metrics(spark, sf_dir):
    return rounded(metrics.selector_metrics(labelled(spark, sf_dir), "score", 0.0))


@query(_BOXES + "SELECT l_returnflag, exclusion AS selector_exclusion, action AS selector_action, count(*) AS n, round(avg(b_iou), 9) AS baseline_miou FROM m GROUP BY ALL")
def selector_actions(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).groupBy("l_returnflag", "selector_exclusion", "selector_action").agg(F.count(F.lit(1)).alias("n"), F.avg("baseline_iou").alias("baseline_miou")))


@query(
    _BOXES
    + """
, t AS (SELECT CASE WHEN bs IS NULL THEN 'false_rejection' WHEN b_iou = 0.0 THEN 'valid_zero' ELSE 'overlap' END AS x,
        CASE WHEN c_iou = 0.0 THEN 'valid_zero' ELSE 'overlap' END AS y FROM m)
SELECT CASE WHEN x = 'valid_zero' AND y = 'overlap' THEN 'recovered_zero' WHEN x = 'overlap' AND y = 'valid_zero' THEN 'regressed_zero'
  WHEN x = 'valid_zero' AND y = 'valid_zero' THEN 'persistent_zero' WHEN x = 'overlap' AND y = 'overlap' THEN 'stable_overlap'
  ELSE x || '_to_' || y END AS transition, count(*) AS n FROM t GROUP BY ALL
"""
)
def transitions(spark, sf_dir):
    r = labelled(spark, sf_dir)
    before = decisions.box_state(F.col("baseline").isNotNull(), F.col("baseline_iou"))
    after = decisions.box_state(F.lit(True), F.col("challenger_iou"))
    return r.select(decisions.transition(before, after).alias("transition")).groupBy("transition").agg(F.count(F.lit(1)).alias("n"))


_SWEEP = (
    _BOXES
    + """
, d AS (SELECT l_returnflag, score AS t, sum(CASE WHEN eligible THEN c_iou - b_iou ELSE 0 END) AS gain,
        count(*) FILTER (eligible AND b_iou > 1e-12 AND c_iou <= 1e-12) AS lost, count(*) FILTER (eligible) AS moved FROM m GROUP BY ALL),
e AS (SELECT * FROM d UNION ALL SELECT l_returnflag, min(t) - 1e-9, 0, 0, 0 FROM d GROUP BY 1
      UNION ALL SELECT DISTINCT l_returnflag, CAST('inf' AS DOUBLE), 0, 0, 0 FROM d),
w AS (SELECT l_returnflag, t, coalesce(sum(gain) OVER p, 0) AS gain, coalesce(sum(lost) OVER p, 0) AS lost, coalesce(sum(moved) OVER p, 0) AS moved
      FROM e WINDOW p AS (PARTITION BY l_returnflag ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
)


@query(_SWEEP + "SELECT l_returnflag, round(t, 9) AS threshold, round(gain, 6) AS gain, CAST(lost AS BIGINT) AS lost, CAST(moved AS BIGINT) AS moved FROM w")
def threshold_sweep(spark, sf_dir):
    out = metrics.threshold_sweep(labelled(spark, sf_dir), "score", ("l_returnflag",))
    return out.select("l_returnflag", F.round("threshold", 9).alias("threshold"), F.round("gain", 6).alias("gain"), "lost", "moved")


@query(
    _SWEEP
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY gain DESC, lost, moved, t DESC) AS k FROM w WHERE lost <= 40)
SELECT l_returnflag, round(t, 9) AS threshold, round(gain, 6) AS gain, CAST(lost AS BIGINT) AS lost, CAST(moved AS BIGINT) AS moved FROM r WHERE k = 1"""
)
def safe_threshold(spark, sf_dir):
    out = metrics.safe_threshold(labelled(spark, sf_dir), "score", 40, ("l_returnflag",))
    return out.select("l_returnflag", F.round("threshold", 9).alias("threshold"), F.round("gain", 6).alias("gain"), "lost", "moved")


@query(
    """WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('seed:' || c_custkey), c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= greatest(1, least(round_even(n * 0.05, 0), n - 1)) THEN 'calibration' ELSE 'train' END AS data_split FROM h"""
)
def hash_split(spark, sf_dir):
    return hashing.exact_split(table(spark, sf_dir, "customer"), "c_custkey", 0.05, "seed")


@query("SELECT o_orderkey, CAST(CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS UBIGINT) % 8 AS INT) AS shard, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2)) AS INT) % 2 = 1 AS swap FROM orders")
def hash_shards(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.shard_of(k, 8).alias("shard"), hashing.swap_bit(k).alias("swap"))


@query(
    """WITH r AS (SELECT DISTINCT c_mktsegment FROM customer), k AS (SELECT *, row_number() OVER (ORDER BY c_mktsegment) AS i, count(*) OVER () AS n FROM r)
SELECT c_mktsegment, CAST(1003 // n + CASE WHEN i <= 1003 % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k"""
)
def source_quotas(spark, sf_dir):
    return hashing.quotas(table(spark, sf_dir, "customer").select("c_mktsegment").distinct(), 1003, "c_mktsegment")


_EVENTS = "WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events)"


def day_events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


@query(_EVENTS + " SELECT user_id, day, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def log_latest_then_filter(spark, sf_dir):
    return logs.latest_then(day_events(spark, sf_dir), ["user_id", "day"], "event_id", F.col("event_type") != "error").select("user_id", "day", "event_id", "event_type")


@query(_EVENTS + " SELECT user_id, day, event_id, event_type FROM e WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) = 1")
def log_filter_then_latest(spark, sf_dir):
    return logs.then_latest(day_events(spark, sf_dir), ["user_id", "day"], "event_id", F.col("event_type") != "error").select("user_id", "day", "event_id", "event_type")


@query(
    _EVENTS
    + """ SELECT user_id, day, event_id, event_type <> 'error' AS succeeded FROM e
QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_type <> 'error' DESC, event_id DESC) = 1"""
)
def log_success_precedence(spark, sf_dir):
    return logs.success_and_residue(day_events(spark, sf_dir), ["user_id", "day"], "event_id", F.col("event_type") != "error").select("user_id", "day", "event_id", "succeeded")


@query(
    _EVENTS
    + """, r AS (SELECT *, event_id % 3 AS reviewer, min(event_id) OVER (PARTITION BY user_id, day, event_id % 3) AS began FROM e),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, day, reviewer ORDER BY event_id DESC) = 1)
SELECT user_id, day, reviewer, event_id FROM l WHERE event_type IN ('purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY began DESC) = 1"""
)
def log_review_winner(spark, sf_dir):
    e = day_events(spark, sf_dir).withColumn("reviewer", F.col("event_id") % 3)
    return logs.review_winner(e, ["user_id", "day"], "reviewer", "event_id", F.col("event_type").isin("purchase", "signup")).select("user_id", "day", "reviewer", "event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error' AND user_id IS NOT NULL)")
def pending_work(spark, sf_dir):
    done = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    return logs.pending(table(spark, sf_dir, "customer"), done, ["c_custkey"], F.col("event_type") != "error").select("c_custkey")


@query(
    """WITH a AS (SELECT user_id AS k, count(*) AS tries, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1),
b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT count(*) AS expected, count(tries) AS attempted, count(*) FILTER (tries IS NULL) AS missing, CAST(coalesce(sum(tries - 1), 0) AS BIGINT) AS extra_attempts,
  count(*) FILTER (tries = failures) AS never_succeeded, count(*) FILTER (tries IS NULL) = 0 AND count(*) FILTER (tries = failures) = 0 AS complete
FROM b LEFT JOIN a USING (k)"""
)
def attempt_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    return metrics.coverage(table(spark, sf_dir, "customer"), e, ["c_custkey"], F.col("event_type") == "error")


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95,
  round(greatest(stddev_pop(value), 1e-6), 6) AS spread FROM events GROUP BY 1"""
)
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.greatest(F.stddev_pop("value"), F.lit(1e-6)), 6).alias("spread"))
    found = metrics.exact_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    out = out.join(found.select("event_type", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95")), "event_type", "left")
    return out


_RATES = """
WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn,
  count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn
  FROM labels JOIN documents USING (doc_id) GROUP BY 1),
p AS (SELECT *, fp / nullif(fp + tn, 0) AS r, CAST(nullif(fp + tn, 0) AS DOUBLE) AS m FROM c)
SELECT lang, tp, fn, fp, tn, round((tp + tn) / (tp + fn + fp + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(r, 9) AS false_rate,
  CASE WHEN m > 0 THEN round(greatest(0.0, (r + 3.8416 / (2 * m) - 1.96 * sqrt((r * (1 - r) + 3.8416 / (4 * m)) / m)) / (1 + 3.8416 / m)), 9) END AS false_rate_low,
  CASE WHEN m > 0 THEN round(least(1.0, (r + 3.8416 / (2 * m) + 1.96 * sqrt((r * (1 - r) + 3.8416 / (4 * m)) / m)) / (1 + 3.8416 / m)), 9) END AS false_rate_high
FROM p
"""


@query(_RATES)
def confusion_by_stratum(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(metrics.confusion(joined, F.col("quality") == 1, F.col("toxic") == 1, ("lang",)))


@query(
    """WITH k AS (SELECT 'customer' AS split, c_custkey AS id, c_nationkey AS grp FROM customer UNION ALL SELECT 'orders', o_custkey, NULL FROM orders
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier)
SELECT split, count(*) AS records, count(DISTINCT id) AS distinct_id, count(DISTINCT grp) AS distinct_grp FROM k GROUP BY 1"""
)
def split_identity(spark, sf_dir):
    return isolation.identity(split_rows(spark, sf_dir), "split", ["id", "grp"])


def split_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("split"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"))
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("split"), F.col("o_custkey").alias("id"), F.lit(None).cast("int").alias("grp"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("split"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("grp"))
    return c.union(o).union(s)


@query(
    """WITH k AS (SELECT 'customer' AS split, c_custkey AS id, c_nationkey AS grp FROM customer UNION ALL SELECT 'orders', o_custkey, NULL FROM orders
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier),
v AS (SELECT DISTINCT 'id' AS key, split, CAST(id AS VARCHAR) AS v FROM k WHERE id IS NOT NULL UNION ALL SELECT DISTINCT 'grp', split, CAST(grp AS VARCHAR) FROM k WHERE grp IS NOT NULL)
SELECT a.key AS key, a.split AS left_split, b.split AS right_split, count(*) AS shared, array_to_string(list_slice(list_sort(list(a.v)), 1, 10), ',') AS examples
FROM v a JOIN v b ON a.key = b.key AND a.v = b.v AND a.split < b.split GROUP BY ALL"""
)
def split_overlaps(spark, sf_dir):
    out = isolation.overlaps(split_rows(spark, sf_dir), "split", ["id", "grp"])
    return out.withColumn("examples", F.array_join("examples", ","))


@query(
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both
FROM a FULL OUTER JOIN b ON a.k = b.k"""
)
def key_equality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return isolation.same_keys(table(spark, sf_dir, "customer"), o, ["c_custkey"])


@query(
    """SELECT n_name, count(*) AS lines, count(*) FILTER (o_orderkey IS NULL) AS missing_order, count(*) FILTER (c_custkey IS NULL) AS missing_customer
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def checked_enrichment(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = joins.enriched(t("lineitem").select("l_orderkey"), t("orders").select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey", "order")
    out = joins.enriched(out, t("customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey", "customer")
    out = joins.enriched(out, t("nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey", "nation")
    has = lambda v: F.count(F.when(F.array_contains("violations", v), 1))
    return out.groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"), has("missing_order").alias("missing_order"), has("missing_customer").alias("missing_customer"))


def placed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes in an image of 980 by 900, one image a supplier and category a flag; line 6 is a crowd, line 7 has no box."""
    key = ["l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"]
    # dealt by image and category at once, so that work by them needs no other shuffle
    li = table(spark, sf_dir, "lineitem").repartition("l_suppkey", "l_returnflag").groupBy(*key).agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_tax", "l_discount")])
    x, y = (F.col("l_partkey") % 97 * 10).cast("double"), (F.col("l_orderkey") % 89 * 10).cast("double")
    box = F.array(x, y, x + 5 + F.col("l_quantity") / 2, y + 5 + 100 * F.col("l_tax") + 200 * F.col("l_discount"))
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    return li.select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("category"), line.alias("line"), "l_linenumber", F.when(F.col("l_linenumber") != 7, box).alias("box"))


_PLACED = """
WITH b AS (
  SELECT l_suppkey AS image, l_returnflag AS category, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS line, l_linenumber, CAST(l_partkey % 97 * 10 AS DOUBLE) AS x1, CAST(l_orderkey % 89 * 10 AS DOUBLE) AS y1,
    CAST(l_partkey % 97 * 10 AS DOUBLE) + 5 + l_quantity / 2 AS x2, CAST(l_orderkey % 89 * 10 AS DOUBLE) + 5 + 100 * l_tax + 200 * l_discount AS y2
  FROM (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL) WHERE l_linenumber <> 7
)
"""


@query(
    _PLACED
    + """, p AS (
  SELECT t.image, t.category, t.line AS target, o.line AS other, greatest(least(t.x2, o.x2) - greatest(t.x1, o.x1), 0.0) * greatest(least(t.y2, o.y2) - greatest(t.y1, o.y1), 0.0) AS shared,
    (t.x2 - t.x1) * (t.y2 - t.y1) AS ta, (o.x2 - o.x1) * (o.y2 - o.y1) AS oa, sqrt(pow((t.x1 + t.x2 - o.x1 - o.x2) / 2, 2) + pow((t.y1 + t.y2 - o.y1 - o.y2) / 2, 2)) AS away
  FROM b t JOIN b o USING (image, category) WHERE t.line <> o.line AND o.l_linenumber <> 6
), h AS (
  SELECT image, category, target, other, shared / (ta + oa - shared) AS iou, round(0.6 * exp(-abs(ln(oa / ta))) + 0.4 * greatest(0.0, 1 - away / sqrt(980.0 * 980 + 900 * 900)), 9) AS hardness FROM p
)
SELECT image, category, target, other, round(iou, 9) AS iou, hardness, CAST(row_number() OVER (PARTITION BY image, category, target ORDER BY hardness DESC, other) AS INT) AS rank, count(*) OVER (PARTITION BY image, category, target) AS available
FROM h WHERE iou < 0.3 QUALIFY rank <= 5"""
)
def top_competitors(spark, sf_dir):
    """The five hardest other boxes of a box's image and category, crowds and overlaps of 0.3 left out."""
    found = boxes.competitors(placed_boxes(spark, sf_dir), ["image", "category"], "line", "box", 980, 900, 5, 0.3, F.col("l_linenumber") == 6)
    return rounded(found)


@query(
    _PLACED
    + """, p AS (
  SELECT image, t.line, o.line AS other, greatest(least(t.x2, o.x2) - greatest(t.x1, o.x1), 0.0) * greatest(least(t.y2, o.y2) - greatest(t.y1, o.y1), 0.0) AS shared,
    (t.x2 - t.x1) * (t.y2 - t.y1) AS ta, (o.x2 - o.x1) * (o.y2 - o.y1) AS oa
  FROM b t JOIN b o USING (image) WHERE t.l_linenumber % 2 = 1 AND o.l_linenumber % 2 = 0
), u AS (SELECT image, line, other, shared / (ta + oa - shared) AS iou FROM p WHERE shared > 0)
SELECT line, other, round(iou, 9) AS iou FROM u QUALIFY row_number() OVER (PARTITION BY image, line ORDER BY iou DESC, other) = 1"""
)
def best_annotations(spark, sf_dir):
    """For each box of an odd line the box of an even line of its image that it overlaps most."""
    b = placed_boxes(spark, sf_dir)
    odd = F.col("l_linenumber") % 2 == 1
    others = b.where(~odd).select("image", F.col("line").alias("other"), F.col("box").alias("other_box"))
    return rounded(boxes.best_match(b.where(odd).select("image", "line", "box"), others, ["image"], "line", "box", "other", "other_box"))


@query(
    _PLACED
    + """SELECT image, count(*) AS pairs, round(sum(shared / (ta + oa - shared)), 6) AS total FROM (
  SELECT t.image, greatest(least(t.x2, o.x2) - greatest(t.x1, o.x1), 0.0) * greatest(least(t.y2, o.y2) - greatest(t.y1, o.y1), 0.0) AS shared, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta, (o.x2 - o.x1) * (o.y2 - o.y1) AS oa
  FROM b t JOIN b o USING (image) WHERE t.category = 'R' AND o.category = 'A') WHERE shared > 0 GROUP BY 1"""
)
def overlapping_boxes(spark, sf_dir):
    """Pairs of boxes of two categories that share an area, and the sum of their overlaps, by image."""
    b = placed_boxes(spark, sf_dir)
    side = lambda flag, name: b.where(F.col("category") == flag).select("image", F.col("box").alias(name))
    pairs = boxes.overlapping(side("R", "p"), side("A", "q"), ["image"], "p", "q")
    return pairs.groupBy("image").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("iou"), 6).alias("total"))


@query(
    """WITH t AS (SELECT CAST(epoch_us(o_orderdate::TIMESTAMP) AS BIGINT) * 1000 + o_orderkey AS place, o_totalprice, o_orderstatus FROM orders)
SELECT o_orderstatus, count(*) AS n, round(quantile_cont(place, 0.5), 0) AS middle, round(quantile_cont(o_totalprice, 0.01), 9) AS low_price, round(quantile_cont(o_totalprice, 0.999), 9) AS high_price FROM t GROUP BY 1"""
)
def wide_percentiles(spark, sf_dir):
    """Percentiles of large whole numbers that differ in their last digits only, and of prices."""
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderstatus", "o_totalprice", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_orderkey")).alias("place"))
    middle = metrics.exact_percentiles(o, ["o_orderstatus"], "place", {"middle": 0.5}).withColumn("middle", F.round("middle", 0))
    prices = metrics.exact_percentiles(o, ["o_orderstatus"], "o_totalprice", {"low_price": 0.01, "high_price": 0.999})
    return rounded(o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).join(middle, "o_orderstatus").join(prices, "o_orderstatus"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS others FROM part")
def distractor_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", joins.group_size_without_self(["p_brand", "p_size"]).alias("others"))


@query(
    """WITH c AS (SELECT role, turn, count(*) AS n FROM conversations GROUP BY ALL)
SELECT turn, coalesce(max(n) FILTER (role = 'user'), 0) AS "user", coalesce(max(n) FILTER (role = 'assistant'), 0) AS assistant, coalesce(max(n) FILTER (role = 'system'), 0) AS system FROM c GROUP BY 1"""
)
def role_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("turn").pivot("role", ["user", "assistant", "system"]).count().na.fill(0)


@query(
    """WITH n AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT count(*) AS n, count(DISTINCT t) AS distinct_texts, count(*) - count(DISTINCT t) AS duplicates FROM n"""
)
def semantic_duplicates(spark, sf_dir):
    # digests of 32 bytes are shuffled, not texts
    t = table(spark, sf_dir, "documents").select(F.sha2(text.normalised(F.col("text")), 256).alias("t"))
    counts = t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("distinct_texts"))
    return counts.withColumn("duplicates", F.col("n") - F.col("distinct_texts"))


@query(
    """SELECT page_id, CASE WHEN lower(regexp_extract(url, '(https|http)', 1)) = 'https' THEN true WHEN lower(regexp_extract(url, '(https|http)', 1)) = 'http' THEN false END AS secure,
  split_part(split_part(url, '://', 2), '/', 1) AS host, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages"""
)
def url_text_functions(spark, sf_dir):
    scheme = F.regexp_extract("url", "(https|http)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(scheme == "https", True).when(scheme == "http", False).alias("secure"),
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"),
        text.slug(F.col("url")).alias("slug"),
    )


@query("SELECT p_brand, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1")
def having_count(spark, sf_dir):
    out = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return out.groupBy("p_brand").agg(F.sum("n").alias("n"))


@query()
def suppressed_boxes(spark, sf_dir):
    """Boxes of each order after greedy suppression, largest quantity first."""
    r = box_rows(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("gt"), asc=False).alias("boxes"))
    return r.select("l_orderkey", F.size("boxes").alias("boxes"), F.size(g.suppressed(F.col("boxes"))).alias("kept"))


@query("SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def closed_groups(spark, sf_dir):
    """All lines of an order that has a returned one."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return joins.closed_groups(r, ["l_orderkey"], F.col("l_returnflag") == "R")


@query(
    """SELECT user_id, event_id, event_type, min(event_type) OVER (PARTITION BY user_id) <> max(event_type) OVER (PARTITION BY user_id) AS conflict
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"""
)
def first_row_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return logs.first_unless_conflict(e, ["user_id"], "event_id", "event_type")


@query(
    """WITH p AS (SELECT c_custkey, s_suppkey, 1 / (1 + abs(c_acctbal - s_acctbal)) AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT c_custkey, s_suppkey, round(score, 9) AS score FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) = 1"""
)
def nearest_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    near = joins.nearest_value(c, s, ["nation"], "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal")
    return rounded(near.select("c_custkey", "s_suppkey", (1 / (1 + F.col("distance"))).alias("score")))


@query(
    """WITH r AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT round(avg(k / n), 9) AS macro, round(sum(k) / sum(n), 9) AS pooled, count(*) AS types FROM r"""
)
def macro_and_pooled_rates(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(metrics.typed_rates(joined, "lang", F.col("toxic") == 1))


@query(
    """WITH d AS (SELECT event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1)
SELECT event_type, n FROM d ORDER BY n DESC, seen LIMIT 3"""
)
def most_common_events(spark, sf_dir):
    return metrics.most_common(table(spark, sf_dir, "events"), "event_type", "event_id", 3)


@query(
    """WITH e AS (SELECT unnest(['purchase', 'signup', 'refund']) AS event_type), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (event_type)"""
)
def enumerated_counts(spark, sf_dir):
    return metrics.enumerated(table(spark, sf_dir, "events"), "event_type", ["purchase", "signup", "refund"])


@query(
    _BOXES
    + """
, f AS (SELECT l_returnflag AS u, count(*) AS n, sum(b_iou) AS base, greatest(sum(b_iou), sum(kept)) AS strong, sum(oracle) AS best,
        count(*) FILTER (eligible AND b_iou > 1e-12 AND c_iou <= 1e-12) // 2 AS allowed FROM m GROUP BY 1),
t AS (SELECT DISTINCT score AS t FROM m UNION ALL SELECT min(score) - 1e-9 FROM m UNION ALL SELECT CAST('inf' AS DOUBLE)),
a AS (SELECT t, u, n, base, strong, best, allowed, sum(CASE WHEN eligible THEN c_iou - b_iou ELSE 0 END) AS gain,
        count(*) FILTER (eligible AND b_iou > 1e-12 AND c_iou <= 1e-12) AS lost, count(*) FILTER (eligible) AS moved
      FROM t CROSS JOIN f LEFT JOIN m ON m.l_returnflag = u AND m.score > t GROUP BY ALL),
j AS (SELECT t, avg((base + coalesce(gain, 0) - strong) / (best - strong)) AS c, sum((base + coalesce(gain, 0)) / n) AS s, sum(lost) AS lost, sum(moved) AS moved
      FROM a GROUP BY 1 HAVING bool_and(lost <= allowed))
SELECT round(t, 9) AS threshold, round(c, 6) AS mean_capture, round(s, 6) AS selector_miou_sum, CAST(lost AS BIGINT) AS lost, CAST(moved AS BIGINT) AS moved
FROM j ORDER BY c DESC, s DESC, lost, moved, t LIMIT 1"""
)
def joint_threshold(spark, sf_dir):
    out = metrics.joint_threshold(labelled(spark, sf_dir), "score", "l_returnflag")
    return out.select(F.round("threshold", 9).alias("threshold"), F.round("mean_capture", 6).alias("mean_capture"), F.round("selector_miou_sum", 6).alias("selector_miou_sum"), "lost", "moved")


@query(
    _BOXES
    + """
, v AS (SELECT l_orderkey, l_linenumber, score / 0.5 AS x, l_tax / 0.02 AS y FROM m)
SELECT 'action' AS variant, round(avg(x), 9) AS mean, round(max(x), 9) AS top FROM v UNION ALL SELECT 'quality', round(avg(y), 9), round(max(y), 9) FROM v
UNION ALL SELECT 'even', round(avg(0.5 * x + 0.5 * y), 9), round(max(0.5 * x + 0.5 * y), 9) FROM v"""
)
def blended_scores(spark, sf_dir):
    r = box_rows(spark, sf_dir).select(F.col("score").alias("action"), F.col("l_tax").alias("quality"))
    out = metrics.blended(r, {"action": 0.5, "quality": 0.02}, {"action": {"action": 1.0}, "quality": {"quality": 1.0}, "even": {"action": 0.5, "quality": 0.5}})
    return rounded(out.groupBy("variant").agg(F.avg("score").alias("mean"), F.max("score").alias("top")))
