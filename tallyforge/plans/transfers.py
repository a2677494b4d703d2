"""Registered queries of outside calls, files in members, logs that are followed, and resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, decisions, metrics, resampling
from ..sources import files, lineage, members, records
from ..streaming import state
from .catalog import _BOXES, box_rows, labelled, query, rounded, table
from .stores import folder

_MODULUS = {"first": 5, "second": 25}


def _judge(turn: str):
    """A stand-in for an outside service, which refuses the keys of one modulus."""
    modulus = _MODULUS[turn]

    def call(rows: list[dict]) -> list:
        return [ValueError(f"refused {r['o_orderkey']}") if r["o_orderkey"] % modulus == 0 else {"choice": "ab"[r["o_orderkey"] % 2], "run": turn} for r in rows]

    return call


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 25 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END END AS choice, CASE WHEN o_orderkey % 25 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'second' ELSE 'first' END END AS run,
  CASE WHEN o_orderkey % 25 = 0 THEN 'ValueError: refused ' || o_orderkey END AS error, CASE WHEN o_orderkey % 25 = 0 THEN 2 ELSE 1 END AS attempts FROM orders"""
)
def answered_requests(spark, sf_dir):
    """Each order is asked about until it has an answer: one row with a result or its last error; answers are not asked for again."""
    log, asked = folder(spark, "answers"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    again = {"result": "struct<choice:string,run:string>", "attempts": 2, "first_wait": 0.0}
    calls.answer_pending(asked, ["o_orderkey"], log, _judge("first"), rounds=2, **again)
    out = calls.answer_pending(asked, ["o_orderkey"], log, _judge("second"), **again)
    return out.select("o_orderkey", "result.choice", F.col("result.run"), "error", "attempts")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS line, o_orderkey, o_orderpriority, TRUE AS same_bytes FROM orders")
def gzip_members(spark, sf_dir):
    """Orders as one gzip file, written twice from other partitions with equal bytes, read by members with line numbers."""
    o, place = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), folder(spark, "members")
    spark.createDataFrame([], "x int").write.json(place)  # the folder, by whatever file system it is on
    paths = [f"{place}/{n}.jsonl.gz" for n in (3, 11)]
    for n, path in zip((3, 11), paths):
        members.write_gzip_file(o.repartition(n), path, ["o_orderkey"], f"{place}/scratch-{n}", lines=1000)
    digests = files.digests(spark, f"{place}/*.gz").agg((F.count_distinct("sha256") == 1).alias("same_bytes"))
    lines = members.read_gzip_file(spark, paths[1])
    rows = lines.select("line", F.from_json("value", "o_orderkey bigint, o_orderpriority string").alias("r")).select("line", "r.*")
    return rows.join(F.broadcast(digests))  # one row


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 50 = 0 THEN 'expected a JSON object' END AS error FROM orders WHERE o_orderkey % 9 <> 1")
def records_in_one_pass(spark, sf_dir):
    """Lines of several files, blank ones among them, with their error where they hold no object."""
    path, k = folder(spark, "records"), F.col("o_orderkey")
    line = F.when(k % 9 == 1, " ").when(k % 50 == 0, F.to_json(F.array(k))).otherwise(F.to_json(F.struct("o_orderkey", "o_orderpriority")))
    table(spark, sf_dir, "orders").repartition(3, "o_orderkey").select(line.alias("value")).write.text(path)
    raw = records.read_raw_records(spark, f"{members.local(path)}/*.txt", range_bytes=100_000)
    found = raw.select("file", "place", F.regexp_extract("error", ": (expected .*)$", 1).alias("said"), F.from_json("value", "o_orderkey bigint, o_orderpriority string").alias("r"))
    # a broken line is known by its place; the keys that it held come from the lines themselves
    lines = spark.read.text(path).select(F.from_json("value", "array<bigint>")[0].alias("broken")).where("broken is not null")
    bad = found.where("r is null").agg(F.count(F.lit(1)).alias("n"), F.min("said").alias("said"))
    broken = lines.join(F.broadcast(bad.where(F.col("n") == lines.count()))).select(F.col("broken").alias("o_orderkey"), F.lit(None).cast("string").alias("o_orderpriority"), F.col("said").alias("error"))
    return found.where("r is not null").select("r.o_orderkey", "r.o_orderpriority", F.lit(None).cast("string").alias("error")).union(broken)


@query(
    """WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', event_id DESC) AS s FROM events)
SELECT user_id, max(CASE WHEN k = 1 THEN event_type END) AS latest, max(CASE WHEN k = 1 THEN event_id END) AS event_id, max(CASE WHEN s = 1 THEN event_id END) AS success FROM l GROUP BY 1"""
)
def followed_log(spark, sf_dir):
    """Events as files of a log that arrive out of order, taken in by two runs: each user's last row, and last row that is no error."""
    path, e = folder(spark, "followed"), table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    schema, late = "user_id bigint, event_id bigint, event_type string", F.col("event_id") % 3 == 0
    rules = {
        "latest": lambda s: state.greatest(s, ["user_id"], ["event_id"]),
        "success": lambda s: state.greatest(s.withColumn("ok", (F.col("event_type") != "error").cast("int")), ["user_id"], ["ok", "event_id"]),
    }
    for part in (~late, late):  # the second files hold earlier rows
        files.append_json_lines(e.where(part).repartition(3, "event_id"), f"{path}/files")
        found = {name: state.followed(spark, f"{path}/files", schema, rule, ["user_id"], f"{path}/{name}", f"{path}/{name}-checkpoint") for name, rule in rules.items()}
    success = found["success"].select("user_id", F.col("event_id").alias("success"))
    return found["latest"].select("user_id", F.col("event_type").alias("latest"), "event_id").join(success, "user_id")


@query("SELECT l_returnflag, count(*) OVER () * 0 + (SELECT count(*) FROM lineitem) AS draws, TRUE AS near FROM lineitem GROUP BY l_returnflag")
def weighted_sample(spark, sf_dir):
    """As many weighted draws with replacement as there are lines; the share of each flag is within five standard deviations."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_returnflag").alias("l_returnflag"), F.count(F.lit(1)).alias("rows"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    weight = F.when(F.col("l_returnflag") == "A", 3.0).when(F.col("l_returnflag") == "R", 1.0).otherwise(0.5) * F.col("rows")
    r = r.select(key.alias("line"), "l_returnflag", "rows", weight.alias("w"))
    size = r.agg(F.sum("rows")).first()[0]
    drawn = resampling.weighted_draws(r, "line", F.col("w"), size, 42).groupBy("l_returnflag").agg(F.sum("times").alias("times"))
    shares = r.groupBy("l_returnflag").agg(F.sum("w").alias("w")).join(drawn, "l_returnflag", "left")
    total = shares.agg(F.sum("w").alias("all"), F.sum("times").alias("draws"))
    out = shares.join(F.broadcast(total)).withColumn("p", F.col("w") / F.col("all"))  # one row
    away = F.abs(F.coalesce("times", F.lit(0)) - F.col("draws") * F.col("p"))
    return out.select("l_returnflag", "draws", (away <= 5 * F.sqrt(F.col("draws") * F.col("p") * (1 - F.col("p")))).alias("near"))


@query()
def resampled_scores(spark, sf_dir):
    """Mean overlap of each flag with its bootstrap interval of 200 replicates, in order of the line."""
    r = labelled(spark, sf_dir).select("l_returnflag", "baseline_iou", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_partkey")
    one = r.groupBy("l_returnflag", "line").agg(F.min_by("baseline_iou", "l_partkey").alias("iou"))
    return rounded(resampling.bootstrap(one, ["l_returnflag"], "line", {"x": F.col("iou")}, F.col("x") / F.col("n"), 200))


_EXCLUDED = """, x AS (SELECT *, l_orderkey % 11 = 0 AS failed, l_partkey % 7 <> 0 AS b_ok, l_suppkey % 5 <> 0 AS c_ok FROM u),
y AS (SELECT *, CASE WHEN failed THEN 'inference_error' WHEN NOT b_ok THEN 'baseline_parse_invalid' WHEN bs IS NULL THEN 'baseline_null_locked_stage1' WHEN NOT c_ok THEN 'challenger_parse_invalid' END AS exclusion,
  CASE WHEN NOT b_ok OR bs IS NULL THEN 'baseline_parse_invalid' WHEN NOT c_ok THEN 'challenger_parse_invalid' END AS plain FROM x)
"""


@query(
    _BOXES
    + _EXCLUDED
    + """SELECT exclusion, plain, CASE WHEN exclusion IS NULL THEN CASE WHEN c_iou - b_iou >= 0.05 THEN 'switch' ELSE 'keep' END END AS action,
  count(*) AS n, round(avg(CASE WHEN exclusion IS NULL THEN greatest(b_iou, c_iou) ELSE b_iou END), 9) AS oracle, round(avg(CASE WHEN plain IS NULL THEN greatest(b_iou, c_iou) ELSE b_iou END), 9) AS plain_oracle FROM y GROUP BY ALL"""
)
def exclusion_reasons(spark, sf_dir):
    """All four reasons in their order, beside the rule without errors, by which a missing box counts as unparsed."""
    b_ok, c_ok = F.col("l_partkey") % 7 != 0, F.col("l_suppkey") % 5 != 0
    rows = box_rows(spark, sf_dir)
    full = decisions.selector_columns(rows, "gt", "baseline", "challenger", error=F.col("l_orderkey") % 11 == 0, baseline_parsed=b_ok, challenger_parsed=c_ok)
    full = full.withColumnsRenamed({"selector_exclusion": "exclusion", "selector_action": "action", "two_box_oracle_iou": "oracle"}).drop("selector_eligible", "baseline_iou", "challenger_iou")
    plain = decisions.selector_columns(full, "gt", "baseline", "challenger", baseline_parsed=b_ok & F.col("baseline").isNotNull(), challenger_parsed=c_ok)
    out = plain.groupBy("exclusion", F.col("selector_exclusion").alias("plain"), "action")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg("oracle").alias("oracle"), F.avg("two_box_oracle_iou").alias("plain_oracle")))


_UNSCORED = ", v AS (SELECT *, CASE WHEN l_orderkey % 3 <> 0 THEN score END AS s FROM s), p AS (SELECT unnest(['baseline', 'challenger']) AS policy)"


@query(
    _BOXES.replace(", m AS (SELECT *, CASE WHEN switched THEN c_iou ELSE b_iou END AS s_iou FROM s)", "")
    + _UNSCORED
    + """, w AS (SELECT *, eligible AND CASE WHEN s IS NULL THEN policy = 'challenger' ELSE s > 0.1 END AS moved FROM v CROSS JOIN p)
SELECT policy, l_returnflag, count(*) AS n, count(*) FILTER (eligible AND s IS NOT NULL) AS scored_eligible, count(*) FILTER (moved) AS switches,
  round(avg(CASE WHEN moved THEN c_iou ELSE b_iou END), 9) AS selector_miou, count(*) FILTER (b_iou > 1e-12 AND moved AND c_iou <= 1e-12) AS regressions,
  round(avg(CASE WHEN eligible AND s IS NOT NULL THEN CAST((action = 'switch') = moved AS INT) END), 9) AS action_accuracy FROM w GROUP BY ALL"""
)
def unscored_rows(spark, sf_dir):
    """A third of the rows have no score: they keep the baseline or take the challenger, by policy."""
    rows = labelled(spark, sf_dir).withColumn("score", F.when(F.col("l_orderkey") % 3 != 0, F.col("score")))
    out = None
    for policy in ("baseline", "challenger"):
        m = metrics.selector_metrics(rows, "score", 0.1, policy, ("l_returnflag",))
        m = m.select(F.lit(policy).alias("policy"), "l_returnflag", "n", "scored_eligible", "switches", "selector_miou", "regressions", "action_accuracy")
        out = m if out is None else out.union(m)
    return rounded(out)


_BUDGETS = {"A": 40, "N": 25, "R": 0}


@query(
    _BOXES.replace(", m AS (SELECT *, CASE WHEN switched THEN c_iou ELSE b_iou END AS s_iou FROM s)", "")
    + """, v AS (SELECT *, CASE WHEN l_orderkey % 3 <> 0 THEN score END AS x FROM s),
f AS (SELECT l_returnflag AS u, count(*) AS n, sum(b_iou) AS base, greatest(sum(b_iou), sum(kept)) AS strong, sum(oracle) AS best, CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 25 ELSE 0 END AS allowed FROM v GROUP BY 1),
t AS (SELECT DISTINCT x AS t FROM v WHERE x IS NOT NULL UNION ALL SELECT min(x) - 1e-9 FROM v UNION ALL SELECT CAST('inf' AS DOUBLE)),
a AS (SELECT t, u, n, base, strong, best, allowed, sum(CASE WHEN eligible THEN c_iou - b_iou ELSE 0 END) AS gain,
        count(*) FILTER (eligible AND b_iou > 1e-12 AND c_iou <= 1e-12) AS lost, count(*) FILTER (eligible) AS moved FROM t CROSS JOIN f LEFT JOIN v ON v.l_returnflag = u AND v.x > t GROUP BY ALL),
j AS (SELECT t, avg((base + coalesce(gain, 0) - strong) / (best - strong)) AS c, sum((base + coalesce(gain, 0)) / n) AS s, sum(lost) AS lost, sum(moved) AS moved FROM a GROUP BY 1 HAVING bool_and(lost <= allowed))
SELECT round(t, 9) AS threshold, round(c, 6) AS mean_capture, round(s, 6) AS selector_miou_sum, CAST(lost AS BIGINT) AS lost, CAST(moved AS BIGINT) AS moved FROM j ORDER BY c DESC, s DESC, lost, moved, t LIMIT 1"""
)
def budgeted_threshold(spark, sf_dir):
    """One threshold for three suites, each with its own budget of regressions; rows without a score keep the baseline."""
    rows = labelled(spark, sf_dir).withColumn("score", F.when(F.col("l_orderkey") % 3 != 0, F.col("score")))
    out = metrics.joint_threshold(rows, "score", "l_returnflag", _BUDGETS)
    return out.select(F.round("threshold", 9).alias("threshold"), F.round("mean_capture", 6).alias("mean_capture"), F.round("selector_miou_sum", 6).alias("selector_miou_sum"), "lost", "moved")


@query(
    """SELECT o_orderstatus, count(*) AS orders, (SELECT count(*) FROM orders) AS read_rows, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS kept_rows, TRUE AS refused, TRUE AS chained
FROM orders WHERE o_totalprice > 1000 GROUP BY 1"""
)
def lineage_documents(spark, sf_dir):
    """Two tables derived in turn, whose documents hold what was counted while they were written; a changed input is refused."""
    path, source = folder(spark, "lineage"), f"{sf_dir}/orders.parquet"
    first = lineage.derive(spark, {"orders": source}, lambda t: t["orders"].where("o_totalprice > 1000"), f"{path}/dear", {"total": F.sum("o_totalprice")})
    second = lineage.derive(spark, {"dear": f"{path}/dear"}, lambda t: t["dear"].groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")), f"{path}/counts")
    chained = lineage.check_chain(spark, f"{path}/counts") == [] and second["inputs"]["dear"]["rows"] == first["rows"]
    spark.read.parquet(f"{path}/dear").limit(1).write.mode("append").parquet(f"{path}/dear")
    try:
        lineage.derive(spark, {"dear": f"{path}/dear"}, lambda t: t["dear"], f"{path}/again")
        refused = False
    except ValueError:
        refused = True
    facts = {"read_rows": first["inputs"]["orders"]["rows"], "kept_rows": first["rows"], "refused": refused, "chained": chained}
    return spark.read.parquet(f"{path}/counts").withColumns({k: F.lit(v) for k, v in facts.items()}).withColumns({k: F.col(k).cast("long") for k in ("read_rows", "kept_rows")})
