"""Registered queries of evaluation, sampling and record rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import parsing, relations, text
from ..operators import evaluation, joins, records, sampling
from .catalog import _BOXES, box_rows, labelled, query, rounded, table


def evaluator_rows(spark, sf_dir):
    """Line items as evaluator records: lines 1 to 4 are positives; decisions, kinds and scores come from keys."""
    r, part = labelled(spark, sf_dir), F.col("l_partkey") % 5
    truth = F.col("l_linenumber") <= 4
    said = F.when(part == 1, True).when(part == 2, True).when(part != 0, False)
    kind = F.element_at(F.array(*[F.lit(k) for k in evaluation.KINDS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return r.select(
        "l_returnflag", "l_orderkey", "l_linenumber", truth.alias("label_exists"), F.when(truth, "positive").otherwise("negative").alias("query_role"),
        said.alias("pred_exists"), said.alias("pred_found"), F.col("baseline").alias("pred_bbox_xyxy"), F.when(F.col("baseline").isNotNull(), F.col("baseline_iou")).alias("iou"),
        F.when(~truth, kind).alias("hallucination_type"), (F.col("l_partkey") % 11 != 0).alias("parse_valid"), F.col("l_tax").alias("latency_sec"),
        F.when(F.col("l_orderkey") % 3 != 2, F.col("l_orderkey") % 3 == 0).alias("caption_target_hallucination"), F.col("l_discount").alias("target_coverage"),
        (F.col("l_tax") * 10).alias("amber_cosine"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_tax")).alias("amber_cosine_penalized"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_discount")).alias("clip_clip_score_pred_bbox"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_tax")).alias("clip_clip_score_gt_bbox"),
        F.col("l_discount").alias("clip_clip_score_full_img"), F.col("l_tax").alias("clip_clip_score_target_expr"), (F.col("l_discount") - F.col("l_tax")).alias("clip_clip_localization_gain"),
    )


_ROWS = (
    _BOXES
    + """
, r AS (SELECT l_returnflag, l_orderkey, l_linenumber <= 4 AS pos, l_tax AS tax, l_discount AS disc, bs IS NOT NULL AS boxed, CASE WHEN bs IS NULL THEN 0 ELSE b_iou END AS o,
  CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS said, l_suppkey % 4 AS kind, l_partkey % 11 = 0 AS broken,
  CASE WHEN l_orderkey % 3 <> 2 THEN l_orderkey % 3 = 0 END AS lying, CASE WHEN l_suppkey % 3 = 0 THEN l_tax END AS pen,
  CASE WHEN l_partkey % 2 = 0 THEN l_discount END AS near, CASE WHEN l_suppkey % 2 = 0 THEN l_tax END AS tru FROM m)
"""
)


def _n(x: str) -> str:
    return f"round({x}, 9)"


def _rate(name: str, k: str, n: str) -> str:
    p, m = f"({k}) / nullif({n}, 0)", f"CAST(nullif({n}, 0) AS DOUBLE)"
    mid, spread = f"({p} + 3.8416 / (2 * {m}))", f"1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {m})) / {m})"
    low, high = f"least(greatest(({mid} - {spread}) / (1 + 3.8416 / {m}), 0.0), 1.0)", f"least(greatest(({mid} + {spread}) / (1 + 3.8416 / {m}), 0.0), 1.0)"
    none = f"CASE WHEN {m} IS NOT NULL THEN {{}} END"
    return f"{_n(p)} AS {name}, {_n(none.format(low))} AS {name}_ci_lower, {_n(none.format(high))} AS {name}_ci_upper"


_YES = 'round(tp / nullif(tp + fp, 0), 9) AS "precision", round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1'
_KIND_COUNTS = ", ".join(f"count(*) FILTER (NOT pos AND kind = {i}) AS n{i}, count(*) FILTER (NOT pos AND kind = {i} AND said) AS k{i}" for i in range(4))
_KIND_RATES = ", ".join(f"k{i} / nullif(n{i}, 0) AS r{i}" for i in range(4))
_MEANS = "list_avg([r0, r1, r2, r3]) AS macro, list_avg([r0, r1]) AS plain, list_avg([r2, r3]) AS bound"
_KIND_OUT = ", ".join(f"round(r{i}, 9) AS rate_{k}" for i, k in enumerate(evaluation.KINDS)) + ", round(macro, 9) AS macro_rate, round(plain, 9) AS plain_rate, round(bound, 9) AS bound_rate, round(bound - plain, 9) AS bound_minus_plain"
_TAIL = f", k AS (SELECT *, {_KIND_RATES} FROM c), q AS (SELECT *, {_MEANS} FROM k) "


@query(
    _ROWS
    + f""", c AS (SELECT l_returnflag, count(*) FILTER (pos AND coalesce(said, false)) AS tp, count(*) FILTER (pos AND NOT coalesce(said, false)) AS fn,
  count(*) FILTER (NOT pos AND coalesce(said, false)) AS fp, count(*) FILTER (NOT pos AND NOT coalesce(said, false)) AS tn,
  avg(tax) AS lat, count(*) FILTER (broken) AS parse_failures, {_KIND_COUNTS} FROM r GROUP BY 1){_TAIL}
SELECT l_returnflag, tp, fn, fp, tn, tp + fn + fp + tn AS n, tp + fn AS pos, fp + tn AS neg, parse_failures, round(lat, 9) AS avg_latency_sec, round((tp + tn) / (tp + fn + fp + tn), 9) AS accuracy,
  {_YES}, {_rate('false_rate', 'fp', 'fp + tn')}, {_rate('refusal_rate', 'fn', 'tp + fn')}, {_KIND_OUT}, round(list_avg([tp / nullif(tp + fn, 0), 1 - macro]), 9) AS balanced_accuracy FROM q"""
)
def existence_task(spark, sf_dir):
    return rounded(evaluation.existence_metrics(evaluator_rows(spark, sf_dir), ("l_returnflag",)))


_GROUND = f"""count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn, avg(o) FILTER (pos) AS mi, avg(o) FILTER (pos AND boxed) AS mv, count(*) FILTER (pos AND o <= 1e-12) AS z,
  count(*) FILTER (pos AND boxed AND o <= 1e-12) AS vz, count(*) FILTER (pos AND o >= 0.5) AS hits, count(*) FILTER (pos AND boxed) AS bx,
  count(*) FILTER (pos AND said) AS tp, count(*) FILTER (pos AND NOT said) AS fn, count(*) FILTER (NOT pos AND said) AS fp, count(*) FILTER (NOT pos AND NOT said) AS tn,
  avg(tax) AS lat, count(*) FILTER (broken) AS parse_failures, {_KIND_COUNTS}"""
_GROUND_OUT = f"""l_returnflag, np AS num_positive, nn AS num_negative, round(mi, 9) AS mean_iou, round(mv, 9) AS mean_iou_valid_only, z AS zero_count, vz AS valid_zero_count, tp, fn, fp, tn,
  round(lat, 9) AS avg_latency_sec, parse_failures, round(z / np, 9) AS zero_rate, round(vz / np, 9) AS valid_zero_rate, round(bx / np, 9) AS valid_box_rate, fn AS false_rejection_count,
  {_rate('false_rejection_rate', 'fn', 'np')}, {_rate('hit_rate', 'hits', 'np')}, {_rate('false_rate', 'fp', 'nn')}, {_rate('accuracy', 'tp + tn', 'tp + fn + fp + tn')}, {_YES}, {_KIND_OUT},
  round(list_avg([tp / np, 1 - macro]), 9) AS balanced_accuracy"""


@query(_ROWS + f", c AS (SELECT l_returnflag, {_GROUND} FROM r GROUP BY 1){_TAIL} SELECT {_GROUND_OUT} FROM q")
def grounding_task(spark, sf_dir):
    return rounded(evaluation.grounding_metrics(evaluator_rows(spark, sf_dir), ("l_returnflag",)))


@query(
    _ROWS
    + f""", c AS (SELECT l_returnflag, {_GROUND}, avg(tax * 10) AS am, avg(pen) AS ap, avg(near) AS an, avg(disc) AS af, avg(tax) AS te, avg(disc - tax) AS ag, avg(disc) FILTER (pos) AS cov,
  avg(coalesce(near, 0) * o) FILTER (pos) AS w1, avg(o * tru) FILTER (pos) AS w2, avg(near - tru) FILTER (pos) AS w3, avg(o * (tru - near)) FILTER (pos) AS w4,
  count(*) FILTER (NOT pos AND lying) AS l, count(*) FILTER (NOT pos AND NOT lying) AS cl, count(*) FILTER (NOT pos AND lying AND said) AS ly, count(*) FILTER (NOT pos AND NOT lying AND said) AS cy
  FROM r GROUP BY 1){_TAIL}
SELECT {_GROUND_OUT}, round(am, 9) AS avg_amber_cosine, round(ap, 9) AS avg_amber_cosine_penalized, round(an, 9) AS avg_clip_clip_score_pred_bbox, round(af, 9) AS avg_clip_clip_score_full_img,
  round(te, 9) AS avg_clip_clip_score_target_expr, round(ag, 9) AS avg_clip_clip_localization_gain, round(cov, 9) AS target_coverage, round(w1, 9) AS avg_clip_iou_weighted, round(w2, 9) AS avg_iou_times_gt_clip,
  round(w3, 9) AS avg_clip_delta, round(w4, 9) AS avg_iou_weighted_clip_delta, l AS caption_lying_n, cl AS caption_clean_n, round(ly / nullif(l, 0), 9) AS grounded_given_lying,
  round(cy / nullif(cl, 0), 9) AS grounded_given_clean, round(ly / nullif(l, 0) - cy / nullif(cl, 0), 9) AS coupling_gap, round(ly / nn, 9) AS joint_rate FROM q"""
)
def caption_task(spark, sf_dir):
    return rounded(evaluation.caption_metrics(evaluator_rows(spark, sf_dir), ("l_returnflag",)))


def changed_rows(spark, sf_dir):
    r = labelled(spark, sf_dir)
    return r.select("l_orderkey", "l_linenumber", "l_returnflag", "baseline_iou", F.col("challenger_iou").alias("result_iou"), F.col("l_linestatus").alias("transition"), F.col("l_discount").alias("gt_area_ratio"), F.col("l_linenumber").alias("distractors"))


@query(
    _BOXES
    + """SELECT l_returnflag, count(*) AS n, round(avg(b_iou), 9) AS baseline_miou, round(avg(c_iou), 9) AS result_miou, round(avg(greatest(b_iou, c_iou)), 9) AS oracle_miou, round(avg(c_iou - b_iou), 9) AS mean_delta,
  round(count(*) FILTER (greatest(b_iou, c_iou) >= 0.5) / count(*), 9) AS oracle_hit_rate, count(*) FILTER (greatest(b_iou, c_iou) = 0) AS oracle_zero, count(*) FILTER (b_iou = 0) AS baseline_zero, count(*) FILTER (c_iou = 0) AS result_zero,
  count(*) FILTER (c_iou - b_iou > 1e-9) AS improved, count(*) FILTER (abs(c_iou - b_iou) <= 1e-9) AS unchanged, count(*) FILTER (c_iou - b_iou < -1e-9) AS degraded,
  count(*) FILTER (b_iou = 0 AND c_iou >= 0.5) AS recovered_to_half, count(*) FILTER (b_iou < 0.5 AND c_iou >= 0.5) AS to_half, count(*) FILTER (c_iou < 0.5 AND b_iou >= 0.5) AS from_half FROM m GROUP BY 1"""
)
def change_study(spark, sf_dir):
    return rounded(evaluation.change_study(changed_rows(spark, sf_dir), ("l_returnflag",)))


@query(
    _BOXES
    + """SELECT l_returnflag, l_linestatus AS transition, count(*) AS n, round(median(l_discount), 9) AS median_area_ratio, round(avg(l_linenumber), 9) AS mean_distractors, round(avg(c_iou - b_iou), 9) AS mean_delta FROM m GROUP BY ALL"""
)
def change_context(spark, sf_dir):
    return rounded(evaluation.change_context(changed_rows(spark, sf_dir), ("l_returnflag",)))


@query(
    _BOXES
    + """, t AS (SELECT * FROM m WHERE l_linenumber <= 2)
SELECT count(*) FILTER (z1 AND z2) AS both_zero, count(*) FILTER (h1 AND h2) AS both_half FROM (SELECT l_orderkey, bool_or(b_iou = 0) FILTER (l_linenumber = 1) AS z1, bool_or(b_iou = 0) FILTER (l_linenumber = 2) AS z2,
  bool_or(c_iou >= 0.5) FILTER (l_linenumber = 1) AS h1, bool_or(c_iou >= 0.5) FILTER (l_linenumber = 2) AS h2 FROM t GROUP BY 1)"""
)
def across_tasks(spark, sf_dir):
    r = changed_rows(spark, sf_dir).where("l_linenumber <= 2")
    return evaluation.across_tasks(r, "l_orderkey", "l_linenumber", (1, 2), {"both_zero": F.col("baseline_iou") == 0, "both_half": F.col("result_iou") >= 0.5})


@query(
    _BOXES
    + """, p AS (SELECT l_orderkey, l_linenumber AS k, b_iou AS o FROM m WHERE bs IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber + 100, c_iou FROM m)
, f AS (SELECT count(*) AS records FROM m)
SELECT records, round(avg(CAST(bs IS NOT NULL OR seen AS INT)), 9) AS coverage, round(avg(CAST(top >= 0.5 AS INT)), 9) AS top_hit_rate, round(avg(CAST(best >= 0.5 AS INT)), 9) AS best_hit_rate, round(avg(top), 9) AS mean_top_iou,
  round(avg(best), 9) AS mean_best_iou FROM (SELECT *, CASE WHEN seen THEN c_iou ELSE b_iou END AS top, CASE WHEN seen THEN greatest(b_iou, c_iou) ELSE b_iou END AS best FROM (SELECT *, l_suppkey % 10 <> 0 AS seen FROM m)), f GROUP BY 1"""
)
def detector_quality(spark, sf_dir):
    both = F.filter(F.array(F.struct(F.col("baseline").alias("box"), F.lit(0.4).alias("score")), F.struct(F.when(F.col("l_suppkey") % 10 != 0, F.col("challenger")).alias("box"), F.lit(0.6).alias("score"))), lambda p: p["box"].isNotNull())
    return rounded(evaluation.detector_metrics(box_rows(spark, sf_dir).withColumn("proposals", both), "gt", "proposals"))


@query("SELECT round(median(c_acctbal / (c_custkey % 4 + 1)), 9) AS warm_latency FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)")
def warm_latency(spark, sf_dir):
    batches = table(spark, sf_dir, "customer").withColumn("size", F.col("c_custkey") % 4 + 1)
    return rounded(evaluation.warm_latency(batches, "c_custkey", "c_acctbal", "size"))


@query(
    """SELECT user_id, [c for c in [CASE WHEN min(event_type) <> max(event_type) THEN 'event_type' END, CASE WHEN min(value) <> max(value) OR (count(value) > 0 AND count(value) < count(*)) THEN 'value' END] if c IS NOT NULL]::VARCHAR AS columns
FROM events GROUP BY 1 HAVING min(event_type) <> max(event_type) OR min(value) <> max(value) OR (count(value) > 0 AND count(value) < count(*))"""
)
def dependency_violations(spark, sf_dir):
    out = evaluation.dependency_violations(table(spark, sf_dir, "events"), ["user_id"], ["event_type", "value"])
    return out.withColumn("columns", F.concat(F.lit("["), F.array_join("columns", ", "), F.lit("]")))


@query(
    """SELECT l_returnflag, l_linestatus || ':' || v AS counter, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, 'line' || l_linenumber AS v FROM lineitem
UNION ALL SELECT l_returnflag, l_linestatus, CASE WHEN l_tax > 0.04 THEN 'high' END FROM lineitem) WHERE v IS NOT NULL GROUP BY ALL"""
)
def long_counters(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").withColumns({"a": F.concat(F.lit("line"), F.col("l_linenumber").cast("string")), "b": F.when(F.col("l_tax") > 0.04, "high")})
    return evaluation.long_counters(r, ["l_returnflag"], ["a", "b"], "l_linestatus")


@query("SELECT role, count(*) FILTER (turn % 2 = 0) AS even, count(*) FILTER (turn % 2 = 1) AS odd FROM conversations GROUP BY 1")
def rollup_checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.array(F.struct("role", F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("verdict"))).alias("checks"))
    return evaluation.rollup_checks(c, "checks", "role", "verdict", ["even", "odd"])


@query("SELECT event_type, event_id, user_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY sha256('s:' || event_id), event_id) - 1 AS INT) AS rank FROM events QUALIFY rank < 7")
def top_by_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return sampling.top_n(e, ["event_type"], 7, sampling.hash_order("s", F.col("event_id")), F.col("event_id"))


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, sha256('b:' || p_partkey), p_partkey) = 1")
def best_per_group(spark, sf_dir):
    return sampling.best_of(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], -F.col("p_size"), sampling.hash_order("b", F.col("p_partkey")), F.col("p_partkey"))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS INT) AS shard FROM orders")
def round_robin(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1 AS first_of_group FROM customer")
def group_representatives(spark, sf_dir):
    return sampling.representatives(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey")


@query(
    """WITH h AS (SELECT event_id, event_type, sha256('x:' || event_id) AS h FROM events WHERE event_type IN ('purchase', 'signup')),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS r FROM h)
SELECT event_id, event_type FROM k ORDER BY r > 15, h, event_id LIMIT 31"""
)
def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 31, ["purchase", "signup"], "x")


@query()
def compute_subset(spark, sf_dir):
    """Ten queries from each of four order priorities, as far as they have different customers."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).cast("string").alias("source"), F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("ann_id"), F.lit("q").alias("query"))
    return sampling.compute_subset(o, {str(k): 10 for k in range(4)}, "seed")


@query(
    """WITH k AS (SELECT user_id, event_type, min(value > 50) = max(value > 50) AS same, min(event_id) AS event_id FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type, event_id FROM k WHERE same"""
)
def unambiguous_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type", "event_id", (F.col("value") > 50).cast("string").alias("out"))
    return records.unambiguous(e, ["user_id", "event_type"], "out", "event_id").drop("out")


@query(
    """WITH d AS (SELECT user_id AS c_custkey, max(event_id) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1)
SELECT c_custkey, last AS event_id, last IS NOT NULL AS reused FROM customer LEFT JOIN d USING (c_custkey)"""
)
def cached_or_pending(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_id").alias("event_id"))
    return records.reused(table(spark, sf_dir, "customer").select("c_custkey"), e, ["c_custkey"], "event_id")


@query()
def candidate_oracle(spark, sf_dir):
    r = box_rows(spark, sf_dir)
    both = F.array(F.struct(F.lit("a").alias("source"), F.array("baseline").alias("boxes")), F.struct(F.lit("b").alias("source"), F.array("challenger").alias("boxes")))
    rows = r.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("id"), "gt", "l_linenumber", F.inline(both))
    groups = evaluation.group_candidates(rows, "id", "gt", "source", "boxes", ["a", "b"], "l_linenumber")
    return rounded(evaluation.candidate_oracle(groups, ["a", "b"], "a"))


@query(
    """WITH n AS (SELECT split_part(CAST(conv_id AS VARCHAR), '__', 1) AS k, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, turn FROM conversations)
SELECT CAST(a.k AS BIGINT) AS conv_id, a.turn AS turn, b.turn AS other_turn FROM n a JOIN n b ON a.k = b.k AND a.t = b.t"""
)
def text_keyed_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    other = c.select("conv_id", F.upper("text").alias("text"), F.col("turn").alias("other_turn"))
    return joins.by_text(c, other, "conv_id", "text").select("conv_id", "turn", "other_turn")


@query(
    """WITH o AS (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS a, c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AS b FROM (SELECT DISTINCT c_custkey FROM customer))
SELECT count(*) FILTER (a) AS ordered, count(*) FILTER (b) AS seen, count(*) FILTER (a OR b) AS covered, count(*) FILTER (a AND b) AS shared, count(*) FILTER (NOT a AND NOT b) AS unresolved FROM o"""
)
def coverage_union(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return joins.coverage_union(table(spark, sf_dir, "customer"), {"ordered": o, "seen": e}, ["c_custkey"])


@query(
    """WITH g AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1 ORDER BY f, user_id LIMIT 10 OFFSET 5)
SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM g)"""
)
def group_slice(spark, sf_dir):
    return joins.group_slice(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5, 10)


@query(
    """WITH c AS (SELECT o_orderkey % 7 AS g, o_custkey % 3 AS v, count(*) AS n FROM orders GROUP BY ALL)
SELECT g, CAST(sum(n) AS BIGINT) AS n, string_agg(v || '=' || n, ',' ORDER BY v) AS v_counts FROM c GROUP BY 1"""
)
def emission_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("g"), (F.col("o_custkey") % 3).alias("v"))
    out = joins.value_counts(o, ["g"], "v")
    return out.withColumn("v_counts", F.array_join(F.transform(F.map_entries("v_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query(
    """SELECT o_orderkey, t AS task, c_custkey IS NOT NULL AS known, s_suppkey IS NOT NULL AS supplied FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN supplier ON s_suppkey = o_custkey, (SELECT unnest(['t2', 't4']) AS t)"""
)
def assembled_rows(spark, sf_dir):
    key = lambda n, c: table(spark, sf_dir, n).withColumn("k", F.col(c))
    out = joins.assembled(key("orders", "o_custkey"), {"customer": key("customer", "c_custkey")}, {"supplier": key("supplier", "s_suppkey")}, ["k"], ["t2", "t4"])
    return out.select("o_orderkey", "task", (F.size("violations") == 0).alias("known"), F.col("supplier").isNotNull().alias("supplied"))
