"""Registered queries of boxes, decisions, record shaping and checked joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import parsing, relations, text
from ..operators import decisions, evaluation, isolation, joins, manifests, mentions, metrics, records
from .catalog import _BOXES, box_rows, labelled, query, rounded, split_rows, table

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_KEYS = ", ".join(_KEY)
_POLICY = """
WITH l AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_quantity / 10 END AS b, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 20000 END AS c, 2.0 + l_tax * 10 AS n FROM lineitem),
w AS (SELECT *, coalesce(b, -1e300) AS x, coalesce(c, -1e300) AS y FROM l),
k AS (SELECT *, n > x AND n >= y AS nb, y > x AND y > n AS cb FROM w),
d AS (SELECT *, CASE WHEN nb AND b IS NOT NULL AND n - greatest(x, y) < 0.5 THEN 'keep' WHEN cb AND b IS NOT NULL AND y - x < 0.5 THEN 'keep' WHEN nb THEN 'reject' WHEN cb THEN 'switch' ELSE 'keep' END AS action,
  CASE WHEN nb AND b IS NOT NULL AND n - greatest(x, y) < 0.5 THEN 'reject_margin_not_met' WHEN cb AND b IS NOT NULL AND y - x < 0.5 THEN 'switch_margin_not_met' ELSE 'joint_argmax' END AS reason,
  greatest(x, y, n) AS top FROM k),
e AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE exp((b - top) / 2) END AS pb, CASE WHEN c IS NULL THEN 0 ELSE exp((c - top) / 2) END AS pc, exp((n - top) / 2) AS pn FROM d)
"""


@query(
    _POLICY
    + """SELECT action, reason, count(*) AS n, round(avg(CASE action WHEN 'keep' THEN pb WHEN 'switch' THEN pc ELSE pn END / (pb + pc + pn)), 9) AS confidence,
  round(avg(pc / (pb + pc + pn)), 9) AS challenger_probability FROM e GROUP BY ALL"""
)
def decision_policy(spark, sf_dir):
    """Decisions from three logits of each line item; line 7 has no baseline, so its challenger takes no part."""
    r = table(spark, sf_dir, "lineitem")
    b = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 10)
    p = decisions.policy(b, F.col("l_extendedprice") / 20000, F.lit(2.0) + F.col("l_tax") * 10, 0.5, 0.5, temperature=2.0)
    out = r.select(p.alias("p")).groupBy("p.action", "p.reason")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg("p.confidence").alias("confidence"), F.avg(F.col("p.probabilities")[1]).alias("challenger_probability")))


@query(
    f"""SELECT {_KEYS}, round(0.5 * l_tax + 0.3 * l_discount + 0.2 * l_quantity, 9) AS plain, round(0.5 * l_tax + 0.3 * l_discount - 0.7 * l_quantity, 9) AS contradicted,
  round(0.1 + 0.4 * l_discount + 0.6 * l_tax, 9) AS nothing, round((l_tax - l_discount) / 2, 9) AS antisymmetric, CASE WHEN l_returnflag <> 'N' THEN CAST((l_returnflag = 'A') = (l_linenumber % 2 = 1) AS DOUBLE) END AS vote FROM lineitem"""
)
def logits_and_votes(spark, sf_dir):
    r, t, d, q = table(spark, sf_dir, "lineitem"), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    status, odd = F.when(F.col("l_returnflag") == "N", "error").otherwise("ok"), F.col("l_linenumber") % 2 == 1
    vote = records.vote_score(status, F.when(F.col("l_returnflag") == "A", "a").otherwise("b"), odd)
    return rounded(
        r.select(
            *_KEY, decisions.candidate_logit([t, d, q], [0.5, 0.3, 0.2]).alias("plain"), records.evidence_logit([t, d], [0.5, 0.3], q, 0.7).alias("contradicted"),
            records.null_logit(d, t, 0.1, 0.4, 0.6).alias("nothing"), decisions.antisymmetric(t, d).alias("antisymmetric"), vote.alias("vote"),
        )
    )


def _sides(name: str, *parts: str) -> str:
    return ", ".join(f"round({p}, 6) AS {name}_{k}" for k, p in enumerate(parts))


def _listed(name: str, b):
    return [F.round(b[k], 6).alias(f"{name}_{k}") for k in range(4)]


_CUT = "greatest(least(x, 40.0), 0.0) AS cx, greatest(least(y, 25.0), 0.0) AS cy, greatest(least(x + w, 40.0), 0.0) AS ca, greatest(least(y + h, 25.0), 0.0) AS cb"


@query(
    f"""WITH b AS (SELECT *, l_quantity - 5 AS x, 100 * l_tax - 1 AS y, 10 + 100 * l_discount AS w, 20.0 AS h FROM lineitem), c AS (SELECT *, {_CUT} FROM b),
d AS (SELECT *, ca > cx AND cb > cy AS ok, greatest(0, least(39, CAST(round_even(x, 0) AS INT))) AS px, greatest(0, least(24, CAST(round_even(y, 0) AS INT))) AS py FROM c)
SELECT {_KEYS}, {_sides('plain', 'x', 'y', 'x + w', 'y + h')}, {_sides('clipped', *[f'CASE WHEN ok THEN {v} END' for v in ('cx', 'cy', 'ca', 'cb')])}, {_sides('clamped', 'cx', 'cy', 'ca', 'cb')},
  px AS pixel_0, py AS pixel_1, greatest(px + 1, least(40, CAST(round_even(x + w, 0) AS INT))) AS pixel_2, greatest(py + 1, least(25, CAST(round_even(y + h, 0) AS INT))) AS pixel_3,
  {_sides('scaled', *[f'CASE WHEN l_quantity <= 15 THEN {v} END' for v in ('l_tax * 40', 'l_discount * 25', '(l_tax + 0.5) * 40', '(l_discount + 0.25) * 25')])},
  round(greatest(w, 0) * greatest(h, 0), 6) AS area, ok AS valid FROM d"""
)
def box_conversions(spark, sf_dir):
    """Line items as x, y, width and height in an image of 40 by 25: converted, clipped, clamped, in pixels, rescaled."""
    r = table(spark, sf_dir, "lineitem")
    b = F.array(F.col("l_quantity") - 5, 100 * F.col("l_tax") - 1, 10 + 100 * F.col("l_discount"), F.lit(20.0))
    w, h, t, d = F.lit(40), F.lit(25), F.col("l_tax"), F.col("l_discount")
    r = r.withColumns({"xywh": b, "xyxy": g.from_xywh(b), "cut": g.xywh_clipped(b, w, h)})
    px = g.pixels(F.col("xyxy"), w, h)
    relative = F.when(F.col("l_quantity") <= 15, g.rescaled(F.array(t + 0.5, d + 0.25, t, d), w, h))
    return r.select(
        *_KEY, *_listed("plain", F.col("xyxy")), *_listed("clipped", F.col("cut")), *_listed("clamped", g.clamped(F.col("xyxy"), w, h)), *[px[k].alias(f"pixel_{k}") for k in range(4)],
        *_listed("scaled", relative), F.round(g.area(F.col("xyxy")), 6).alias("area"), F.col("cut").isNotNull().alias("valid"),
    )


@query(
    _BOXES
    + f"""SELECT {_KEYS}, CASE WHEN bs IS NOT NULL THEN round(b_iou, 9) END AS overlap, CASE WHEN bs IS NOT NULL THEN round(b_iou, 9) END AS strict,
  CASE WHEN bs IS NOT NULL THEN round(0.6 * exp(-abs(ln(ba / ga))) + 0.4 * greatest(0.0, 1 - abs(bs) / 50.0), 9) END AS hardness,
  CASE WHEN bs IS NULL THEN CASE WHEN c_iou >= 0.5 THEN 0 END WHEN c_iou >= 0.5 AND c_iou > b_iou THEN 1 WHEN b_iou >= 0.5 THEN 0 END AS best FROM u"""
)
def box_overlaps(spark, sf_dir):
    """Nullable and strict overlap, hardness, and the first best box of the two if it reaches one half."""
    r = labelled(spark, sf_dir)
    gt, b = F.col("gt"), F.col("baseline")
    return rounded(r.select(*_KEY, g.iou(gt, b).alias("overlap"), g.iou(gt, b, "strict").alias("strict"), g.hardness(gt, b, F.lit(50.0)).alias("hardness"), g.best_index(F.filter(F.array("baseline", "challenger"), lambda b: b.isNotNull()), gt).cast("int").alias("best")))


@query(
    _BOXES
    + """, t AS (SELECT l_orderkey, l_linenumber, l_partkey, gx1 AS x1, y1, gx2 AS x2, y2, gx2 - gx1 AS w, y2 - y1 AS h FROM i),
j AS (SELECT *, least(greatest(CASE WHEN x1 + w * 0.35 + w > 300 THEN x1 - w * 0.35 ELSE x1 + w * 0.35 END, 0.0), 300.0 - w) AS sx,
  least(greatest(CASE WHEN y1 + h * 0.35 + h > 40 THEN y1 - h * 0.35 ELSE y1 + h * 0.35 END, 0.0), 40.0 - h) AS sy FROM t),
p AS (SELECT 'partial_horizontal' AS kind, *, x1 AS a, y1 AS b, x1 + w * 0.55 AS c, y2 AS d FROM j UNION ALL SELECT 'partial_vertical', *, x1, y1, x2, y1 + h * 0.55 FROM j
  UNION ALL SELECT 'oversized_context', *, greatest(0.0, x1 - w * 0.4), greatest(0.0, y1 - h * 0.4), least(300.0, x2 + w * 0.4), least(40.0, y2 + h * 0.4) FROM j
  UNION ALL SELECT 'jitter_horizontal', *, sx, y1, sx + w, y2 FROM j UNION ALL SELECT 'jitter_vertical', *, x1, sy, x2, sy + h FROM j),
o AS (SELECT l_orderkey, l_linenumber, l_partkey, kind, a, b, c, d, greatest(least(x2, c) - greatest(x1, a), 0) * greatest(least(y2, d) - greatest(y1, b), 0) AS shared, w * h AS ta, (c - a) * (d - b) AS pa FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, kind, round(a, 6) AS x1, round(b, 6) AS y1, round(c, 6) AS x2, round(d, 6) AS y2, round(shared / (ta + pa - shared), 9) AS iou FROM o WHERE shared / (ta + pa - shared) < 0.95"""
)
def perturbed_boxes(spark, sf_dir):
    """Lower-overlap boxes of every line item in an image of 300 by 40, by their corners."""
    r = box_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.inline(g.perturbed(F.col("gt"), F.lit(300), F.lit(40))))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "kind", *[F.round(F.col("box")[k], 6).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], F.round("iou", 9).alias("iou"))


def _cases():
    """The lines of an order as cases (line, box, iou), in order of line."""
    case = F.struct(F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") != 3, F.array("l_tax")).alias("box"), F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("iou"))
    return F.sort_array(F.collect_list(case)).alias("cases")


@query(
    """WITH z AS (SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) FILTER (l_linenumber <> 3 AND l_returnflag <> 'A' AND l_tax = 0) AS zero,
  count(*) FILTER (l_linenumber <> 3 AND l_returnflag <> 'A' AND l_tax = 0) AS k FROM lineitem GROUP BY 1) SELECT l_orderkey, zero FROM z WHERE k > 0"""
)
def zero_cases(spark, sf_dir):
    """Orders with cases that have a box and an overlap of exactly 0; a missing overlap is none."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_cases())
    out = records.with_zero_cases(grouped, "cases")
    return out.select("l_orderkey", F.array_join(F.transform("cases", lambda c: c["line"].cast("string")), ",").alias("zero"))


@query(
    """SELECT o_orderkey AS query_id, CAST(o_custkey AS VARCHAR) AS image_id, lower(o_orderpriority) AS query, min_by(l_linenumber, (l_tax, l_linenumber)) AS easiest, max_by(l_linenumber, (l_tax, -l_linenumber)) AS hardest
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""
)
def queue_rows(spark, sf_dir):
    """Allowed columns only, with their types, and the first least and greatest element of each row's cases."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("image_id"), F.lower("o_orderpriority").alias("query"), F.col("o_totalprice").alias("gt_box"))
    cases = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_tax").alias("v")))).alias("cases"))
    out = records.projected(o, {"query_id": "bigint", "image_id": "string", "query": "string"}, ("gt_box",)).join(cases, "query_id")
    out = records.assert_without(out, ("gt_box", "supervision"))
    return out.select("query_id", "image_id", "query", records.extreme(F.col("cases"), "v", False)["line"].alias("easiest"), records.extreme(F.col("cases"), "v")["line"].alias("hardest"))


@query(
    f"""WITH r AS (SELECT *, l_tax * 10 AS o, CASE WHEN l_linenumber <> 2 THEN l_partkey % 3 END AS m, l_suppkey % 3 AS t, l_partkey % 2 AS mc, l_suppkey % 2 AS tc FROM lineitem)
SELECT {_KEYS}, CASE WHEN m IS NULL OR o < 0.1 THEN 'background_or_unannotated' WHEN o < 0.5 THEN 'partial_or_oversized_region' WHEN m = t THEN 'target_annotation_coordinate_mismatch'
  WHEN mc = tc THEN 'wrong_same_category_instance' ELSE 'other_category_or_reference' END AS region, CASE WHEN l_linenumber = 1 THEN 'relation' WHEN l_linenumber = 2 THEN 'attribute' ELSE 'object_only' END AS structure,
  l_linenumber % 2 = 0 AND l_returnflag <> 'A' AND l_suppkey % 3 <> 0 AND l_linenumber <> 6 AS relation_eligible,
  CASE l_partkey % 6 WHEN 0 THEN 'arrearage' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'timeout' WHEN 3 THEN 'schema_validation' ELSE 'api_or_other' END AS error_class,
  CASE l_suppkey % 5 WHEN 0 THEN 'unclear' WHEN 1 THEN 'evidence_insufficient_or_self_contradictory' WHEN 2 THEN 'stereotype_sensitive_cue' WHEN 3 THEN 'evidence_insufficient_or_self_contradictory' ELSE 'no_automatic_flag' END AS flag,
  CASE WHEN l_partkey % 3 > 1 THEN 'multiple_reference_categories' WHEN l_partkey % 3 = 1 THEN CASE least(l_suppkey % 3, 2) WHEN 0 THEN 'reference_category_no_annotation' WHEN 1 THEN 'unique_reference_annotation' ELSE 'multiple_reference_annotations' END
    WHEN l_returnflag = 'A' THEN 'no_relation_pattern' ELSE 'no_reference_category' END AS status FROM r"""
)
def record_labels(spark, sf_dir):
    """Classes of regions, expressions, errors, evidence and references of each line item."""
    r, line = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    some, none = F.array(F.lit("x")), F.array().cast("array<string>")
    pick = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v) + 1).cast("int"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    error = pick(p, "Arrearage: x", "HTTP 429", "Read timed out", "ValueError: y", "other", None)
    evidence = pick(s, "any", "No visible gender cue", "their Uniform", " ", "a face")
    return r.select(
        *_KEY,
        records.region_class(F.col("l_tax") * 10, F.when(line != 2, p % 3), s % 3, p % 2, s % 2).alias("region"),
        records.expression_structure(F.when(line == 1, some), F.when(line <= 2, some).otherwise(none)).alias("structure"),
        records.relation_eligible(F.when(line % 2 == 0, True), F.when(F.col("l_returnflag") != "A", "left"), F.when(s % 3 != 0, "dog").otherwise(""), F.when(line != 6, some)).alias("relation_eligible"),
        records.error_class(error).alias("error_class"),
        records.presentation_flag(F.when(s % 5 == 0, "unclear").otherwise("female"), evidence).alias("flag"),
        relations.reference_status(F.when(F.col("l_returnflag") != "A", "left"), F.array_repeat(F.lit("c"), (p % 3).cast("int")), (s % 3).cast("int")).alias("status"),
    )


@query(
    """SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END, ''), o_orderpriority) AS value,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END AS fixed,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '[0].kind:1-URGENT->urgent' WHEN o_orderpriority = '5-LOW' THEN '[0].kind:5-LOW->low' ELSE '' END AS corrections,
  concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'missing:status' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'not_allowed:o_orderpriority' END, CASE WHEN o_orderkey % 3 = 0 THEN 'empty:items' END) AS violations FROM orders"""
)
def record_checks(spark, sf_dir):
    """First filled alias, replaced names with their notes, and what is wrong with each row."""
    o = table(spark, sf_dir, "orders").withColumns({"blank": F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), "status": F.when(F.col("o_orderstatus") != "P", "x"), "items": F.array_repeat(F.lit(1), (F.col("o_orderkey") % 3).cast("int"))})
    fixed = records.aliased(F.array(F.struct(F.col("o_orderpriority").alias("kind"))), "kind", {"1-URGENT": "urgent", "5-LOW": "low"})
    wrong = records.violations(("status",), {"o_orderpriority": ("1-URGENT", "2-HIGH")}, ("items",))
    return o.withColumn("f", fixed).select(
        "o_orderkey", text.first_filled("blank", "o_orderpriority").alias("value"), F.col("f.items")[0]["kind"].alias("fixed"), F.array_join("f.corrections", ",").alias("corrections"), F.array_join(wrong, ",").alias("violations")
    )


@query(
    """SELECT o_orderkey, c_custkey, event_id FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'error' AND value > 20 GROUP BY 1) ON user_id = c_custkey
WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type <> 'error' AND value > 20)"""
)
def exact_covers(spark, sf_dir):
    """Orders of the wanted customers, all of them found, one to one with the latest good event of each."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey").withColumn("model", F.when(F.col("value") > 20, "new").otherwise("old"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    done = records.complete(c, e, ["c_custkey"], "event_id", F.col("event_type") != "error", {"model": "new"})
    wanted = records.exact_cover(c, done, ["c_custkey"])
    good = e.where("event_type <> 'error' and model = 'new'").select("c_custkey", "event_id").join(wanted, "c_custkey", "left_semi")
    latest = records.one_to_one(wanted, good, ["c_custkey"], "event_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(latest, "c_custkey").select("o_orderkey", "c_custkey", "event_id")


@query(
    """SELECT c_custkey, c_nationkey, kind FROM customer, (SELECT unnest(['near', 'far']) AS kind) WHERE CASE kind WHEN 'near' THEN c_custkey % 3 ELSE c_nationkey % 2 END > 0
UNION ALL SELECT -s_suppkey, s_nationkey, 'supplier' FROM supplier"""
)
def candidate_pools(spark, sf_dir):
    """Customers once for each kind of candidate that they have, and another suite below them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    some = lambda n: F.array_repeat(F.lit(1), n.cast("int"))
    banks = c.select("c_custkey", some(F.col("c_custkey") % 3).alias("near"), F.when(F.col("c_nationkey") % 2 > 0, some(F.lit(2))).alias("far"))
    out = joins.pools(c, banks, "c_custkey", {"near": "near", "far": "far"}).select("c_custkey", "c_nationkey", "kind")
    s = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.lit("supplier").alias("kind"))
    return evaluation.union_all([out, s])


@query(
    """WITH c AS (SELECT *, CASE WHEN l_linenumber <= 3 THEN 'positive' ELSE 'negative' END AS role, l_partkey % 2 = 0 AS found, l_suppkey % 3 = 0 AS offered, l_linenumber <> 5 AS task FROM lineitem)
SELECT role, CASE WHEN task AND found THEN CASE WHEN offered THEN 'replaced' ELSE 'no_candidate' END END AS replacement, count(*) AS n, count(*) FILTER (task AND found AND offered AND l_returnflag = 'R') AS mismatches,
  round(sum(CASE WHEN task AND found AND offered THEN l_tax ELSE l_discount END), 6) AS first_side FROM c GROUP BY ALL"""
)
def state_preserving(spark, sf_dir):
    """Found boxes replaced by the candidate of the same role and key; others stay."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = table(spark, sf_dir, "lineitem").withColumn("k", key)
    role = F.when(F.col("l_linenumber") <= 3, "positive").otherwise("negative")
    rows = r.select(F.when(F.col("l_linenumber") != 5, "t2").otherwise("t1").alias("task"), role.alias("query_role"), F.when(role == "positive", F.col("k")).alias("base_sample_id"), F.when(role != "positive", F.col("k")).alias("pair_id"), F.lit("q").alias("query"), (F.col("l_partkey") % 2 == 0).alias("pred_found"), F.array("l_discount").alias("pred_bbox_xyxy"))
    side = r.where("l_suppkey % 3 = 0").select(role.alias("role"), F.col("k").alias("key"), F.when(F.col("l_returnflag") == "R", "other").otherwise("q").alias("query"), F.array("l_tax").alias("box")).dropDuplicates(["key"])
    out = records.preserved(rows, side, ("t2", "t4")).withColumnRenamed("query_role", "role")
    return out.groupBy("role", "replacement").agg(F.count(F.lit(1)).alias("n"), F.count_if("query_mismatch").alias("mismatches"), F.round(F.sum(F.col("pred_bbox_xyxy")[0]), 6).alias("first_side"))


@query(
    """WITH p AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_nationkey < 5 UNION SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT count(*) AS n, min(id) AS least, max(id) AS most FROM p"""
)
def protected_ids(spark, sf_dir):
    """Distinct image numbers from the first filled identity column of two tables."""
    name = lambda c: F.concat(F.lit("COCO_train_"), F.lpad(F.col(c).cast("string"), 12, "0"), F.lit(".jpg"))
    c = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.lit("").alias("image_id"), name("c_custkey").alias("image"), "c_name")
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("image_id"), "o_totalprice")
    return records.protected_ids([c, o], ("image_id", "image"), text.image_number).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query(
    """WITH r AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'i' || o_custkey END AS i, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS b FROM orders),
k AS (SELECT CASE WHEN nullif(i, '') IS NULL THEN 'missing_image' WHEN b IS NULL THEN 'missing_box' ELSE 'kept' END AS reason FROM r) SELECT reason, count(*) AS n FROM k GROUP BY 1"""
)
def benchmark_rows(spark, sf_dir):
    """Benchmark rows with an image and a box, and the others counted by reason."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.when(k % 7 == 0, "").when(k % 5 == 0, None).otherwise(F.concat(F.lit("i"), F.col("o_custkey").cast("string"))).alias("image"), F.when(k % 3 != 0, F.array("o_totalprice")).alias("bbox"))
    kept, dropped = records.valid_benchmark(o, ("image", "image_id"), ("bbox",))
    return kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")).union(dropped.select("_reason", "count")).where("n > 0")


@query(
    """WITH k AS (SELECT 'customer' AS s, c_custkey AS id FROM customer UNION ALL SELECT 'orders', o_custkey FROM orders UNION ALL SELECT 'supplier', s_suppkey FROM supplier),
d AS (SELECT id, count(DISTINCT s) AS n FROM k WHERE id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (n > 1) = 0 AS all_disjoint, count(*) FILTER (n > 1) AS shared_values FROM d"""
)
def disjoint_verdict(spark, sf_dir):
    """Whether no value stands in two splits, and how many do."""
    return isolation.verdict(split_rows(spark, sf_dir), "split", ["id"])


@query(
    """WITH s AS (SELECT l_returnflag, CASE WHEN l_linenumber <> 7 THEN l_tax * 10 END AS v FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(coalesce(avg(coalesce(v, 0)), 0), 9) AS mean_iou, round(count(*) FILTER (coalesce(v, 0) = 0) / count(*), 9) AS zero_rate, round(count(*) FILTER (v >= 0.5) / count(*), 9) AS hit_rate, round(count(v) / count(*), 9) AS found_rate FROM s GROUP BY 1"""
)
def overlap_summary(spark, sf_dir):
    """Mean overlap, and the shares of zeros, hits and found boxes, of each group."""
    r = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 10))
    return rounded(metrics.metric_summary(r.withColumn("v0", F.coalesce("v", F.lit(0.0))), "v0", F.col("v").isNotNull(), ("l_returnflag",)))


_NAMES = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'COCO_train2014_' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '.jpg' WHEN 1 THEN 'a/b/' || page_id || '.png' WHEN 2 THEN 'other_' || page_id || '.jpg' ELSE lpad(CAST(page_id AS VARCHAR), 13, '1') || '_x' END AS f FROM pages"


@query(
    f"""WITH n AS ({_NAMES}) SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN page_id END AS image_number, CASE page_id % 4 WHEN 0 THEN page_id WHEN 3 THEN CAST(left(lpad(CAST(page_id AS VARCHAR), 13, '1'), 12) AS BIGINT) END AS loose_number,
  's' || page_id AS base, CASE page_id % 3 WHEN 0 THEN 's' || page_id || '_x' ELSE 's' || page_id END AS trimmed, CASE WHEN page_id % 2 = 0 THEN 'text ' || page_id END AS bounded,
  CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS said, CASE page_id % 4 WHEN 0 THEN 'prefix' WHEN 1 THEN 'not_found' WHEN 2 THEN 'single_token' ELSE 'parse_fail_default_no' END AS method, 'in ' || page_id AS content,
  page_id::DOUBLE AS first_number FROM n"""
)
def name_functions(spark, sf_dir):
    """Image numbers, ids without suffixes, bounded texts, answers and numbers, of names made of page ids."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    name = F.when(k == 0, F.concat(F.lit("COCO_train2014_"), F.lpad(i, 12, "0"), F.lit(".jpg"))).when(k == 1, F.concat(F.lit("a/b/"), i, F.lit(".png"))).when(k == 2, F.concat(F.lit("other_"), i, F.lit(".jpg"))).otherwise(F.concat(F.lpad(i, 13, "1"), F.lit("_x")))
    said = F.when(k == 0, "<answer> Yes, it is</answer>").when(k == 1, "It was not found.").when(k == 2, "I would say ｙｅｓ").otherwise("either yes or no")
    base = F.concat(F.lit("s"), i, F.when(F.col("page_id") % 3 == 0, "_x").when(F.col("page_id") % 3 == 1, "_cooc").otherwise("_rel"))
    a = table(spark, sf_dir, "pages").select("page_id", name.alias("f"), text.yes_no_answer(said).alias("a"), base.alias("b"))
    listed = text.four_numbers(F.concat(F.lit("box [ "), i, F.lit(", 2, 3.5, 4 ] and 9 9 9 9")))
    return a.select(
        "page_id", text.image_number(F.col("f")).alias("image_number"), text.first_long_number(F.col("f")).alias("loose_number"), text.without_suffix(F.concat(F.lit("s"), i, F.lit("__v2"))).alias("base"),
        text.without_suffix(F.col("b"), "_cooc", "_attr", "_rel").alias("trimmed"), F.when(F.col("page_id") % 2 == 0, text.bounded(F.concat(F.lit(" text "), i, F.lit(" ")))).otherwise(text.bounded(F.repeat(F.lit("x"), 4001))).alias("bounded"),
        F.when(F.col("a.valid"), F.col("a.exists")).alias("said"), F.col("a.method").alias("method"), text.answer_content(F.concat(F.lit("a <answer> in "), i, F.lit(" </answer> b"))).alias("content"), listed[0].alias("first_number"),
    )


def _relation_sql() -> str:
    """The relation of each turn, its phrase and its words, from the same fixed patterns.

    Letters with accents are letters at a word's edge; here that takes a plain letter instead.
    """
    low, trimmed = "lower(text)", "lower(trim(text))"
    first = " ".join(f"WHEN regexp_matches({low}, '{p}') THEN '{n}'" for n, p in relations.RELATIONS.items())
    rest = " ".join(f"WHEN regexp_matches({trimmed}, '{p}') THEN regexp_extract({trimmed}, '(?s){p}(.*)$', 1)" for p in relations.RELATIONS.values())
    edge = r'[ \t.,;:!?()\[\]{}"]'
    phrase = f"nullif(regexp_replace(regexp_replace(regexp_replace(CASE {rest} END, '^{edge}+', ''), '{edge}+$', ''), '^(?:the|a|an|his|her|their|this|that)\\s+', ''), '')"
    words = ", ".join(f"'{w}'" for w in relations.RELATION_WORDS)
    mark = r'[.,;:!?()\[\]{}"]'
    counted = f"len(list_intersect(list_distinct([regexp_replace(regexp_replace(w, '^{mark}+', ''), '{mark}+$', '') FOR w IN regexp_split_to_array({low}, '\\s+')]), [{words}]))"
    return f"""WITH t AS (SELECT conv_id, turn, 'the dog ' || CASE conv_id % 3 WHEN 0 THEN 'left of the ' WHEN 1 THEN 'next to (a) ' ELSE 'and, ' END || regexp_replace(text, '[À-ɏ]', 'x', 'g') AS text FROM conversations),
r AS (SELECT conv_id, turn, CASE {first} END AS relation, {phrase} AS phrase, {counted} AS words FROM t)
SELECT conv_id, turn, relation, CAST(words AS INT) AS words, phrase FROM r"""


@query(_relation_sql())
def relation_mentions(spark, sf_dir):
    """Relation, relation words and reference phrase of every turn, each behind a beginning with or without one; accented letters as x."""
    k = F.col("conv_id") % 3
    plain = F.regexp_replace("text", "[\u00c0-\u024f]", "x")
    said = F.concat(F.lit("the dog "), F.when(k == 0, "left of the ").when(k == 1, "next to (a) ").otherwise("and, "), plain)
    c = table(spark, sf_dir, "conversations").withColumn("text", said)
    return c.select("conv_id", "turn", relations.relation(F.col("text")).alias("relation"), relations.relation_score(F.col("text")).alias("words"), relations.reference_phrase(F.col("text")).alias("phrase"))


def _ten(p: str) -> str:
    return f"[{p}0, {p}1, {p}2, {p}3, {p}2 - {p}0, {p}3 - {p}1, ({p}0 + {p}2) / 2, ({p}1 + {p}3) / 2, ({p}2 - {p}0) * ({p}3 - {p}1), ln(({p}2 - {p}0 + 1e-6) / ({p}3 - {p}1 + 1e-6))]"


def _shared(a: str, b: str) -> tuple[str, str, str]:
    x, y = f"greatest(0.0, least({a}2, {b}2) - greatest({a}0, {b}0))", f"greatest(0.0, least({a}3, {b}3) - greatest({a}1, {b}1))"
    return x, y, f"({x} * {y} / (({a}2 - {a}0) * ({a}3 - {a}1) + ({b}2 - {b}0) * ({b}3 - {b}1) - {x} * {y}))"


def _logs(a: str, b: str) -> str:
    return f"ln((({a}2 - {a}0) * ({a}3 - {a}1) + 1e-6) / (({b}2 - {b}0) * ({b}3 - {b}1) + 1e-6))"


def _pair(a: str, b: str) -> str:
    return f"{_ten(a)} || [least({a}0, 1), least({a}1, 1), least(1 - {a}2, 1), least(1 - {a}3, 1)] || [{_shared(a, b)[2]}, ({a}0 + {a}2 - {b}0 - {b}2) / 2, ({a}1 + {a}3 - {b}1 - {b}3) / 2, {_logs(a, b)}]"


def _reference(a: str, b: str, score: str) -> str:
    x, y, overlap = _shared(a, b)
    dx, dy = f"(({a}0 + {a}2 - {b}0 - {b}2) / 2)", f"(({a}1 + {a}3 - {b}1 - {b}3) / 2)"
    parts = f"{x} * {y} / (({a}2 - {a}0) * ({a}3 - {a}1)), {x} * {y} / (({b}2 - {b}0) * ({b}3 - {b}1)), {x} / least({a}2 - {a}0, {b}2 - {b}0), {y} / least({a}3 - {a}1, {b}3 - {b}1)"
    return f"{_ten(a)} || {_ten(b)} || [{score}, {dx}, {dy}, abs({dx}), abs({dy}), sqrt({dx} * {dx} + {dy} * {dy}), {_logs(a, b)}, {overlap}, {parts}]"


_HOT = "[CAST(rel = 'left' AS DOUBLE), CAST(rel = 'right' AS DOUBLE), CAST(rel = 'above' AS DOUBLE)]"


@query(
    _BOXES
    + f""", n AS (SELECT (gx1 + bs) / 200 AS b0, y1 / 40 AS b1, (gx2 + bs) / 200 AS b2, y2 / 40 AS b3, gx1 / 200 AS g0, y1 / 40 AS g1, gx2 / 200 AS g2, y2 / 40 AS g3,
  (gx1 + cs) / 200 AS c0, y1 / 40 AS c1, (gx2 + cs) / 200 AS c2, y2 / 40 AS c3, l_tax AS s1, l_discount - 0.05 AS s2, CASE l_linenumber % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'above' END AS rel FROM i WHERE bs IS NOT NULL),
w AS (SELECT *, greatest(s1, 0.0) AS p1, greatest(s2, 0.0) AS p2, {_reference('b', 'g', 's1')} AS r1, {_reference('b', 'c', 's2')} AS r2, {_reference('g', 'g', 's1')} AS q1, {_reference('g', 'c', 's2')} AS q2, {_pair('b', 'c')} AS pair FROM n),
v AS (SELECT *, CASE WHEN p1 + p2 > 0 THEN p1 / (p1 + p2) ELSE 0.5 END AS a, CASE WHEN p1 + p2 > 0 THEN p2 / (p1 + p2) ELSE 0.5 END AS z, [0.4, greatest(p1, p2), (p1 + p2) / 2] AS last FROM w),
x AS (SELECT *, [r1[k] * a + r2[k] * z FOR k IN range(1, 33)] || [greatest(r1[k], r2[k]) FOR k IN range(1, 33)] || last AS cb, [q1[k] * a + q2[k] * z FOR k IN range(1, 33)] || [greatest(q1[k], q2[k]) FOR k IN range(1, 33)] || last AS cg FROM v),
l AS (SELECT 'pair' AS vector, pair AS v FROM x UNION ALL SELECT 'context', {_HOT} || cb FROM x
  UNION ALL SELECT 'comparison', {_HOT} || [({_ten('g')} || cg)[k] - ({_ten('b')} || cb)[k] FOR k IN range(1, 78)] FROM x),
e AS (SELECT vector, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS place FROM l)
SELECT vector, CAST(place AS INT) AS place, round(avg(value), 8) + 0.0 AS mean FROM e GROUP BY ALL"""
)
def feature_vectors(spark, sf_dir):
    """Mean of each place of the pair, context and comparison vectors of the line items' boxes, with two proposals."""
    r = box_rows(spark, sf_dir).where("baseline is not null")
    w, h, k, names = F.lit(200.0), F.lit(40.0), F.col("l_linenumber") % 3, ["left", "right", "above"]
    relation = F.when(k == 0, "left").when(k == 1, "right").otherwise("above")
    proposals = F.array(F.struct(F.col("gt").alias("box"), F.col("l_tax").alias("score")), F.struct(F.col("challenger").alias("box"), (F.col("l_discount") - 0.05).alias("score")))
    b, made = F.col("baseline"), {}
    made["pair"] = g.pair_features(b, F.col("challenger"), w, h)
    made["context"] = g.context_features(b, F.col("proposals"), F.col("relation"), names, w, h)
    made["comparison"] = g.comparison_features(b, F.col("gt"), F.col("proposals"), F.col("relation"), names, w, h)
    r = r.withColumns({"proposals": proposals, "relation": relation})
    out = metrics.mean_by_place(r.select(*[v.alias(n) for n, v in made.items()]), list(made))
    return out.select("vector", "place", (F.round("mean", 8) + 0.0).alias("mean"))


@query(
    _BOXES
    + """, r AS (SELECT l_linenumber, bs, least(greatest(gx1 + bs, 0.0), 100.0) AS x1, least(greatest(gx2 + bs, 0.0), 100.0) AS x2, least(greatest(gx1 + cs, 0.0), 100.0) AS z1, least(greatest(gx2 + cs, 0.0), 100.0) AS z2, y1, least(y2, 100.0) AS y2 FROM i),
k AS (SELECT *, bs IS NOT NULL AND x2 > x1 AS bok, z2 > z1 AS cok FROM r),
l AS (SELECT 'box' AS reader, CASE WHEN bs IS NULL THEN 'not_found' WHEN l_linenumber % 2 = 0 THEN 'json_bbox' ELSE 'auto_xyxy' END AS method, bs IS NOT NULL AS found, CASE WHEN bs IS NOT NULL THEN x1 + x2 END AS xs FROM k
  UNION ALL SELECT 'baseline', CASE WHEN bs IS NULL THEN 'not_found' WHEN bok THEN 'bbox' ELSE 'no_bbox' END, bok, CASE WHEN bok THEN x1 + x2 END FROM k
  UNION ALL SELECT 'challenger', CASE WHEN bok OR cok THEN 'ordered_first_box' ELSE 'no_bbox' END, bok OR cok, CASE WHEN bok THEN x1 + x2 WHEN cok THEN z1 + z2 END FROM k
  UNION ALL SELECT 'described', CASE WHEN (bs IS NULL) OR bok THEN 'canonical_json' ELSE 'inconsistent_exists_bbox' END, bok, CASE WHEN bok THEN x1 + x2 END FROM k
  UNION ALL SELECT 'captioned', CASE WHEN bs IS NULL THEN 'not_found' ELSE 'auto_xyxy' END, bs IS NOT NULL, CASE WHEN bs IS NOT NULL THEN x1 + x2 END FROM k)
SELECT reader, method, found, count(*) AS n, round(avg(xs), 6) AS mean_sides FROM l GROUP BY ALL"""
)
def parsed_boxes(spark, sf_dir):
    """Boxes written as model output in the known forms and read back in an image of 100 by 100; each different text is read once."""
    r = box_rows(spark, sf_dir).groupBy("baseline", "challenger", (F.col("l_linenumber") % 2).alias("odd")).agg(F.count(F.lit(1)).alias("n"))
    box, none, line = F.to_json("baseline"), F.col("baseline").isNull(), F.col("odd")
    keyed = F.to_json(F.struct(F.col("baseline").alias("bbox")))
    whole = F.lit(100)
    said = {
        "box": F.when(none, "Not found.").when(line == 0, keyed).otherwise(F.concat(F.lit("it is at "), box)),
        "baseline": F.when(none, "not found").otherwise(F.concat(F.lit("here:\n```json\n"), keyed, F.lit("\n```"))),
        "challenger": F.concat(F.lit("first, second: ["), F.concat_ws(", ", box, F.to_json("challenger")), F.lit("]")),
        "described": F.concat(F.lit('{"description": "a dog", "exists": "'), F.when(none, "no").otherwise("yes"), F.lit('", "bbox": '), F.when(none, '"not found"').otherwise(box), F.lit("} as asked")),
        "captioned": F.concat(F.lit('{"description": "a dog", "bbox": '), F.when(none, '"not found"').otherwise(box), F.lit("}")),
    }
    fields = {"box": ("parse_method", "pred_bbox_xyxy"), "baseline": ("parse_method", "pred_bbox_xyxy"), "challenger": ("parse_method", "selected_bbox_xyxy"), "described": ("parse_method", "pred_bbox_xyxy"), "captioned": ("bbox_parse_method", "pred_bbox_xyxy")}
    parts = []
    for name, words in said.items():
        read = getattr(parsing, f"read_{name}")
        texts = r.select(words.alias("text"), "n").groupBy("text").agg(F.sum("n").alias("n"))
        p, (method, found) = texts.select(read(F.col("text"), whole, whole).alias("p"), "n"), fields[name]
        parts.append(p.select(F.lit(name).alias("reader"), F.col(f"p.{method}").alias("method"), F.col(f"p.{found}").alias("b"), "n"))
    out = evaluation.union_all(parts).groupBy("reader", "method", F.col("b").isNotNull().alias("found"))
    total = F.sum((F.col("b")[0] + F.col("b")[2]) * F.col("n"))
    return out.agg(F.sum("n").alias("n"), F.round(total / F.sum(F.when(F.col("b").isNotNull(), F.col("n"))), 6).alias("mean_sides"))


def _bag(words: str) -> str:
    stop, known = ", ".join(f"'{w}'" for w in text.STOP_WORDS), " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.SYNONYMS.items())
    whole = f"[CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END FOR w IN regexp_split_to_array(lower({words}), '[^a-z0-9]+') IF length(w) > 1 AND w NOT IN ({stop})]"
    return f"[CASE w {known} ELSE w END FOR w IN {whole}]"


@query(
    f"""WITH c AS (SELECT conv_id, turn, row_number() OVER () AS r, {_bag("'two cats on a couch, cats ' || text")} AS p, {_bag("'a cat, one dog and the sofas ' || role")} AS q, {_bag("role || 's and a couch'")} AS pos, {_bag("'dogs cats birds'")} AS neg FROM conversations),
a AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(p) AS w FROM c) GROUP BY ALL), b AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(q) AS w FROM c) GROUP BY ALL),
d AS (SELECT r, sum(a.n * b.n) AS dot FROM a JOIN b USING (r, w) GROUP BY 1), x AS (SELECT r, sqrt(sum(n * n)) AS s FROM a GROUP BY 1), y AS (SELECT r, sqrt(sum(n * n)) AS s FROM b GROUP BY 1),
k AS (SELECT c.*, coalesce(dot / (x.s * y.s), 0) AS cosine, len(list_intersect(list_distinct(p), list_distinct(pos))) / greatest(1, len(list_distinct(pos))) AS cover, len(list_intersect(list_distinct(p), list_distinct(neg))) / greatest(1, len(list_distinct(neg))) AS bad
  FROM c JOIN x USING (r) JOIN y USING (r) LEFT JOIN d USING (r))
SELECT conv_id, turn, round(cosine, 9) AS cosine, round(greatest(0.0, cosine * (1 - 0.5 * bad)), 9) AS penalised, round(cover, 9) AS positive_cover, round(bad, 9) AS negative_overlap FROM k"""
)
def caption_cosine(spark, sf_dir):
    """Captions made of the turns against references made of the roles."""
    join = lambda *c: F.concat(*[F.lit(x) if " " in x else F.col(x) for x in c])
    c = table(spark, sf_dir, "conversations")
    s = text.caption_scores(join("two cats on a couch, cats ", "text"), join("a cat, one dog and the sofas ", "role"), join("role", "s and a couch"), F.lit("dogs cats birds"))
    return rounded(c.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.cosine", "s.penalised", "s.positive_cover", "s.negative_overlap"))


#: Words and pairs of the texts as aliases; the first of a pair is no second of another.
_NAMED = {"article": ("la", "le", "les", "die", "der"), "source": ("de", "de la", "de le"), "thing": ("thing", "things"), "denial": ("nicht", "ist nicht", "no")}


def _mention_sql() -> str:
    owner = " ".join(f"WHEN word = '{a}' THEN '{c}'" for c, names in _NAMED.items() for a in names if " " not in a)
    pairs = " ".join(f"WHEN word || gap || next = '{a}' THEN '{c}'" for c, names in _NAMED.items() for a in names if " " in a)
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(low, '[\\pL\\pN_]+') AS words, regexp_split_to_array(low, '[\\pL\\pN_]+') AS gaps FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS low FROM documents)),
w AS (SELECT doc_id, length(gaps[1]) AS lead, unnest(words) AS word, unnest(gaps[2:]) AS gap, generate_subscripts(words, 1) AS k FROM d),
p AS (SELECT *, lead(word) OVER o AS next, lead + coalesce(sum(length(word) + length(gap)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w WHERE word IS NOT NULL WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
m AS (SELECT *, CASE {pairs} END AS pair, CASE {owner} END AS single FROM p),
n AS (SELECT *, lag(pair) OVER (PARTITION BY doc_id ORDER BY k) AS inside FROM m),
f AS (SELECT doc_id, coalesce(pair, CASE WHEN inside IS NULL THEN single END) AS category, start, pair IS NOT NULL AS wide FROM n)
SELECT doc_id, category, count(*) AS n, CAST(count(*) FILTER (wide) AS BIGINT) AS pairs, CAST(sum(start) AS BIGINT) AS places FROM f WHERE category IS NOT NULL GROUP BY 1, 2"""


@query(_mention_sql())
def category_mentions(spark, sf_dir):
    """Mentions of a table of aliases in whole documents: by category their number, those of two words, and the sum of their places."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mentions.find_mentions(d, ["doc_id"], "text", mentions.alias_table(spark, list(_NAMED), _NAMED))
    return found.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("alias").contains(" ")).alias("pairs"), F.sum("start").alias("places"))


@query(
    """SELECT page_id, 'the "big" dog - no ' || page_id AS canonical, CASE page_id % 3 WHEN 0 THEN '{"a": ' || page_id || '}' WHEN 1 THEN '{"b": 2}' END AS object, CAST(page_id AS DOUBLE) AS first_number, 3 AS n_numbers,
  CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS DOUBLE) ELSE 1.0 END AS left_side, CASE WHEN page_id % 2 = 0 THEN page_id + 9.0 ELSE 5.5 END AS right_side,
  CASE page_id % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'attribute,relation' ELSE '' END AS stated FROM pages"""
)
def reply_texts(spark, sf_dir):
    """Canonical text, the object of a reply, numbers, box cells and the false claims of a caption."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("```json\n{\"a\": "), i, F.lit("}\n```"))).when(k == 1, 'as asked: {"b": 2} so').otherwise("no object")
    cell = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("["), i, F.lit(", 7, "), (F.col("page_id") + 9).cast("string"), F.lit(", 3]"))).otherwise("5.5 and 6, 1 then 2")
    none = F.lit(None).cast("string")
    unit = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[(F.lit(f[n]) if n in f else none).alias(n) for n in ("object", "attribute", "subject", "relation", "target_object")])
    units = F.array(unit("object", object="a frisbee"), unit("attribute", attribute="red"), unit("relation", subject="dog", relation="on", target_object="the sofa"))
    caption = F.when(k == 0, "a dog with a Frisbee").when(k == 1, "a red ball and a dog on a couch").otherwise("a cat")
    p = table(spark, sf_dir, "pages").withColumns({"reply": reply, "cell": cell, "caption": caption, "fancy": F.concat(F.lit("the  \u201cｂｉｇ\u201d dog \u2014 no\u00a0"), i)})
    p = p.withColumns({"box": g.from_text(F.col("cell")), "stated": text.stated_units(F.col("caption"), units, none, none), "numbers": text.numbers(F.concat(i, F.lit(" of 2 and -3.5")))})
    return p.select(
        "page_id", text.canonical(F.col("fancy")).alias("canonical"), parsing.json_object(F.col("reply")).alias("object"), F.col("numbers")[0].alias("first_number"), F.size("numbers").alias("n_numbers"),
        F.col("box")[0].alias("left_side"), F.col("box")[2].alias("right_side"), F.array_join(F.transform("stated", lambda u: u["type"]), ",").alias("stated"),
    )


@query(
    f"""SELECT {_KEYS}, round(l_quantity, 6) AS low, round(l_quantity + 10 + 100 * l_discount, 6) AS high, CASE WHEN l_linenumber <> 2 THEN round(least(l_quantity + 10 + 100 * l_discount, 30.0), 6) END AS held,
  round(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_tax END, 9) AS known, l_linenumber || '-' || l_returnflag AS row_key FROM lineitem WHERE l_quantity < 30"""
)
def box_forms(spark, sf_dir):
    """Corners put in order, boxes held in an image and null where a number is missing; overlaps that default to 0; keys of rows."""
    r = table(spark, sf_dir, "lineitem").where("l_quantity < 30")
    q, right, none = F.col("l_quantity"), F.col("l_quantity") + 10 + 100 * F.col("l_discount"), F.lit(None).cast("double")
    b = F.array(right, F.lit(9.0), q, F.lit(2.0))
    r = r.withColumns({"b": b, "o": g.ordered(b), "h": g.normalised(F.array(right, F.when(F.col("l_linenumber") != 2, F.lit(9.0)).otherwise(none), q, F.lit(2.0)), F.lit(30), F.lit(10))})
    key = manifests.row_key("l_linenumber", "l_returnflag")
    return r.select(
        *_KEY, F.round(F.col("o")[0], 6).alias("low"), F.round(F.col("o")[2], 6).alias("high"), F.round(F.col("h")[2], 6).alias("held"),
        F.round(manifests.overlap_or_zero(F.when(F.col("l_linenumber") != 3, F.col("l_tax"))), 9).alias("known"), F.concat_ws("-", key["l_linenumber"], key["l_returnflag"]).alias("row_key"),
    )
