import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import geometry as g
from tallyforge.functions import parsing, relations, text
from tallyforge.operators import metrics
from tallyforge.plans import shapes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def size(w=100, h=100):
    return F.lit(w), F.lit(h)


def test_shift_turns_back_at_the_edge(spark):
    assert one(spark, g.shifted(box(70, 10, 90, 20), F.lit(15.0), F.lit(0.0), *size())) == [55, 10, 75, 20]
    assert one(spark, g.shifted(box(10, 10, 30, 20), F.lit(15.0), F.lit(5.0), *size())) == [25, 15, 45, 25]


def test_perturbed_boxes_overlap_less(spark):
    rows = one(spark, g.perturbed(box(20, 20, 60, 40), *size()))
    assert [r["kind"] for r in rows] == ["partial_horizontal", "partial_vertical", "oversized_context", "jitter_horizontal", "jitter_vertical"]
    assert [r["box"] for r in rows][2] == [4, 12, 76, 48] and all(r["iou"] < 0.95 for r in rows)
    whole = one(spark, g.perturbed(box(0, 0, 100, 100), *size()))
    assert [r["kind"] for r in whole] == ["partial_horizontal", "partial_vertical"]  # context and shifts give the box itself


def test_whole_pixels_and_cells(spark):
    assert one(spark, g.pixels(box(0.5, 2.5, 0.6, 250), *size())) == [0, 2, 1, 100]
    assert one(spark, g.from_text(F.lit("[9, 1, 2, 8]"))) == [2, 1, 9, 8]
    assert one(spark, g.from_text(F.lit("at 1 2 then 3.5 4"))) == [1, 2, 3.5, 4]
    assert one(spark, g.from_text(F.lit("null"))) is None
    assert one(spark, g.normalised(box(5, 5, 5, 9))) is None and one(spark, g.normalised(box(9, 9, 1, 1))) == [1, 1, 9, 9]


def plain_features(b, w, h):
    x1, y1, x2, y2 = b[0] / w, b[1] / h, b[2] / w, b[3] / h
    return [x1, y1, x2, y2, x2 - x1, y2 - y1, (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * (y2 - y1), math.log((x2 - x1 + 1e-6) / (y2 - y1 + 1e-6))]


def test_feature_vectors(spark):
    a, b = (10, 10, 50, 40), (30, 20, 90, 80)
    assert one(spark, g.box_features(box(*a), *size())) == pytest.approx(plain_features(a, 100, 100))
    pair = one(spark, g.pair_features(box(*a), box(*b), *size()))
    assert len(pair) == 18 and pair[14] == pytest.approx(400 / (1200 + 3600 - 400)) and pair[15] == pytest.approx(-0.3)
    ref = one(spark, g.reference_features(box(*a), box(*b), F.lit(0.5), *size()))
    assert len(ref) == 32 and ref[20] == 0.5 and ref[28] == pytest.approx(1 / 3) and ref[30] == pytest.approx(0.5)
    props = F.array(*[F.struct(box(*x).alias("box"), F.lit(s).alias("score")) for x, s in ((a, 0.25), (b, 0.75))])
    names = list(relations.RELATIONS)
    ctx = one(spark, g.context_features(box(*a), props, F.lit("on"), names, *size()))
    own = one(spark, g.reference_features(box(*a), box(*a), F.lit(0.25), *size()))
    other = one(spark, g.reference_features(box(*a), box(*b), F.lit(0.75), *size()))
    assert len(ctx) == 85 and ctx[:18] == [float(n == "on") for n in names]
    assert ctx[18:50] == pytest.approx([0.25 * x + 0.75 * y for x, y in zip(own, other)])
    assert ctx[50:82] == pytest.approx([max(p) for p in zip(own, other)]) and ctx[82:] == pytest.approx([0.4, 0.75, 0.5])
    forward = one(spark, g.comparison_features(box(*a), box(*b), props, F.lit("on"), names, *size()))
    back = one(spark, g.comparison_features(box(*b), box(*a), props, F.lit("on"), names, *size()))
    assert len(forward) == 95 and forward[18:] == pytest.approx([-v for v in back[18:]])
    assert one(spark, g.best_index(F.array(box(*b), box(*a), box(*a)), box(*a))) == 1
    assert one(spark, g.best_index(F.array(box(*b)), box(*a))) is None


def plain_reference(b, r, score, w, h):
    o, f = plain_features(b, w, h), plain_features(r, w, h)
    dx, dy = o[6] - f[6], o[7] - f[7]
    across, down = (max(0.0, min(o[k + 2], f[k + 2]) - max(o[k], f[k])) for k in (0, 1))
    shared = across * down
    return [*o, *f, score, dx, dy, abs(dx), abs(dy), math.hypot(dx, dy), math.log((o[8] + 1e-6) / (f[8] + 1e-6)), shared / (o[8] + f[8] - shared), shared / o[8], shared / f[8], across / min(o[4], f[4]), down / min(o[5], f[5])]


def plain_context(b, proposals, w, h):
    rows, scores = [plain_reference(b, r, s, w, h) for r, s in proposals], [max(0.0, s) for _, s in proposals]
    weights = [s / sum(scores) if sum(scores) else 1 / len(scores) for s in scores]
    return [*(sum(v * k for v, k in zip(column, weights)) for column in zip(*rows)), *map(max, zip(*rows)), len(rows) / 5, max(scores), sum(scores) / len(scores)]


def test_context_of_many_rows(spark):
    """One to five proposals a row, scores below 0, none at all and no box, against plain loops; 20,000 rows in a moment."""
    rng, rows = random.Random(4), []
    shape = lambda: [x := rng.uniform(0, 80), y := rng.uniform(0, 60), x + rng.uniform(1, 40), y + rng.uniform(1, 30)]
    for k in range(300):
        rows.append((k, shape(), shape(), [(shape(), rng.uniform(-0.5, 1)) for _ in range(k % 6)] if k % 50 else None))
    rows += [(300, shape(), shape(), [(shape(), -1.0), (shape(), -0.5)]), (301, None, shape(), [(shape(), 0.5)])]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>, p array<struct<box:array<double>,score:double>>").repartition(3)
    w, h = F.lit(100.0), F.lit(80)
    names = ["on", "under"]
    made = {"context": g.context_features(F.col("a"), F.col("p"), F.lit("on"), names, w, h), "utility": g.utility_features(F.col("a"), F.col("p"), F.lit("on"), names, w, h), "compared": g.comparison_features(F.col("a"), F.col("b"), F.col("p"), F.lit("on"), names, w, h)}
    got = {r["k"]: r for r in df.select("k", *[v.alias(n) for n, v in made.items()]).collect()}
    sums = [0.0] * 69
    for k, a, b, p in rows[:-1]:
        if not p:
            assert got[k]["context"] is None and got[k]["utility"] is None and got[k]["compared"] is None
            continue
        context = plain_context(a, p, 100, 80)
        first, second = [*plain_features(a, 100, 80), *context], [*plain_features(b, 100, 80), *plain_context(b, p, 100, 80)]
        assert got[k]["context"] == pytest.approx([1, 0, *context]) and got[k]["utility"] == pytest.approx(first)
        assert got[k]["compared"] == pytest.approx([1, 0, *(y - x for x, y in zip(first, second))])
        sums = [x + y for x, y in zip(sums, [1, 0, *context])]
    assert got[301]["context"][2:12] == [None] * 10 and len(got[301]["context"]) == 69
    means = metrics.mean_by_place(df.where("k < 301").select(made["context"].alias("c")), ["c"]).orderBy("place").collect()
    n = sum(bool(r[3]) for r in rows[:-1])
    assert [r["mean"] for r in means] == pytest.approx([v / n for v in sums]) and [r["place"] for r in means] == list(range(69))


def test_vectors_are_made_once_for_a_row(spark):
    """Each vector is a step of Arrow batches; written out natively, their plan had thousands of terms, worked out row by row."""
    p = F.array(F.struct(F.col("a").alias("box"), F.lit(0.5).alias("score")))
    df = spark.range(1).select(F.array(*map(F.lit, (1.0, 1.0, 2.0, 2.0))).alias("a"))
    plan = df.select(g.comparison_features(F.col("a"), F.col("a"), p, F.lit("on"), ["on"], F.lit(9.0), F.lit(9.0)))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 3000 and "lambda" not in plan


def test_relations(spark):
    r = lambda q: one(spark, relations.relation(F.lit(q)))
    assert (r("man on a horse next to a tree"), r("cup"), r("LEFT of it")) == ("next_to", None, "to_the_left_of")
    assert one(spark, relations.relation_score(F.lit("the man on, (left) on Right."))) == 3
    p = lambda q: one(spark, relations.reference_phrase(F.lit(q)))
    assert (p("dog behind the red car."), p("dog behind"), p("dog")) == ("red car", None, None)
    found = relations.mentions(F.lit("hot dog near a dog and dogs"), ["dog", "hot dog"])
    assert [(m["category"], m["start"]) for m in one(spark, found)] == [("hot dog", 0), ("dog", 15), ("dog", 23)]
    assert one(spark, relations.reference_categories(found, F.lit("dog"))) == ["hot dog"]
    twice = relations.mentions(F.lit("a dog and a pup"), ["dog"], {"dog": ["dog", "pup"]})
    assert one(spark, relations.reference_categories(twice, F.lit("dog"))) == ["dog"]
    assert one(spark, relations.mentions(F.lit(None).cast("string"), ["dog"])) == []
    equal = relations.mentions(F.lit("a big red cat, red dog"), ["y", "x", "z"], {"x": ["big red"], "y": ["red cat"], "z": ["red", "red dog"]})
    assert [(m["category"], m["start"], m["end"]) for m in one(spark, equal)] == [("x", 2, 9), ("z", 15, 22)]
    shared = relations.mentions(F.lit("cup cups"), ["b", "a"], {"a": ["cup"], "b": ["cup"]})
    assert [(m["category"], m["alias"]) for m in one(spark, shared)] == [("b", "cup")]


def test_caption_scores_and_units(spark):
    s = one(spark, text.caption_scores(F.lit("two dogs"), F.lit("two dog"), F.lit("dog"), F.lit("dog cat")))
    assert (s["cosine"], s["positive_cover"], s["negative_overlap"]) == (pytest.approx(1.0), 1.0, 0.5) and s["penalised"] == pytest.approx(0.75)
    assert one(spark, text.caption_scores(F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("")))["cosine"] == 0.0
    kind = "array<struct<type:string,object:string,attribute:string,subject:string,relation:string,target_object:string>>"
    units = F.from_json(F.lit('[{"type":"object","object":"the woman"},{"type":"attribute","attribute":"blue"},{"type":"relation","subject":"man","relation":"on","target_object":"bike"}]'), kind)
    kept = one(spark, text.stated_units(F.lit("A man on a blue bicycle"), units, F.lit(None).cast("string"), F.lit("sofa")))
    assert [u["type"] for u in kept] == ["object", "relation"]


def test_yes_no_forms_and_numbers(spark):
    a = lambda t: tuple(one(spark, text.yes_no_answer(F.lit(t))))
    assert a("Yes, it is") == (True, True, "prefix") and a("I say no") == (False, True, "single_token")
    assert a("it was not found") == (False, True, "not_found") and a("Present") == (True, True, "alias_yes")
    assert a("maybe") == (False, False, "parse_fail_default_no") and a("either yes or no")[1] is False
    assert one(spark, text.four_numbers(F.lit("7 [1, 2.5, -3, 4e1] 5"))) == [1, 2.5, -3, 40]
    assert one(spark, text.four_numbers(F.lit("1 2 3"))) is None
    assert one(spark, text.canonical(F.lit("“ﬁne”  x—y"))) == '"fine" x-y'


BOXES = [
    ('{"bbox": [10, 20, 30, 40]}', [10, 20, 30, 40], "json_bbox"),
    ("(1,2),(30,40)", [1, 2, 30, 40], "paren_bbox"),
    ("[0.1, 0.2, 0.5, 0.6]", [10, 20, 50, 60], "auto_xyxy"),
    ("[50, 60, 20, 10]", [50, 60, 70, 70], "auto_xywh"),
    ("not found", None, "not_found"),
    ('{"bbox_2d": [0.1, 0.2, 0.5, 0.6], "label": "x"}', [10, 20, 50, 60], "json_bbox"),
    ('{"bbox": ["a", 2, 3, 4]} (1, 2) (3, 9)', [1, 2, 3, 9], "paren_bbox"),
    ("<answer> None </answer>", None, "not_found"),
    ("x 4, y 5, to 40 by 50", [4, 5, 40, 50], "auto_xyxy"),
    ("a cat", None, "no_bbox"),
    (None, None, "no_bbox"),
]


@pytest.mark.parametrize("raw,expected,method", BOXES)
def test_any_box(raw, expected, method):
    row = parsing.any_box(raw, 100, 100)
    assert (row["pred_bbox_xyxy"], row["parse_method"]) == (expected, method)


def test_readers(spark):
    c = parsing.candidate_boxes
    assert c('x ```json\n{"boxes": [[1,2,3,4],[1,2,3,4],[5,6,7,8]]}\n```', 100, 100, 3) == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert c("see (9, 8, 7, 6)", 100, 100, 3) == [[7, 6, 9, 8]] and c("[5,5,5,5]", 100, 100, 1) == []
    assert parsing.baseline("<answer>none</answer>", 9, 9)["parse_method"] == "not_found"
    d = parsing.described('{"description": "a cat", "exists": "yes", "bbox": [1,2,3,4]"}', 100, 100)
    assert d["parse_valid"] and d["pred_bbox_xyxy"] == [1, 2, 3, 4]
    assert parsing.described('{"description": "a", "exists": "no", "bbox": "not found"} tail', 9, 9)["parse_valid"]
    o = parsing.lenient_object
    assert o('see ```json\n[1, {"a": 1}]\n``` and {"b": 2}') == {"a": 1} and o("[1, 2]") is None and o("{") is None and o("") is None
    assert o('so {"a": {"b": 1}} there') == {"a": {"b": 1}}
    assert parsing.described('{"description": "a", "exists": "no", "bbox": [1,2,3,4]}', 9, 9)["parse_method"] == "inconsistent_exists_bbox"
    k = parsing.captioned('{"exists": "no", "bbox": "not found", "description": "d"}', 9, 9)
    assert (k["pred_exists"], k["pred_found"], k["generated_description"]) == (False, False, "d")
    assert parsing.captioned("Caption: a cat [1,2,3,4]", 9, 9)["generated_description"] == "a cat"
    df = spark.createDataFrame([("[1,2,3,4]",), (None,)], "t string")
    for read in (parsing.read_baseline, parsing.read_box, parsing.read_challenger, parsing.read_described, parsing.read_captioned):
        assert df.select(read(F.col("t"), F.lit(10), F.lit(10)).alias("r")).count() == 2
    got = [r["r"]["pred_bbox_xyxy"] for r in df.select(parsing.read_box(F.col("t"), F.lit(10), F.lit(10)).alias("r")).collect()]
    assert got == [[1, 2, 3, 4], None]
    assert one(spark, parsing.json_object(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, parsing.json_object(F.lit('so {"a":1} ok'))) == '{"a":1}' and one(spark, parsing.json_object(F.lit("no"))) is None


def test_equal_texts_are_read_once(spark, tmp_path, monkeypatch):
    """Ten copies of the line items are read as often as one of them, and counted ten times."""
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 100")
    calls = spark.sparkContext.accumulator(0)

    def counted(text, width, height):
        calls.add(1)
        return parsing.captioned(text, width, height)

    schema = "generated_description:string,pred_exists:boolean,pred_bbox_xyxy:array<double>,pred_found:boolean,bbox_parse_valid:boolean,bbox_parse_method:string"
    monkeypatch.setattr(parsing, "read_captioned", parsing._reader(counted, schema))
    found, read = [], []
    for copies in (1, 10):
        place = tmp_path / str(copies)
        li.crossJoin(spark.range(copies).drop("id")).write.parquet(f"{place}/lineitem.parquet")
        before = calls.value
        found.append({tuple(r)[:3]: (r["n"] * 10 // copies, r["mean_sides"]) for r in shapes.parsed_boxes(spark, str(place)).collect()})
        read.append(calls.value - before)
    assert 0 < read[0] == read[1] and found[0] == found[1] and len(found[0]) > 8
