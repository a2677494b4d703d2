import pytest
from pyspark.sql import functions as F

from tallyforge.functions import geometry as g
from tallyforge.functions import hashing, text
from tallyforge.operators import decisions, isolation, joins, logs, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_overlap_and_missing_policies(spark):
    assert one(spark, g.iou(box(0, 0, 10, 10), box(20, 20, 30, 30))) == 0.0
    assert one(spark, g.iou(box(0, 0, 10, 10), box(0, 0, 5, 10))) == 0.5
    none = F.lit(None).cast("array<double>")
    assert one(spark, g.iou(box(0, 0, 1, 1), none)) is None
    assert one(spark, g.iou(box(0, 0, 1, 1), none, "zero")) == 0.0


def test_clipping(spark):
    assert one(spark, g.xywh_clipped(box(-2, 3, 10, 20), F.lit(6), F.lit(12))) == [0, 3, 6, 12]
    assert one(spark, g.clipped(box(12, 3, 12, 8), F.lit(10), F.lit(10))) is None
    assert one(spark, g.clipped(box(float("nan"), 3, 12, 8), F.lit(10), F.lit(10))) is None
    assert one(spark, g.rescaled(box(0.1, 0.2, 0.5, 0.75), F.lit(100), F.lit(80))) == [10, 16, 50, 60]


def test_suppression_keeps_the_first(spark):
    a, b, c = box(0, 0, 10, 10), box(0, 0, 10, 9.9), box(20, 20, 30, 30)
    assert one(spark, g.suppressed(F.array(a, b, c), 0.9)) == [[0, 0, 10, 10], [20, 20, 30, 30]]


def test_exact_split_ignores_order(spark):
    a = hashing.exact_split(spark.range(100), "id", 0.1, "seed")
    b = hashing.exact_split(spark.range(99, -1, -1), "id", 0.1, "seed")
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.where("data_split = 'train'").count() == 90


def rows(spark):
    data = [("gain", 0.0, 0.8, True, 2.0), ("risk", 0.7, 0.0, True, 1.0), ("locked", 0.0, 0.9, False, 99.0)]
    r = spark.createDataFrame(data, "id string, baseline_iou double, challenger_iou double, selector_eligible boolean, score double")
    best = F.when(F.col("selector_eligible"), F.greatest("baseline_iou", "challenger_iou")).otherwise(F.col("baseline_iou"))
    return r.withColumn("two_box_oracle_iou", best).withColumn("selector_action", F.when(F.col("challenger_iou") > F.col("baseline_iou"), "switch").otherwise("keep"))


def test_selector_metrics_and_safe_threshold(spark):
    m = metrics.selector_metrics(rows(spark), "score").first()
    assert (m["switches"], m["regressions"]) == (2, 1)
    assert m["selector_miou"] == pytest.approx(0.8 / 3) and m["raw_challenger_miou"] == pytest.approx(1.7 / 3)
    t = metrics.safe_threshold(rows(spark), "score", 0).first()
    assert (t["threshold"], t["moved"]) == (1.0, 1)
    forced = metrics.selector_metrics(rows(spark).withColumn("score", F.when(F.col("id") == "gain", -1.0)), "score", 0.0, "challenger").first()
    assert (forced["switches"], forced["regressions"]) == (1, 1)


def test_policy(spark):
    def p(b, c, n, **more):
        v = lambda x: F.lit(x).cast("double")
        return tuple(one(spark, decisions.policy(v(b), v(c), v(n), **more)))[:2]

    assert [p(3, 2, 1)[0], p(2, 3, 1)[0], p(2, 1, 3)[0]] == ["keep", "switch", "reject"]
    assert p(1, 1.2, 0, switch_margin=0.5) == ("keep", "switch_margin_not_met")
    assert p(1, 0, 1.2, reject_margin=0.5) == ("keep", "reject_margin_not_met")
    assert p(None, 5, 0)[0] == "reject" and p(None, 5, 0, recover=True)[0] == "switch"
    # the reject margin is measured from the better box, and a miss keeps the baseline
    assert p(0, 0.9, 1.0, reject_margin=0.5) == ("keep", "reject_margin_not_met") and p(0, 0.4, 1.0, reject_margin=0.5) == ("reject", "joint_argmax")
    assert p(1, 1, 1) == ("keep", "joint_argmax") and p(0, 1, 1)[0] == "reject"
    full = one(spark, decisions.policy(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert full["probabilities"] == pytest.approx([1 / 3] * 3) and full["confidence"] == pytest.approx(1 / 3)
    alone = one(spark, decisions.policy(F.lit(None).cast("double"), F.lit(9.0), F.lit(0.0)))
    assert alone["probabilities"] == [0.0, 0.0, 1.0]


def test_review_log_rules(spark):
    df = spark.createDataFrame([("a", "r", "completed", 1), ("a", "r", "draft", 2), ("b", "r", "completed", 3)], "s string, r string, status string, pos int")
    done = F.col("status") == "completed"
    assert [x["s"] for x in logs.latest_then(df, ["s"], "pos", done).collect()] == ["b"]
    assert sorted(x["s"] for x in logs.then_latest(df, ["s"], "pos", done).collect()) == ["a", "b"]
    two = spark.createDataFrame([("g", "r1", "draft", 1), ("g", "r2", "completed", 2), ("g", "r1", "completed", 3)], "s string, r string, status string, pos int")
    assert logs.review_winner(two, ["s"], "r", "pos", done).first()["r"] == "r2"


def test_isolation(spark):
    df = spark.createDataFrame([("dev", 1), ("train", 1), ("train", 2)], "split string, image int")
    o = isolation.overlaps(df, "split", ["image"]).first()
    assert (o["shared"], o["examples"]) == (1, ["1"])


def test_violations_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "d int")
    with pytest.raises(ValueError, match="missing_dim: 1"):
        joins.assert_clean(joins.enriched(a, b, "k", "d", "dim"))


def test_text(spark):
    assert one(spark, text.image_number(F.lit("COCO_train2014_000000445503.jpg"))) == 445503
    assert one(spark, text.yes_no(F.lit("<answer> Yes, it is</answer>"))) is True
    assert one(spark, text.tokens(F.lit("ｃａｔ and ﬁre"))) == ["cat", "fire"] and one(spark, text.yes_no(F.lit("ＹＥＳ"))) is True
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(spark, text.bag_cosine(words("a", "b", "a"), words("a", "c"))) == pytest.approx(2 / 10**0.5)
    assert one(spark, text.bag_cosine(words("a"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, text.bag_cosine(text.tokens(F.lit("two cats")), text.tokens(F.lit("two cat")))) == pytest.approx(1.0)


def test_registered_sql_matches(spark, tmp_path):
    import os

    import duckdb

    import __spark_entry__
    from tallyforge.plans import catalog

    assert __spark_entry__.queries().keys() >= catalog.QUERIES.keys()
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    for name in catalog.ORACLES:
        df = catalog.QUERIES[name](spark, sf)
        got = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
        r = con.sql(catalog.ORACLES[name])
        columns = [c[0] for c in r.description]
        assert got == sorted(tuple(str(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall()), name


def test_typed_rates_bootstrap_and_summary(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1), ("a", 0, 0.5, 2), ("b", 1, 1.0, 3)], "t string, y int, v double, pos int")
    r = metrics.typed_rates(df, "t", F.col("y") == 1).first()
    assert (r["macro"], r["pooled"]) == (0.75, pytest.approx(2 / 3))
    b = {x["t"]: x for x in metrics.bootstrap_mean(df, "v", "pos", "t").collect()}
    assert b["b"]["ci_lower"] is None and (b["a"]["ci_lower"], b["a"]["ci_upper"]) == (0.0, 0.5)
    s = metrics.metric_summary(df.limit(0), "v", F.col("y") == 1).first()
    assert (s["n"], s["mean_iou"], s["found_rate"]) == (0, 0.0, 0.0)
    assert one(spark, decisions.candidate_logit([F.lit(v) for v in (1.0, 2.0, 1.0)], [1, 1, -2])) == 1.0
