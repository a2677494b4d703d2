import pytest
from pyspark.sql import functions as F

from tallyforge.functions import parsing
from tallyforge.operators import manifests


def test_keys_and_specs(spark):
    df = spark.createDataFrame([("t", "a/b.jpg", "The  Dog", None, None), ("t", "b.jpg/", None, True, 0.25)], "task string, image string, query string, there boolean, iou double")
    rows = df.select(manifests.output_key(F.col("task"), F.col("image"), F.col("query"), F.col("there")).alias("k"), manifests.overlap_or_zero(F.col("iou")).alias("o"), manifests.with_interval(F.lit(0.5), F.col("iou"), F.col("iou")).alias("i")).collect()
    assert [r["k"]["image"] for r in rows] == ["b.jpg", "b.jpg"] and [r["k"]["exists"] for r in rows] == [False, True] and rows[1]["k"]["query"] in (None, "")
    assert [r["o"] for r in rows] == [0.0, 0.25] and [r["i"]["ci_level"] for r in rows] == [None, 0.95]
    assert manifests.spec_digest({"a": 1, "b": 2}) == manifests.spec_digest({"b": 2, "a": 1}) != manifests.spec_digest({"a": 1})
    assert manifests.chosen({"x": {"n": 1}, "y": {"n": 2}}, ["y"]) == [{"name": "y", "n": 2}]
    with pytest.raises(ValueError):
        manifests.chosen({"x": {}}, ["z"])


def test_statistics_of_awkward_and_empty_tables(spark):
    refs = spark.createDataFrame([(1, ["a", "b"]), (1, []), (2, None), (None, ["c"])], "image_id int, sentences array<string>")
    s = manifests.reference_stats(refs, spark.createDataFrame([(1,), (1,), (9,), (None,)], "image_id int")).first()
    assert (s["original_refs"], s["original_queries"], s["original_images"], s["protected_images"]) == (4, 3, 2, 1)
    assert (s["excluded_refs"], s["excluded_queries"], s["retained_refs"], s["retained_queries"], s["retained_images"]) == (2, 2, 2, 1, 1)
    assert set(manifests.reference_stats(refs.where("false"), refs.select("image_id")).first()) == {0}
    rows = spark.createDataFrame([(1, 1, "d", "person"), (1, 1, "d", "cat"), (1, 2, "e", "person"), (2, 1, None, None)], "i int, t int, d string, c string")
    s = manifests.selection_stats(rows, "i", "t", "d", "c").first()
    assert (s["queries"], s["unique_images"], s["unique_targets"], s["dataset_queries"], s["category_queries"], s["watched_rate"]) == (4, 2, 3, {"d": 2, "e": 1}, {"cat": 1, "person": 2}, 0.5)
    s = manifests.selection_stats(rows.where("false"), "i", "t", "d", "c").first()
    assert (s["queries"], s["unique_targets"], s["dataset_queries"], s["watched_rate"]) == (0, 0, {}, None)


def test_proposals_keep_the_order_of_ties(spark):
    p = [("a", 0.5), ("b", None), ("c", 0.9), ("d", 0.5)]
    df = spark.createDataFrame([(1, p), (2, []), (3, None)], "id int, p array<struct<n:string,score:double>>")
    rows = {r["id"]: r["b"] for r in df.select("id", manifests.best_proposals(F.col("p"), 3).alias("b")).collect()}
    assert [x["n"] for x in rows[1]] == ["c", "a", "d"] and rows[2] == [] and rows[3] is None


def test_assertions(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "error"), (2, "a", None)], "k int, spec string, error string")
    assert manifests.assert_single(df, "spec", F.col("error").isNull()) is df
    for check in (lambda: manifests.assert_single(df, "spec", F.lit(True)), lambda: manifests.assert_unique(df, ["k"]), lambda: manifests.dataset_slice(df, "spec", "a", "spec")):
        with pytest.raises(ValueError):
            check()


def test_requests(spark):
    groups = spark.createDataFrame([(i, "q") for i in range(4)], "id int, query string")
    audits = spark.createDataFrame([(0, "x"), (1, "y"), (3, "z"), (9, "w")], "id int, said string")
    reviews = spark.createDataFrame([(0, 1, True), (0, 2, False), (1, 1, False), (1, 2, True)], "id int, at int, fine boolean")
    done = spark.createDataFrame([(3, None), (0, "error")], "id int, error string")
    rows = manifests.review_requests(groups, audits, reviews, done, "id", "at", F.col("fine"), F.col("error").isNull()).collect()
    assert sorted((r["id"], r["audit"]["said"], r["review"] and r["review"]["at"]) for r in rows) == [(0, "x", None), (1, "y", 2)]
    case = "array<struct<task:string,gt_box:array<double>,baseline_box:array<double>,automatic_baseline_class:string>>"
    df = spark.createDataFrame([(1, [("t2", [0.0, 1.0], [2.0, 3.0], None), ("t4", [0.0, 1.0], None, "c")]), (2, [])], f"id int, cases {case}")
    out = [r["c"] for r in df.select(manifests.request_context(F.col("cases"), {"base": F.col("id")}).alias("c")).collect()]
    assert (out[0]["base"], out[0]["gt_box_xyxy"], [b["task"] for b in out[0]["zero_iou_baselines"]]) == (1, [0.0, 1.0], ["t2", "t4"])
    assert out[1]["gt_box_xyxy"] is None and out[1]["zero_iou_baselines"] == []


def test_reparsing_and_counted_files(spark, tmp_path):
    log = spark.createDataFrame([("a", "[10, 10, 50, 60]", 1), ("b", None, 1)], "id string, raw string, t4 int")
    queue = spark.createDataFrame([("a", 100, 100), ("b", 10, 10), ("c", 1, 1)], "id string, w int, h int")
    again = manifests.reparsed(log, queue, "id", F.col("raw"), "w", "h", parsing.read_baseline, "t4")
    valid = {r["id"]: r["t4"]["parse_valid"] for r in again.collect()}
    assert again.columns == log.columns and valid == {"a": True, "b": False}
    with pytest.raises(Exception, match="not in the queue"):
        manifests.reparsed(log, queue.where("id = 'a'"), "id", F.col("raw"), "w", "h", parsing.read_baseline, "t4").collect()
    assert manifests.write_counted(queue, str(tmp_path / "q"), ["id"]) == 3


def test_evaluation_rows(spark):
    gt, near, far = [0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 10.0, 8.0], [50.0, 50.0, 60.0, 60.0]
    bench = spark.createDataFrame([("a", "a.jpg", "Red dog", gt), ("a", "a.jpg", "Red dog", gt), ("b", "b.jpg", "cat", gt), ("c", "c.jpg", "cow", gt)], "base_sample_id string, image_filename string, query string, gt_bbox_xyxy array<double>")
    pool = spark.createDataFrame([("a", 1, None, True, [near, far]), ("b", 1, None, True, [near]), ("b", 2, "failed", None, None)], "base_sample_id string, position int, error string, parse_valid boolean, candidate_boxes array<array<double>>")
    records = spark.createDataFrame(
        [
            ("a", 1, "t2", "positive", "red  DOG", True, True, far), ("a", 2, "t2", "positive", "blue dog", True, True, gt), ("a", 3, "t2", "negative", "red dog", True, True, gt),
            ("a", 1, "t4", "positive", "red dog", True, False, near), ("b", 1, "t2", "positive", "cat", True, True, near), ("b", 1, "t9", "positive", "cat", True, True, near), ("z", 1, "t2", "positive", "x", True, True, gt),
        ],
        "base_sample_id string, position int, task string, query_role string, query string, parse_valid boolean, pred_found boolean, pred_bbox_xyxy array<double>",
    )
    rows = {r["query_id"]: r for r in manifests.evaluation_rows(bench, pool, records, ["t2", "t4"]).collect()}
    assert len(rows) == 6 and (rows["t2:a"]["selector_action"], rows["t2:a"]["baseline_iou"], rows["t2:a"]["challenger_iou"]) == ("switch", 0.0, pytest.approx(0.8))
    assert rows["t4:a"]["selector_exclusion"] == "baseline_null_locked_stage1" and rows["t4:a"]["baseline_iou"] == pytest.approx(0.8)
    assert rows["t2:b"]["selector_exclusion"] == "challenger_parse_invalid" and rows["t2:b"]["challenger_bbox_xyxy"] is None
    assert {rows[k]["selector_exclusion"] for k in ("t4:b", "t2:c", "t4:c")} == {"baseline_parse_invalid"}
    with pytest.raises(ValueError):
        manifests.evaluation_rows(bench.union(bench.where("base_sample_id = 'c'").withColumn("query", F.lit("bull"))), pool, records, ["t2"])
