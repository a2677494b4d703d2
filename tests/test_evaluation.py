import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluation, joins, metrics, records, sampling
from tallyforge.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


RECORDS = "label_exists boolean, query_role string, pred_exists boolean, pred_found boolean, pred_bbox_xyxy array<double>, iou double, hallucination_type string, parse_valid boolean, latency_sec double"


def test_task_metrics(spark):
    b = [0.0, 0.0, 1.0, 1.0]
    df = spark.createDataFrame(
        [
            (True, "positive", True, True, b, 0.8, None, True, 1.0),
            (True, "positive", None, None, None, None, None, None, None),
            (False, "negative", True, True, b, None, "object", False, 3.0),
            (False, "negative", False, False, None, None, "relation", True, None),
        ],
        RECORDS,
    )
    e = evaluation.existence_metrics(df).first()
    assert (e["tp"], e["fn"], e["fp"], e["tn"], e["parse_failures"], e["avg_latency_sec"]) == (1, 1, 1, 1, 1, 2.0)
    assert (e["macro_rate"], e["plain_rate"], e["bound_minus_plain"], e["rate_attribute"]) == (0.5, 1.0, -1.0, None)
    g = evaluation.grounding_metrics(df).first()
    assert (g["mean_iou"], g["mean_iou_valid_only"], g["zero_count"], g["fn"], g["accuracy"]) == (0.4, 0.8, 1, 0, pytest.approx(2 / 3))
    none = evaluation.existence_metrics(df.limit(0)).first()
    assert (none["n"], none["accuracy"], none["false_rate_ci_lower"]) == (0, None, None)


def test_candidate_oracle_counts(spark):
    gt, near, far = [0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 10.0, 8.0], [50.0, 50.0, 60.0, 60.0]
    rows = spark.createDataFrame([("1", gt, "a", [far], 1), ("1", gt, "b", [near, near], 2), ("2", gt, "a", None, 1), ("2", gt, "x", [gt], 1)], "id string, gt array<double>, source string, boxes array<array<double>>, pos int")
    groups = evaluation.group_candidates(rows, "id", "gt", "source", "boxes", ["a", "b"], "pos")
    o = evaluation.candidate_oracle(groups, ["a", "b"], "a").first()
    assert (o["n_groups"], o["oracle_miou"], o["a_top1_miou"], o["mean_candidates"], o["mean_unique_candidates"]) == (2, 0.4, 0.0, 1.5, 1.0)
    assert (o["recovered_zero"], o["recovered_to_half"], o["gain_hit_rate"], o["conflicts"]) == (1, 1, 0.5, 0)


def plain_subset(rows, quotas, seed):
    import hashlib

    order = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (hashlib.sha256(f"{seed}:{s}:{r[1]}".encode()).hexdigest(), r[1])) for s in quotas}
    out, seen, images, n = [], set(), set(), dict.fromkeys(quotas, 0)
    for fresh in (True, False):
        at = dict.fromkeys(quotas, 0)
        moved = True
        while moved:
            moved = False
            for s in sorted(quotas):
                while n[s] < quotas[s] and at[s] < len(order[s]):
                    r = order[s][at[s]]
                    at[s] += 1
                    meaning = (r[2], r[3], r[4].strip().lower())
                    if meaning in seen or (fresh and r[2] in images):
                        continue
                    out.append((s, r[1]))
                    seen.add(meaning)
                    images.add(r[2])
                    n[s] += 1
                    moved = True
                    break
    return out


def test_compute_subset_is_the_plain_choice(spark):
    rows = [(s, f"{s}{i}", i % 7, i % 5, ["Cat", " cat", "dog"][i % 3]) for s in "abc" for i in range(60)]
    df = spark.createDataFrame(rows, "source string, query_id string, image_id int, ann_id int, query string")
    for quotas in ({"a": 3, "b": 2, "c": 1}, {"a": 12, "b": 9, "c": 11}):
        got = sampling.compute_subset(df, quotas, "s").orderBy("queue_rank").collect()
        assert [(r["source"], r["query_id"]) for r in got] == plain_subset(rows, quotas, "s")
    with pytest.raises(Exception, match="quotas not met"):
        sampling.compute_subset(df, {"a": 500}, "s").collect()


def test_joint_threshold_of_an_unscored_suite(spark):
    df = spark.createDataFrame([("x", True, 0.0, 0.9, 2.0), ("x", True, 0.8, 0.0, 1.0), ("y", True, 0.2, 0.6, None)], "suite string, selector_eligible boolean, baseline_iou double, challenger_iou double, score double")
    t = metrics.joint_threshold(df, "score", "suite", {"x": 0, "y": 0}, "challenger").first()
    assert (t["threshold"], t["moved"]) == (1.0, 2)
    assert metrics.joint_threshold(df, "score", "suite", {"x": -1}).first() is None


def test_sums_above_match_a_plain_sum(spark):
    df = spark.createDataFrame([("g", float(i % 50) + i, float(i)) for i in range(500)], "k string, p double, v double").groupBy("k", "p").agg(F.sum("v").alias("v"))
    plain = [(r["p"], r["v"]) for r in df.collect()]
    got = {r["p"]: r["v"] for r in metrics.sums_above(df, "p", ["v"], ("k",)).collect()}
    assert got == {p: sum(v for q, v in plain if q > p) for p, _ in plain}


def test_record_rules(spark):
    items = F.from_json(F.lit('[{"h":1.0,"n":"a"},{"h":3.0,"n":"b"},{"h":3.0,"n":"c"}]'), "array<struct<h:double,n:string>>")
    assert one(spark, records.extreme(items, "h"))["n"] == "b" and one(spark, records.extreme(items, "h", False))["n"] == "a"
    assert one(spark, records.extreme(F.filter(items, lambda x: x["h"] > 9), "h")) is None
    fixed = one(spark, records.aliased(items, "n", {"a": "z"}))
    assert [i["n"] for i in fixed["items"]] == ["z", "b", "c"] and fixed["corrections"] == ["[0].n:a->z"]
    assert one(spark, records.error_class(F.lit("HTTP 429"))) == "rate_limit" and one(spark, records.error_class(F.lit(None).cast("string"))) == "api_or_other"
    assert one(spark, records.presentation_flag(F.lit("male"), F.lit("Body build"))) == "stereotype_sensitive_cue"
    assert one(spark, records.vote_score(F.lit("ok"), F.lit("b"), F.lit(False))) == 1.0 and one(spark, records.vote_score(F.lit("ok"), F.lit("?"), F.lit(True))) == 0.0
    with pytest.raises(ValueError):
        records.projected(spark.range(1), {"id": "long"}, ("id",))
    found = spark.createDataFrame([("t2", "positive", "1", None, "q", True, [0.0]), ("t2", "negative", None, "1", "q", True, [0.0]), ("t2", "positive", "1", None, "q", False, None), ("t1", "positive", "1", None, "q", True, [0.0])], "task string, query_role string, base_sample_id string, pair_id string, query string, pred_found boolean, pred_bbox_xyxy array<double>")
    c = spark.createDataFrame([("positive", "1", "other", [9.0])], "role string, key string, query string, box array<double>")
    got = sorted((r["task"], r["query_role"], str(r["replacement"]), r["query_mismatch"]) for r in records.preserved(found, c, ("t2",)).collect())
    assert got == [("t1", "positive", "None", False), ("t2", "negative", "no_candidate", False), ("t2", "positive", "None", False), ("t2", "positive", "replaced", True)]
    cases = spark.createDataFrame([(1, [([1.0], 0.0), (None, 0.0), ([1.0], None)]), (2, [])], "id int, cases array<struct<box:array<double>,iou:double>>")
    assert [(r["id"], len(r["cases"])) for r in records.with_zero_cases(cases, "cases").collect()] == [(1, 1)]


def test_joins_that_have_to_be_whole(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, "z")], "k int, pos int, v string")
    assert sorted(r["v"] for r in records.one_to_one(a, b, ["k"], "pos").collect()) == ["y", "z"]
    with pytest.raises(ValueError):
        records.one_to_one(a, b.where("k = 1"), ["k"], "pos")
    with pytest.raises(ValueError):
        records.exact_cover(b.where("k = 1"), a, ["k"])
    assert [r["k"] for r in records.complete(a, b, ["k"], "pos", F.col("v") != "z", {"v": "y"}).collect()] == [1]
    assert [r["columns"] for r in evaluation.dependency_violations(b, ["k"], ["v", "pos"]).collect()] == [["v", "pos"]]
    assert [r["v"] for r in records.unambiguous(b, ["k"], "v", "pos").collect()] == ["z"]
    ids = records.protected_ids([a, spark.createDataFrame([("", "3")], "x string, y string")], ("k", "x", "y"), lambda c: c.cast("int"))
    assert sorted(r["id"] for r in ids.collect()) == [1, 2, 3]


def test_instances_reports_and_manifests(spark, tmp_path):
    p = tmp_path / "i.json"
    p.write_text(json.dumps({"images": [{"id": 1}], "annotations": [{"id": 1, "bbox": [0, 0, 2, 2]}, {"id": 2, "bbox": [0, 0, 0, 2]}, {"id": 3}], "categories": [{"id": 1, "name": "c"}]}))
    assert [r["valid"] for r in files.read_instances(spark, str(p))[1].orderBy("id").collect()] == [True, False, False]
    p.write_text('{"images": []}')
    with pytest.raises(ValueError):
        files.read_instances(spark, str(p))
    (tmp_path / "r.jsonl").write_text('{"id":1,"sentences":["a","b"]}\n{"id":2,"sentences":[]}\n')
    assert files.read_references(spark, str(tmp_path / "r.jsonl"), "id int, sentences array<string>").count() == 3
    target = str(tmp_path / "m.json")
    files.replace_file(target, "x")
    with pytest.raises(FileExistsError):
        files.replace_file(target, "y")
    df = spark.createDataFrame([("m", (0.5, 0.1, 0.9))], "model string, acc struct<value:double,ci_lower:double,ci_upper:double>")
    assert files.with_flat_intervals(df).columns == ["model", "acc", "acc_ci_lower", "acc_ci_upper"]
    assert "| m | 0.5000 | 0.1000 | 0.9000 |" in files.markdown_table(files.with_flat_intervals(df))
    up = files.merged(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert sorted(tuple(r) for r in up.collect()) == [(1, "a"), (2, "c")]


def test_assembly(spark, tmp_path):
    from tallyforge.functions import text
    from tallyforge.operators import joins

    e = spark.createDataFrame([(1, "a"), (2, "b")], "k int, q string")
    bank = spark.createDataFrame([(1, [1], []), (2, [1], [2])], "k int, x array<int>, y array<int>")
    got = joins.pools(e, bank, ["k"], {"same": "x", "near": "y"}).select("k", "kind").collect()
    assert sorted(tuple(r) for r in got) == [(1, "same"), (2, "near"), (2, "same")]
    with pytest.raises(ValueError):
        joins.assert_count(e, 3)
    listed = spark.createDataFrame([("/b/a",), ("/b/b",), ("/a/b",)], "path string")
    found = joins.resolved(e, listed, [F.concat(F.lit("/a/"), "q"), F.concat(F.lit("/b/"), "q")])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", "/b/a"), (2, "b", "/a/b")]
    with pytest.raises(ValueError, match="missing_bank: 1"):
        joins.assert_clean(joins.assembled(e, {"bank": bank.where("k = 1")}, {}, ["k"]))
    assert one(spark, text.first_long_number(F.lit("x1234567890123"))) == 123456789012
    items = F.from_json(F.lit('[{"a":1,"b":2},{"a":null,"b":3}]'), "array<struct<a:int,b:int>>")
    assert one(spark, text.compact_items(items, ["a"])) == '[{"a":1},{}]'


def test_exact_percentiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 501)) for v in rng.normal(0, 100, n).round(1)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in metrics.exact_percentiles(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}).collect():
        own = [v for k, v in rows if k == r["k"] and v is not None]
        assert [r["low"], r["mid"], r["high"], r["top"]] == pytest.approx(list(np.percentile(own, [0, 50, 95, 100])))


def test_nearest_value_equals_all_pairs(spark):
    a = [(i, i % 3, float(i * 37 % 50)) for i in range(60)]
    b = [(100 + i, i % 2, float(i * 11 % 40 // 2)) for i in range(30)]
    out = joins.nearest_value(spark.createDataFrame(a, "k int, g int, v double"), spark.createDataFrame(b, "o int, g int, w double"), ["g"], "k", "v", "o", "w")
    wanted = {k: min((abs(v - w), o) for o, h, w in b if h == g) for k, g, v in a if g < 2}
    assert {r["k"]: (r["distance"], r["o"]) for r in out.collect()} == wanted


def test_splits_that_share_a_value_are_refused(spark):
    from tallyforge.operators import isolation

    df = spark.createDataFrame([("dev", 1, "x"), ("train", 2, "y"), ("train", None, "y")], "split string, image int, pair string")
    assert isolation.assert_disjoint(df, "split", ["image", "pair"]) is df
    with pytest.raises(ValueError, match="1 values"):
        isolation.assert_disjoint(df.union(spark.createDataFrame([("dev", 2, "z")], df.schema)), "split", ["image", "pair"])
