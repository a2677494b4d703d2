"""Box joins against all pairs, and ordered work on any numbers against plain sorts."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import boxes, metrics, ranks, sampling


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)


def hardness(a, b, diagonal):
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    away = math.hypot(a[0] + a[2] - b[0] - b[2], a[1] + a[3] - b[1] - b[3]) / 2
    return round(0.6 * math.exp(-abs(math.log(area(b) / area(a)))) + 0.4 * max(0, 1 - away / diagonal), 9)


@pytest.fixture(scope="module")
def placed():
    """Boxes of half a pixel to the whole image, at its edges, equal ones, and one image with most of them."""
    rng, out = np.random.default_rng(5), []
    for i in range(500):
        w, h = (float(x) for x in rng.choice([0.5, 1, 7, 16, 33, 300], 2))
        x, y = (float(v) for v in rng.integers(-40, 400, 2))
        out.append((i, int(rng.choice([1, 1, 1, 2, 3])), [x, y, x + w, y + h]))
    out += [(500 + i, 1, list(out[7][2])) for i in range(4)]
    return [*out, (600, 1, None), (601, 1, [5.0, 5.0, 5.0, 9.0]), (602, 2, [float("nan"), 0.0, 1.0, 1.0])]


def fits(box):
    return box is not None and not any(map(math.isnan, box)) and box[2] > box[0] and box[3] > box[1]


def test_overlapping_boxes_equal_all_pairs(spark, placed):
    df = spark.createDataFrame(placed, "k int, image int, box array<double>")
    other = df.where("k % 2 = 0").select(F.col("k").alias("o"), "image", F.col("box").alias("other_box"))
    found = [(r["k"], r["o"], round(r["iou"], 12)) for r in boxes.overlapping(df, other, ["image"], "box", "other_box").collect()]
    good = [r for r in placed if fits(r[2])]
    wanted = [(a, o, round(iou(b, c), 12)) for a, i, b in good for o, j, c in good if o % 2 == 0 and i == j and iou(b, c) > 0]
    assert sorted(found) == sorted(wanted) and len(set(found)) == len(found) > 500
    best = {}
    for k, o, v in wanted:
        best[k] = max(best.get(k, (0, 0)), (v, -o))
    got = boxes.best_match(df, other, ["image"], "k", "box", "o", "other_box").collect()
    assert {r["k"]: (round(r["iou"], 12), -r["o"]) for r in got} == best and len(got) == len(best)


def test_boxes_far_apart_make_no_pairs(spark):
    """Squares in a row, each of which touches two: the joins give a few rows for each."""
    df = spark.range(20_000).select("id", F.lit(1).alias("g"), F.array(F.col("id") * 9.0, F.lit(0.0), F.col("id") * 9.0 + 10, F.lit(10.0)).alias("b"))
    pairs = boxes.overlapping(df, df.select(F.col("id").alias("o"), "g", F.col("b").alias("c")), ["g"], "b", "c")
    assert pairs.count() == 3 * 20_000 - 2
    joined = [df.where(F.col("id") < n) for n in (1000, 2000)]
    made = [boxes.overlapping(d, d.select(F.col("id").alias("o"), "g", F.col("b").alias("c")), ["g"], "b", "c") for d in joined]
    assert made[1].count() <= 2.1 * made[0].count()


@pytest.mark.parametrize("keep", [1, 5, 1000])
def test_competitors_equal_all_pairs(spark, placed, keep):
    df = spark.createDataFrame(placed, "k int, image int, box array<double>")
    out = boxes.competitors(df, ["image"], "k", "box", 400, 300, keep, 0.4, F.col("k") % 9 == 0).collect()
    good, wanted = [r for r in placed if fits(r[2])], set()
    for k, i, b in good:
        others = [(-hardness(b, c, 500), o) for o, j, c in good if o != k and j == i and o % 9 and iou(b, c) < 0.4]
        wanted |= {(k, o, n, -h, len(others)) for n, (h, o) in enumerate(sorted(others)[:keep], 1)}
    assert {(r["target"], r["other"], r["rank"], r["hardness"], r["available"]) for r in out} == wanted


@pytest.mark.parametrize("whole", [0, 150, 32_768])
def test_competitors_of_whole_groups_and_by_cells(spark, placed, whole):
    """All groups by cells, the largest only, or none."""
    df = spark.createDataFrame(placed, "k int, image int, box array<double>")
    out = boxes.competitors(df, ["image"], "k", "box", 400, 300, 3, 0.4, F.col("k") % 9 == 0, whole=whole).collect()
    good, wanted = [r for r in placed if fits(r[2])], set()
    for k, i, b in good:
        others = [(-hardness(b, c, 500), o) for o, j, c in good if o != k and j == i and o % 9 and iou(b, c) < 0.4]
        wanted |= {(k, o, n, -h, len(others)) for n, (h, o) in enumerate(sorted(others)[:3], 1)}
    assert {(r["target"], r["other"], r["rank"], r["hardness"], r["available"]) for r in out} == wanted


@pytest.mark.parametrize("most", [0.0, 0.3, 0.9, 1.5])
def test_strips_of_a_group(placed, most, monkeypatch):
    """Strips of a few rows, which look at others of their size first, find what one strip of all finds."""
    shapes = np.array([r[2] for r in placed if fits(r[2])])
    code, single = np.random.default_rng(2).permutation(len(shapes)), np.arange(len(shapes)) % 7 > 0
    found = []
    for strip in (1 << 30, 2000):
        monkeypatch.setattr(boxes, "STRIP", strip)
        found.append(sorted(zip(*(v.tolist() for v in boxes.hardest(shapes, code, single, 500.0, 5, most)))))
    assert found[0] == found[1] and (most == 0) == (not found[0])


def test_competitors_write_no_pairs(spark, placed):
    """The plan of groups that fit a task has no join, and shuffles boxes only."""
    df = spark.createDataFrame(placed, "k int, image int, box array<double>")
    plan = boxes.competitors(df, ["image"], "k", "box", 400, 300, 3, 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_order_keys_are_the_bits_of_a_double(spark):
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2**63, 20_000)
    values = [0.0, -0.0, 1.0, -1.0, 2.0, 2**-1022, 2**-1074, 2**-1021, 1.7976931348623157e308, math.inf, -math.inf, *(2.0**k for k in range(-1074, 1024, 3)), *(math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7))]
    values += [v for v in struct.unpack(f"{len(bits)}d", bits.tobytes()) if v == v]
    df = spark.createDataFrame([(v,) for v in values] + [(-v,) for v in values], "v double")
    for r in df.select("v", ranks.order_key(F.col("v"), "double").alias("k")).collect():
        expected = struct.unpack("q", struct.pack("d", abs(r["v"])))[0]
        assert r["k"] == (expected if r["v"] > 0 else -expected)
    nan = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(ranks.order_key(F.col("v"), "double").alias("k")).collect()
    assert [r["k"] for r in nan] == [2**63 - 1, None]


@pytest.mark.parametrize("start", [0, 10**9, 10**12, 1_700_000_000_000_000])
def test_ranges_hold_few_rows_wherever_numbers_start(spark, start):
    df = spark.range(1_000_000).select((F.col("id") + start).alias("v"))
    for kind in ("bigint", "double"):
        sizes = ranks.bucketed(df.select(F.col("v").cast(kind).alias("v")), (), "v").groupBy("_b").count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[0] <= ranks.LEAST and sizes[1] == 1_000_000


def test_ranges_of_uneven_numbers(spark):
    """Most numbers within a thousandth of the span, one value very often, groups of any size."""
    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 == 0, F.lit(7.5)).when(F.col("id") % 5 < 4, 1 + F.col("id") * 1e-12).otherwise(F.col("id") * 1e12).alias("v"))
    cut = ranks.bucketed(df, ("g",), "v", least=500)
    full = cut.groupBy("g", "_b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
    assert full.where("n > 500 AND values > 1").count() == 0 and full.where("n > 500").count() == 3
    rows = full.orderBy("g", "_b").collect()
    assert all(a["g"] != b["g"] or a["high"] < b["low"] for a, b in zip(rows, rows[1:]))


def test_percentiles_and_shards_of_large_whole_numbers(spark):
    rng = np.random.default_rng(7)
    values = np.unique(1_700_000_000_000_000 + rng.integers(0, 40_000, 30_000))
    df = spark.createDataFrame([(int(v),) for v in rng.permutation(values)], "v long")
    got = metrics.exact_percentiles(df.select(F.lit("a").alias("g"), "v"), ["g"], "v", {"a": 0.1, "b": 0.5}).first()
    assert (got["a"], got["b"]) == tuple(np.percentile(values, [10, 50]))
    out = sampling.round_robin(df, "v", 7).collect()
    place = {int(v): k for k, v in enumerate(values)}
    assert all(r["shard"] == place[r["v"]] % 7 for r in out) and len(out) == len(values)
