import gzip

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files
from tallyforge.streaming import tail


def test_json_lines_round_trip_is_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    for name in ("one", "two"):
        files.write_json_lines(df.coalesce(1), str(tmp_path / name), ["b"])
    data = [b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / n).glob("*.gz"))) for n in ("one", "two")]
    assert data[0] == data[1] == b'{"a":"x","b":1}\n{"a":null,"b":2}\n'
    back = files.read_json_lines(spark, str(tmp_path / "one"), "b int, a string")
    assert sorted(back.collect()) == sorted(df.collect(), key=lambda r: r["b"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_json_lines(df, str(tmp_path / "one"), ["b"])


def test_strict_scan_fails_and_lax_skips(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\nbroken\n')
    good, broken = files.read_good_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert good.count() == 1 and broken.count() == 1
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_log_positions_csv_and_digest(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r["a"] for r in files.read_log(spark, str(tmp_path / "l.jsonl"), "a int").orderBy("position").collect()] == [1, 2]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 5)], "b array<double>, n int")
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_table_csv(spark, str(tmp_path / "csv"), ("b",), n="int").collect() == df.collect()
    sha = files.digests(spark, str(tmp_path / "l.jsonl")).first()["sha256"]
    assert files.verified(spark, str(tmp_path / "l.jsonl"), sha)
    with pytest.raises(ValueError):
        files.verified(spark, str(tmp_path / "l.jsonl"), "0")


def test_tail_keeps_the_latest(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    schema = spark.createDataFrame([], "k int, pos int").schema
    for n, line in enumerate(['{"k":1,"pos":1}\n{"k":2,"pos":1}', '{"k":1,"pos":2}']):
        (folder / f"{n}.json").write_text(line + "\n")
        tail.follow(spark, str(folder), schema, ["k"], "pos", state, str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.schema(schema).parquet(f"{state}/epoch=1").count() == 1  # a batch writes its own keys only
    wanted = [(1, 2), (2, 1)]
    assert sorted(tuple(r) for r in tail.current(spark, schema, ["k"], "pos", state).select("k", "pos").collect()) == wanted
    tail.compacted(spark, schema, ["k"], "pos", state, str(tmp_path / "less"))
    assert sorted(tuple(r) for r in tail.current(spark, schema, ["k"], "pos", str(tmp_path / "less")).select("k", "pos").collect()) == wanted


def test_lines_are_numbered_across_splits(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for name, n in (("b.jsonl", 300), ("a.jsonl", 200)):
        (folder / name).write_text("".join("\n" if i % 7 == 3 else f'{{"f":"{name}","i":{i}}}\n' for i in range(n)))
    wanted = [(name, i) for name, n in (("a.jsonl", 200), ("b.jsonl", 300)) for i in range(n) if i % 7 != 3]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert files.read_lines(spark, str(folder)).rdd.getNumPartitions() > 2
        rows = files.numbered_lines(spark, str(folder)).select(F.from_json("value", "f string, i int").alias("r"), "line").orderBy("r.f", "line").collect()
        assert [(r["r"]["f"], r["r"]["i"]) for r in rows] == wanted and all(r["r"]["i"] == r["line"] for r in rows)
        assert [tuple(r) for r in files.read_log(spark, str(folder), "f string, i int").orderBy("position").select("f", "i").collect()] == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_checked_lines_name_the_first_broken_one(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a":1}\n\n{"a":2}\n[3]\nbroken\n')
    with pytest.raises(ValueError, match="x.jsonl:4: no JSON object"):
        files.checked_json_lines(spark, str(path), "a int")
    path.write_text('{"a":1}\n\n{"a":2}\n')
    assert [r["a"] for r in files.checked_json_lines(spark, str(path), "a int").collect()] == [1, 2]
