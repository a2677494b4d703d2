"""Result-or-error rows, gzip files in members, and the source of records."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import calls
from tallyforge.sources import members, records


def test_only_failed_rows_are_called_again_and_waits_double():
    seen, waits = [], []

    def call(rows):
        seen.append([r["k"] for r in rows])
        if len(seen) == 1:
            raise OSError("down")
        return [ValueError("odd") if r["k"] % 2 else {"v": r["k"]} for r in rows]

    out = calls.outcomes(call, [{"k": k} for k in range(3)], 4, 1.0, 1.5, waits.append)
    assert out == [({"v": 0}, None, 2), (None, "ValueError: odd", 4), ({"v": 2}, None, 2)]
    assert seen == [[0, 1, 2], [0, 1, 2], [1], [1]] and waits == [1.0, 1.5, 1.5]
    short = calls.outcomes(lambda rows: [], [{"k": 0}], 1, 1.0, 1.0, waits.append)
    assert short == [(None, "ValueError: 0 answers to 1 rows", 1)]


def test_no_row_is_lost_and_no_finished_one_repeated(spark, tmp_path):
    log, trace = str(tmp_path / "log"), tmp_path / "trace"
    trace.mkdir()

    def call(rows):
        out = []
        for r in rows:
            with open(trace / str(r["k"]), "a") as f:
                f.write("x" if random.random() < 0.4 else "y")
            out.append(TimeoutError("late") if (trace / str(r["k"])).read_text().endswith("x") else {"twice": 2 * r["k"], "who": [r["name"]]})
        return out

    df = spark.range(300).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).repartition(7)
    done = set()
    for _ in range(12):
        out = calls.answer_pending(df, ["k"], log, call, "struct<twice:bigint,who:array<string>>", rounds=3, attempts=2, first_wait=0.0).collect()
        assert sorted(r["k"] for r in out) == list(range(300))
        assert all((r["error"] is None) == (r["result"] is not None) for r in out)
        assert all(r["result"]["twice"] == 2 * r["k"] and r["result"]["who"] == [f"n{r['k']}"] for r in out if r["result"])
        now = {r["k"] for r in out if r["result"]}
        assert done <= now
        done = now
    # a row is called until it has an answer, and not once more
    assert len(done) > 290 and all((trace / str(k)).read_text().count("y") == 1 for k in done)


def test_an_empty_request_table(spark, tmp_path):
    df = spark.createDataFrame([], "k long")
    assert calls.answer_pending(df, ["k"], str(tmp_path / "log"), lambda rows: 1 / 0, "struct<v:long>").collect() == []


ROWS = [{"b": f"é {k % 13}\n", "a": None if k % 5 == 0 else k, "c": [k % 3]} for k in range(1234)]


def wanted_text():
    return "".join(json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n" for r in sorted(ROWS, key=lambda r: (r["a"] is not None, r["a"] or 0)) if r["a"] is not None)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(r["a"], r["b"], r["c"]) for r in ROWS if r["a"] is not None], "a long, b string, c array<long>")


def test_bytes_do_not_depend_on_partitions(spark, table, tmp_path):
    found = set()
    for n in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        path = str(tmp_path / f"{n}.jsonl.gz")
        members.write_gzip_file(table.repartition(n), path, ["a"], str(tmp_path / f"scratch{n}"), lines=100)
        found.add(hashlib.sha256(open(path, "rb").read()).hexdigest())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == 1
    assert gzip.open(path, "rt", encoding="utf-8").read() == wanted_text()
    assert len(members.offsets(path)) == 10 and not list(tmp_path.glob("*.tmp"))
    with pytest.raises(FileExistsError):
        members.write_gzip_file(table, path, ["a"], str(tmp_path / "no"))
    empty = str(tmp_path / "empty.gz")
    members.write_gzip_file(table.limit(0), empty, ["a"], str(tmp_path / "scratch-empty"))
    assert gzip.open(empty).read() == b"" and members.read_gzip_file(spark, empty).count() == 0


def test_members_are_read_by_a_task_each(spark, table, tmp_path):
    path = str(tmp_path / "x.jsonl.gz")
    members.write_gzip_file(table, path, ["a"], str(tmp_path / "scratch"), lines=100)
    lines = wanted_text().split("\n")[:-1]
    found = members.read_gzip_file(spark, path)
    assert sorted((r["line"], r["value"]) for r in found.collect()) == list(enumerate(lines, 1))
    assert found.rdd.getNumPartitions() == 10 and found.select(F.spark_partition_id()).distinct().count() == 10
    plain = str(tmp_path / "plain.gz")
    with gzip.open(plain, "wb") as f:
        f.write(b"one\n\ntwo")
    with gzip.open(plain, "ab") as f:
        f.write(b" more\nthree\n")
    assert [(r["line"], r["value"]) for r in members.read_gzip_file(spark, plain).orderBy("line").collect()] == [(1, "one"), (2, ""), (3, "two more"), (4, "three")]


def test_records_of_every_form(spark, table, tmp_path):
    read = lambda name, **k: records.read_records(spark, str(tmp_path / name), "a long, b string", **k)
    rows = [{"a": k, "b": "x" * (k % 30) + "é"} for k in range(500)]
    lines = [json.dumps(r, ensure_ascii=False) for r in rows]
    (tmp_path / "r.jsonl").write_text("\n".join([*lines[:250], "", "  ", *lines[250:]]), encoding="utf-8")
    wanted = sorted((r["a"], r["b"]) for r in rows)
    for size in (17, 100, 1 << 20):
        got = read("r.jsonl", range_bytes=size)
        assert sorted(map(tuple, got.collect())) == wanted
    assert read("r.jsonl", range_bytes=1000).rdd.getNumPartitions() > 10
    for key in (None, *records.LISTS):
        (tmp_path / "d.json").write_text(json.dumps({"data": 3, "samples": rows[:3]} | {key: rows} if key else rows))
        if key == "records":
            (tmp_path / "d.json").write_text(json.dumps({"samples": rows[:3], "records": rows}))
        assert sorted(map(tuple, read("d.json").collect())) == wanted
    path = str(tmp_path / "g.jsonl.gz")
    members.write_gzip_file(table, path, ["a"], str(tmp_path / "scratch"), lines=64)
    got = read("g.jsonl.gz")
    assert got.count() == table.count() and got.rdd.getNumPartitions() == len(members.offsets(path))
    assert got._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1


def test_a_broken_record_is_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2\n[3]\n{"a": 4}')
    with pytest.raises(Exception, match=r"x\.jsonl:[34]: "):
        records.read_records(spark, str(tmp_path / "x.jsonl"), "a long").collect()
    lax = records.read_records(spark, str(tmp_path / "x.jsonl"), "a long", strict=False, range_bytes=4).orderBy("place").collect()
    assert [r["a"] for r in lax] == [1, None, None, 4] and lax[2]["error"].endswith("x.jsonl:4: expected a JSON object") and ":3: invalid JSON" in lax[1]["error"]
    (tmp_path / "d.json").write_text('{"rows": []}')
    with pytest.raises(Exception, match="expected a list"):
        records.read_records(spark, str(tmp_path / "d.json"), "a long").collect()


def test_broken_lines_are_numbered_by_one_count(tmp_path, monkeypatch):
    """A file is read once for the numbers of all of its broken lines, however many ranges it has."""
    path, read = tmp_path / "y.txt", []
    path.write_text("".join("[1]\n" if k % 3 == 0 else "\n" if k % 3 == 1 else '{"a": 1}\n' for k in range(3000)))
    monkeypatch.setattr(records, "MARK", 512)

    class Counted:
        def __init__(self, *a):
            self.file = open(*a)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    monkeypatch.setattr(records, "open", Counted, raising=False)
    for size in (100, 5000):
        rows = [r for part in records.stretches(str(path), size) for r in records.rows_of(part)]
        assert [r[3] for r in rows if r[3]] == [f"{path}:{k + 1}: expected a JSON object" for k in range(0, 3000, 3)] and len(rows) == 2000
    # the file once, and less than a mark for each range
    assert sum(read) <= path.stat().st_size + 512 * (2 + path.stat().st_size // 100 + path.stat().st_size // 5000)


def test_small_ranges_grow_with_files(tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PARTS", 10)
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text("".join(f'{{"a": {k}}}\n' for k in range(1000)))
    parts = records.stretches(str(tmp_path / "*.txt"), 50)
    assert len(parts) <= 12 and sum(p.size for p in parts) == sum(f.stat().st_size for f in tmp_path.iterdir())
    assert sorted(json.loads(r[2])["a"] for p in parts for r in records.rows_of(p)) == sorted([*range(1000)] * 2)
    monkeypatch.setattr(records, "RANGE", 100)  # a range does not outgrow it
    assert {p.size for p in records.stretches(str(tmp_path / "*.txt"), 50)} >= {100}
