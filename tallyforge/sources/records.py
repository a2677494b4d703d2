"""A data source of records in files, one pass: lines, gzip lines, or one document with a list.

Each partition is a range of bytes of a file of lines, a member of a gzip file, or a
document. A row has its file, its place there (the byte at which its line starts; in a gzip
file or document its number), its JSON text, or what is wrong with it.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .members import _inflate, local, offsets

RANGE = 64 << 20
#: Partitions of lines beyond which ranges grow, up to ``RANGE``, as each costs a start.
PARTS = 1024
#: Keys under which a document may hold its list, the first of them counts.
LISTS = ("records", "data", "samples")
SCHEMA = "file string, place long, value string, error string"


@dataclass
class Stretch(InputPartition):
    file: str
    kind: str
    start: int
    size: int
    line: bool


def stretches(path: str, range_bytes: int) -> list[Stretch]:
    """Partitions of the files that a path or pattern names, in order of name; lines go in ranges of ``range_bytes`` at least."""
    found = sorted(glob.glob(local(path))) or [local(path)]
    names = [n for f in found for n in (sorted(os.path.join(f, x) for x in os.listdir(f) if x[0] not in "._") if os.path.isdir(f) else [f])]
    sizes = {name: os.path.getsize(name) for name in names}  # a file that is not there is an error
    of_lines = sum(size for name, size in sizes.items() if name.endswith((".jsonl", ".txt")))
    out, step = [], max(range_bytes, min(RANGE, -(-of_lines // PARTS)))
    for name, size in sizes.items():
        if name.endswith(".gz"):
            places = offsets(name)
            out += [Stretch(name, "gzip", a, n, len(places) == 1) for a, n in places]
        elif name.endswith((".jsonl", ".txt")):
            out += [Stretch(name, "lines", a, min(step, size - a), True) for a in range(0, size, step)]
        else:
            out.append(Stretch(name, "document", 0, size, True))
    return out


#: Line ends before every ``MARK`` bytes of the files that this process has counted, by name, size and time.
MARK = 1 << 20
_marks: dict[tuple, list[int]] = {}


def line_number(file: str, place: int) -> int:
    """The number of the line that starts at a byte, from 1; read when a line is broken only.

    What was counted is kept, so that a process reads a file once for all of its ranges.
    """
    state = os.stat(file)
    marks = _marks.setdefault((file, state.st_size, state.st_mtime_ns), [0])
    with open(file, "rb") as f:
        f.seek((len(marks) - 1) * MARK)
        while len(marks) <= place // MARK:
            marks.append(marks[-1] + f.read(MARK).count(b"\n"))
        f.seek(place // MARK * MARK)
        return 1 + marks[place // MARK] + f.read(place % MARK).count(b"\n")


def trouble(line: bytes) -> str | None:
    try:
        return None if isinstance(json.loads(line), dict) else "expected a JSON object"
    except ValueError as error:
        return f"invalid JSON: {error}"


def lines_of(part: Stretch) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines that start within a range."""
    with open(part.file, "rb") as file:
        at, end = part.start, part.start + part.size
        if at:
            file.seek(at - 1)
            at += len(file.readline()) - 1  # the line before belongs to the range before
        while at < end and (line := file.readline()):
            yield at, line
            at += len(line)


def rows_of(part: Stretch) -> Iterator[tuple]:
    """(file, place, value, error) of a partition; blank lines are left out."""
    if part.kind == "document":
        with open(part.file, encoding="utf-8") as file:
            try:
                whole = json.load(file)
            except ValueError as error:
                yield part.file, 0, None, f"{part.file}: invalid JSON: {error}"
                return
        rows = whole if isinstance(whole, list) else next((whole[k] for k in LISTS if isinstance(whole, dict) and isinstance(whole.get(k), list)), None)
        if rows is None:
            yield part.file, 0, None, f"{part.file}: expected a list, or one under {', '.join(LISTS)}"
            return
        for n, row in enumerate(rows, 1):
            good = isinstance(row, dict)
            yield part.file, n, json.dumps(row, ensure_ascii=False) if good else None, None if good else f"{part.file}: record {n}: expected a JSON object"
        return
    if part.kind == "gzip":
        numbered, n = [], 0
        for text in _inflate(part.file, part.start, part.size):
            for line in text.split(b"\n"):
                n += 1
                if line.strip():
                    wrong = trouble(line)
                    where = f"{part.file}:{n}" if part.line else f"{part.file}: line {n} of the member at {part.start}"
                    yield part.file, part.start + n, line.decode("utf-8", "replace") if not wrong else None, f"{where}: {wrong}" if wrong else None
        return
    first = None
    for n, (place, line) in enumerate(lines_of(part)):
        if line.strip():
            wrong = trouble(line)
            if wrong and first is None:
                first = line_number(part.file, place) - n  # lines that follow are counted on
            yield part.file, place, line.decode("utf-8", "replace").rstrip("\r\n") if not wrong else None, f"{part.file}:{first + n}: {wrong}" if wrong else None


class RecordReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, self.range_bytes)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        held, size = [], 0
        for row in rows_of(partition):
            held.append(row)
            size += len(row[2] or "")
            if size > 4 << 20:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["file", "place", "value", "error"])
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["file", "place", "value", "error"])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options.get("rangebytes", RANGE)))


def read_raw_records(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, place, value, error) of every record; see the module."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("path", path).option("rangebytes", str(range_bytes)).load()


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Records of lines, gzip lines or documents, in one scan: their columns by ``schema``.

    Strict: the job fails at a broken record, with its file and line. Else the rows come
    with ``file``, ``place`` and ``error``, and a broken one has null columns. Blank lines
    are no records. Files have to be on a folder that all machines mount.
    """
    raw = read_raw_records(spark, path, range_bytes)
    if strict:
        good = F.when(F.col("error").isNull(), F.col("value")).otherwise(F.raise_error(F.col("error")).cast("string"))
        return raw.select(F.from_json(good, schema).alias("r")).select("r.*")
    return raw.select("file", "place", "error", F.from_json("value", schema).alias("r")).select("file", "place", "error", "r.*")
