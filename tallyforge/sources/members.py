"""One gzip file of JSON lines that tasks write and read in parallel.

The file is a row of gzip members of a fixed number of lines each. A member's header holds
its size in an extra field, so the members are found without an index beside the file, and
any reader of gzip takes the file as a whole. Bytes depend on the rows and their order alone,
not on partitions or on the time.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MEMBER_LINES = 50_000
_HEAD = struct.Struct("<4BI2BH2BHQ")
_EXTRA = (ord("T"), ord("M"))


def member(text: bytes) -> bytes:
    """A gzip member without name and time, with its size in an extra field."""
    squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = squeeze.compress(text) + squeeze.flush()
    size = _HEAD.size + len(body) + 8
    head = _HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 12, *_EXTRA, 8, size)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text) & 0xFFFFFFFF)


def local(path: str) -> str:
    """The place of a path on a file system that all machines mount; other schemes are an error."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"{path}: members are written and read in place, on a mounted folder")
    return unquote(found.path) if found.scheme else path


def offsets(path: str) -> list[tuple[int, int]]:
    """(offset, size) of each member; a file without sizes is one member."""
    out, at, end = [], 0, os.path.getsize(local(path))
    with open(local(path), "rb") as file:
        while at < end:
            file.seek(at)
            head = file.read(_HEAD.size)
            parts = _HEAD.unpack(head) if len(head) == _HEAD.size else None
            if parts is None or parts[:4] != (0x1F, 0x8B, 8, 4) or parts[8:10] != _EXTRA:
                return [*out, (at, end - at)]
            out.append((at, parts[-1]))
            at += parts[-1]
    return out


def _lines(df: DataFrame, order: list[str]) -> DataFrame:
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(line.alias("value"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))


def write_gzip_file(df: DataFrame, path: str, order: list[str], scratch: str, lines: int = MEMBER_LINES, overwrite: bool = False) -> None:
    """Write ``df`` as one gzip file of JSON lines with sorted keys, in ``order`` (a key).

    Rows are put in order and stored in ``scratch``, a new folder that all machines share;
    their places follow from the counts of its parts. Each member is compressed by the task
    that has its lines, and written at its offset of a file beside ``path``, which is then
    put in place. Tasks may be repeated, as they write the same bytes.
    """
    if os.path.exists(local(path)) and not overwrite:
        raise FileExistsError(path)
    spark = df.sparkSession
    _lines(df, order).write.parquet(f"{scratch}/lines")
    rows = spark.read.parquet(f"{scratch}/lines")
    # one row for each part of the sorted table
    parts = rows.groupBy("part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", (before - F.col("first")).alias("shift"))
    placed = rows.join(F.broadcast(parts), "part").withColumn("at", F.col("id") + F.col("shift"))
    placed = placed.select(F.floor(F.col("at") / lines).alias("member"), "at", "value")

    def squeeze(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        text = "".join(f"{x}\n" for x in table["value"].to_pylist()).encode()
        data = member(text)
        return pa.table({"member": table["member"].slice(0, 1), "size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    placed.groupBy("member").applyInArrow(squeeze, "member long, size long, data binary").write.parquet(f"{scratch}/members")
    made = spark.read.parquet(f"{scratch}/members")
    # one number for each member
    start = F.coalesce(F.sum("size").over(Window.orderBy("member").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = made.select("member", "size").withColumn("start", start).drop("size")
    total = made.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = f"{local(path)}.tmp"

    def put(rows) -> None:
        with open(target, "r+b") as file:
            for row in rows:
                file.seek(row["start"])
                file.write(row["data"])

    try:
        with open(target, "wb") as file:
            file.truncate(total)
        made.join(starts, "member").select("start", "data").foreachPartition(put)
        os.replace(target, local(path))
    finally:
        if os.path.exists(target):
            os.remove(target)


def read_gzip_file(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a gzip file, a task for each of its members; ``line`` counts from 1.

    Lines of a member are numbered from its first; the members' counts, one number each,
    are added when the plan is made, which is a job of its own.
    """
    places = offsets(path)
    source = local(path)
    index = spark.createDataFrame([(k, a, n) for k, (a, n) in enumerate(places)], "member int, start long, size long")
    dealt = index.repartitionByRange(max(1, len(places)), "member")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                line = 0
                for text in _inflate(source, start, size):
                    values = text.split(b"\n")
                    yield pa.record_batch({"member": pa.array([k] * len(values), pa.int32()), "at": pa.array(range(line, line + len(values)), pa.int64()), "value": pa.array(values, pa.binary()).cast(pa.string())})
                    line += len(values)

    lines = dealt.mapInArrow(unpack, "member int, at long, value string")
    if len(places) < 2:
        return lines.select((F.col("at") + 1).alias("line"), "value")
    counts = sorted((r["member"], r["n"]) for r in lines.groupBy("member").agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, at = [], 1
    for k, n in counts:
        firsts.append((k, at))
        at += n
    first = spark.createDataFrame(firsts, "member int, first long")
    return lines.join(F.broadcast(first), "member").select((F.col("first") + F.col("at")).alias("line"), "value")


def _inflate(path: str, start: int, size: int, step: int = 4 << 20) -> Iterator[bytes]:
    """Whole lines of the gzip data in a stretch of a file, some MB at a time, without the last line end."""
    rest, unzip = b"", zlib.decompressobj(31)
    with open(path, "rb") as file:
        file.seek(start)
        while size:
            data = file.read(min(step, size))
            if not data:
                raise ValueError(f"{path} ends within a member")
            size -= len(data)
            while data:
                rest += unzip.decompress(data)
                data = unzip.unused_data
                if unzip.eof and (data or size):
                    unzip = zlib.decompressobj(31)  # another member
            if b"\n" in rest:
                whole, _, rest = rest.rpartition(b"\n")
                yield whole
    if not unzip.eof:
        raise ValueError(f"{path} ends within a member")
    if rest:
        yield rest
