"""Shared helpers: tables, the shared folder, and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line rule: space, tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    Where none is set, a local master gets a temporary one (tests); a cluster is an error,
    as a folder of one machine would lose rows there.
    """
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(folder)
        found = spark.sparkContext.getCheckpointDir()
    return found


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``stored`` has written that still are there."""
    return len(_written)


def forget(spark: SparkSession, since: int) -> None:
    """Delete the tables that were written after the first ``since``, all but the newest.

    For callers that have stored their result: what was read from the others cannot be
    computed any more.
    """
    for path in _written[since:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _written[since:-1]


def small(df: DataFrame, rows: int, most_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint where it is measured to have at most ``rows`` rows and ``most_bytes``.

    Bytes are those of strings, binaries and arrays and 8 for every other column. Call it
    on stored narrow tables only; larger ones join by shuffle.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    cost = F.lit(0).cast("long")
    for c, kind in df.dtypes:
        column = F.col(f"`{c}`")
        wide = F.octet_length(column) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(column))) if "<" in kind else F.lit(8)
        cost = cost + F.coalesce(wide, F.lit(0))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0] <= most_bytes else df


def floor_of(counts: DataFrame, most: int) -> int:
    """Smallest power of two so that at most ``most`` rows have a count ``n`` of it or more."""
    size = F.char_length(F.bin("n"))
    found, floor = 0, 1 << 62
    for power, n in sorted(map(tuple, counts.groupBy(size).count().collect()), reverse=True):
        found += n
        if found > most:
            break
        floor = 1 << (power - 1)
    return floor


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bound(value: Column, f) -> Column:
    """``f(value)``, with ``value`` computed once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def arrow_function(kind: str):
    """Like ``F.arrow_udf``, for functions of a module: the type is read when a column is made.

    Workers import the module without a session, where a type's text cannot be read.
    """
    return lambda f: lambda *columns: F.arrow_udf(f, kind)(*columns)


def texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def pieces(array: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices of a text array with about ``most`` bytes each (one row at least)."""
    if not len(array):
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield array.slice(at, to - at)
        at = to
