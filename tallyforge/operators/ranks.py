"""Ordered work on any numbers without a task that holds them all.

``order_key`` maps a number to a 64-bit whole number of the same order. ``bucketed`` cuts the
keys into ranges: a histogram over the leading bits counts them, and where a range is too
full, it is counted again by the bits that follow, until it is small or a single value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a range may hold at any size of table, and the part of the table's rows beyond it.
LEAST, SHARE = 10_000, 8_192
#: Bits of the first histogram, and of those within a full range.
FIRST, NEXT = 16, 8


def order_key(value: Column, kind: str) -> Column:
    """A long that rises with ``value``, equal only for equal values; null stays null.

    For doubles it is the order of their bits, made of exponent and fraction: -0.0 is 0.0,
    and NaN is above infinity. ``kind`` is the column's type. Decimals of more than 18
    digits and other types are an error.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("long")
    if kind == "date":
        return F.unix_date(value).cast("long")
    if kind == "timestamp":
        return F.unix_micros(value)
    if kind.startswith("decimal"):
        digits, scale = map(int, kind[8:-1].split(","))
        if digits > 18:
            raise ValueError(f"no 64-bit key for {kind}")
        return (value * F.lit(10**scale).cast("decimal(19,0)")).cast("long")
    if kind not in ("float", "double"):
        raise ValueError(f"no order key for {kind}")
    v = F.abs(value.cast("double"))
    guess = F.floor(F.log2(v))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # a logarithm may be rounded over the power that it stands for
    e = F.when(v / two(guess) >= 2, guess + 1).when(v / two(guess) < 1, guess - 1).otherwise(guess)
    normal = ((e + 1022) * F.lit(2**52)) + (v / two(e) * float(2**52)).cast("long")
    tiny = (v * 2.0**537 * 2.0**537).cast("long")
    size = F.when(v == 0, F.lit(0).cast("long")).when(F.isnan(v), F.lit(2**63 - 1)).when(v == float("inf"), F.lit(2047 << 52)).when(v < 2.0**-1021, tiny).otherwise(normal)
    return F.when((value < 0) & ~F.isnan(value), -size).otherwise(size)


def bucketed(df: DataFrame, by: tuple[str, ...] | list[str], value: str, name: str = "_b", least: int = LEAST) -> DataFrame:
    """``df`` with the range of each row's ``value``, a long that rises with it; null for null.

    A range of a group holds at most ``least`` rows, or one in 8,192 of the table's if that
    is more, unless it is a single value. Ranges come from counts that are made first: a job
    for the ends, one for the first histogram, and one for each further eight bits that full
    ranges need. As a full range has its share of the rows, at most 8,192 of them are read.
    """
    rows = df.withColumn(name, order_key(F.col(value), dict(df.dtypes)[value]))
    n, low, high = rows.agg(F.count(name), F.min(name), F.max(name)).first()
    most = max(least, n // SHARE)
    if n <= most:
        return rows.withColumn(name, F.when(F.col(name).isNotNull(), F.lit(low)))
    cut = lambda bits: F.call_function("shiftleft", F.call_function("shiftright", F.col("_key"), F.lit(bits)), F.lit(bits))
    bits = max(0, (high - low).bit_length() - FIRST)
    rows = rows.withColumnRenamed(name, "_key").withColumn(name, cut(bits))
    part = rows.where(F.col(name).isNotNull())
    while bits:
        counts = part.groupBy(*by, name).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n")
        full = counts.collect()
        if not full:
            break
        bits = max(0, bits - NEXT)
        marks = F.broadcast(df.sparkSession.createDataFrame(full, counts.schema)).select(*[F.col(c).alias(f"_f{k}") for k, c in enumerate([*by, name])], F.lit(True).alias("_full"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f{k}")) for k, c in enumerate([*by, name])])
        refined = rows.join(marks, same, "left").withColumn(name, F.when(F.col("_full"), cut(bits)).otherwise(F.col(name)))
        part = refined.where("_full").select(*rows.columns)
        rows = refined.select(*rows.columns)
    return rows.select(*df.columns, name)


def positions(df: DataFrame, by: tuple[str, ...] | list[str], order: str, name: str = "at") -> DataFrame:
    """``df`` with the place of each row of its group in ``order`` (a number without nulls), from 0.

    No task holds a group: rows are put in order within their range (see ``bucketed``), and
    ranges start at the counts before them. Rows of equal ``order`` follow each other in any order.
    """
    rows = bucketed(df, by, order, "_b")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    mark = {c: f"_g{k}" for k, c in enumerate([*by, "_b"])}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(m)) for c, m in mark.items()])
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order)) - 1
    placed = rows.withColumn("_r", within).join(starts.drop("_n").withColumnsRenamed(mark), same)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_s") + F.col("_r")).alias(name))
