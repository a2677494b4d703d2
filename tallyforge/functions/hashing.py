"""Deterministic assignment by SHA-256: splits, shards, swaps and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def digest(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def head_number(value: Column, digits: int = 16) -> Column:
    """The first hex digits of the digest as an unsigned number."""
    return F.conv(F.substring(digest(value), 1, digits), 16, 10).cast("decimal(20,0)")


def shard_of(value: Column, shards: int, digits: int = 16) -> Column:
    return F.pmod(head_number(value, digits), F.lit(shards).cast("decimal(20,0)")).cast("int")


def swap_bit(value: Column) -> Column:
    return (F.conv(F.substring(digest(value), 1, 2), 16, 10).cast("int") % 2) == 1


def exact_split(df: DataFrame, key: str, fraction: float, seed: str, name: str = "data_split") -> DataFrame:
    """Distinct keys with ``calibration`` for the exact share of least digests, else ``train``.

    The share is rounded half to even and leaves one key on each side. The ranks are
    found in two steps, so the keys are never sorted in one task: a digest's first
    three hex digits give its bucket, and ranks start at the bucket's running count.
    """
    keys = df.select(key).distinct().withColumn("h", digest(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    keys = keys.withColumn("b", F.substring("h", 1, 3))
    counts = keys.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = keys.join(F.broadcast(starts), "b")  # at most 4,096 rows
    rank = F.col("start") + F.row_number().over(Window.partitionBy("b").orderBy("h", key))
    wanted = F.greatest(F.lit(1), F.least(F.bround(F.col("total") * fraction), F.col("total") - 1))
    return ranked.select(key, F.when(rank <= wanted, "calibration").otherwise("train").alias(name))


def quotas(sources: DataFrame, total: int, key: str = "source") -> DataFrame:
    """``total`` divided over the sources; the first ones in order take the remainder."""
    everything = Window.partitionBy()
    n, rank = F.count(F.lit(1)).over(everything), F.row_number().over(Window.orderBy(key))
    return sources.select(key).distinct().select(key, (F.floor(F.lit(total) / n) + (rank <= F.lit(total) % n).cast("int")).cast("long").alias("quota"))
