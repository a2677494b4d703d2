"""Split isolation and set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Parts in which the first examples of a pair of splits are looked for.
PARTS = 512


def identity(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """Rows and distinct keys of each split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("records"), *[F.count_distinct(k).alias(f"distinct_{k}") for k in keys])


def overlaps(df: DataFrame, split: str, keys: list[str], examples: int = 10) -> DataFrame:
    """For each pair of splits and each key: how many values both hold, and the first of them."""
    parts = []
    for k in keys:
        values = df.where(F.col(k).isNotNull()).select(F.col(split).alias("s"), F.col(k).cast("string").alias("v")).distinct()
        pairs = values.alias("a").join(values.alias("b"), "v").where("a.s < b.s").select(F.col("a.s").alias("left_split"), F.col("b.s").alias("right_split"), "v")
        # counted by task first; the least values of each range of the hash, then the least of those
        counts = pairs.groupBy("left_split", "right_split").agg(F.count(F.lit(1)).alias("shared"))
        some = Window.partitionBy("left_split", "right_split", F.pmod(F.xxhash64("v"), F.lit(PARTS))).orderBy("v")
        few = pairs.withColumn("_k", F.row_number().over(some)).where(F.col("_k") <= examples)
        least = few.groupBy("left_split", "right_split").agg(F.slice(F.sort_array(F.collect_list("v")), 1, examples).alias("examples"))
        found = counts.join(least, ["left_split", "right_split"])
        parts.append(found.withColumn("key", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, and on both."""
    x, y = a.select(*key).distinct().withColumn("_a", F.lit(1)), b.select(*key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("_a").isNull(), 1)).alias("right_only"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"))


def verdict(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """One row: whether no value of any key stands in two splits (``all_disjoint``), and how many values do."""
    values = reduce(DataFrame.union, [df.where(F.col(k).isNotNull()).select(F.lit(k).alias("k"), F.col(k).cast("string").alias("v"), F.col(split).alias("s")).distinct() for k in keys])
    held = values.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    return held.agg(F.count_if(F.col("n") > 1).alias("shared_values")).select((F.col("shared_values") == 0).alias("all_disjoint"), "shared_values")


def assert_disjoint(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """``df``, if its splits share no value of any key; else an error that names how many."""
    found = verdict(df, split, keys).first()
    if not found["all_disjoint"]:
        raise ValueError(f"{found['shared_values']} values stand in more than one split")
    return df
