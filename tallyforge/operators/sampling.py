"""Deterministic choice of rows: top ranks, representatives, shards and a balanced subset."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import digest
from .ranks import positions


def best_of(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The row of least ``order`` for each key; the columns have to decide every tie."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("r")).select("r.*")


def hash_order(seed: str, *parts: Column) -> Column:
    return digest(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))


def top_n(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank`` from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n)


def assert_full(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """``df``, if each of its groups has ``n`` rows."""
    short = df.groupBy(*by).count().where(F.col("count") < n).orderBy(*by).limit(20).collect()
    if short:
        raise ValueError(f"groups of fewer than {n} rows: {[tuple(r) for r in short]}")
    return df


def round_robin(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Shard by position in ``order``.

    ``order`` is a number without nulls; see ``ranks.positions``, which puts no table into
    one task.
    """
    return positions(df, (), order, "_at").withColumn("shard", (F.col("_at") % shards).cast("int")).drop("_at")


def balanced_sample(df: DataFrame, stratum: str, key: str, total: int, strata: list[str], seed: str) -> DataFrame:
    """``total // len(strata)`` rows of each stratum by hash order, filled up from the rest in the same order."""
    each = total // len(strata)
    h = hash_order(seed, F.col(key))
    # no stratum needs more than ``total`` rows, so at most total x strata are ranked together
    ranked = top_n(df.where(F.col(stratum).isin(strata)).withColumn("_h", h), [stratum], total, F.col("_h"), F.col(key))
    return ranked.orderBy(F.col("rank") >= each, "_h", key).limit(total).drop("_h", "rank")


def representatives(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``df`` with ``first_of_group``, true at the least ``order`` (a key) of each group.

    The least is a sum that tasks make before anything is shuffled; no group is sorted.
    """
    least = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.min(order).alias("_least"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
    return df.join(least, same).select(*df.columns, (F.col(order) == F.col("_least")).alias("first_of_group"))


def compute_subset(df: DataFrame, quotas: dict[str, int], seed: str, source: str = "source", key: str = "query_id", image: str = "image_id", same: tuple[str, ...] = ("image_id", "ann_id", "query")) -> DataFrame:
    """Keys chosen to fill every source's quota, with ``queue_rank`` from 0.

    Sources take turns in order of name, each giving its next row by hash; first only rows
    of unused images, then any, and never a second row of one meaning (``same``; text is
    trimmed and lower-cased). A quota that can't be met is an error.

    An acceptance depends on all before it, so one task makes the choice, over rows that
    the quotas bound: with Q wanted in total, Q rows of different meaning, and the Q first
    rows of different images, hold all that a source can be asked for.
    """
    wanted = sum(quotas.values())
    kinds = dict(df.dtypes)
    meaning = [F.lower(F.trim(F.col(c))) if kinds[c] == "string" else F.col(c) for c in same]
    rows = df.where(F.col(source).isin(list(quotas))).select(
        F.col(source).cast("string").alias("s"), F.col(key).cast("string").alias("q"), F.col(image).cast("string").alias("i"), F.to_json(F.struct(*[m.alias(f"m{n}") for n, m in enumerate(meaning)])).alias("m")
    ).withColumn("h", hash_order(seed, F.col("s"), F.col("q")))
    unlike = best_of(rows, ["s", "m"], F.col("h"), F.col("q"))
    order = (F.col("h"), F.col("q"))
    any_row = top_n(unlike, ["s"], wanted, *order)
    new_image = top_n(best_of(unlike, ["s", "i"], *order), ["s"], wanted, *order)
    pool = any_row.drop("rank").union(new_image.drop("rank")).distinct()

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        turns = {s: list(g.sort_values(["h", "q"]).itertuples(index=False)) for s, g in pool.groupby("s")}
        left, taken, meanings, images = dict(quotas), [], set(), set()
        for fresh in (True, False):
            queues = {s: iter(turns.get(s, [])) for s in sorted(quotas)}
            while queues:
                for s in list(queues):
                    row = None
                    if left[s] > 0:
                        row = next((r for r in queues[s] if r.m not in meanings and not (fresh and r.i in images)), None)
                    if row is None:
                        del queues[s]
                        continue
                    taken.append((s, row.q, len(taken)))
                    meanings.add(row.m)
                    images.add(row.i)
                    left[s] -= 1
        short = {s: n for s, n in left.items() if n > 0}
        if short:
            raise ValueError(f"quotas not met: {short}")
        return pd.DataFrame(taken, columns=[source, key, "queue_rank"])

    return pool.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, f"{source} string, {key} string, queue_rank long")
