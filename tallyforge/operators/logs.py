"""Append-only logs: the row of each key that counts, under the rules that differ by log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """Last row of each key by ``position``."""
    w = Window.partitionBy(*key).orderBy(F.desc(position))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first(df: DataFrame, key: list[str], position: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(position)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_then(df: DataFrame, key: list[str], position: str, condition: Column) -> DataFrame:
    """A later row that fails the condition takes its key out."""
    return latest(df, key, position).where(condition)


def then_latest(df: DataFrame, key: list[str], position: str, condition: Column) -> DataFrame:
    """Rows that fail the condition do not hide an earlier one that holds."""
    return latest(df.where(condition), key, position)


def success_and_residue(df: DataFrame, key: list[str], position: str, ok: Column) -> DataFrame:
    """The last success of each key, else its last failure, with ``succeeded``."""
    w = Window.partitionBy(*key).orderBy(F.desc("succeeded"), F.desc(position))
    out = df.withColumn("succeeded", F.coalesce(ok, F.lit(False)))
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def review_winner(df: DataFrame, sample: list[str], reviewer: str, position: str, completed: Column) -> DataFrame:
    """One review a sample: of reviewers whose latest row is complete, the one who began last."""
    began = Window.partitionBy(*sample, reviewer)
    rows = latest_then(df.withColumn("_began", F.min(position).over(began)), [*sample, reviewer], position, completed)
    return latest(rows, sample, "_began").drop("_began")


def pending(queue: DataFrame, done: DataFrame, key: list[str], ok: Column) -> DataFrame:
    """Queued rows without a row in ``done`` that holds."""
    return queue.join(done.where(ok).select(*key).distinct(), key, "left_anti")


def first_unless_conflict(df: DataFrame, key: list[str], position: str, same: str) -> DataFrame:
    """First row of each key, with ``conflict`` where its rows differ in ``same``."""
    w = Window.partitionBy(*key)
    return first(df.withColumn("conflict", F.min(same).over(w) != F.max(same).over(w)), key, position)
