"""Rules of append-only logs over a stream, with state by key.

Files may arrive in any order: a row counts by its place, not by the time that it is read, so
after all files the rows are those of the batch rules in ``operators.logs``. State survives a
restart in the query's checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import latest

HELD = "held binary"


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def _best_of_batches(key: list[str], rank: list[str]):
    """Keeps one row a key of each Arrow batch, so a frequent key reaches its state in few rows."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(rank).drop_duplicates(key, keep="last")

    return best


def greatest(stream: DataFrame, key: list[str], rank: list[str]) -> DataFrame:
    """Updates of the row of greatest ``rank`` (numbers without nulls that decide every tie) of each key.

    Ranked by place it is the latest row (filter before it for "filter, then latest", after
    it for "latest, then filter"); by success and place, the last success, else the last row.
    """
    schema = stream.schema

    def update(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        now = held
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                values = dict(zip(frame.columns, map(_plain, row)))
                if now is None or [values[c] for c in rank] > [now[c] for c in rank]:
                    now = values
        if now is not held:
            state.update((pickle.dumps(now),))
            yield pd.DataFrame({f.name: pd.Series([now[f.name]], dtype=object) for f in schema.fields})

    few = stream.mapInPandas(_best_of_batches(key, rank), schema)
    return few.groupBy(*key).applyInPandasWithState(update, schema, HELD, "update", GroupStateTimeout.NoTimeout)


def review_winners(stream: DataFrame, sample: list[str], reviewer: str, position: str, completed: Column) -> DataFrame:
    """Updates of the winning review of each sample, with ``gone`` where it has none any more.

    As the batch rule: of the reviewers whose latest row is complete, the one who began
    last. A later draft takes its reviewer out. A sample's state has one row a reviewer.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("gone", T.BooleanType())])
    marked = stream.withColumn("gone", ~F.coalesce(completed, F.lit(False)))

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first and the last row of each reviewer in a batch."""
        for frame in frames:
            frame = frame.sort_values(position)
            by = [*sample, reviewer]
            yield frame[~frame.duplicated(by) | ~frame.duplicated(by, keep="last")]

    def update(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reviews, before = pickle.loads(state.get[0]) if state.exists else ({}, None)
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                values = dict(zip(frame.columns, map(_plain, row)))
                began, last = reviews.get(values[reviewer], (values[position], None))
                if last is None or values[position] > last[position]:
                    last = values
                reviews[values[reviewer]] = (min(began, values[position]), last)
        done = [(began, last) for began, last in reviews.values() if not last["gone"]]
        now = max(done, key=lambda x: x[0])[1] if done else None
        state.update((pickle.dumps((reviews, now)),))
        if now != before:
            shown = now or {**before, "gone": True}
            yield pd.DataFrame({f.name: pd.Series([shown[f.name]], dtype=object) for f in schema.fields})

    few = marked.mapInPandas(ends, schema)
    return few.groupBy(*sample).applyInPandasWithState(update, schema, HELD, "update", GroupStateTimeout.NoTimeout)


def run(updates: DataFrame, folder: str, checkpoint: str):
    """Start a query that adds each batch's updates as ``epoch=n`` under ``folder``; a repeated batch replaces itself."""

    def add(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return updates.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, schema: T.StructType, key: list[str], folder: str) -> DataFrame:
    """The rows that hold after all batches: each key's last update, unless it says ``gone``."""
    kept = latest(spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(folder), key, "epoch").drop("epoch")
    return kept.where(~F.col("gone")).drop("gone") if "gone" in schema.names else kept


def followed(spark: SparkSession, files: str, schema: T.StructType | str, rule: Callable[[DataFrame], DataFrame], key: list[str], folder: str, checkpoint: str, files_a_batch: int = 1000) -> DataFrame:
    """Take in the files that are new in a folder of JSON lines by ``rule``; the rows that hold then."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(files)
    updates = rule(stream)
    run(updates, folder, checkpoint).awaitTermination()
    return current(spark, updates.schema, key, folder)
