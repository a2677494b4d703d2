"""An extension: follow a folder of log files and keep the latest row of each key.

Order is arrival order, as in the batch rules, so there is no watermark. A batch writes
only its own keys' latest rows; ``current`` takes the latest over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.logs import latest


def follow(spark: SparkSession, folder: str, schema: T.StructType, key: list[str], position: str, state: str, checkpoint: str):
    """Start a query that adds each batch's latest rows as ``epoch=n`` under ``state``; a repeated batch replaces itself."""

    def add(batch: DataFrame, epoch: int) -> None:
        latest(batch, key, position).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, schema: T.StructType, key: list[str], position: str, state: str) -> DataFrame:
    """The latest row of each key over all batches."""
    return latest(spark.read.schema(schema).parquet(state), key, position)


def compacted(spark: SparkSession, schema: T.StructType, key: list[str], position: str, state: str, into: str) -> None:
    """Write the current rows as the only epoch of a new state folder, while no query follows."""
    current(spark, schema, key, position, state).write.mode("errorifexists").parquet(f"{into}/epoch=-1")
