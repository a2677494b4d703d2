"""From raw documents to training shards: five stages, each stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import common, decontaminate, mixing, neardup, quality, sharding

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: The trained classifier and the hash draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded rows of ``documents``: their columns, ``shard`` and ``slot``.

    Null and empty texts are scored like any text and form one class; the mix takes no
    document without words. Repeated rows and ties are one class, of which one row stays.
    Very long texts are read whole in every stage. An empty table gives an empty result.
    Other columns pass through, whatever their names. Tables that a stage wrote are
    deleted when its result is stored.
    """
    docs, since = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.forget(spark, since)
    return docs
