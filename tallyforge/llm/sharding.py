"""Sharding: a two-pass external shuffle in DataFrame operations only.

Pass one scatters the records into memory-sized buckets by a seeded hash of the
whole record, neighbouring buckets to one task. Pass two gathers each bucket, permutes it
with Spark's ``shuffle`` (a Fisher-Yates draw) and deals the chain of shuffled buckets to
the shards as consecutive ranges, so the shards' row counts differ by at most one (law
``rows``); each task writes its ranges. Records cross the network once.

Buckets are sorted before they are permuted and partitions hold whole buckets in
sorted order, so a retried task draws the same permutation. Rows that repeat are
the only cause of an oversized bucket; such buckets are split by row, and the parts are
dealt to tasks by hash.

What grows with the input in one place is the table of buckets, 24 bytes each, which every
task holds. There are at most ``MOST_BUCKETS``, and as many parts of split ones: beyond
8 TB the buckets themselves grow, to 100 MB at 100 TB.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

SHARDS = 24
SEED = 20_260
#: Bytes of records that a bucket should hold (a task gathers one at a time), and that a task should get.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 128 << 20
MOST_BUCKETS = 1_000_000
#: A bucket of more than this many times its share is split by row.
OVERSIZE = 4
#: Buckets whose rows are summed in one go.
TOGETHER = 4096


def record_bytes(df: DataFrame) -> F.Column:
    """About the bytes of a record: its strings and binaries, and 8 for each other column."""
    cost = F.lit(8).cast("long")
    for field in df.schema.fields:
        wide = isinstance(field.dataType, (T.StringType, T.BinaryType))
        cost = cost + (F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) if wide else F.lit(8))
    return cost.cast("long")


def starts_of(counts: DataFrame) -> DataFrame:
    """(b, p, start): the rows before each bucket (b, p, rows), summed in two steps."""
    counts = counts.withColumn("t", F.expr(f"b div {TOGETHER}"))
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("t").agg(F.sum("rows").alias("n")).select("t", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("t").orderBy("b", "p").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("local", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    return local.join(F.broadcast(base), "t").select("b", "p", (F.col("base") + F.col("local")).alias("start"))  # a row for 4,096 buckets


def shuffle_into_shards(
    df: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    size: F.Column | None = None,
    shard_name: str = "shard",
    slot_name: str = "slot",
) -> DataFrame:
    """Every row of ``df`` once, in random order, with its shard and its slot there.

    Slots count from 0 without gaps. Nulls in any column are hashed like values,
    repeated rows are separate records, records of equal hash tie and are ordered by all
    columns, very long texts are moved whole, an empty table gives an empty result, and
    names that ``df`` has already get underscores for the two new columns. Columns
    that Spark cannot hash or order (maps, variants) are not supported.
    ``size`` (bytes of a record) only steers the number of buckets.
    """
    spark = df.sparkSession
    columns = [F.col(f"`{c}`") for c in df.columns]
    shard_name, slot_name = common.free_name(df, shard_name), common.free_name(df, slot_name)
    keyed = df.select(
        F.struct(*columns).alias("r"),
        F.xxhash64(F.lit(seed), *columns).alias("h"),
        (size if size is not None else record_bytes(df)).alias("n"),
    )
    total = keyed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    rows, bucket_bytes = total["rows"], max(bucket_bytes, math.ceil(total["bytes"] / MOST_BUCKETS))
    buckets = max(1, math.ceil(total["bytes"] / bucket_bytes))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = max(1, min(TASK_BYTES // bucket_bytes, math.ceil(buckets / parallel)))  # buckets of a task
    tasks = math.ceil(buckets / run)
    bucketed = keyed.withColumn("b", F.pmod("h", F.lit(buckets)))

    counts = common.stored(bucketed.groupBy("b").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")), "buckets")
    large = counts.where(F.col("bytes") > OVERSIZE * bucket_bytes).select("b", F.ceil(F.col("bytes") / bucket_bytes).alias("parts"))
    task, keys = F.expr(f"b div {run}"), ["task", "b"]
    if large.limit(1).count():
        # the row number only tells repeated rows apart
        bucketed = bucketed.withColumn("i", F.monotonically_increasing_id()).join(F.broadcast(large), "b", "left")
        bucketed = bucketed.withColumn("p", F.pmod("i", F.coalesce("parts", F.lit(1))))
        task, keys = F.when(F.col("parts").isNull(), task).otherwise(F.pmod(F.xxhash64("b", "p"), F.lit(tasks))), ["task", "b", "p"]
        counts = common.stored(bucketed.groupBy("b", "p").agg(F.count(F.lit(1)).alias("rows")), "parts")
    else:
        counts = counts.withColumn("p", F.lit(0).cast("long"))
    starts = F.broadcast(common.stored(starts_of(counts), "starts"))

    gathered = (
        bucketed.withColumn("task", task.cast("int"))
        .repartitionById(tasks, F.col("task"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("h", "r"))).alias("all"))
        .sortWithinPartitions(*keys[1:])
        .select(*keys[1:], F.shuffle("all", seed).alias("all"))
    )
    place = F.col("start") + F.col("k")
    dealt = (
        gathered.join(starts if "p" in keys else starts.drop("p"), keys[1:])
        .select("start", F.posexplode("all").alias("k", "x"))
        .select("x.r", place.alias("place"))
        .withColumn("s", F.expr(f"(place * {shards}) div {max(rows, 1)}"))
    )
    first = F.expr(f"(s * {rows} + {shards - 1}) div {shards}")
    return dealt.select("r.*", F.col("s").cast("int").alias(shard_name), (F.col("place") - first).cast("long").alias(slot_name))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the shards as one folder each, ``shard=0`` and so on, rows of a file in slot order.

    A task writes the ranges of its buckets, so files hold consecutive slots but where a
    bucket was split.
    """
    name, slot = common.free_name(df, "shard"), common.free_name(df, "slot")
    dealt = shuffle_into_shards(df, **options)
    dealt.sortWithinPartitions(name, slot).write.partitionBy(name).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all ``documents``, read back from the shards that were written.

    Null texts count as empty in the checksum and have no bytes; see
    ``shuffle_into_shards`` for ties, repeated rows, very long texts and empty tables.
    """
    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path)
    shard, slot = common.free_name(docs, "shard"), common.free_name(docs, "slot")
    schema = T.StructType([*docs.schema.fields, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    text = F.coalesce("text", F.lit(""))
    return spark.read.schema(schema).parquet(path).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their shard and slot."""
    return shuffle_into_shards(docs)
