"""Scans and sinks: JSON lines, wrapped JSON, CSV with nested cells, verified files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, plain or gzip by suffix; blank lines are skipped, and a broken one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_good_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines, and the lines (file, value) that hold none, for the caller to count or keep.

    Each of the two reads the files when it is used.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.length(F.btrim("value", F.lit(" \t\r"))) > 0)
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return lines.where(whole).select(F.from_json("value", schema).alias("r")).select("r.*"), lines.where(~whole)


def read_wrapped(spark: SparkSession, path: str, schema: T.StructType, field: str = "records") -> DataFrame:
    """One JSON document with its rows in a list field."""
    outer = T.StructType([T.StructField(field, T.ArrayType(schema))])
    return spark.read.schema(outer).option("multiLine", True).json(path).select(F.inline(field))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) of each line that is not blank; ``position`` sorts by file, then by line.

    Files are read split by split, and a line's place is its split's and its number there,
    so no task needs a file as a whole.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return scan.select(place.alias("position"), "value").where(F.length(F.btrim("value", F.lit(" \t\r"))) > 0)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of each line that is not blank; ``line`` counts all lines of the file from 0.

    The lines of each split are counted first, and the few counts added up; that reads the
    files twice. Use ``read_lines`` where the order is enough.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    out = lines.where(F.length(F.btrim("value", F.lit(" \t\r"))) > 0).join(splits, ["file", "block"])
    return out.select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that hold no JSON object; ``line`` counts from 1."""
    parsed = F.try_parse_json("value")
    whole = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return numbered_lines(spark, path).where(~whole).select("file", (F.col("line") + 1).alias("line"), "value")


def checked_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines whose every line is an object; else an error that names the first broken line."""
    first = broken_lines(spark, path).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}:{first[0]['line']}: no JSON object")
    return read_json_lines(spark, path, schema)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with ``position``: file, then line, the order that latest-wins needs."""
    return read_lines(spark, path).select("position", F.from_json("value", schema).alias("r")).select("position", "r.*")


def read_table_csv(spark: SparkSession, path: str, boxes: tuple[str, ...] = (), **casts: str) -> DataFrame:
    """CSV with a header, all text; box cells hold JSON, other cells are cast by name."""
    out = spark.read.option("header", True).csv(path)
    for name in boxes:
        out = out.withColumn(name, F.from_json(name, "array<double>"))
    for name, kind in casts.items():
        out = out.withColumn(name, F.col(name).try_cast(kind))
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, sha256: str) -> str:
    """``path``, if its only file has the digest."""
    found = [r["sha256"] for r in digests(spark, path).limit(2).collect()]
    if found != [sha256]:
        raise ValueError(f"{path}: digest {found} is not {sha256}")
    return path


def write_json_lines(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Sorted keys, nulls kept, rows in order, gzip; reruns give the same bytes."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(line.alias("value")).write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip").text(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested cells as JSON."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.option("header", True).csv(path)


def write_by_split(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).mode("errorifexists").parquet(path)


def read_references(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Referring expressions from a JSON or Parquet export, one row a sentence; pickled files are not read.

    Rows without sentences keep one row with a null ``sentence``, for the check that follows.
    """
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_json_lines(spark, path, schema)
    return df.select("*", F.explode_outer("sentences").alias("sentence")).drop("sentences")


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of an instances document; annotations say whether their box is valid.

    A box is valid with four finite numbers and a positive width and height. A document
    without any of the three parts is an error.
    """
    image, category = "array<struct<id:bigint,file_name:string,width:int,height:int>>", "array<struct<id:bigint,name:string>>"
    annotation = "array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int>>"
    whole = spark.read.schema(f"images {image}, annotations {annotation}, categories {category}").option("multiLine", True).json(path)
    sizes = whole.select(*[F.coalesce(F.size(c), F.lit(0)).alias(c) for c in whole.columns]).agg(*[F.sum(c).alias(c) for c in whole.columns]).first()
    empty = [c for c in whole.columns if not sizes[c]]
    if empty:
        raise ValueError(f"{path}: nothing in {empty}")
    images, annotations, categories = (whole.select(F.inline(c)) for c in whole.columns)
    b = F.col("bbox")
    finite = F.size(F.filter(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))) == 4
    return images, annotations.withColumn("valid", F.coalesce((F.size(b) == 4) & finite & (b[2] > 0) & (b[3] > 0), F.lit(False))), categories


def replace_file(path: str, content: str, overwrite: bool = False) -> None:
    """Write a small manifest beside ``path`` and put it in place in one step; a failure leaves no trace.

    For single files in a shared folder. Tables use Spark's own commit.
    """
    import os

    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    part = f"{path}.tmp"
    try:
        with open(part, "w", encoding="utf-8", newline="\n") as f:
            f.write(content)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def with_flat_intervals(df: DataFrame) -> DataFrame:
    """Structs of value, ci_lower and ci_upper become three columns."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType) and {"value", "ci_lower", "ci_upper"} <= set(f.dataType.names):
            out += [F.col(f.name)["value"].alias(f.name), F.col(f.name)["ci_lower"].alias(f"{f.name}_ci_lower"), F.col(f.name)["ci_upper"].alias(f"{f.name}_ci_upper")]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_metrics_csv(frames: list[DataFrame], path: str) -> None:
    """Metrics of several models as one CSV over the union of their columns."""
    from ..operators.evaluation import union_all

    write_csv(union_all([with_flat_intervals(f) for f in frames]), path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report table; more than ``most`` rows are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def merged(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keyed upsert of summaries: rows of ``after`` replace those of their key."""
    return before.join(after.select(*key).distinct(), key, "left_anti").unionByName(after, allowMissingColumns=True)
