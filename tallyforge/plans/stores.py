"""Registered queries of sources and sinks: tables are written, read back and compared with their SQL.

They write to the session's checkpoint folder, which driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import joins, manifests
from ..sources import files
from .catalog import query, table


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; on a local master without one, in a temporary folder."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp()
    return f"{found}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price, TRUE AS refused FROM orders")
def json_lines_round_trip(spark, sf_dir):
    """Ordered, sorted keys, nulls kept, gzip; a second write to the place is refused; read strictly."""
    path = folder(spark, "lines")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("price"))
    files.write_json_lines(o, path, ["o_orderkey"])
    try:
        files.write_json_lines(o.limit(1), path, ["o_orderkey"])
        refused = False
    except AnalysisException:
        refused = True
    return files.read_json_lines(spark, path, o.schema).select("o_orderkey", "o_custkey", "price", F.lit(refused).alias("refused"))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS broken, TRUE AS failed FROM customer WHERE c_nationkey <> 3")
def lax_lines(spark, sf_dir):
    """Blank lines are skipped; a broken line fails the strict reader and is left out and counted by the tolerant one."""
    path = folder(spark, "lax")
    line = F.when(F.col("c_nationkey") == 3, F.lit('{"broken"')).otherwise(F.concat(F.to_json(F.struct("c_custkey", "c_name")), F.lit("\n")))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    try:
        files.read_json_lines(spark, path, "c_custkey bigint, c_name string").agg(F.max("c_custkey")).collect()
        failed = False
    except Exception:  # noqa: BLE001  the job's own class
        failed = True
    rows, broken = files.read_good_lines(spark, path, "c_custkey bigint, c_name string")
    return rows.join(F.broadcast(broken.agg(F.count(F.lit(1)).alias("broken")))).withColumn("failed", F.lit(failed))  # one row


@query("SELECT r_regionkey, r_name FROM region")
def wrapped_records(spark, sf_dir):
    """One document with its rows in a list."""
    path, r = folder(spark, "wrapped"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    r.agg(F.to_json(F.struct(F.collect_list(F.struct("r_regionkey", "r_name")).alias("records")), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    return files.read_wrapped(spark, path, r.schema)


@query("SELECT r_regionkey, CAST(CASE WHEN r_regionkey < 3 THEN r_regionkey ELSE r_regionkey - 3 END AS INT) AS line FROM region")
def appended_log(spark, sf_dir):
    """Two batches appended to a log; each row has its place, file by file."""
    path, r = folder(spark, "log"), table(spark, sf_dir, "region").select("r_regionkey").coalesce(1).sortWithinPartitions("r_regionkey")
    for part in ("r_regionkey < 3", "r_regionkey >= 3"):
        files.append_json_lines(r.where(part), path)
    ordered = files.read_log(spark, path, "r_regionkey int")
    lines = files.numbered_lines(spark, path).select(F.from_json("value", "r_regionkey int")["r_regionkey"].alias("r_regionkey"), F.col("line").cast("int").alias("line"))
    return lines.join(ordered.select("r_regionkey"), "r_regionkey")


@query("SELECT c_custkey + 1 AS line FROM customer WHERE c_nationkey = 7")
def broken_lines(spark, sf_dir):
    """The numbers of the lines of one file that hold no object."""
    path = folder(spark, "broken")
    line = F.when(F.col("c_nationkey") == 7, F.lit("[1]")).otherwise(F.to_json(F.struct("c_custkey", "c_name")))
    table(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1).select(line.alias("value")).write.text(path)
    return files.broken_lines(spark, path).select("line")


@query("SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal, round(c_acctbal / 2, 6) AS half FROM customer")
def csv_round_trip(spark, sf_dir):
    """Nested cells as JSON text, read back as boxes; other cells cast by name."""
    path = folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.array(F.col("c_acctbal"), F.col("c_acctbal") / 2).alias("box")), path)
    out = files.read_table_csv(spark, path, ("box",), c_custkey="bigint", c_acctbal="double")
    return out.select("c_custkey", "c_name", F.round("c_acctbal", 6).alias("c_acctbal"), F.round(F.col("box")[1], 6).alias("half"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY 1")
def split_folders(spark, sf_dir):
    """One folder a split, read back by folder."""
    path = folder(spark, "splits")
    files.write_by_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT sha256(t) AS sha256, CAST(strlen(t) AS BIGINT) AS bytes FROM (SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) AS t FROM region)")
def file_digests(spark, sf_dir):
    """Digest and size of a file, which is then verified."""
    path = folder(spark, "digest")
    table(spark, sf_dir, "region").coalesce(1).sortWithinPartitions("r_regionkey").select("r_name").write.text(path)
    out = files.digests(spark, f"{path}/*.txt")
    files.verified(spark, f"{path}/*.txt", out.first()["sha256"])
    return out.select("sha256", "bytes")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN unnest([o_orderpriority, lower(o_orderpriority)][1:CAST(greatest(o_orderkey % 3, 1) AS INT)]) END AS sentence FROM orders")
def references(spark, sf_dir):
    """One row a sentence; a reference without any keeps one row."""
    path = folder(spark, "refs") + ".parquet"
    said = F.slice(F.array("o_orderpriority", F.lower("o_orderpriority")), 1, (F.col("o_orderkey") % 3).cast("int"))
    table(spark, sf_dir, "orders").select("o_orderkey", said.alias("sentences")).write.parquet(path)
    return files.read_references(spark, path, "o_orderkey bigint, sentences array<string>")


@query(
    """SELECT count(*) AS annotations, count(*) FILTER (s_nationkey % 4 <> 0 AND s_nationkey <> 1) AS valid, (SELECT count(*) FROM region) AS images, (SELECT count(*) FROM nation) AS categories FROM supplier"""
)
def instances(spark, sf_dir):
    """Images, annotations and categories of one document; a box is valid with positive sides."""
    path = folder(spark, "instances")
    listed = lambda df, *c: df.agg(F.collect_list(F.struct(*c)).alias("x"))
    one = F.lit(1.0)
    box = F.when(F.col("s_nationkey") == 1, F.array(one, one)).otherwise(F.array(one, one, (F.col("s_nationkey") % 4).cast("double"), one))
    images = listed(table(spark, sf_dir, "region"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("file_name"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    categories = listed(table(spark, sf_dir, "nation"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    marks = listed(table(spark, sf_dir, "supplier"), F.col("s_suppkey").alias("id"), F.lit(1).alias("image_id"), F.col("s_nationkey").alias("category_id"), box.alias("bbox"), F.lit(0).alias("iscrowd"))
    whole = images.select(F.col("x").alias("images")).join(categories.select(F.col("x").alias("categories"))).join(marks.select(F.col("x").alias("annotations")))
    whole.select(F.to_json(F.struct("images", "categories", "annotations")).alias("value")).coalesce(1).write.text(path)
    i, a, c = files.read_instances(spark, path)
    counts = a.agg(F.count(F.lit(1)).alias("annotations"), F.count_if("valid").alias("valid"))
    return counts.join(i.agg(F.count(F.lit(1)).alias("images"))).join(c.agg(F.count(F.lit(1)).alias("categories")))


@query(
    """SELECT c_mktsegment AS model, round(avg(c_acctbal), 6) AS rate, round(min(c_acctbal), 6) AS rate_ci_lower, round(max(c_acctbal), 6) AS rate_ci_upper, NULL::BIGINT AS n FROM customer GROUP BY 1
UNION ALL SELECT 'suppliers', NULL, NULL, NULL, count(*) FROM supplier"""
)
def metrics_csv(spark, sf_dir):
    """Metrics of several models over the union of their columns, intervals as columns of their own."""
    path, v = folder(spark, "metrics"), "c_acctbal"
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.avg(v).alias("m"), F.min(v).alias("a"), F.max(v).alias("b"))
    c = c.select("model", manifests.with_interval(F.col("m"), F.col("a"), F.col("b")).alias("rate"))
    s = table(spark, sf_dir, "supplier").agg(F.lit("suppliers").alias("model"), F.count(F.lit(1)).alias("n"))
    files.write_metrics_csv([c, s], path)
    out = files.read_table_csv(spark, path, rate="double", rate_ci_lower="double", rate_ci_upper="double", n="bigint")
    return out.select("model", *[F.round(x, 6).alias(x) for x in ("rate", "rate_ci_lower", "rate_ci_upper")], "n")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS n_name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT -1, 'added'")
def merged_summaries(spark, sf_dir):
    """Rows of the second summary replace those of their key."""
    n = table(spark, sf_dir, "nation")
    after = n.where("n_regionkey = 1").select("n_nationkey", F.lit("new").alias("n_name")).union(spark.range(1).select(F.lit(-1), F.lit("added")))
    return files.merged(n.where("n_regionkey < 2").select("n_nationkey", "n_name"), after, ["n_nationkey"])


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |' || chr(10), '' ORDER BY r_regionkey) AS report FROM region")
def markdown_report(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.range(1).select(F.lit(files.markdown_table(r)).alias("report"))


@query("SELECT count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'one' END) AS values, count(*) AS n, TRUE AS refused FROM orders")
def single_value(spark, sf_dir):
    """Good rows have one setting at most and keys do not repeat, which is checked; all rows together are refused."""
    o = table(spark, sf_dir, "orders").withColumn("setting", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("one"))
    checked = manifests.assert_unique(manifests.assert_single(o, "setting", F.col("o_orderstatus") != "P"), ["o_orderkey"])
    try:
        manifests.assert_single(o, "setting", F.lit(True))
        refused = False
    except ValueError:
        refused = True
    return checked.agg(F.count_distinct("setting").alias("values"), F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))
