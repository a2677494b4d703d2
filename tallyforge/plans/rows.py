"""Registered queries of keys, projections, checks and sinks of single rows, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import joins, manifests, records, sampling
from ..sources import files, members
from .catalog import query, table
from .stores import folder


@query(
    """SELECT conv_id, turn, role AS task, conv_id || '.jpg' AS image, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS query, coalesce(CASE WHEN turn % 3 > 0 THEN turn % 3 = 1 END, FALSE) AS exists_,
  CASE WHEN conv_id % 4 > 0 THEN '/' || CASE conv_id % 4 WHEN 1 THEN 'b' ELSE 'a' END || '/' || conv_id || '.jpg' END AS path FROM conversations WHERE conv_id % 4 > 0"""
)
def output_keys(spark, sf_dir):
    """Cache key of each turn, and the first of two places at which its image is listed; images without one are left out."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.col("conv_id").cast("string"), F.lit(".jpg"))
    key = manifests.output_key(F.col("role"), F.concat(F.lit("some/folder/"), name), F.concat(F.lit(" "), F.col("text"), F.lit("\n")), F.when(F.col("turn") % 3 > 0, F.col("turn") % 3 == 1))
    listed = c.select("conv_id").distinct().withColumn("n", F.col("conv_id") % 4)
    at = lambda place, where: listed.where(where).select(F.concat(F.lit(f"/{place}/"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("path"))
    listing = at("a", "n >= 2").union(at("b", "n = 1 OR n = 3"))
    found = joins.resolved(c.select("conv_id", "turn", key.alias("k")), listing, [F.concat(F.lit(f"/{p}/"), F.col("conv_id").cast("string"), F.lit(".jpg")) for p in ("a", "b")])
    return found.select("conv_id", "turn", "k.task", "k.image", "k.query", F.col("k.exists").alias("exists_"), "path")


@query(
    """SELECT o_orderkey, '[' || string_agg('{' || concat_ws(',', '"line":' || l_linenumber, CASE WHEN l_returnflag <> 'N' THEN '"flag":"' || l_returnflag || '"' END) || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) || ']' AS items,
  arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS truth, string_agg('T' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS tasks, any_value(o_orderpriority) AS query
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def request_contexts(spark, sf_dir):
    """The request of each order as nested JSON: items with the fields that they have, the first case's truth, all cases' tasks."""
    case = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(case)).alias("lines"))
    cases = F.transform("lines", lambda x: F.struct(F.concat(F.lit("T"), x["l_linenumber"].cast("string")).alias("task"), F.array(x["l_quantity"]).alias("baseline_box"), F.lit("near").alias("automatic_baseline_class"), F.array(x["l_quantity"]).alias("gt_box"), x["l_linenumber"].alias("line"), x["flag"].alias("flag")))
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("cases", cases)
    context = manifests.request_context(F.col("cases"), {"query": F.col("o_orderpriority")})
    o = o.select("o_orderkey", text.compact_items(F.col("cases"), ["line", "flag"]).alias("items"), context.alias("c"))
    return o.select("o_orderkey", "items", F.col("c.gt_box_xyxy")[0].alias("truth"), F.array_join(F.transform("c.zero_iou_baselines", lambda z: z["task"]), ",").alias("tasks"), "c.query")


@query("""SELECT o_orderpriority AS name, n, sha256('{"n": ' || n || ', "priority": "' || o_orderpriority || '"}') AS digest FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def spec_digests(spark, sf_dir):
    """A setting for each priority of orders (a handful), chosen by name, with the digest that is the same for any order of its keys."""
    counts = {r[0]: {"priority": r[0], "n": r[1]} for r in table(spark, sf_dir, "orders").groupBy("o_orderpriority").count().collect()}
    rows = [(s.pop("name"), s["n"], manifests.spec_digest(s)) for s in manifests.chosen(counts, sorted(counts, reverse=True))]
    return spark.createDataFrame(rows, "name string, n long, digest string")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS quantity, 'images/' || l_orderkey || '.jpg' AS path, 'dev' AS suite, l_quantity AS first_side, l_quantity + 10 AS second_side, TRUE AS refused FROM lineitem"""
)
def inference_rows(spark, sf_dir):
    """Rows for a judge: allowed columns with their types, path, suite and two boxes as one array; a forbidden column is refused."""
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumns({"path": F.concat(F.lit("images/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")), "suite": F.lit("dev"), "quantity": q, "boxes": F.array(F.array(q, q), F.array(q + 10, q))})
    allowed = {"l_orderkey": "bigint", "l_linenumber": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "quantity": "int", "path": "string", "suite": "string", "boxes": "array<array<double>>"}
    try:
        records.assert_without(rows, ("l_tax",))
        refused = False
    except ValueError:
        refused = True
    out = records.projected(rows, allowed, ("l_tax",))
    return out.select(*list(allowed)[:-1], F.col("boxes")[0][0].alias("first_side"), F.col("boxes")[1][0].alias("second_side"), F.lit(refused).alias("refused"))


@query(
    """SELECT violation, count(*) AS n FROM (SELECT unnest([x FOR x IN [CASE WHEN o_custkey % 13 = 0 THEN 'missing_image' END, CASE WHEN o_orderkey % 7 = 0 THEN 'missing_annotation' END,
  CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 = 0 THEN 'wrong_image' END, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 3 = 0 THEN 'wrong_category' END, CASE WHEN o_orderkey % 4 = 3 THEN 'unknown_category' END] IF x IS NOT NULL]) AS violation FROM orders) GROUP BY 1"""
)
def reference_checks(spark, sf_dir):
    """References of orders to their customer as image: missing and wrong images, annotations and categories are counted."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    refs = o.select(F.col("o_custkey").alias("image_id"), k.alias("ann_id"), (k % 4).alias("category_id"))
    marks = o.where(k % 7 != 0).select(k.alias("ann_id"), F.when(k % 5 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("image_id"), F.when(k % 3 == 0, F.lit(9)).otherwise(k % 4).alias("category_id"))
    images = o.select(F.col("o_custkey").alias("image_id")).where("image_id % 13 <> 0")
    out = joins.checked_references(refs, images, marks, spark.range(3).select(F.col("id").alias("category_id")))
    return out.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i,
  l_linenumber = 5 AS gone, l_linenumber = 2 AS blank, l_returnflag NOT IN ('A', 'R') AS odd FROM lineitem),
v AS (SELECT l_orderkey, CASE WHEN gone THEN ['items[' || i || '] is no object'] ELSE [x FOR x IN [CASE WHEN blank THEN 'items[' || i || '].value is empty' END, CASE WHEN odd THEN 'items[' || i || '].flag is invalid' END] IF x IS NOT NULL] END AS w, i FROM l)
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'items is no list' WHEN count(i) = 0 THEN 'items is empty' ELSE coalesce(string_agg(array_to_string(w, ';'), ';' ORDER BY i) FILTER (len(w) > 0), '') END AS wrong
FROM orders LEFT JOIN v ON l_orderkey = o_orderkey GROUP BY 1"""
)
def nested_checks(spark, sf_dir):
    """Lines of an order as nested items: null items, blank texts and values outside their list, by their place."""
    n = F.col("l_linenumber")
    item = F.when(n != 5, F.struct(F.when(n == 2, " ").otherwise("x").alias("value"), F.col("l_returnflag").alias("flag")))
    held = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", item.alias("item"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["item"]).alias("items"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    items = F.when(F.col("o_orderkey") % 10 != 0, F.coalesce("items", F.array().cast(lines.schema["items"].dataType)))
    return o.select("o_orderkey", F.array_join(records.item_violations(items, "items", ("value",), {"flag": ("A", "R")}, some=True), ";").alias("wrong"))


@query(
    """WITH g AS (SELECT l_returnflag, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) - 1 AS available FROM lineitem),
h AS (SELECT l_returnflag, available, count(*) AS n FROM g GROUP BY ALL)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, string_agg(available || '=' || n, ',' ORDER BY available) AS histogram FROM h GROUP BY 1"""
)
def availability(spark, sf_dir):
    """How many others of its image and category each box has, as a histogram of each category."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", joins.group_size_without_self(["l_suppkey", "l_returnflag"]).alias("available"))
    out = joins.value_counts(li, ["l_returnflag"], "available")
    return out.select("l_returnflag", "n", F.array_join(F.transform(F.map_entries("available_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("histogram"))


@query(
    """SELECT event_type, count(*) AS n, CASE WHEN count(*) < 100000000 THEN 'groups of fewer than 100000000 rows' END AS refused, 5 AS taken FROM events GROUP BY 1"""
)
def full_pools(spark, sf_dir):
    """The first five events of each type; a pool that is too short for a number of rows is refused."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    first = sampling.assert_full(sampling.top_n(e, ["event_type"], 5, sampling.hash_order("p", F.col("event_id")), F.col("event_id")), ["event_type"], 5)
    try:
        sampling.assert_full(e, ["event_type"], 100_000_000)
        said = None
    except ValueError as error:
        said = str(error).partition(":")[0]
    taken = first.groupBy("event_type").agg(F.count(F.lit(1)).cast("int").alias("taken"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(said)).join(taken, "event_type")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'seen ' || o_orderpriority ELSE '' END AS description, o_orderkey % 3 = 0 AS parse_valid, CASE WHEN o_orderkey % 3 = 0 THEN 10.0 END AS left_side, CASE WHEN o_orderkey % 3 = 0 THEN 40.0 END AS right_side FROM orders WHERE o_orderkey % 5 <> 0"""
)
def reparsed_replies(spark, sf_dir):
    """Stored replies read again with the image sizes of their queue."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    said = F.concat(F.lit('{"description": "seen '), F.col("o_orderpriority"), F.lit('", "exists": "yes", "bbox": [10, 10, 40, 30]}'))
    log = o.where(k % 5 != 0).select("o_orderkey", F.when(k % 3 == 0, said).when(k % 3 == 1, "no answer").alias("raw"))
    queue = o.select("o_orderkey", F.lit(100.0).alias("width"), F.lit(80.0).alias("height"))
    out = manifests.reparsed(log, queue, "o_orderkey", F.col("raw"), "width", "height", parsing.read_described, "read")
    return out.select("o_orderkey", F.col("read.generated_description").alias("description"), "read.parse_valid", F.col("read.pred_bbox_xyxy")[0].alias("left_side"), F.col("read.pred_bbox_xyxy")[2].alias("right_side"))


@query("SELECT count(*) AS n, TRUE AS refused, TRUE AS replaced, TRUE AS tidy FROM customer")
def guarded_sinks(spark, sf_dir):
    """A counted sink that refuses to overwrite, and a manifest put in place in one step, again only when asked to."""
    path = folder(spark, "guarded")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n = manifests.write_counted(c, f"{path}/rows", ["c_custkey"])
    refused = []
    for write in (lambda: manifests.write_counted(c, f"{path}/rows", ["c_custkey"]), lambda: files.replace_file(f"{members.local(path)}/manifest.json", "{}")):
        try:
            files.replace_file(f"{members.local(path)}/manifest.json", "[]", overwrite=True)
            write()
        except Exception as error:  # noqa: BLE001  Spark's own class for tables, Python's for files
            refused.append("exist" in str(error).lower() or isinstance(error, FileExistsError))
    files.replace_file(f"{members.local(path)}/manifest.json", str(n), overwrite=True)
    with open(f"{members.local(path)}/manifest.json", encoding="utf-8") as file:
        replaced = file.read() == str(n)
    tidy = not [x for x in os.listdir(members.local(path)) if x.endswith(".tmp")]
    joins.assert_count(spark.read.text(f"{path}/rows"), n)
    return spark.range(1).select(F.lit(n).alias("n"), F.lit(refused == [True, True]).alias("refused"), F.lit(replaced).alias("replaced"), F.lit(tidy).alias("tidy"))
