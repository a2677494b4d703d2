"""Documents of origin: counts of the writing job, refused inputs, and chains."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import lineage


def test_a_chain_of_tables(spark, tmp_path):
    at = {name: str(tmp_path / name) for name in ("raw", "one", "two", "three", "four")}
    spark.range(100).select("id", F.map_from_arrays(F.array(F.lit("k")), F.array("id")).alias("m"), F.when(F.col("id") % 3 > 0, "é").alias("t")).write.parquet(at["raw"])
    one = lineage.derive(spark, {"raw": at["raw"]}, lambda t: t["raw"].where("id < 50"), at["one"], {"texts": F.count("t"), "total": F.sum("id")}, "first")
    assert (one["rows"], one["metrics"], one["inputs"]["raw"]["rows"], one["inputs"]["raw"]["document"]) == (50, {"texts": 33, "total": 1225}, 100, None)
    two = lineage.derive(spark, {"a": at["one"], "b": at["raw"]}, lambda t: t["a"].join(t["b"].select("id", F.lit(1).alias("one")), "id"), at["two"])
    assert two["rows"] == 50 and two["inputs"]["a"]["checksum"] == one["checksum"] and two["inputs"]["a"]["document"] == lineage.digest(one)
    assert spark.read.parquet(at["two"]).count() == 50 and lineage.check_chain(spark, at["two"]) == []
    assert lineage.check_chain(spark, at["raw"]) == [f"{at['raw']}: no document"]

    # rows that are changed behind the document's back are seen while they are read
    spark.range(1).select(F.lit(7).cast("long").alias("id"), F.lit(None).cast("map<string,bigint>").alias("m"), F.lit("x").alias("t")).write.mode("append").parquet(at["one"])
    with pytest.raises(ValueError, match=r"\['a'\]"):
        lineage.derive(spark, {"a": at["one"]}, lambda t: t["a"], at["three"])
    assert not (tmp_path / "three").exists()
    # a document that is changed is seen without reading rows
    lineage.write_text(spark, f"{at['one']}/{lineage.NAME}", json.dumps(one | {"rows": 51}))
    assert lineage.check_chain(spark, at["two"]) == [f"{at['one']}: changed after {at['two']} was made"]


def test_one_job_writes_and_counts(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    spark.range(1000).repartition(3).write.parquet(raw)
    spark.sparkContext.setJobGroup("lineage", "lineage")
    doc = lineage.derive(spark, {"raw": raw}, lambda t: t["raw"].select(F.col("id") % 7), out)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lineage")
    spark.sparkContext.setJobGroup("", "")
    # the schema is read by one, the rows are read, counted and written by another
    assert len(jobs) <= 2 and doc["rows"] == doc["inputs"]["raw"]["rows"] == 1000


def test_empty_tables_have_documents(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    spark.createDataFrame([], "a int, b string").write.parquet(raw)
    doc = lineage.derive(spark, {"raw": raw}, lambda t: t["raw"], out)
    assert (doc["rows"], doc["checksum"]) == (0, "0") and lineage.check_chain(spark, out) == []
