"""Tables with a document of their origin: what was counted while they were written, and from what.

Counts and a checksum of rows are observed in the job that writes, so nothing is read twice.
Inputs that have such a document are observed as well while they are read; if they are not what
their document says, the result is taken back. A document holds the digests of its parents'
documents, so a table's whole past can be checked without reading a row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

NAME = "_lineage.json"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file of any file system, None where there is none."""
    place, fs = _folder(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, fs = _folder(spark, path)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def document(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, f"{path}/{NAME}")
    return None if text is None else json.loads(text)


def digest(doc: dict) -> str:
    return hashlib.sha256(json.dumps(doc, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _observed(df: DataFrame, name: str, more: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df``, whose rows are counted and summed up by hash, in any order, when a job runs over it."""
    seen = Observation(name)
    # as JSON, so columns of every type take part
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    total = F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), total.alias("checksum"), *[c.alias(k) for k, c in more.items()]), seen


def derive(spark: SparkSession, inputs: dict[str, str], make: Callable[[dict[str, DataFrame]], DataFrame], path: str, metrics: dict[str, Column] | None = None, note: str = "") -> dict:
    """Write ``make`` of the ``inputs`` (name: path of a Parquet table) to ``path``; its document.

    ``metrics`` are aggregates over the rows written. ``make`` uses each input once and reads
    it whole, as a checksum of a part is no check. An input without a document is noted with
    what was seen. An input that differs from its document, in rows or columns, is an error,
    and ``path`` is removed.
    """
    parents, frames, seen = {}, {}, {}
    for name, place in inputs.items():
        parents[name] = document(spark, place)
        frames[name], seen[name] = _observed(spark.read.parquet(place), f"in-{name}", {})
    out, written = _observed(make(frames), "out", metrics or {})
    out.write.mode("errorifexists").parquet(path)
    found = {name: seen[name].get for name in inputs}
    wrong = sorted(name for name, doc in parents.items() if doc and {k: doc[k] for k in ("rows", "checksum")} != found[name])
    if wrong:
        place, fs = _folder(spark, path)
        fs.delete(place, True)
        raise ValueError(f"not as their documents say: {wrong}")
    values = dict(written.get)
    doc = {
        "rows": values.pop("rows"), "checksum": values.pop("checksum"), "metrics": values, "columns": [f"{c}: {t}" for c, t in out.dtypes], "note": note,
        "inputs": {name: {"path": place, **found[name], "document": digest(parents[name]) if parents[name] else None} for name, place in inputs.items()},
    }
    write_text(spark, f"{path}/{NAME}", json.dumps(doc, indent=1, sort_keys=True, ensure_ascii=False, default=str) + "\n")
    return document(spark, path)


def check_chain(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with the documents that a table rests on: missing or changed ones, by path."""
    wrong, ahead, seen = [], [path], set()
    while ahead:
        place = ahead.pop()
        if place in seen:
            continue
        seen.add(place)
        doc = document(spark, place)
        if doc is None:
            wrong.append(f"{place}: no document")
            continue
        for parent in doc["inputs"].values():
            if parent["document"] is None:
                continue
            held = document(spark, parent["path"])
            if held is None or digest(held) != parent["document"]:
                wrong.append(f"{parent['path']}: changed after {place} was made")
            else:
                ahead.append(parent["path"])
    return sorted(wrong)
