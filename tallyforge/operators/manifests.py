"""Statistics of manifests and queues, and the rows of review and parsing jobs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.text import normalised
from ..sources.files import write_json_lines
from .decisions import selector_columns
from .evaluation import dependency_violations
from .logs import latest, latest_then, pending
from .metrics import count_if


def row_key(*parts: str) -> Column:
    """A key of several columns, each as text."""
    return F.struct(*[F.col(c).cast("string").alias(c) for c in parts])


def overlap_or_zero(overlap: Column) -> Column:
    return F.coalesce(overlap.cast("double"), F.lit(0.0))


def output_key(task: Column, image: Column, query: Column, exists: Column) -> Column:
    """Cache key of a model output: the image without its folder, the query as normalised text."""
    name = F.regexp_extract(image, r"([^/]*)/*$", 1)
    return F.struct(task.alias("task"), name.alias("image"), normalised(query).alias("query"), F.coalesce(exists.cast("boolean"), F.lit(False)).alias("exists"))


def with_interval(value: Column, low: Column, high: Column, level: float = 0.95) -> Column:
    """An estimate and its interval; without bounds there is no level either."""
    return F.struct(value.alias("value"), low.alias("ci_lower"), high.alias("ci_upper"), F.when(low.isNotNull() & high.isNotNull(), F.lit(level)).alias("ci_level"))


def spec_digest(spec: dict) -> str:
    """Digest of a prompt or generation setting, the same for any order of its keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()


def chosen(available: dict[str, dict], names: list[str]) -> list[dict]:
    """Named entries in the order asked for."""
    if unknown := [n for n in names if n not in available]:
        raise ValueError(f"{unknown} not among {sorted(available)}")
    return [{"name": n} | available[n] for n in names]


def reference_stats(references: DataFrame, protected: DataFrame, image: str = "image_id", sentences: str = "sentences", kept: Column | None = None) -> DataFrame:
    """References, queries and images before and after those of protected images go.

    ``protected`` has the column ``image``; ``kept`` chooses the rows of the split.
    """
    rows = references.where(F.lit(True) if kept is None else kept).select(F.col(image), F.coalesce(F.size(sentences), F.lit(0)).alias("_q"))
    marks = protected.select(image).distinct().withColumn("_out", F.lit(True))
    # one row an image first: the distinct counts below need no second shuffle of the references
    images = rows.groupBy(image).agg(F.count(F.lit(1)).alias("_r"), F.sum("_q").alias("_q")).join(marks, image, "left")
    gone, total = F.col("_out").isNotNull(), lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    known = F.col(image).isNotNull()
    return images.agg(
        total("_r", F.lit(True)).alias("original_refs"), total("_q", F.lit(True)).alias("original_queries"), count_if(known).alias("original_images"),
        count_if(gone).alias("protected_images"), total("_r", gone).alias("excluded_refs"), total("_q", gone).alias("excluded_queries"),
        total("_r", ~gone).alias("retained_refs"), total("_q", ~gone).alias("retained_queries"), count_if(known & ~gone).alias("retained_images"),
    )


def _counts(groups: Column, field: str) -> Column:
    """Map of a field's values to their rows, in order of value, from an array of groups with ``n``."""
    values = F.array_sort(F.array_distinct(F.filter(F.transform(groups, lambda g: g[field]), lambda v: v.isNotNull())))
    rows = lambda v: F.aggregate(F.filter(groups, lambda g: g[field] == v), F.lit(0).cast("bigint"), lambda a, g: a + g["n"])
    return F.map_from_entries(F.transform(values, lambda v: F.struct(v, rows(v))))


def selection_stats(rows: DataFrame, image: str, target: str, dataset: str, category: str, watched: str = "person") -> DataFrame:
    """Images, targets, queries a dataset and a category, and the share of a watched category; one row.

    Datasets and categories are few; their pairs are counted before they meet.
    """
    pairs = rows.groupBy(dataset, category).agg(F.count(F.lit(1)).alias("n"))
    g = F.col("_g")
    maps = pairs.agg(F.collect_list(F.struct(F.col(dataset).cast("string").alias("d"), F.col(category).cast("string").alias("c"), "n")).alias("_g"), F.sum("n").alias("_n"))
    maps = maps.select(
        F.coalesce("_n", F.lit(0)).alias("queries"), _counts(g, "d").alias("dataset_queries"), _counts(g, "c").alias("category_queries"),
        F.try_divide(F.coalesce(F.element_at(_counts(g, "c"), watched), F.lit(0)), F.col("_n")).alias("watched_rate"),
    )
    targets = rows.groupBy(image, target).agg(F.lit(1)).groupBy(image).agg(F.count(F.lit(1)).alias("_t")).agg(F.count(F.lit(1)).alias("unique_images"), F.coalesce(F.sum("_t"), F.lit(0)).alias("unique_targets"))
    both = maps.unionByName(targets, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def selector_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Actions, exclusions, mean overlaps and recoveries of labelled rows (``selector_columns``), a split each."""
    base, other, best = F.col("baseline_iou"), F.col("challenger_iou"), F.col("two_box_oracle_iou")
    action = F.coalesce("selector_action", F.lit("excluded"))
    groups = rows.groupBy(*by, action.alias("a"), F.col("selector_exclusion").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(base).alias("b"), F.sum(other).alias("c"), F.sum(best).alias("o"),
        count_if(base == 0).alias("z"), count_if((base == 0) & (other > 0)).alias("r"),
    )
    out = groups.groupBy(*by).agg(*[F.sum(c).alias(c) for c in "nbcozr"], F.collect_list(F.struct("a", "x", "n")).alias("g"))
    mean = lambda c: F.try_divide(c, F.col("n"))
    return out.select(
        *by, F.col("n").alias("records"), _counts(F.col("g"), "a").alias("actions"), _counts(F.col("g"), "x").alias("exclusions"),
        mean(F.col("b")).alias("baseline_miou"), mean(F.col("c")).alias("challenger_miou"), mean(F.col("o")).alias("two_box_oracle_miou"),
        mean(F.col("o") - F.col("b")).alias("oracle_gain"), F.col("z").alias("baseline_zero"), F.col("r").alias("recovered_zero"),
    )


def assert_single(df: DataFrame, column: str, ok: Column) -> DataFrame:
    """``df``, if the rows that are ``ok`` have at most one value of ``column``."""
    found = df.where(ok).select(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("v")).distinct().limit(10).collect()
    if len(found) > 1:
        raise ValueError(f"several values of {column}: {sorted(r['v'] for r in found)}")
    return df


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    if again := df.groupBy(*key).count().where("count > 1").limit(10).collect():
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in again]}")
    return df


def best_proposals(proposals: Column, most: int = 5) -> Column:
    """The first ``most`` by score, descending; equal scores keep their order, missing ones come last."""
    ranked = F.transform(proposals, lambda p, i: F.struct((-F.coalesce(p["score"].cast("double"), F.lit(float("-inf")))).alias("s"), i.alias("i"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda r: r["p"])


def dataset_slice(rows: DataFrame, dataset: str, wanted: str, key: str) -> DataFrame:
    """Rows of one dataset, whose keys must differ; write them with ``write_json_lines`` in order of their rank."""
    return assert_unique(rows.where(F.col(dataset) == wanted), [key])


def request_context(cases: Column, fields: dict[str, Column]) -> Column:
    """Nested request of a group: its fields, the truth of its first case and the baseline of each case."""
    each = F.transform(cases, lambda c: F.struct(c["task"].alias("task"), c["baseline_box"].alias("baseline_box_xyxy"), c["automatic_baseline_class"].alias("match_class_hint")))
    return F.struct(*[v.alias(k) for k, v in fields.items()], F.get(cases, F.lit(0))["gt_box"].alias("gt_box_xyxy"), each.alias("zero_iou_baselines"))


def review_requests(groups: DataFrame, audits: DataFrame, reviews: DataFrame, done: DataFrame, key: str, position: str, reviewed: Column, ok: Column) -> DataFrame:
    """Audited groups that are not done, with the audit and the latest review (null where none) as structs.

    ``reviewed`` holds for the review rows that count, ``ok`` for successes in ``done``.
    """
    nested = lambda df, name: df.select(key, F.struct(*[F.col(c) for c in df.columns if c != key]).alias(name))
    human = latest_then(reviews, [key], position, reviewed)
    return pending(groups, done, [key], ok).join(nested(audits, "audit"), key).join(nested(human, "review"), key, "left")


def reparsed(log: DataFrame, queue: DataFrame, key: str, raw: Column, width: str, height: str, read: Callable[[Column, Column, Column], Column], name: str) -> DataFrame:
    """Log rows with column ``name`` made anew from the stored raw text and the queue's image size.

    A key that the queue lacks fails the job. Write the rows as a new version of the log.
    """
    sizes = queue.select(key, F.col(width).alias("_w"), F.col(height).alias("_h"), F.lit(True).alias("_known"))
    out = log.join(sizes, key, "left")
    there = F.when(F.col("_known"), F.coalesce(raw, F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("not in the queue: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return out.withColumn(name, read(there, F.col("_w"), F.col("_h"))).drop("_w", "_h", "_known")


def write_counted(df: DataFrame, path: str, order: list[str]) -> int:
    """Write JSON lines in order and tell how many; the count is that of the rows written."""
    write_json_lines(df, path, order)
    return df.sparkSession.read.text(path).count()


def evaluation_rows(benchmark: DataFrame, candidates: DataFrame, records: DataFrame, tasks: list[str], position: str = "position", margin: float = 0.05) -> DataFrame:
    """Labelled selector rows of each positive and task from a benchmark, a log of candidates and evaluator records.

    All have ``base_sample_id``; ``benchmark`` image_filename, query and gt_bbox_xyxy, which must
    agree for each id; ``candidates`` error, parse_valid and candidate_boxes; ``records`` task,
    query_role, query, parse_valid, pred_found and pred_bbox_xyxy. The last row by ``position``
    counts, of records only those of positives with the benchmark's text. A candidate that
    failed, even after a good one, gives no box.
    """
    key, fields = "base_sample_id", ["image_filename", "query", "gt_bbox_xyxy"]
    if wrong := dependency_violations(benchmark, [key], fields).limit(10).collect():
        raise ValueError(f"rows of one id differ: {[r[key] for r in wrong]}")
    positives = benchmark.groupBy(key).agg(*[F.first(c).alias(c) for c in fields])
    good = F.col("error").isNull() & F.coalesce("parse_valid", F.lit(False))
    box = F.when(good & (F.size("candidate_boxes") > 0), F.get("candidate_boxes", F.lit(0)))
    pool = latest(candidates, [key], position).select(key, box.alias("challenger_bbox_xyxy"))
    said = records.where((F.col("query_role") == "positive") & F.col("task").isin(tasks)).withColumn("_t", normalised(F.col("query")))
    said = said.join(positives.select(key, normalised(F.col("query")).alias("_t")), [key, "_t"], "left_semi")
    said = latest(said, [key, "task"], position).select(key, "task", F.col("pred_bbox_xyxy").alias("baseline_bbox_xyxy"), "pred_found", "parse_valid")
    rows = positives.join(pool, key, "left").withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks]))).join(said, [key, "task"], "left")
    usable = F.when(F.coalesce("pred_found", F.lit(False)), F.col("baseline_bbox_xyxy"))
    parsed = F.coalesce("parse_valid", F.lit(False))
    out = selector_columns(rows.withColumn("_usable", usable), "gt_bbox_xyxy", "_usable", "challenger_bbox_xyxy", margin, baseline_parsed=parsed)
    # a box that is present but not called found is no choice, yet its overlap is reported
    return out.withColumn("baseline_iou", iou(F.col("gt_bbox_xyxy"), F.col("baseline_bbox_xyxy"), "zero")).select(
        F.concat_ws(":", "task", key).alias("query_id"), F.col(key).alias("group_id"), "task", *fields, "baseline_bbox_xyxy", "challenger_bbox_xyxy",
        "baseline_iou", "challenger_iou", "selector_action", "selector_eligible", "selector_exclusion",
    )
