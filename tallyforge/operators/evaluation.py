"""Task metrics of evaluator records, candidate oracles and the study of changed boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, normalised, suppressed
from .metrics import count_if, wilson

#: Kinds of negatives; the first two are plain objects, the others depend on a relation.
KINDS = ("object", "co_occurrence", "attribute", "relation")
ZERO = 1e-12


def mean_of(*values: Column) -> Column:
    """Mean of the values that are not null; null if none is."""
    return F.try_divide(sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)), sum((v.isNotNull().cast("int") for v in values), F.lit(0)))


def _is(c: str, value: bool) -> Column:
    return F.coalesce(F.col(c) == value, F.lit(False))


def _with_rate(name: str, k: str, n: str) -> dict[str, Column]:
    low, high = wilson(F.col(k), F.col(n))
    return {name: F.try_divide(F.col(k), F.col(n)), f"{name}_ci_lower": low, f"{name}_ci_upper": high}


def _kind_counts(negative: Column, bad: Column) -> list[Column]:
    kind = F.col("hallucination_type")
    return [x for k in KINDS for x in (count_if(negative & (kind == k)).alias(f"n_{k}"), count_if(negative & bad & (kind == k)).alias(f"bad_{k}"))]


def _kind_rates() -> dict[str, Column]:
    rate = {k: F.try_divide(F.col(f"bad_{k}"), F.col(f"n_{k}")) for k in KINDS}
    plain, bound = mean_of(*[rate[k] for k in KINDS[:2]]), mean_of(*[rate[k] for k in KINDS[2:]])
    return {f"rate_{k}": v for k, v in rate.items()} | {"macro_rate": mean_of(*rate.values()), "plain_rate": plain, "bound_rate": bound, "bound_minus_plain": bound - plain}


def _yes_no_rates() -> dict[str, Column]:
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)}


def _parse_failures() -> Column:
    return count_if(~F.coalesce("parse_valid", F.lit(True)))


def existence_metrics(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Yes/no task: confusion, rates with Wilson intervals, rates by kind. A missing prediction or label counts as no.

    Columns: label_exists, pred_exists, parse_valid, hallucination_type, latency_sec.
    """
    truth, said = _is("label_exists", True), _is("pred_exists", True)
    negative = _is("label_exists", False)
    out = records.groupBy(*by).agg(
        count_if(truth & said).alias("tp"), count_if(truth & ~said).alias("fn"), count_if(~truth & said).alias("fp"), count_if(~truth & ~said).alias("tn"),
        F.avg("latency_sec").alias("avg_latency_sec"), _parse_failures().alias("parse_failures"), *_kind_counts(negative, said),
    )
    out = out.withColumns({"n": F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"), "pos": F.col("tp") + F.col("fn"), "neg": F.col("fp") + F.col("tn"), "right": F.col("tp") + F.col("tn")})
    out = out.withColumns(_yes_no_rates() | {"accuracy": F.try_divide("right", "n")} | _with_rate("false_rate", "fp", "neg") | _with_rate("refusal_rate", "fn", "pos") | _kind_rates())
    return out.withColumn("balanced_accuracy", mean_of(F.col("recall"), 1 - F.col("macro_rate"))).drop("right", *[f"{p}_{k}" for p in ("n", "bad") for k in KINDS])


def _grounding(records: DataFrame, by: tuple[str, ...], positive: Column, negative: Column, decided: str, threshold: float, more: list[Column]) -> DataFrame:
    yes, no = _is(decided, True), _is(decided, False)
    overlap, boxed = F.coalesce("iou", F.lit(0.0)), F.col("pred_bbox_xyxy").isNotNull()
    out = records.groupBy(*by).agg(
        count_if(positive).alias("num_positive"), count_if(negative).alias("num_negative"),
        F.avg(F.when(positive, overlap)).alias("mean_iou"), F.avg(F.when(positive & boxed, overlap)).alias("mean_iou_valid_only"),
        count_if(positive & (overlap <= ZERO)).alias("zero_count"), count_if(positive & boxed & (overlap <= ZERO)).alias("valid_zero_count"),
        count_if(positive & (overlap >= threshold)).alias("hits"), count_if(positive & boxed).alias("boxed"),
        count_if(positive & yes).alias("tp"), count_if(positive & no).alias("fn"), count_if(negative & yes).alias("fp"), count_if(negative & no).alias("tn"),
        F.avg("latency_sec").alias("avg_latency_sec"), _parse_failures().alias("parse_failures"), *_kind_counts(negative, yes), *more,
    )
    of = lambda c: F.try_divide(F.col(c), F.col("num_positive"))
    out = out.withColumns({"right": F.col("tp") + F.col("tn"), "decided": F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")})
    out = out.withColumns(
        {"zero_rate": of("zero_count"), "valid_zero_rate": of("valid_zero_count"), "valid_box_rate": of("boxed"), "false_rejection_count": F.col("fn")}
        | _with_rate("false_rejection_rate", "fn", "num_positive") | _with_rate("hit_rate", "hits", "num_positive") | _with_rate("false_rate", "fp", "num_negative")
        | _with_rate("accuracy", "right", "decided") | _yes_no_rates() | _kind_rates()
    )
    out = out.withColumn("balanced_accuracy", mean_of(of("tp"), 1 - F.col("macro_rate")))
    return out.drop("right", "decided", "hits", "boxed", *[f"{p}_{k}" for p in ("n", "bad") for k in KINDS])


def grounding_metrics(records: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Boxes of positives and false boxes on negatives; a missing overlap of a positive counts as 0, an undecided row in neither class."""
    return _grounding(records, by, _is("label_exists", True), _is("label_exists", False), "pred_found", threshold, [])


#: Nullable scores of the caption task that are averaged where present, over all rows.
CAPTION_MEANS = ("amber_cosine", "amber_cosine_penalized", "clip_clip_score_pred_bbox", "clip_clip_score_full_img", "clip_clip_score_target_expr", "clip_clip_localization_gain")


def caption_metrics(records: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """As grounding, decided by ``pred_exists``, with caption scores and how false captions and false boxes go together."""
    positive, negative = F.col("query_role") == "positive", F.col("query_role") == "negative"
    overlap, near, true = F.coalesce("iou", F.lit(0.0)), F.col("clip_clip_score_pred_bbox"), F.col("clip_clip_score_gt_bbox")
    lying, clean, yes = _is("caption_target_hallucination", True), _is("caption_target_hallucination", False), _is("pred_exists", True)
    both = near.isNotNull() & true.isNotNull()
    more = [F.avg(c).alias(f"avg_{c}") for c in CAPTION_MEANS] + [
        F.avg(F.when(positive, F.col("target_coverage"))).alias("target_coverage"),
        F.avg(F.when(positive, F.coalesce(near, F.lit(0.0)) * overlap)).alias("avg_clip_iou_weighted"),
        F.avg(F.when(positive & true.isNotNull(), overlap * true)).alias("avg_iou_times_gt_clip"),
        F.avg(F.when(positive & both, near - true)).alias("avg_clip_delta"),
        F.avg(F.when(positive & both, overlap * (true - near))).alias("avg_iou_weighted_clip_delta"),
        count_if(negative & lying).alias("caption_lying_n"), count_if(negative & clean).alias("caption_clean_n"),
        count_if(negative & lying & yes).alias("lying_grounded"), count_if(negative & clean & yes).alias("clean_grounded"),
    ]
    out = _grounding(records, by, positive, negative, "pred_exists", threshold, more)
    lied, told = F.try_divide("lying_grounded", "caption_lying_n"), F.try_divide("clean_grounded", "caption_clean_n")
    return out.withColumns({"grounded_given_lying": lied, "grounded_given_clean": told, "coupling_gap": lied - told, "joint_rate": F.try_divide("lying_grounded", "num_negative")}).drop("lying_grounded", "clean_grounded")


def bootstrap_f1(df: DataFrame, truth: str, predicted: str, order: str, by: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """95 % bootstrap interval of F1 for each group; a missing prediction counts as no.

    Rows are resampled in ``order`` (a number); see ``resampling.bootstrap``.
    """
    from .resampling import bootstrap

    t, p = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (truth, predicted))
    hit, wrong = (t & p).cast("double"), (t != p).cast("double")
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), 2 * F.col("hit") + F.col("wrong")), F.lit(0.0))
    out = bootstrap(df, [by], order, {"hit": hit, "wrong": wrong}, f1, rounds, seed)
    return out.select(by, F.col("ci_lower").alias("f1_ci_lower"), F.col("ci_upper").alias("f1_ci_upper"))


def _summary(value: str, found: str, prefix: str) -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda c: zero(F.avg(c.cast("double")))
    v = F.col(value)
    return [zero(F.avg(v)).alias(f"{prefix}_miou"), share(v <= 0).alias(f"{prefix}_zero_rate"), share(v >= 0.5).alias(f"{prefix}_hit_rate"), share(F.col(found) > 0).alias(f"{prefix}_found_rate")]


def group_candidates(records: DataFrame, key: str, truth: str, source: str, boxes: str, sources: list[str], order: str) -> DataFrame:
    """One row a group: for each source its first and best overlap and number of boxes, the pool of all, and whether its truths conflict.

    Records of other sources are left out. Boxes of a source are in ``order``; a group's
    boxes are the few candidates of one query.
    """
    kept = records.where(F.col(source).isin(sources)).withColumn("_gt", normalised(F.col(truth)))
    valid = F.filter(F.transform(F.coalesce(F.col(boxes), F.array().cast("array<array<double>>")), lambda b: normalised(b)), lambda b: b.isNotNull())
    kept = kept.withColumn("_boxes", valid)
    per = []
    for s in sources:
        mine = F.sort_array(F.collect_list(F.when(F.col(source) == s, F.struct(order, "_boxes"))))
        per.append(F.flatten(F.transform(mine, lambda r: r["_boxes"])).alias(f"_{s}"))
    rows = kept.groupBy(key).agg(F.min("_gt").alias("_gt"), (reduce(lambda a, b: a | b, [F.max(F.col("_gt")[i]) - F.min(F.col("_gt")[i]) > 1e-6 for i in range(4)])).alias("conflict"), *per)
    out = rows.withColumn("_pool", F.concat(*[F.col(f"_{s}") for s in sources]))
    cols = [F.col(key), F.coalesce("conflict", F.lit(True)).alias("conflict")]
    for name, c in [(s, f"_{s}") for s in sources] + [("pool", "_pool")]:
        values = F.transform(F.col(c), lambda b: iou(b, F.col("_gt"), "zero"))
        cols += [F.coalesce(F.get(values, F.lit(0)), F.lit(0.0)).alias(f"{name}_top1"), F.coalesce(F.array_max(values), F.lit(0.0)).alias(f"{name}_best"), F.size(c).alias(f"{name}_n")]
    return out.select(*cols, F.size(suppressed(F.col("_pool"))).alias("unique_n"))


def candidate_oracle(groups: DataFrame, sources: list[str], baseline: str) -> DataFrame:
    """One row: for each source its first and best choice, the pool's oracle, and what it gains over ``baseline``."""
    base, best = F.col(f"{baseline}_best"), F.col("pool_best")
    parts = [x for s in sources for x in (*_summary(f"{s}_top1", f"{s}_n", f"{s}_top1"), *_summary(f"{s}_best", f"{s}_n", f"{s}_oracle"), F.coalesce(F.avg(f"{s}_n"), F.lit(0.0)).alias(f"{s}_mean_candidates"))]
    out = groups.agg(
        F.count(F.lit(1)).alias("n_groups"), count_if(F.col("conflict")).alias("conflicts"), *parts, *_summary("pool_best", "pool_n", "oracle"),
        F.coalesce(F.avg("pool_n"), F.lit(0.0)).alias("mean_candidates"), F.coalesce(F.avg("unique_n"), F.lit(0.0)).alias("mean_unique_candidates"),
        count_if((base <= 0) & (best > 0)).alias("recovered_zero"), count_if((base < 0.5) & (best >= 0.5)).alias("recovered_to_half"),
    )
    return out.withColumns({f"gain_{m}": F.col(f"oracle_{m}") - F.col(f"{baseline}_oracle_{m}") for m in ("miou", "zero_rate", "hit_rate")})


def change_study(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Overlaps before and after: means, oracle of the two, direction of change and crossings of one half."""
    b, r = F.col("baseline_iou"), F.col("result_iou")
    d, top = r - b, F.greatest("baseline_iou", "result_iou")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(b).alias("baseline_miou"), F.avg(r).alias("result_miou"), F.avg(top).alias("oracle_miou"), F.avg(d).alias("mean_delta"),
        F.avg((top >= 0.5).cast("double")).alias("oracle_hit_rate"), count_if(top == 0).alias("oracle_zero"), count_if(b == 0).alias("baseline_zero"), count_if(r == 0).alias("result_zero"),
        count_if(d > 1e-9).alias("improved"), count_if(F.abs(d) <= 1e-9).alias("unchanged"), count_if(d < -1e-9).alias("degraded"),
        count_if((b == 0) & (r >= 0.5)).alias("recovered_to_half"), count_if((b < 0.5) & (r >= 0.5)).alias("to_half"), count_if((r < 0.5) & (b >= 0.5)).alias("from_half"),
    )


def change_context(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each transition: rows, median area ratio, mean number of distractors and mean change."""
    return rows.groupBy(*by, "transition").agg(
        F.count(F.lit(1)).alias("n"), F.median("gt_area_ratio").alias("median_area_ratio"), F.avg("distractors").alias("mean_distractors"), F.avg(F.col("result_iou") - F.col("baseline_iou")).alias("mean_delta")
    )


def across_tasks(rows: DataFrame, key: str, task: str, tasks: tuple[str, str], conditions: dict[str, Column]) -> DataFrame:
    """How many keys meet each condition in both tasks (a key has one row a task)."""
    flags = rows.groupBy(key).agg(*[F.bool_or(F.when(F.col(task) == t, c)).alias(f"{n}_{i}") for n, c in conditions.items() for i, t in enumerate(tasks)])
    return flags.agg(*[count_if(F.col(f"{n}_0") & F.col(f"{n}_1")).alias(n) for n in conditions])


def warm_latency(batches: DataFrame, order: str, seconds: str, queries: str) -> DataFrame:
    """Median seconds a query (``warm_latency``) over batches but the least by ``order``; of one batch, its own.

    Batches with one time are counted together before the median, so no task holds them all.
    """
    each = batches.select(F.col(order).alias("o"), (F.col(seconds) / F.col(queries)).alias("v"))
    least = each.agg(F.min("o").alias("least"), F.count(F.lit(1)).alias("all"))
    warm = each.join(F.broadcast(least), (F.col("all") == 1) | (F.col("o") > F.col("least")))
    return warm.groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.expr("percentile(v, 0.5, n)").alias("warm_latency"))


def detector_metrics(rows: DataFrame, truth: str, proposals: str) -> DataFrame:
    """Share of rows with proposals; overlap of the best-scored and of the best proposal (array<struct<box, score>>)."""
    p = F.col(proposals)
    first = F.aggregate(p, F.struct(F.lit(None).cast("array<double>").alias("box"), F.lit(None).cast("double").alias("score")), lambda a, x: F.when(a["score"].isNull() | (x["score"] > a["score"]), F.struct(x["box"].alias("box"), x["score"].alias("score"))).otherwise(a))
    top = iou(F.col(truth), first["box"], "zero")
    best = F.coalesce(F.array_max(F.transform(p, lambda x: iou(F.col(truth), x["box"], "zero"))), F.lit(0.0))
    v = rows.select(F.coalesce(F.size(p) > 0, F.lit(False)).cast("double").alias("has"), top.alias("top"), best.alias("best"))
    return v.agg(
        F.count(F.lit(1)).alias("records"), F.avg("has").alias("coverage"), F.avg((F.col("top") >= 0.5).cast("double")).alias("top_hit_rate"),
        F.avg((F.col("best") >= 0.5).cast("double")).alias("best_hit_rate"), F.avg("top").alias("mean_top_iou"), F.avg("best").alias("mean_best_iou"),
    )


def dependency_violations(rows: DataFrame, key: list[str], dependent: list[str]) -> DataFrame:
    """Keys whose rows differ in a dependent column (null is a value), with the columns that differ."""
    differs = lambda c: ((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))))
    found = rows.groupBy(*key).agg(*[differs(c).alias(f"_{c}") for c in dependent])
    names = F.filter(F.array(*[F.when(F.col(f"_{c}"), c) for c in dependent]), lambda v: v.isNotNull())
    return found.select(*key, names.alias("columns")).where(F.size("columns") > 0)


def long_counters(rows: DataFrame, by: list[str], counters: list[str], prefix: str) -> DataFrame:
    """Counts of each value of each counter as rows (by, ``<prefix value>:<counter value>``, n); nulls are not counted."""
    wide = F.explode(F.filter(F.array(*[F.col(c).cast("string") for c in counters]), lambda v: v.isNotNull()))
    return rows.select(*by, F.col(prefix).alias("_p"), wide.alias("_v")).groupBy(*by, F.concat_ws(":", "_p", "_v").alias("counter")).agg(F.count(F.lit(1)).alias("n"))


def rollup_checks(rows: DataFrame, checks: str, kind: str, verdict: str, verdicts: list[str]) -> DataFrame:
    """Kind of check by verdict over a nested array of checks, zeros kept."""
    flat = rows.select(F.explode(checks).alias("c")).select(F.col(f"c.{kind}").alias(kind), F.col(f"c.{verdict}").alias(verdict))
    return flat.groupBy(kind).pivot(verdict, verdicts).count().na.fill(0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
