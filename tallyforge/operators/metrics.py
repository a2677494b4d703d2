"""Aggregates over labelled rows: selector metrics, rates with intervals, threshold search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import bucketed

Z = 1.96


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a rate; null where n is 0."""
    n = F.nullif(n, F.lit(0))
    p = k / n
    middle, spread = p + F.lit(Z * Z) / (2 * n), Z * F.sqrt((p * (1 - p) + F.lit(Z * Z) / (4 * n)) / n)
    bound = lambda v: F.least(F.greatest(v / (1 + F.lit(Z * Z) / n), F.lit(0.0)), F.lit(1.0))
    return F.when(n.isNotNull(), bound(middle - spread)), F.when(n.isNotNull(), bound(middle + spread))


def selected(rows: DataFrame, score: str, threshold: float | Column, unscored: str = "baseline") -> DataFrame:
    """Add ``switched`` (eligible and above the threshold) and the chosen overlap."""
    above = F.coalesce(F.col(score) > threshold, F.lit(unscored == "challenger"))
    out = rows.withColumn("switched", F.coalesce(F.col("selector_eligible"), F.lit(False)) & above)
    return out.withColumn("selector_iou", F.when(F.col("switched"), F.col("challenger_iou")).otherwise(F.col("baseline_iou")))


def selector_metrics(rows: DataFrame, score: str, threshold: float = 0.0, unscored: str = "baseline", by: tuple[str, ...] = (), zero: float = 1e-12) -> DataFrame:
    """One aggregation: means, gap to the oracle from either fixed choice, zero changes and action accuracy.

    Missing overlaps count as 0. Accuracy is over the rows that are eligible and scored.
    """
    r = selected(rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("baseline_iou", "challenger_iou")}), score, threshold, unscored)
    b, c, s = F.col("baseline_iou"), F.col("challenger_iou"), F.col("selector_iou")
    can = F.coalesce(F.col("selector_eligible"), F.lit(False))
    kept, best = F.when(can, c).otherwise(b), F.when(can, F.greatest(b, c)).otherwise(b)
    scored, right = can & F.col(score).isNotNull(), (F.col("selector_action") == "switch") == F.col("switched")
    out = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(scored).alias("scored_eligible"),
        count_if(F.col("switched")).alias("switches"),
        F.avg(b).alias("baseline_miou"),
        F.avg(c).alias("raw_challenger_miou"),
        F.avg(kept).alias("challenger_miou"),
        F.avg(s).alias("selector_miou"),
        F.avg(best).alias("oracle_miou"),
        count_if(s >= 0.5).alias("hits_at_half"),
        count_if(b <= zero).alias("baseline_zero"),
        count_if(s <= zero).alias("selector_zero"),
        count_if((b > zero) & (s <= zero)).alias("regressions"),
        count_if(can & (b > zero) & (c <= zero)).alias("unconditional_regressions"),
        count_if((b <= zero) & (s > zero)).alias("recoveries"),
        count_if(s - b > zero).alias("improved"),
        count_if(s - b < -zero).alias("degraded"),
        count_if(F.abs(s - b) <= zero).alias("tied"),
        F.avg(F.when(scored, right.cast("double"))).alias("action_accuracy"),
    )
    return with_gaps(out)


def with_gaps(means: DataFrame) -> DataFrame:
    """Gap to the oracle and the part of it that the selector takes, from the baseline and from the better fixed choice."""
    top, low, got = F.col("oracle_miou"), F.col("baseline_miou"), F.col("selector_miou")
    out = means.withColumn("strongest_fixed_miou", F.greatest("baseline_miou", "challenger_miou"))
    strong = F.col("strongest_fixed_miou")
    return out.withColumns(
        {
            "oracle_gap": top - low,
            "gap_captured": got - low,
            "capture": F.when(top - low > 0, F.try_divide(got - low, top - low)),
            "gap_from_strongest": top - strong,
            "gain_over_strongest": got - strong,
            "capture_from_strongest": F.when(top - strong > 0, F.try_divide(got - strong, top - strong)),
            "switch_rate": F.try_divide(F.col("switches"), F.col("n")),
            "hit_rate": F.try_divide(F.col("hits_at_half"), F.col("n")),
        }
    )


def sums_above(steps: DataFrame, position: str, sums: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Replace each of ``sums`` by its total over the rows of greater ``position``.

    Rows are cut into ranges of position that hold few (see ``ranks.bucketed``, which counts
    them first), so no task sorts all of them: sums of whole ranges are added, then the
    rows within a range. Rows of a null position are above none and below all.
    """
    parts = bucketed(steps, by, position)
    later = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    whole = whole.select(*by, "_b", *[F.coalesce(F.sum(f"_{c}").over(later), F.lit(0)).alias(f"_{c}") for c in sums])
    above = Window.partitionBy(*by, "_b").orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    within = parts.withColumns({c: F.coalesce(F.sum(c).over(above), F.lit(0)) for c in sums})
    mark = {c: f"_g{k}" for k, c in enumerate([*by, "_b"])}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(m)) for c, m in mark.items()])
    out = within.join(whole.withColumnsRenamed(mark), same)
    return out.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in sums else F.col(c) for c in steps.columns])


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles (name: share) of each group, linear between neighbours at ``(n - 1) * share``.

    Equal values are counted first, then the ranges of values that ``ranks.bucketed`` finds;
    only the ranges that hold a wanted rank are put in order, so no task holds all values of
    a group. Null values, and groups of a null key, are left out.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows = bucketed(rows, by, "_v")
    counts = rows.groupBy(*by, "_b").agg(F.sum("_n").alias("_c"))
    before, whole = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    counts = counts.withColumns({"_s": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_all": F.sum("_c").over(whole)})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items()])
    at = counts.withColumn("w", F.explode(wanted)).withColumn("_at", (F.col("_all") - 1) * F.col("w.p"))
    at = at.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).where((F.col("_s") <= F.col("_r")) & (F.col("_r") < F.col("_s") + F.col("_c")))
    at = at.select(*by, "_b", "w.name", "_at", "_r", (F.col("_r") - F.col("_s")).alias("_k"))
    held = rows.join(at.select(*by, "_b").distinct(), [*by, "_b"], "left_semi")
    upto = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("_end", F.sum("_n").over(upto))
    found = at.join(ranked, [*by, "_b"]).where((F.col("_end") - F.col("_n") <= F.col("_k")) & (F.col("_k") < F.col("_end")))
    found = found.groupBy(*by, "name", "_at").agg(F.min_by("_v", "_r").alias("low"), F.max_by("_v", "_r").alias("high"))
    found = found.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * (F.col("_at") - F.floor("_at")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares])


def threshold_sweep(rows: DataFrame, score: str, by: tuple[str, ...] = (), zero: float = 1e-12) -> DataFrame:
    """For each threshold (each distinct score, just below the least, infinity) the switches, regressions and summed gain.

    One pass: deltas are summed by score first, then over the scores above each threshold.
    """
    gain = F.when(F.col("selector_eligible"), F.col("challenger_iou") - F.col("baseline_iou")).otherwise(0.0)
    lost = F.col("selector_eligible") & (F.col("baseline_iou") > zero) & (F.col("challenger_iou") <= zero)
    steps = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(gain).alias("gain"), count_if(lost).alias("lost"), count_if(F.col("selector_eligible")).alias("moved")
    )
    least = steps.groupBy(*by).agg((F.min("threshold") - 1e-9).alias("threshold"))
    most = steps.groupBy(*by).agg(F.lit(float("inf")).alias("threshold"))
    nothing = [F.lit(0.0).alias("gain"), F.lit(0).cast("long").alias("lost"), F.lit(0).cast("long").alias("moved")]
    steps = steps.unionByName(least.select(*by, "threshold", *nothing)).unionByName(most.select(*by, "threshold", *nothing))
    return sums_above(steps, "threshold", ["gain", "lost", "moved"], by)


def safe_threshold(rows: DataFrame, score: str, budget: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold of greatest gain among those within the regression budget.

    Ties: fewer regressions, fewer switches, higher threshold. None feasible: no row.
    """
    order = F.struct("gain", -F.col("lost"), -F.col("moved"), "threshold")
    best = threshold_sweep(rows, score, by).where(F.col("lost") <= budget).groupBy(*by).agg(F.max_by(F.struct("threshold", "gain", "lost", "moved"), order).alias("t"))
    return best.select(*by, "t.*")


def joint_threshold(rows: DataFrame, score: str, suite: str, budgets: dict[str, int] | None = None, unscored: str = "baseline", zero: float = 1e-12) -> DataFrame:
    """One threshold for all suites: the mean capture from the better fixed choice is greatest.

    Each suite keeps to its regression budget; without ``budgets`` that is half of its
    unconditional regressions. Ties: greater sum of the selectors' means, fewer
    regressions, fewer switches, lower threshold. None feasible: no row.
    """
    can, b, c = F.coalesce(F.col("selector_eligible"), F.lit(False)), F.coalesce("baseline_iou", F.lit(0.0)), F.coalesce("challenger_iou", F.lit(0.0))
    gone, silent = can & (b > zero) & (c <= zero), F.col(score).isNull() & (unscored == "challenger")
    gain = F.when(can, c - b).otherwise(0.0)
    fixed = rows.groupBy(suite).agg(
        F.count(F.lit(1)).alias("n"), F.sum(b).alias("base"), F.sum(F.when(can, c).otherwise(b)).alias("challenger"), F.sum(F.when(can, F.greatest(b, c)).otherwise(b)).alias("oracle"),
        count_if(gone).alias("all_lost"), F.sum(F.when(silent, gain).otherwise(0.0)).alias("gain0"), count_if(silent & gone).alias("lost0"), count_if(silent & can).alias("moved0"),
    )
    steps = rows.where(F.col(score).isNotNull()).groupBy(suite, F.col(score).alias("threshold")).agg(F.sum(gain).alias("gain"), count_if(gone).alias("lost"), count_if(can).alias("moved"))
    names = [r[0] for r in rows.select(suite).distinct().limit(65).collect()]
    if len(names) > 64:
        raise ValueError("a joint threshold is for at most 64 suites")
    least = steps.agg((F.min("threshold") - 1e-9).alias("threshold"))
    every = steps.select("threshold").union(least).union(least.select(F.lit(float("inf")))).distinct().withColumn(suite, F.explode(F.array(*[F.lit(x) for x in names])))
    steps = every.join(steps, [suite, "threshold"], "left").na.fill(0, ["gain", "lost", "moved"])
    at = sums_above(steps, "threshold", ["gain", "lost", "moved"], (suite,)).join(F.broadcast(fixed), suite)  # at most 64 rows
    at = at.withColumns({"gain": F.col("gain") + F.col("gain0"), "lost": F.col("lost") + F.col("lost0"), "moved": F.col("moved") + F.col("moved0")})
    if budgets is None:
        limit = F.floor(F.col("all_lost") / 2)
    else:
        limit = F.coalesce(*[F.when(F.col(suite) == k, F.lit(v)) for k, v in budgets.items()])
    strong = F.greatest("base", "challenger")
    capture = F.when(F.col("oracle") > strong, (F.col("base") + F.col("gain") - strong) / (F.col("oracle") - strong))
    total = at.groupBy("threshold").agg(
        F.avg(capture).alias("mean_capture"), F.sum((F.col("base") + F.col("gain")) / F.col("n")).alias("selector_miou_sum"), F.sum("lost").alias("lost"), F.sum("moved").alias("moved"),
        F.bool_and(F.coalesce(F.col("lost") <= limit, F.lit(True))).alias("feasible"),
    ).where("feasible")
    order = F.struct("mean_capture", "selector_miou_sum", -F.col("lost"), -F.col("moved"), -F.col("threshold"))
    return total.agg(F.max_by(F.struct("threshold", "mean_capture", "selector_miou_sum", "lost", "moved"), order).alias("t")).where("t is not null").select("t.*")


def blended(rows: DataFrame, parts: dict[str, float], variants: dict[str, dict[str, float]]) -> DataFrame:
    """One row a variant: the weighted sum of scores, each over its scale (``parts``: score to scale)."""
    made = [
        F.struct(F.lit(name).alias("variant"), sum((F.col(p) / parts[p] * w for p, w in weights.items()), F.lit(0.0)).alias("score"))
        for name, weights in variants.items()
    ]
    return rows.select("*", F.inline(F.array(*made)))


def scale_of(rows: DataFrame, score: str) -> float:
    """Population deviation of a score, at least 1e-6."""
    return rows.agg(F.greatest(F.stddev_pop(score), F.lit(1e-6))).first()[0] or 1e-6


def confusion(df: DataFrame, truth: Column, predicted: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, rates and intervals of a yes/no task; a missing prediction counts as no."""
    p = F.coalesce(predicted, F.lit(False))
    counts = df.groupBy(*by).agg(count_if(truth & p).alias("tp"), count_if(truth & ~p).alias("fn"), count_if(~truth & p).alias("fp"), count_if(~truth & ~p).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    out = counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fn + fp + tn),
            "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
            "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
            "false_rate": F.try_divide(fp, fp + tn),
        }
    )
    low, high = wilson(fp, fp + tn)
    return out.withColumns({"false_rate_low": low, "false_rate_high": high})


def coverage(expected: DataFrame, attempts: DataFrame, key: list[str], failed: Column) -> DataFrame:
    """Expected keys, attempted, missing, attempts beyond the first, failures and completeness."""
    tried = attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("tries"), count_if(failed).alias("failures"))
    both = expected.select(*key).distinct().join(tried, key, "left")
    return both.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("tries").alias("attempted"),
        count_if(F.col("tries").isNull()).alias("missing"),
        F.coalesce(F.sum(F.col("tries") - 1), F.lit(0)).alias("extra_attempts"),
        count_if(F.col("tries") == F.col("failures")).alias("never_succeeded"),
    ).withColumn("complete", (F.col("missing") == 0) & (F.col("never_succeeded") == 0))


def typed_rates(df: DataFrame, kind: str, condition: Column) -> DataFrame:
    """The mean of the types' rates beside the pooled rate, and the number of types."""
    r = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), count_if(condition).alias("k"))
    return r.agg(F.avg(F.col("k") / F.col("n")).alias("macro"), F.try_divide(F.sum("k"), F.sum("n")).alias("pooled"), F.count(F.lit(1)).alias("types"))


def most_common(df: DataFrame, value: str, position: str, limit: int) -> DataFrame:
    """The most frequent values; of equal ones the first to appear."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_seen"))
    return counts.orderBy(F.desc("n"), "_seen").limit(limit).drop("_seen")


def mean_by_place(df: DataFrame, vectors: list[str]) -> DataFrame:
    """(vector, place, mean): the mean of each place, from 0, of columns of array<double>; nulls do not count.

    Places are added up by partition, so a row for a place of each is shuffled, not one for each number.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {name: np.zeros((2, 0)) for name in vectors}
        for batch in batches:
            for name in vectors:
                lists = batch[name]
                sizes, items = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten()
                place, known = np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes), items.is_valid().to_numpy(zero_copy_only=False)
                values = items.to_numpy(zero_copy_only=False)
                if not known.all():
                    place, values = place[known], values[known]
                wide = max(found[name].shape[1], int(sizes.max(initial=0)))
                now = np.stack([np.bincount(place, minlength=wide), np.bincount(place, values, wide)])
                now[:, : found[name].shape[1]] += found[name]
                found[name] = now
        for name, (n, total) in found.items():
            yield pa.record_batch([pa.array([name] * len(n)), pa.array(range(len(n)), pa.int32()), pa.array(total), pa.array(n.astype(np.int64))], ["vector", "place", "_total", "_n"])

    parts = df.select(*vectors).mapInArrow(sums, "vector string, place int, _total double, _n long")
    return parts.groupBy("vector", "place").agg((F.sum("_total") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"))


def enumerated(df: DataFrame, value: str, values: list[str]) -> DataFrame:
    """Counts of fixed values, zeros kept."""
    fixed = df.sparkSession.createDataFrame([(v,) for v in values], f"{value} string")
    return fixed.join(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def metric_summary(df: DataFrame, overlap: str, found: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean overlap, share without any, share of one half or more and share found; 0 where empty."""
    value = lambda c: F.coalesce(c, F.lit(0.0))
    rate = lambda c: value(F.avg(c.cast("double")))
    v = F.col(overlap)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), value(F.avg(v)).alias("mean_iou"), rate(v <= 0.0).alias("zero_rate"), rate(v >= 0.5).alias("hit_rate"), rate(found).alias("found_rate"))


def bootstrap_mean(df: DataFrame, value: str, order: str, by: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Mean of each group with its 95 % bootstrap interval; groups of fewer than two have none.

    Null values are left out. Values are resampled in ``order`` (a number); see
    ``resampling.bootstrap``, which puts no group into one task.
    """
    from .resampling import bootstrap

    known = df.where(F.col(value).isNotNull())
    out = bootstrap(known, [by], order, {"x": F.col(value).cast("double")}, F.col("x") / F.col("n"), rounds, seed)
    return df.select(by).distinct().join(out, by, "left").select(by, F.col("value").alias("mean"), "ci_lower", "ci_upper")
