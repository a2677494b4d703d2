"""Keep, switch or reject: selector labels, state changes and the decision policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou


def selector_columns(df: DataFrame, truth: str, baseline: str, challenger: str, margin: float = 0.05, *, error: Column | None = None, baseline_parsed: Column | None = None, challenger_parsed: Column | None = None) -> DataFrame:
    """Overlaps, exclusion, action and eligibility of each row.

    The first reason that holds excludes: an error, an unparsed baseline, a missing
    baseline box (locked), an unparsed challenger. A switch needs a gain of ``margin``.
    A challenger counts for the oracle only where the row is eligible.
    """
    yes = F.lit(True)
    out = df.withColumns({"baseline_iou": iou(F.col(truth), F.col(baseline), "zero"), "challenger_iou": iou(F.col(truth), F.col(challenger), "zero")})
    reason = (
        F.when(error if error is not None else ~yes, "inference_error")
        .when(~(baseline_parsed if baseline_parsed is not None else yes), "baseline_parse_invalid")
        .when(F.col(baseline).isNull(), "baseline_null_locked_stage1")
        .when(~(challenger_parsed if challenger_parsed is not None else yes) | F.col(challenger).isNull(), "challenger_parse_invalid")
    )
    out = out.withColumn("selector_exclusion", reason).withColumn("selector_eligible", F.col("selector_exclusion").isNull())
    action = F.when(F.col("selector_eligible"), F.when(F.col("challenger_iou") - F.col("baseline_iou") >= margin, "switch").otherwise("keep"))
    best = F.when(F.col("selector_eligible"), F.greatest("baseline_iou", "challenger_iou")).otherwise(F.col("baseline_iou"))
    return out.withColumns({"selector_action": action, "two_box_oracle_iou": best})


def box_state(found: Column, overlap: Column) -> Column:
    return F.when(~found, "false_rejection").when(overlap == 0.0, "valid_zero").otherwise("overlap")


def transition(before: Column, after: Column) -> Column:
    """Named changes of state; all others are ``<before>_to_<after>``."""
    return (
        F.when((before == "valid_zero") & (after == "overlap"), "recovered_zero")
        .when((before == "overlap") & (after == "valid_zero"), "regressed_zero")
        .when((before == "valid_zero") & (after == "valid_zero"), "persistent_zero")
        .when((before == "overlap") & (after == "overlap"), "stable_overlap")
        .when((before == "false_rejection") & (after == "false_rejection"), "persistent_rejection")
        .otherwise(F.concat_ws("_to_", before, after))
    )


def policy(baseline: Column, challenger: Column, null: Column, switch_margin: float = 0.0, reject_margin: float = 0.0, recover: bool = False, temperature: float = 1.0) -> Column:
    """struct<action, reason, confidence, probabilities> from three logits; null marks an absent candidate.

    The greatest logit wins; ties go to the baseline, then to null. Where null wins over a
    baseline by less than the reject margin, measured from the better of both boxes, and
    where a challenger wins over it by less than the switch margin, the baseline is kept.
    Without a baseline the challenger takes part only if ``recover``. Probabilities
    (baseline, challenger, null) are those of the candidates that take part, 0 for others.
    """
    low = F.lit(float("-inf"))
    b, n, has = F.coalesce(baseline, low), null, baseline.isNotNull()
    c = F.coalesce(challenger if recover else F.when(has, challenger), low)
    null_best, challenger_best = (n > b) & (n >= c), (c > b) & (c > n)
    held_back = null_best & has & (n - F.greatest(b, c) < reject_margin)
    too_close = challenger_best & has & (c - b < switch_margin)
    p = softmax([b, c, n], temperature)
    made = lambda action, reason, k: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"), p[k].alias("confidence"), p.alias("probabilities"))
    return (
        F.when(held_back, made("keep", "reject_margin_not_met", 0))
        .when(too_close, made("keep", "switch_margin_not_met", 0))
        .when(null_best, made("reject", "joint_argmax", 2))
        .when(challenger_best, made("switch", "joint_argmax", 1))
        .otherwise(made("keep", "joint_argmax", 0))
    )


def softmax(logits: list[Column], temperature: float = 1.0) -> Column:
    most = F.greatest(*logits)
    parts = [F.exp((x - most) / temperature) for x in logits]
    total = sum(parts[1:], parts[0])
    return F.array(*[p / total for p in parts])


def candidate_logit(parts: list[Column], weights: list[float]) -> Column:
    """Weighted sum of a candidate's evidence; a contradiction has a negative weight."""
    return sum((p * w for p, w in zip(parts[1:], weights[1:])), parts[0] * weights[0])


def antisymmetric(forward: Column, swapped: Column) -> Column:
    """A score that changes its sign when the two boxes change places."""
    return (forward - swapped) / 2
