"""Box geometry on ``array<double>`` columns (x1, y1, x2, y2).

One overlap core, and a named policy for missing boxes: ``strict`` reports a
violation, ``zero`` counts 0.0 and ``null`` stays null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.array(*[F.col(v).cast("double") if isinstance(v, str) else v.cast("double") for v in (x1, y1, x2, y2)])


def _side(b: Column, low: int) -> Column:
    return F.greatest(b[low + 2] - b[low], F.lit(0.0))


def area(b: Column) -> Column:
    """Area with negative extents as 0."""
    return _side(b, 0) * _side(b, 1)


def valid(b: Column) -> Column:
    """Four finite numbers that span a positive area; null is not valid."""
    finite = ~F.exists(b, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(b) == 4) & finite & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column, missing: str = "null") -> Column:
    """Intersection over union; an empty union gives 0."""
    shared = overlap(a, b)
    # the union is never negative, and a division by 0 gives null: no second copy of it in the plan
    value = F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0)))
    if missing == "zero":
        return F.coalesce(value, F.lit(0.0))
    if missing == "strict":
        return F.when(valid(a) & valid(b), value)
    return value


def from_xywh(b: Column) -> Column:
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def clipped(b: Column, width: Column, height: Column) -> Column:
    """A box cut to the image; null if nothing is left or a coordinate is not finite."""
    x = lambda v: F.least(F.greatest(v, F.lit(0.0)), width.cast("double"))
    y = lambda v: F.least(F.greatest(v, F.lit(0.0)), height.cast("double"))
    cut = F.array(x(b[0]), y(b[1]), x(b[2]), y(b[3]))
    return F.when(valid(cut) & valid(b), cut)


def xywh_clipped(b: Column, width: Column, height: Column) -> Column:
    return F.when((b[2] > 0) & (b[3] > 0), clipped(from_xywh(b), width, height))


def rescaled(b: Column, width: Column, height: Column) -> Column:
    """Relative boxes (no coordinate beyond 1.5) become pixels; corners are ordered, then clipped."""
    relative = ~F.exists(b, lambda v: F.abs(v) > 1.5)
    w, h = F.when(relative, width.cast("double")).otherwise(F.lit(1.0)), F.when(relative, height.cast("double")).otherwise(F.lit(1.0))
    x1, y1, x2, y2 = b[0] * w, b[1] * h, b[2] * w, b[3] * h
    return clipped(F.array(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)), width, height)


def hardness(target: Column, other: Column, diagonal: Column) -> Column:
    """How confusable a box is with the target: by area ratio and distance of the centres."""
    ratio = F.try_divide(area(other), area(target))
    away = F.hypot((target[0] + target[2] - other[0] - other[2]) / 2, (target[1] + target[3] - other[1] - other[3]) / 2)
    return 0.6 * F.exp(-F.abs(F.ln(ratio))) + 0.4 * F.greatest(F.lit(0.0), 1 - F.try_divide(away, diagonal))


def ordered(b: Column) -> Column:
    """Four numbers as corners in order; null unless there are four."""
    return F.when(F.size(b) == 4, F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])))


def clamped(b: Column, width: Column, height: Column) -> Column:
    """Corners in order and within the image; an empty box stays."""
    x = lambda v: F.least(F.greatest(v, F.lit(0.0)), width.cast("double"))
    y = lambda v: F.least(F.greatest(v, F.lit(0.0)), height.cast("double"))
    return ordered(F.array(x(b[0]), y(b[1]), x(b[2]), y(b[3])))


def normalised(b: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Ordered and, where the size of the image is given, clamped; null for an empty or non-finite box."""
    out = ordered(b) if width is None else clamped(b, width, height)
    finite = F.size(F.filter(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))) == 4
    return F.when(finite & valid(out), out)


def from_text(cell: Column) -> Column:
    """A JSON cell, else the first four numbers of the text, as an ordered box."""
    found = F.transform(F.regexp_extract_all(cell, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda v: v.try_cast("double"))
    listed = F.from_json(F.when(F.trim(cell).startswith("["), cell), "array<double>")
    return ordered(F.when(F.size(listed) >= 0, listed).when(F.size(found) >= 4, F.slice(found, 1, 4)))


def pixels(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels, halves to even, within the image and at least one pixel on each side."""
    low = lambda v, most: F.greatest(F.lit(0), F.least(most - 1, F.bround(v).cast("int")))
    x1, y1 = low(b[0], width), low(b[1], height)
    high = lambda v, start, most: F.greatest(start + 1, F.least(most, F.bround(v).cast("int")))
    return F.array(x1, y1, high(b[2], x1, width), high(b[3], y1, height))


def shifted(b: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """Move a box; a step beyond the image is taken the other way, then the box is held inside."""

    def start(at: Column, size: Column, step: Column, most: Column) -> Column:
        moved = F.when(at + step + size > most, at - step).otherwise(at + step)
        return F.least(F.greatest(moved, F.lit(0.0)), most.cast("double") - size)

    w, h = b[2] - b[0], b[3] - b[1]
    x, y = start(b[0], w, dx, width), start(b[1], h, dy, height)
    return F.array(x, y, x + w, y + h)


#: The kept part, the added context and the shift, each as a share of a side.
PARTIAL, CONTEXT, JITTER = 0.55, 0.4, 0.35


def perturbed(truth: Column, width: Column, height: Column) -> Column:
    """array<struct<kind, box, iou>>: cuts, context and shifts of a box that overlap it by less than 0.95.

    A box equal to the truth or, at ten decimals, to an earlier one is left out.
    """
    x1, y1, x2, y2 = (truth[i] for i in range(4))
    w, h, zero = x2 - x1, y2 - y1, F.lit(0.0)
    made = {
        "partial_horizontal": F.array(x1, y1, x1 + w * PARTIAL, y2),
        "partial_vertical": F.array(x1, y1, x2, y1 + h * PARTIAL),
        "oversized_context": F.array(
            F.greatest(zero, x1 - w * CONTEXT), F.greatest(zero, y1 - h * CONTEXT), F.least(width.cast("double"), x2 + w * CONTEXT), F.least(height.cast("double"), y2 + h * CONTEXT)
        ),
        "jitter_horizontal": shifted(truth, w * JITTER, zero, width, height),
        "jitter_vertical": shifted(truth, zero, h * JITTER, width, height),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("box"), iou(truth, v).alias("iou")) for k, v in made.items()])
    key = lambda b: F.transform(b, lambda v: F.round(v, 10))
    start = F.array().cast("array<struct<kind:string,box:array<double>,iou:double>>")
    # an accumulator, as a lambda that names ``rows`` would compute them again for each element
    fresh = F.aggregate(rows, start, lambda seen, r: F.when((key(r["box"]) == truth) | F.exists(seen, lambda e: key(e["box"]) == key(r["box"])), seen).otherwise(F.concat(seen, F.array(r))))
    return F.filter(fresh, lambda r: r["iou"] < 0.95)


def _log_ratio(a: Column, b: Column) -> Column:
    return F.ln((a + 1e-6) / (b + 1e-6))


def box_features(b: Column, width: Column, height: Column) -> Column:
    """Ten numbers relative to the image: corners, size, centre, area and log aspect."""
    x1, y1, x2, y2 = b[0] / width, b[1] / height, b[2] / width, b[3] / height
    return F.array(x1, y1, x2, y2, x2 - x1, y2 - y1, (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * (y2 - y1), _log_ratio(x2 - x1, y2 - y1))


def pair_features(b: Column, other: Column, width: Column, height: Column) -> Column:
    """18 numbers of one box of a pair: its own ten, its distance to each edge, and its relation to the other."""
    own, far = box_features(b, width, height), box_features(other, width, height)
    one = F.lit(1.0)
    edges = F.array(F.least(own[0], one), F.least(own[1], one), F.least(1 - own[2], one), F.least(1 - own[3], one))
    between = F.array(iou(b, other), own[6] - far[6], own[7] - far[7], _log_ratio(own[8], far[8]))
    return F.concat(own, edges, between)


# The longer vectors are made in Arrow batches, as native forms compute an item again for each use of it.


def _corners(column: pa.Array) -> np.ndarray:
    """Boxes as rows of four numbers, NaN for null."""
    four = pc.fill_null(pc.equal(pc.list_value_length(column), 4), False)
    out = np.full((len(column), 4), np.nan)
    out[four.to_numpy(zero_copy_only=False)] = column.filter(four).flatten().cast("float64").to_numpy(zero_copy_only=False).reshape(-1, 4)
    return out


def _doubles(column: pa.Array) -> np.ndarray:
    return column.cast("float64").to_numpy(zero_copy_only=False)


def _logs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.log((a + 1e-6) / (b + 1e-6))


def _ten(b: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """``box_features`` of each row."""
    x1, y1, x2, y2 = b[:, 0] / width, b[:, 1] / height, b[:, 2] / width, b[:, 3] / height
    return np.column_stack([x1, y1, x2, y2, x2 - x1, y2 - y1, (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * (y2 - y1), _logs(x2 - x1, y2 - y1)])


def _referred(own: np.ndarray, ref: np.ndarray, score: np.ndarray) -> np.ndarray:
    """``reference_features`` of each row."""
    o, r = own.T, ref.T
    dx, dy = o[6] - r[6], o[7] - r[7]
    shared_x = np.maximum(0.0, np.minimum(o[2], r[2]) - np.maximum(o[0], r[0]))
    shared_y = np.maximum(0.0, np.minimum(o[3], r[3]) - np.maximum(o[1], r[1]))
    shared = shared_x * shared_y
    part = lambda whole: np.divide(shared, whole, out=np.zeros_like(shared), where=whole != 0)
    size = lambda v: np.maximum(v[4], 0.0) * np.maximum(v[5], 0.0)
    across, down = np.minimum(o[4], r[4]), np.minimum(o[5], r[5])
    if not (across.all() and down.all()):
        raise ZeroDivisionError("a box without a side has no part that is shared")
    offsets = [score, dx, dy, np.abs(dx), np.abs(dy), np.hypot(dx, dy), _logs(o[8], r[8]), part(size(o) + size(r) - shared)]
    return np.column_stack([own, ref, *offsets, part(o[8]), part(r[8]), shared_x / across, shared_y / down])


def _context(own: np.ndarray, proposals: pa.Array, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """``context_features`` without the one-hot part of each row, NaN without proposals."""
    sizes = pc.fill_null(pc.list_value_length(proposals), 0).to_numpy(zero_copy_only=False)
    held, items = sizes > 0, proposals.flatten()
    out = np.full((len(sizes), 67), np.nan)
    if not held.any():
        return out
    row, fields = np.repeat(np.arange(len(sizes)), sizes), items.flatten()
    boxes, scores = (fields[items.type.get_field_index(name)] for name in ("box", "score"))
    score = _doubles(scores)
    rows = _referred(own[row], _ten(_corners(boxes), width[row], height[row]), score)
    starts, n, weight = (np.cumsum(sizes) - sizes)[held], sizes[held], np.fmax(score, 0.0)
    total = np.add.reduceat(weight, starts)
    each, count = np.repeat(total, n), np.repeat(n, n)
    share = np.where(each > 0, weight / np.where(each > 0, each, 1.0), 1.0 / count)
    out[held, :32] = np.add.reduceat(rows * share[:, None], starts, axis=0)
    out[held, 32:64] = np.fmax.reduceat(rows, starts, axis=0)
    out[held, 64:] = np.column_stack([n / 5.0, np.maximum.reduceat(weight, starts), total / n])
    return out


def _vectors(make: Callable, *columns: Column) -> Column:
    """array<double> by ``make`` over batches of box columns, then proposals or a score, width and height.

    Its numbers that are NaN become null; a row of no other is null.
    """

    def batch(*given: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            values = make(*given[:-2], _doubles(given[-2]), _doubles(given[-1]))
        none = np.isnan(values)
        ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), mask=none.ravel()), mask=pa.array(none.all(axis=1)))

    return F.arrow_udf(batch, "array<double>")(*columns)  # made late: the type is parsed by a session


def _reference(b, reference, score, width, height):
    return _referred(_ten(_corners(b), width, height), _ten(_corners(reference), width, height), _doubles(score))


def _about(b, proposals, width, height):
    return _context(_ten(_corners(b), width, height), proposals, width, height)


def _utility(b, proposals, width, height):
    own = _ten(_corners(b), width, height)
    context = _context(own, proposals, width, height)
    return np.where(np.isnan(context).all(axis=1)[:, None], np.nan, np.column_stack([own, context]))


def _compared(first, second, proposals, width, height):
    return _utility(second, proposals, width, height) - _utility(first, proposals, width, height)


def reference_features(b: Column, reference: Column, score: Column, width: Column, height: Column) -> Column:
    """32 numbers of a box and one reference: ten of each, the score, offsets and shared parts."""
    return _vectors(_reference, b, reference, score, width, height)


def context_features(b: Column, proposals: Column, relation: Column, relations: list[str], width: Column, height: Column) -> Column:
    """One-hot relation, score-weighted mean and maximum of the reference features, number, best and mean score.

    ``proposals``: array<struct<box, score>>, not empty (else null). Scores below 0 weigh
    nothing; where all do, proposals weigh the same. With 18 relations, 85 numbers.
    """
    hot = F.array(*[(relation == r).cast("double") for r in relations])
    return F.concat(hot, _vectors(_about, b, proposals, width, height))


def utility_features(b: Column, proposals: Column, relation: Column, relations: list[str], width: Column, height: Column) -> Column:
    """Own features and context of a box without the relation's one-hot part."""
    return _vectors(_utility, b, proposals, width, height)


def comparison_features(first: Column, second: Column, proposals: Column, relation: Column, relations: list[str], width: Column, height: Column) -> Column:
    """One-hot relation, then second minus first utility features: changing places changes their sign."""
    hot = F.array(*[(relation == r).cast("double") for r in relations])
    return F.concat(hot, _vectors(_compared, first, second, proposals, width, height))


def best_index(truths: Column, b: Column, least: float = 0.5) -> Column:
    """0-based position of the greatest overlap, the first of equal ones; null below ``least``."""
    values = F.transform(truths, lambda t: iou(t, b, "zero"))
    most = F.array_max(values)
    return F.when(most >= least, F.array_position(values, most) - 1)


def suppressed(boxes: Column, limit: float = 0.95) -> Column:
    """Keep a box unless it overlaps an earlier kept one by ``limit`` or more (order counts)."""
    start = F.array().cast("array<array<double>>")
    return F.aggregate(boxes, start, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b, "zero") >= limit), kept).otherwise(F.concat(kept, F.array(b))))
