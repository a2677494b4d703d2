"""Joins of boxes within their images that make no pairs of boxes far apart.

A box belongs to the grid whose tiles are as wide as its longer side, rounded up to a power
of two, and touches at most four of them. It meets boxes of its own or a wider grid in the
tiles of that grid, so pairs are made of neighbours only, and each in the one tile that holds
the corner of what the two share.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g

#: Cells of the image's diagonal, and of a factor of e of areas, when the hardest others are looked for.
SIDE, FINE = 5, 1
#: Boxes of a group that one task compares, and pairs of them that it looks at together.
WHOLE, STRIP = 32_768, 1 << 15


def _grid(box: Column) -> Column:
    return F.ceil(F.log2(F.greatest(box[2] - box[0], box[3] - box[1])))


def _tiles(box: Column, level: Column) -> Column:
    """The tiles that a box touches in the grid of a level."""
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), level))
    across = lambda a, b: F.sequence(at(box[a]), at(box[b]))
    return F.flatten(F.transform(across(0, 2), lambda x: F.transform(across(1, 3), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def overlapping(df: DataFrame, others: DataFrame, group: list[str], box: str, other_box: str) -> DataFrame:
    """Pairs of rows of one ``group`` whose boxes share an area, with ``iou``; no pair twice.

    The tables share no column but ``group``. Boxes that are not valid, null ones too, pair
    with nothing. The distinct grids of both sides are read first, which is one job; there
    are as many as powers of two between the least and the greatest side.
    """
    a, b = df.where(g.valid(F.col(box))).withColumn("_l", _grid(F.col(box))), others.where(g.valid(F.col(other_box))).withColumn("_l", _grid(F.col(other_box)))
    grids = [sorted(r[0] for r in side.select("_l").distinct().collect()) for side in (a, b)]

    def placed(side: DataFrame, column: str, name: str, levels: list[int] | None, equal: bool = True) -> DataFrame:
        """Rows by tile: of their own grid, or of each of ``levels`` that is as wide (``equal``) or wider."""
        if levels is not None:
            fits = lambda x: x >= F.col("_l") if equal else x > F.col("_l")
            side = side.withColumn("_l", F.explode(F.filter(F.array(*[F.lit(n).cast("long") for n in levels]).cast("array<bigint>"), fits)))
        keep = F.struct(*[F.col(c) for c in side.columns if c not in (*group, "_l")])
        return side.select(*group, F.col("_l"), F.explode(_tiles(F.col(column), F.col("_l"))).alias("_t"), keep.alias(name))

    keys = [*group, "_l", "_t"]
    narrow = placed(a, box, "_a", grids[1]).join(placed(b, other_box, "_b", None), keys)
    wide = placed(a, box, "_a", None).join(placed(b, other_box, "_b", grids[0], equal=False), keys)
    both = narrow.unionByName(wide)
    p, q = F.col(f"_a.{box}"), F.col(f"_b.{other_box}")
    corner = lambda k: F.floor(F.greatest(p[k], q[k]) / F.pow(F.lit(2.0), F.col("_l")))
    met = (corner(0) == F.col("_t.x")) & (corner(1) == F.col("_t.y")) & (g.overlap(p, q) > 0)
    return both.where(met).select(*group, "_a.*", "_b.*").withColumn("iou", g.iou(F.col(box), F.col(other_box)))


def best_match(df: DataFrame, others: DataFrame, group: list[str], key: str, box: str, other_key: str, other_box: str) -> DataFrame:
    """(key, other_key, iou): the other of greatest overlap of each row; the least key of equal ones.

    Rows that overlap no other of their group are left out. Equal boxes meet once.
    """
    marks = others.groupBy(*group, other_box).agg(F.min(other_key).alias(other_key))
    shapes = df.select(*group, box).distinct()
    best = overlapping(shapes, marks, group, box, other_box).groupBy(*group, box).agg(F.min_by(F.struct(other_key, "iou"), F.struct(-F.col("iou"), other_key)).alias("m"))
    return df.select(key, *group, box).join(best, [*group, box]).select(key, f"m.{other_key}", "m.iou")


def hardest(boxes: np.ndarray, code: np.ndarray, single: np.ndarray, diagonal: float, keep: int, most: float) -> tuple[np.ndarray, ...]:
    """(target, other, iou, hardness, rank, available) of the rows of one group, by their places.

    ``code`` is the place of the row's key in order, ``single`` marks those that may be others.
    Rows are taken by size in strips, with the others that may overlap them by ``most``; all
    others follow where one of another size may be as hard as the last that is kept.
    """
    area = np.maximum(boxes[:, 2] - boxes[:, 0], 0.0) * np.maximum(boxes[:, 3] - boxes[:, 1], 0.0)
    order, by_key = np.argsort(area, kind="stable"), np.argsort(code, kind="stable")
    others = order[single[order]]
    same, n, out = np.bincount(code[others], minlength=len(code)), len(others), []
    low_bits = np.empty(len(code), np.int64)
    low_bits[by_key] = np.arange(len(code), 0, -1)

    def overlap(t: np.ndarray, o: np.ndarray, ta: np.ndarray, oa: np.ndarray) -> np.ndarray:
        shared = np.maximum(np.minimum(t[2], o[2]) - np.maximum(t[0], o[0]), 0.0) * np.maximum(np.minimum(t[3], o[3]) - np.maximum(t[1], o[1]), 0.0)
        return shared / (ta + oa - shared)

    def strip(at: np.ndarray, to: np.ndarray):
        t, o, ta, oa = boxes[at].T[:, :, None], boxes[to].T[:, None, :], area[at][:, None], area[to][None, :]
        differ, apart = code[at][:, None] != code[to][None, :], overlap(t, o, ta, oa) < most
        dx, dy = (t[0] + t[2] - o[0] - o[2]) / 2, (t[1] + t[3] - o[1] - o[3]) / 2
        # the smaller area by the greater is exp(-|ln|) of their ratio
        hard = 0.6 * (np.minimum(oa, ta) / np.maximum(oa, ta)) + 0.4 * np.maximum(0.0, 1 - np.sqrt(dx * dx + dy * dy) / diagonal)
        # hardest first, then the least key; 0 for those that do not count
        value = ((np.floor(hard * 1e9 + 0.5).astype(np.int64) << 31) + low_bits[to][None, :]) * (differ & apart)
        k = min(keep, len(to))
        best = -np.sort(-np.partition(value, len(to) - k, axis=1)[:, len(to) - k :], axis=1)
        return best, np.count_nonzero(differ & ~apart, axis=1)

    sizes, reach = area[others], min(most, 1.0) * (1 - 1e-9)
    step = max(1, STRIP // max(n, 1))
    for start in range(0, len(order) if n else 0, step):
        at = order[start : start + step]
        low, high = np.searchsorted(sizes, area[at[0]] * reach), np.searchsorted(sizes, area[at[-1]] / reach, "right") if reach > 0 else n
        best, close = strip(at, others[low:high]) if low < high else (None, None)
        if best is None or (high - low < n and (best.shape[1] < keep or best[:, -1].min() >> 31 <= (0.6 * most + 0.4) * 1e9 + 1)):
            best, close = strip(at, others)
        row, place = np.nonzero(best)
        target, other = at[row], by_key[len(code) - (best[row, place] & (2**31 - 1))]
        iou = overlap(boxes[target].T, boxes[other].T, area[target], area[other])
        out.append((target, other, iou, (best[row, place] >> 31) / 1e9, place + 1, (n - same[code[at]] - close)[row]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 6


def _whole(rows: DataFrame, group: list[str], diagonal: float, keep: int, most: float) -> DataFrame:
    """``competitors`` of groups that fit a task each; only boxes are shuffled, and the rows kept are all that leaves it."""
    sides = [f"_{k}" for k in range(4)]
    kinds = dict(rows.dtypes)

    def compare(table: pa.Table) -> pa.Table:
        code = pc.rank(table["_key"], tiebreaker="dense").to_numpy().astype(np.int64) - 1
        shapes = np.column_stack([table[c].to_numpy() for c in sides])
        target, other, iou, hardness, rank, available = hardest(shapes, code, ~table["_crowd"].to_numpy(), diagonal, keep, most)
        keys = table["_key"].combine_chunks()
        found = {c: pa.repeat(table[c][0], len(target)) for c in group} | {"target": keys.take(pa.array(target)), "other": keys.take(pa.array(other))}
        return pa.table(found | {"iou": pa.array(iou, pa.float64()), "hardness": pa.array(hardness, pa.float64()), "rank": pa.array(rank, pa.int32()), "available": pa.array(available, pa.int64())})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), f"target {kinds['_key']}, other {kinds['_key']}", "iou double, hardness double, rank int, available long"])
    sent = rows.select(*group, "_key", "_crowd", *[F.col("_box")[k].alias(c) for k, c in enumerate(sides)])
    return sent.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group])).groupBy(*group).applyInArrow(compare, schema)


def competitors(df: DataFrame, group: list[str], key: str, box: str, width: float, height: float, keep: int, most: float = 0.5, crowd: Column | None = None, whole: int = WHOLE) -> DataFrame:
    """(target, other, iou, hardness, rank, available): the hardest others of each row's group.

    Others that are crowds, or overlap the target by ``most`` or more, do not count; of
    equal hardness (nine places) the least key comes first. ``available`` is how many others
    count. Boxes that are not valid are neither targets nor others.

    Rows are counted by group first, which is one job. A group of up to ``whole`` rows is
    compared in one task (``hardest``), and its pairs are never written. Those of more rows,
    at most one in ``whole`` rows of the table, go by cells (``_by_cells``).
    """
    rows = df.where(g.valid(F.col(box))).select(*group, F.col(key).alias("_key"), F.col(box).alias("_box"), F.coalesce(crowd, F.lit(False)).alias("_crowd") if crowd is not None else F.lit(False).alias("_crowd"))
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).drop("_n")
    large = counts.collect()
    diagonal = float((width**2 + height**2) ** 0.5)
    if not large:
        return _whole(rows, group, diagonal, keep, most)
    marks = F.broadcast(df.sparkSession.createDataFrame(large, counts.schema))
    small, full = rows.join(marks, group, "left_anti"), rows.join(marks, group, "left_semi")
    return _whole(small, group, diagonal, keep, most).unionByName(_by_cells(full, group, width, height, keep, most))


def _by_cells(rows: DataFrame, group: list[str], width: float, height: float, keep: int, most: float) -> DataFrame:
    """``competitors`` of groups of any size.

    ``available`` is the size of the group less the pairs of ``overlapping``. Others are
    summed by cells of their place and area; of a target's cells only those are opened whose
    best hardness reaches what the ``keep`` hardest have at least, so a large group does not
    make its pairs.
    """
    diagonal = F.lit(float((width**2 + height**2) ** 0.5))
    b = F.col("_box")
    rows = rows.withColumns({"_s": F.ln(g.area(b)), "_x": (b[0] + b[2]) / 2, "_y": (b[1] + b[3]) / 2})
    step = F.lit((width**2 + height**2) ** 0.5 / SIDE)
    rows = rows.withColumn("_cell", F.struct(F.floor(F.col("_s") * FINE).alias("s"), F.floor(F.col("_x") / step).alias("x"), F.floor(F.col("_y") / step).alias("y")))
    single = rows.where(~F.col("_crowd"))

    other = single.select(*group, F.col("_key").alias("_other"), F.col("_box").alias("_other_box"))
    close = overlapping(rows.select(*group, "_key", "_box", "_crowd"), other, group, "_box", "_other_box").where((F.col("iou") >= most) & (F.col("_key") != F.col("_other")))
    close = close.groupBy(*group, "_key").agg(F.count(F.lit(1)).alias("_close"))
    sizes = single.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    targets = rows.join(sizes, group).join(close, [*group, "_key"], "left").withColumn("_close", F.coalesce("_close", F.lit(0)))
    targets = targets.withColumn("available", F.col("_size") - F.when(F.col("_crowd"), 0).otherwise(1) - F.col("_close"))

    ends = [f(f"_{c}").alias(f"{c}_{n}") for c in "sxy" for n, f in (("low", F.min), ("high", F.max))]
    cells = single.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("n"), *ends)
    # of one group there are at most as many as places and sizes, whatever its number of boxes
    cells = cells.groupBy(*group).agg(F.collect_list(F.struct("_cell", "n", *[f"{c}_{n}" for c in "sxy" for n in ("low", "high")])).alias("_cells"))

    def bounds(cell: Column) -> Column:
        """The least and the greatest hardness that a member of the cell can have."""
        low, high = (lambda c: cell[f"{c}_low"]), (lambda c: cell[f"{c}_high"])
        nearest = lambda c: F.greatest(F.lit(0.0), low(c) - F.col(f"_{c}"), F.col(f"_{c}") - high(c))
        farthest = lambda c: F.greatest(F.abs(F.col(f"_{c}") - low(c)), F.abs(F.col(f"_{c}") - high(c)))
        hard = lambda by: 0.6 * F.exp(-by("s")) + 0.4 * F.greatest(F.lit(0.0), 1 - F.hypot(by("x"), by("y")) / diagonal)
        return F.struct((-hard(farthest)).alias("least"), cell["n"].alias("n"), hard(nearest).alias("up"), cell["_cell"].alias("cell"))

    # the target itself and others too close may be among those counted, from the hardest cells down
    wanted = F.lit(keep + 1) + F.col("_close")
    down = lambda acc, c: F.struct((acc["n"] + c["n"]).alias("n"), F.when(acc["n"] < wanted, F.when(acc["n"] + c["n"] >= wanted, -c["least"]).otherwise(-1.0)).otherwise(acc["bar"]).alias("bar"))
    bar = lambda cells: F.aggregate(cells, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1.0).alias("bar")), down)["bar"]
    # a lambda's argument is computed once, however often it is used
    once = lambda value, f: F.transform(F.array(value), f)[0]
    opened = once(F.array_sort(F.transform("_cells", bounds)), lambda cells: once(bar(cells), lambda x: F.filter(cells, lambda c: c["up"] >= x - 1e-6)))
    seen = targets.drop("_cell").join(cells, group).withColumn("_c", F.explode(opened)).withColumn("_c", F.col("_c.cell"))
    other = single.select(*group, F.col("_cell").alias("_c"), F.col("_key").alias("_other"), F.col("_box").alias("_other_box"))
    pairs = seen.select(*group, "_key", "_box", "available", "_c").join(other, [*group, "_c"]).where(F.col("_key") != F.col("_other"))
    pairs = pairs.withColumn("iou", g.iou(b, F.col("_other_box"))).where(F.col("iou") < most)
    pairs = pairs.withColumn("hardness", F.round(g.hardness(b, F.col("_other_box"), diagonal), 9))
    each = Window.partitionBy(*group, "_key")
    ranked = pairs.withColumn("rank", F.row_number().over(each.orderBy(F.desc("hardness"), "_other"))).where(F.col("rank") <= keep)
    return ranked.select(*group, F.col("_key").alias("target"), F.col("_other").alias("other"), "iou", "hardness", "rank", "available")
