"""Joins with the checks that the records ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def enriched(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, name: str) -> DataFrame:
    """Left join that records a missing reference in the array column ``violations``."""
    side = dimension.withColumn(f"_has_{name}", F.lit(True))
    out = df.join(side, df[key] == side[dimension_key], "left")
    found = F.when(F.col(f"_has_{name}").isNull(), F.array(F.lit(f"missing_{name}"))).otherwise(F.array().cast("array<string>"))
    before = F.col("violations") if "violations" in df.columns else F.array().cast("array<string>")
    return out.withColumn("violations", F.concat(before, found)).drop(f"_has_{name}")


def assert_clean(df: DataFrame) -> DataFrame:
    """Raise if any row has violations, else ``df`` without that column."""
    bad = df.where(F.size("violations") > 0).select(F.explode("violations").alias("v")).groupBy("v").count().orderBy("v").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['v']}: {r['count']}" for r in bad))
    return df.drop("violations")


def group_size_without_self(group: list[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*group)) - 1


def nearest_value(df: DataFrame, others: DataFrame, group: list[str], key: str, value: str, other_key: str, other_value: str) -> DataFrame:
    """(key, other_key, distance): the other of the group whose number is nearest; the least key of equal ones.

    Each group's numbers are put in order once and every row looks at the other before and
    the one after it, so pairs are not made. Groups without others give no row.
    """
    marks = others.groupBy(*group, F.col(other_value).cast("double").alias("_v")).agg(F.min(other_key).alias("_o"))
    both = df.select(*group, F.col(value).cast("double").alias("_v"), F.col(key).alias("_k"), F.lit(None).cast(dict(marks.dtypes)["_o"]).alias("_o"))
    both = both.unionByName(marks.withColumn("_k", F.lit(None).cast(dict(both.dtypes)["_k"])))
    # of equal numbers the others come first, on the way up and on the way down
    mark, isnt = F.when(F.col("_o").isNotNull(), F.struct("_v", "_o")), F.col("_o").isNull()
    way = lambda *order: F.last(mark, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order, isnt).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumns({"_a": way(F.asc("_v")), "_b": way(F.desc("_v"))}).where("_k is not null")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._v") - F.col("_v")).alias("distance"), F.col(f"{c}._o").alias("o")))
    best = F.array_min(F.filter(F.array(near("_a"), near("_b")), lambda x: x.isNotNull()))
    return found.withColumn("_m", best).where("_m is not null").select(F.col("_k").alias(key), F.col("_m.o").alias(other_key), "_m.distance")


def closed_groups(df: DataFrame, group: list[str], relevant: Column) -> DataFrame:
    """All rows of a group when any of its rows is relevant."""
    return df.join(df.where(relevant).select(*group).distinct(), group, "left_semi")


def assembled(queue: DataFrame, required: dict[str, DataFrame], optional: dict[str, DataFrame], key: list[str], tasks: list[str] | None = None) -> DataFrame:
    """Queue rows with the parts of other tables, each as a struct column of its name, once for each task.

    A required part that is missing is noted in ``violations`` (see ``assert_clean``); an
    optional one is null. Parts have one row a key.
    """
    out = queue.withColumn("violations", F.array().cast("array<string>"))
    for name, part in {**required, **optional}.items():
        fields = [F.col(c) for c in part.columns if c not in key]
        out = out.join(part.select(*key, F.struct(*fields).alias(name)), key, "left")
        if name in required:
            out = out.withColumn("violations", F.when(F.col(name).isNull(), F.array_append("violations", F.lit(f"missing_{name}"))).otherwise(F.col("violations")))
    return out if tasks is None else out.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))


def by_text(a: DataFrame, b: DataFrame, key: str, text: str, how: str = "inner") -> DataFrame:
    """Join on an id and a text that may differ in case and white space; ids lose what follows two underscores.

    ``b`` keeps its other columns only.
    """
    from ..functions.text import normalised, without_suffix

    side = b.select(without_suffix(F.col(key).cast("string")).alias("_k"), normalised(F.col(text)).alias("_t"), *[c for c in b.columns if c not in (key, text)])
    mine = a.withColumns({"_k": without_suffix(F.col(key).cast("string")), "_t": normalised(F.col(text))})
    return mine.join(side, ["_k", "_t"], how).drop("_k", "_t")


def pools(expressions: DataFrame, banks: DataFrame, key: list[str], arrays: dict[str, str]) -> DataFrame:
    """Expressions with their candidate bank, once for each kind whose array isn't empty (kind: array column)."""
    kinds = F.array(*[F.when(F.coalesce(F.size(c), F.lit(0)) > 0, kind) for kind, c in arrays.items()])
    return expressions.join(banks, key).withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))


def coverage_union(everything: DataFrame, parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """How many keys each part covers, how many any, how many all, and how many none."""
    out = everything.select(*key).distinct()
    for name, part in parts.items():
        out = out.join(part.select(*key, F.lit(1).alias(name)).distinct(), key, "left")
    n = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    count = lambda c: F.count(F.when(c, 1))
    return out.agg(*[F.count(p).alias(p) for p in parts], count(n > 0).alias("covered"), count(n == len(parts)).alias("shared"), count(n == 0).alias("unresolved"))


def assert_count(df: DataFrame, expected: int) -> DataFrame:
    found = df.count()
    if found != expected:
        raise ValueError(f"{found} rows, not {expected}")
    return df


def group_slice(df: DataFrame, group: list[str], order: str, offset: int, limit: int) -> DataFrame:
    """All rows of the groups that come at ``offset`` and after by their first row, ``limit`` of them."""
    firsts = df.groupBy(*group).agg(F.min(order).alias("_first")).orderBy("_first", *group).offset(offset).limit(limit)
    return df.join(firsts.drop("_first"), group, "left_semi")


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows of each group and a map of a small set of values to their counts, in order of value."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(value, "_n"))))
    return counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.map_from_entries(entries).alias(f"{value}_counts"))


def resolved(df: DataFrame, files: DataFrame, candidates: list[Column]) -> DataFrame:
    """Rows with ``path``, the first candidate among the listed files (column ``path``); rows without one are left out."""
    tries = df.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode(F.array(*candidates)).alias("_n", "path"))
    found = tries.join(files.select("path").distinct(), "path", "left_semi")
    return found.groupBy("_id").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns], "path"), "_n").alias("r")).select("r.*")


def checked_references(references: DataFrame, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """References (image_id, ann_id, category_id, ...) with ``violations``, see ``assert_clean``.

    A reference names an image and an annotation that are there (image_id; ann_id), the
    annotation is of that image and category, and the category is known (category_id).
    """
    there = lambda df, key, name: df.select(F.col(key).alias(f"_{name}"), F.lit(True).alias(f"_has_{name}")).distinct()
    marks = annotations.select(F.col("ann_id").alias("_ann"), F.col("image_id").alias("_ann_image"), F.col("category_id").alias("_ann_category"))
    out = references.join(there(images, "image_id", "image"), F.col("image_id") == F.col("_image"), "left")
    out = out.join(marks, F.col("ann_id") == F.col("_ann"), "left").join(there(categories, "category_id", "category"), F.col("category_id") == F.col("_category"), "left")
    found = F.array(
        F.when(F.col("_has_image").isNull(), "missing_image"),
        F.when(F.col("_ann").isNull(), "missing_annotation"),
        F.when(F.col("_ann_image") != F.col("image_id"), "wrong_image"),
        F.when(F.col("_ann_category") != F.col("category_id"), "wrong_category"),
        F.when(F.col("_has_category").isNull(), "unknown_category"),
    )
    return out.select(*references.columns, F.filter(found, lambda v: v.isNotNull()).alias("violations"))
