"""Record shaping: allow-lists, guards, labels of nested records, caches and replacement rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logs import first, then_latest


def projected(df: DataFrame, allowed: dict[str, str], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Only the allowed columns with their types; a forbidden one among them is an error, found without a scan."""
    bad = sorted(set(allowed) & set(forbidden))
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in allowed.items()])


def assert_without(df: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    bad = sorted(set(df.columns) & set(forbidden))
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def extreme(items: Column, field: str, greatest: bool = True) -> Column:
    """Element of the greatest (or least) field; the first of equal ones, null for an empty array."""
    values = F.transform(items, lambda x: x[field])
    return F.get(items, F.array_position(values, F.array_max(values) if greatest else F.array_min(values)).cast("int") - 1)


def zero_cases(cases: Column) -> Column:
    """Cases with a box and an overlap of exactly 0; a missing overlap is not 0."""
    return F.filter(cases, lambda c: c["box"].isNotNull() & F.coalesce(c["iou"] == 0.0, F.lit(False)))


def with_zero_cases(df: DataFrame, cases: str) -> DataFrame:
    return df.withColumn(cases, zero_cases(F.col(cases))).where(F.size(cases) > 0)


def region_class(overlap: Column, match: Column, target: Column, match_category: Column, target_category: Column) -> Column:
    """What a box without overlap lies on, from its best match among the annotations."""
    return (
        F.when(match.isNull() | (overlap < 0.1), "background_or_unannotated")
        .when(overlap < 0.5, "partial_or_oversized_region")
        .when(match == target, "target_annotation_coordinate_mismatch")
        .when(match_category == target_category, "wrong_same_category_instance")
        .otherwise("other_category_or_reference")
    )


def expression_structure(relations: Column, attributes: Column) -> Column:
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(filled(relations), "relation").when(filled(attributes), "attribute").otherwise("object_only")


def relation_eligible(eligible: Column, relation: Column, phrase: Column, proposals: Column) -> Column:
    some = lambda c: F.coalesce(c != "", F.lit(False))
    return F.coalesce(eligible, F.lit(False)) & some(relation) & some(phrase) & F.coalesce(F.size(proposals) > 0, F.lit(False))


def error_class(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: F.coalesce(*[F.when(F.contains(m, F.lit(w)), True) for w in words], F.lit(False))
    return (
        F.when(has("arrearage", "overdue-payment"), "arrearage")
        .when(has("ratelimit", "429"), "rate_limit")
        .when(has("timeout", "timed out"), "timeout")
        .when(has("valueerror"), "schema_validation")
        .otherwise("api_or_other")
    )


#: Words of an explanation that rest on a stereotype.
WEAK_CUES = ("clothing style", "attire", "uniform", "body build", "body shape", "posture", "commonly associated", "typical male", "typical female")


def presentation_flag(presentation: Column, evidence: Column) -> Column:
    e = F.lower(F.coalesce(evidence, F.lit("")))
    has = lambda words: F.coalesce(*[F.when(F.contains(e, F.lit(w)), True) for w in words], F.lit(False))
    return (
        F.when(presentation.isin("not_applicable", "unclear"), presentation)
        .when(has(("no visible gender", "no visible secondary")) | (F.trim(e) == ""), "evidence_insufficient_or_self_contradictory")
        .when(has(WEAK_CUES), "stereotype_sensitive_cue")
        .otherwise("no_automatic_flag")
    )


def aliased(items: Column, field: str, aliases: dict[str, str]) -> Column:
    """struct<items, corrections>: the field's aliases replaced, and a note of each replacement."""
    known = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    fixed = F.transform(items, lambda x: x.withField(field, F.coalesce(F.try_element_at(known, x[field]), x[field])))
    note = lambda x, i: F.when(F.try_element_at(known, x[field]).isNotNull(), F.concat(F.lit("["), i.cast("string"), F.lit(f"].{field}:"), x[field], F.lit("->"), F.try_element_at(known, x[field])))
    return F.struct(fixed.alias("items"), F.filter(F.transform(items, note), lambda n: n.isNotNull()).alias("corrections"))


def violations(required: tuple[str, ...] = (), enums: dict[str, tuple[str, ...]] | None = None, lists: tuple[str, ...] = ()) -> Column:
    """What is wrong with a row: missing fields, values outside their enumeration, empty lists."""
    checks = [F.when(F.col(c).isNull(), f"missing:{c}") for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(v)), f"not_allowed:{c}") for c, v in (enums or {}).items()]
    checks += [F.when(F.coalesce(F.size(c), F.lit(0)) == 0, f"empty:{c}") for c in lists]
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def item_violations(items: Column, label: str, required: tuple[str, ...] = (), enums: dict[str, tuple[str, ...]] | None = None, some: bool = False) -> Column:
    """What is wrong with a list of structs and with each of its items, as ``label[i].field``.

    A null list is wrong, with ``some`` an empty one too; so are null items, required texts
    that are blank, and values outside their enumeration (a missing one is outside).
    """
    blank = lambda v: F.coalesce(F.trim(v.cast("string")) == "", F.lit(True))

    def of(item: Column, at: Column) -> Column:
        where = lambda text: F.concat(F.lit(f"{label}["), at.cast("string"), F.lit(f"]{text}"))
        wrong = [F.when(blank(item[f]), where(f".{f} is empty")) for f in required]
        wrong += [F.when(~F.coalesce(item[f].isin(list(v)), F.lit(False)), where(f".{f} is invalid")) for f, v in (enums or {}).items()]
        return F.when(item.isNull(), F.array(where(" is no object"))).otherwise(F.filter(F.array(*wrong), lambda w: w.isNotNull()))

    inside = F.flatten(F.transform(items, of))
    short = F.when(F.size(items) == 0, F.array(F.lit(f"{label} is empty"))).otherwise(inside) if some else inside
    return F.when(items.isNull(), F.array(F.lit(f"{label} is no list"))).otherwise(short)


def unambiguous(df: DataFrame, key: list[str], output: str, order: str) -> DataFrame:
    """The first row of each key whose rows agree on ``output``; null outputs count as empty."""
    o = F.coalesce(F.col(output), F.lit(""))
    agreed = df.groupBy(*key).agg((F.min(o) == F.max(o)).alias("_same"), F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("r"))
    return agreed.where("_same").select("r.*")


def reused(queue: DataFrame, cache: DataFrame, key: list[str], output: str) -> DataFrame:
    """Queue rows with the cached output, and ``reused`` where there was one; the others await inference."""
    known = cache.select(*key, output, F.lit(True).alias("_hit"))
    return queue.join(known, key, "left").withColumn("reused", F.coalesce("_hit", F.lit(False))).drop("_hit")


def complete(queue: DataFrame, log: DataFrame, key: list[str], position: str, ok: Column, provenance: dict[str, str]) -> DataFrame:
    """Last good row of each key whose provenance is current; a row of another model or prompt is not done."""
    current = ok
    for name, value in provenance.items():
        current = current & F.coalesce(F.col(name) == value, F.lit(False))
    return queue.join(then_latest(log, key, position, current), key, "left_semi")


def exact_cover(df: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the wanted keys; a wanted key without a row is an error."""
    missing = wanted.select(*key).distinct().join(df, key, "left_anti").limit(10).collect()
    if missing:
        raise ValueError(f"keys without rows: {[tuple(r) for r in missing]}")
    return df.join(wanted.select(*key).distinct(), key, "left_semi")


def one_to_one(a: DataFrame, b: DataFrame, key: list[str], position: str) -> DataFrame:
    """Inner join with the latest row of each key in ``b``; both have to hold the same keys."""
    newest = then_latest(b, key, position, F.lit(True))
    odd = a.select(*key).join(newest.select(*key, F.lit(1).alias("_b")), key, "full_outer")
    lone = odd.where("_b is null").count() + newest.join(a, key, "left_anti").count()
    if lone:
        raise ValueError(f"{lone} keys are on one side only")
    return a.join(newest, key)


def preserved(rows: DataFrame, candidates: DataFrame, tasks: tuple[str, ...]) -> DataFrame:
    """Replace the box of found rows by the candidate of the same role, key and query.

    Rows: task, query_role, base_sample_id, pair_id, query, pred_found, pred_bbox_xyxy.
    Candidates: role, key, query, box. Rejected rows and rows of other tasks stay; adds
    ``replacement`` (replaced, no_candidate or null) and ``query_mismatch``.
    """
    key = F.when(F.col("query_role") == "positive", F.col("base_sample_id")).otherwise(F.col("pair_id"))
    role = F.when(F.col("query_role") == "positive", "positive").otherwise("negative")
    side = candidates.select(F.col("role").alias("_role"), F.col("key").alias("_key"), F.col("query").alias("_query"), F.col("box").alias("_box"))
    found = F.col("task").isin(list(tasks)) & F.coalesce(F.col("pred_found"), F.lit(False))
    out = rows.withColumns({"_role": role, "_key": F.when(found, key.cast("string")), "_may": found}).join(side, ["_role", "_key"], "left")
    hit = F.col("_may") & F.col("_box").isNotNull()
    out = out.withColumns(
        {
            "pred_bbox_xyxy": F.when(hit, F.col("_box")).otherwise(F.col("pred_bbox_xyxy")),
            "replacement": F.when(hit, "replaced").when(F.col("_may"), "no_candidate"),
            "query_mismatch": hit & (F.coalesce("query", F.lit("")) != F.coalesce("_query", F.lit(""))),
        }
    )
    return out.drop("_role", "_key", "_may", "_query", "_box")


def vote_score(status: Column, choice: Column, first_is_challenger: Column) -> Column:
    """1 where the vote picks the challenger, 0 where it does not or is unsure, null without a good answer."""
    challenger = F.when(choice == "a", first_is_challenger).when(choice == "b", ~first_is_challenger).otherwise(F.lit(False))
    return F.when(status == "ok", challenger.cast("double"))


def evidence_logit(support: list[Column], weights: list[float], contradiction: Column, penalty: float) -> Column:
    return sum((s * w for s, w in zip(support, weights)), F.lit(0.0)) - contradiction * penalty


def null_logit(difficulty: Column, contradiction: Column, bias: float, by_difficulty: float, by_contradiction: float) -> Column:
    return bias + by_difficulty * difficulty + by_contradiction * contradiction


def protected_ids(frames: list[DataFrame], columns: tuple[str, ...], read) -> DataFrame:
    """Distinct ids from the first filled of ``columns`` of each frame; only those columns are scanned."""
    out = None
    for df in frames:
        have = [c for c in columns if c in df.columns]
        ids = df.select(read(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in have])).alias("id")).where("id is not null")
        out = ids if out is None else out.union(ids)
    return out.distinct()


def valid_benchmark(df: DataFrame, image: tuple[str, ...], box: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows with an image and a box, counts of those dropped by reason); the first filled alias counts."""
    first_of = lambda names: F.coalesce(*[F.col(n) for n in names if n in df.columns])
    out = df.withColumns({"_image": F.nullif(first_of(image).cast("string"), F.lit("")), "_box": first_of(box)})
    reason = F.when(F.col("_image").isNull(), "missing_image").when(F.col("_box").isNull(), "missing_box")
    out = out.withColumn("_reason", reason)
    return out.where("_reason is null").drop("_reason"), out.where("_reason is not null").groupBy("_reason").count()


def first_rows(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return first(df, key, order)
