"""Text functions of the grounding records, as native columns."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*columns: str) -> Column:
    """First alias that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def normalised(text: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def image_number(name: Column) -> Column:
    """An all-digit name, or the only run of twelve digits, as a number."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")
    runs = F.regexp_extract_all(base, F.lit(r"(?<!\d)(\d{12})(?!\d)"), F.lit(1))
    return F.when(base.rlike(r"^\d+$"), base.try_cast("bigint")).when(F.size(runs) == 1, F.get(runs, F.lit(0)).try_cast("bigint"))


def without_suffix(name: Column, *suffixes: str) -> Column:
    """``a__b`` gives ``a``; named suffixes are cut from the end."""
    base = F.split_part(name, F.lit("__"), F.lit(1))
    return F.regexp_replace(base, f"({'|'.join(suffixes)})$", "") if suffixes else base


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


#: Words without meaning for caption scoring, and words counted as another.
STOP_WORDS = (
    "a", "an", "the", "this", "that", "these", "those", "is", "are", "was", "were", "in", "on", "at", "of", "to", "with", "and", "or", "for", "from",
    "by", "as", "it", "its", "there", "here", "image", "picture", "photo", "scene", "shows", "showing", "visible", "contains", "containing", "red",
    "box", "bounding",
)
SYNONYMS = {
    "man": "person", "woman": "person", "boy": "person", "girl": "person", "people": "person", "men": "person", "women": "person", "child": "person", "children": "person",
    "couch": "sofa", "bike": "bicycle", "motorbike": "motorcycle", "cellphone": "phone", "mobile": "phone", "tv": "television",
}


def _synonym(word: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in SYNONYMS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, word), word)


def tokens(text: Column, stop: tuple = STOP_WORDS) -> Column:
    """Words of two letters or more without stop words; a plural s goes from longer ones, then synonyms."""
    words = F.filter(F.split(F.lower(canonical(text)), r"[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(list(stop) or [""]))
    return F.transform(words, lambda w: _synonym(F.when((F.length(w) > 3) & w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)))


def phrase_tokens(text: Column, plain: bool = False) -> Column:
    """All words but articles, with synonyms; ``plain`` texts have their canonical form already."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit("")) if plain else canonical(text)), r"[^a-z0-9]+"), lambda w: ~w.isin("", "a", "an", "the"))
    return F.transform(words, _synonym)


def caption_scores(predicted: Column, reference: Column, positive: Column, negative: Column) -> Column:
    """struct<cosine, penalised, positive_cover, negative_overlap> of a caption."""
    p = tokens(predicted)
    share = lambda of: F.size(F.array_intersect(p, of)) / F.greatest(F.lit(1), F.size(F.array_distinct(of)))
    cosine, bad = bag_cosine(p, tokens(reference)), share(tokens(negative))
    return F.struct(cosine.alias("cosine"), F.greatest(F.lit(0.0), cosine * (1 - 0.5 * bad)).alias("penalised"), share(tokens(positive)).alias("positive_cover"), bad.alias("negative_overlap"))


def stated_units(caption: Column, units: Column, default_kind: Column, head: Column) -> Column:
    """The false claims that a caption states.

    ``units``: array<struct<type, object, attribute, subject, relation, target_object>>.
    An object is stated by its words; an attribute needs the object (else ``head``) too
    if there is one; a relation needs its three parts.
    """
    # a Python function cannot stand in a lambda; annotations are written in plain letters
    has = lambda said, phrase: holds_phrase(said, phrase_tokens(phrase, plain=True))
    filled = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])

    def match(said: Column, u: Column) -> Column:
        kind, owner = F.coalesce(filled(u["type"], default_kind), F.lit("")), filled(u["object"], head)
        return (
            F.when(kind.isin("object", "co_occurrence"), has(said, u["object"]))
            .when(kind == "attribute", has(said, u["attribute"]) & (owner.isNull() | has(said, owner)))
            .when(kind == "relation", has(said, u["subject"]) & has(said, u["relation"]) & has(said, u["target_object"]))
            .otherwise(F.lit(False))
        )

    every = F.coalesce(units, F.array().cast("array<struct<type:string,object:string,attribute:string,subject:string,relation:string,target_object:string>>"))
    return F.transform(F.array(phrase_tokens(caption)), lambda said: F.filter(every, lambda u: match(said, u)))[0]


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of two bags of words; an empty bag gives 0.

    Sorted bags are cut into runs of one word, so words are counted once each and looked up
    in a map: no word of one bag is compared with all of the other.
    """
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.array().cast("array<struct<w:string,n:int>>").alias("out"))

    def step(s, w):
        run = F.struct(s["w"].alias("w"), s["n"].alias("n"))
        ended = F.when(s["n"] > 0, F.concat(s["out"], F.array(run))).otherwise(s["out"])
        return F.when(s["w"] == w, F.struct(w.alias("w"), (s["n"] + 1).alias("n"), s["out"].alias("out"))).otherwise(F.struct(w.alias("w"), F.lit(1).alias("n"), ended.alias("out")))

    last = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct(s["w"].alias("w"), s["n"].alias("n"))))).otherwise(s["out"])
    counts = lambda bag: F.map_from_entries(F.aggregate(F.array_sort(bag), start, step, last))
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda t, n: t + n * n)

    def cosine(m):
        dot = F.aggregate(F.map_entries(m["a"]), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.try_element_at(m["b"], e["key"]), F.lit(0)))
        return F.coalesce(F.try_divide(dot, F.sqrt(square(m["a"])) * F.sqrt(square(m["b"]))), F.lit(0.0))

    return F.transform(F.array(F.struct(counts(a).alias("a"), counts(b).alias("b"))), cosine)[0]


def holds_phrase(text_tokens: Column, phrase_tokens: Column) -> Column:
    return (F.size(phrase_tokens) > 0) & (F.size(F.array_except(phrase_tokens, text_tokens)) == 0)


def answer_content(text: Column) -> Column:
    """Inside the answer tag, else the whole text."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?is)<answer>(.*?)</answer>", 1)), F.lit("")), F.trim(text))


def yes_no_answer(text: Column) -> Column:
    """struct<exists, valid, method>: not found, yes or no in front, a lone yes or no, other words; else an invalid no."""
    low = normalised(answer_content(canonical(text)))
    lead = F.regexp_extract(low, r"^[\s\"']*(yes|no)\b", 1)
    said = F.regexp_extract_all(low, F.lit(r"\b(yes|no)\b"), F.lit(1))
    row = lambda exists, valid, method: F.struct(exists.alias("exists"), F.lit(valid).alias("valid"), F.lit(method).alias("method"))
    return (
        F.when(F.contains(low, F.lit("not found")), row(F.lit(False), True, "not_found"))
        .when(lead != "", row(lead == "yes", True, "prefix"))
        .when(F.size(said) == 1, row(F.get(said, F.lit(0)) == "yes", True, "single_token"))
        .when(low.isin("true", "found", "exists", "present"), row(F.lit(True), True, "alias_yes"))
        .when(low.isin("false", "none", "absent", "null"), row(F.lit(False), True, "alias_no"))
        .otherwise(row(F.lit(False), False, "parse_fail_default_no"))
    )


def yes_no(text: Column) -> Column:
    """true, false, or null where the answer is neither."""
    a = yes_no_answer(text)
    return F.when(a["valid"], a["exists"])


NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def four_numbers(text: Column) -> Column:
    """The first bracketed list of four numbers, else the first four numbers, else null."""
    listed = F.regexp_extract(text, rf"\[\s*((?:{NUMBER}\s*,\s*){{3}}{NUMBER})\s*\]", 1)
    every = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    parts = F.when(listed != "", F.split(listed, r"\s*,\s*")).when(F.size(every) >= 4, F.slice(every, 1, 4))
    return F.transform(parts, lambda v: v.cast("double"))


def canonical(text: Column) -> Column:
    """NFKC, plain quotes and dashes, single spaces; null gives an empty text."""
    plain = {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-", 0xA0: " "}

    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda t: "" if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(plain).split()))

    return F.pandas_udf(texts, "string")(text)


def bounded(text: Column, most: int = 4000) -> Column:
    """Trimmed text, empty for null; null where it is longer than ``most``."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= most, t)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def first_long_number(name: Column) -> Column:
    """The first twelve digits in a row, whatever is beside them."""
    return F.nullif(F.regexp_extract(name, r"(\d{12})", 1), F.lit("")).try_cast("bigint")


def compact_items(items: Column, fields: list[str]) -> Column:
    """JSON of an array of structs with the named fields only; null ones are left out."""
    return F.to_json(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])))
