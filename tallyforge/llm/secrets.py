"""Secret scans: base patterns and a sliding-window entropy scan, in SQL functions only.

Spark has no function for match positions. ``split`` and ``regexp_extract_all``
with one pattern see the same leftmost non-overlapping matches, so the running sum
of the lengths of pieces and matches gives them. Texts without a match skip that.

Entropy scan. Candidates are runs of 20 or more token characters that hold a letter
and a digit. A window of ``WINDOW`` characters slides over each; the count of each
character and the sum of ``c * log2(c)`` are carried from window to window, changed
by the character that enters and the one that leaves. The limit is that of the
characters inside the window: windows within a run of hexadecimal digits have a lower
one, whatever label stands before the run. Base spans are blanked first, so what is left
of a longer token around them is a candidate too. A candidate is reported where a window
reaches its limit and no allow-list pattern holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A failing match of these is a whole run and cannot hide another, so the length is asked for here.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Characters that a candidate may hold; the first 16 are the hexadecimal class.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_RUN = r"[0-9a-fA-F]{20,}"
#: Bits a character in the window, for each class.
LIMITS = {"hex": 3.0, "mixed": 3.6}
#: What looks random and is no secret.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^sha(1|256|384|512)[-_=]",  # integrity digests
    r"^(.)\1+$",
    r"^[0-9_=+/-]+$",  # numbers, dates and rules
)
#: Words of values that are no secret; a label before ``=`` may hold them.
ALLOWED_WORDS = r"(?i)example|sample|dummy|placeholder|changeme"
LABEL = r"^[A-Za-z0-9_=-]*=(?=[^=])"
#: The shape of a path, and the changes of character class that are rare in its words
#: (at most one in ``PATH_CHARS`` characters) and frequent in random base64.
PATH, PATH_CHARS = r"^/|/.*/.*/", 12
ODD = r"[0-9][A-Za-z]|[a-z][A-Z](?![a-z])|[A-Z][a-z][A-Z]"


#: Matches that are summed in one go.
RUN = 256
SPANS = "array<struct<s:int,e:int,m:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>>: code point start, end (exclusive) and text of each match.

    Running sums are made in runs of ``RUN`` matches, then over the runs, as every step of
    an aggregate copies what it has so far.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state, pair):
        s = state["at"] + F.length(pair["p"])
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m")))).alias("out"))

    def runs(pairs):
        return F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(RUN)), lambda i: F.aggregate(F.slice(pairs, i + 1, RUN), start, step))

    def joined(parts):
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda ends, part: F.concat(ends, F.array(F.element_at(ends, -1) + part["at"])))
        shifted = lambda part, at: F.transform(part["out"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["m"].alias("m")))
        return common.bound(ends, lambda ends: F.flatten(F.zip_with(parts, F.slice(ends, 1, F.size(parts)), shifted)))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"))
    return F.when(text.rlike(pattern), common.bound(common.bound(pairs, runs), joined)).otherwise(F.array().cast(SPANS))


def without(text: Column, pattern: str, holds=None) -> Column:
    """``text`` with blanks for the characters of the pattern's matches (those that ``holds`` accepts).

    The pieces between the matches are put together again, so no place is looked up.
    """

    def blanked(piece, found):
        blank = F.repeat(F.lit(" "), F.length(found))
        return F.concat(piece, F.when(F.coalesce(holds(found), F.lit(False)), blank).otherwise(found) if holds else blank)

    def joined(pieces):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), found, blanked), ""), F.element_at(pieces, -1))

    return F.when(text.rlike(pattern), common.bound(F.split(text, pattern, -1), joined)).otherwise(text)


def without_base(text: Column) -> Column:
    """``text`` with blanks for what the base kinds match, one kind after the other."""
    text = common.bound(text, lambda t: without(t, ASSIGN, assigned))
    text = common.bound(text, lambda t: without(t, ACCESS))
    return common.bound(text, lambda t: without(t, HEX))


def assigned(match: Column) -> Column:
    """Whether the value of a match of ``ASSIGN`` is long enough."""
    return F.length(F.regexp_extract(match, "^" + ASSIGN, 2)) >= 12


def base_spans(text: Column) -> dict[str, Column]:
    """The matches of each base kind that hold."""
    return {"assign": F.filter(matches(text, ASSIGN), lambda x: assigned(x["m"])), "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def window_entropy(word: Column) -> Column:
    """Greatest Shannon entropy (bits a character) over the windows of ``word``."""
    chars = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    weight = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

    def move(state, pair):
        enters, leaves, full = pair["i"], pair["o"], pair["n"] >= WINDOW
        counts = state["counts"]
        c_in = F.element_at(counts, enters)
        same = leaves == enters
        c_out = F.when(leaves > 0, F.element_at(counts, F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
        change = F.when(same, F.lit(0.0)).otherwise(weight(c_in + 1) - weight(c_in) + F.when(leaves > 0, weight(c_out - 1) - weight(c_out)).otherwise(F.lit(0.0)))
        total = state["sum"] + change
        moved = F.transform(counts, lambda c, k: c + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int"))
        return F.struct(moved.alias("counts"), total.alias("sum"), F.when(full, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

    pairs = F.transform(chars, lambda c, k: F.struct(c.alias("i"), k.alias("k")))
    pairs = F.zip_with(pairs, F.concat(F.array_repeat(F.lit(0), WINDOW), chars), lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(b, F.lit(0)).alias("o"), (a["k"] + 1).alias("n")))
    pairs = F.slice(pairs, 1, F.length(word))
    return F.aggregate(pairs, start, move, lambda s: F.lit(math.log2(WINDOW)) - s["least"] / WINDOW)


def harmless(word: Column) -> Column:
    """Whether an allow-list rule holds: for the whole ``word``, or for the value behind its label."""
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | word.rlike(pattern)
    value = F.regexp_replace(word, LABEL, "")
    path = value.rlike(PATH) & (F.size(F.regexp_extract_all(value, F.lit(ODD), F.lit(0))) * PATH_CHARS <= F.length(value))
    return out | value.rlike(ALLOWED_WORDS) | path


def entropy_spans(text: Column) -> Column:
    """Candidates with a window that reaches its class's limit, where the base kinds match nothing."""
    both = lambda word: word.rlike("[0-9]") & word.rlike("[A-Za-z]")

    def hex_run(word):
        return F.exists(F.regexp_extract_all(word, F.lit(HEX_RUN), F.lit(0)), lambda r: F.when(both(r), window_entropy(r) >= LIMITS["hex"]).otherwise(F.lit(False)))

    def holds(x):
        word = x["m"]
        return F.when(both(word) & ~harmless(word), hex_run(word) | (window_entropy(word) >= LIMITS["mixed"])).otherwise(F.lit(False))

    left = F.when(text.rlike(CANDIDATE), without_base(text)).otherwise(F.lit(""))
    return F.filter(common.bound(left, lambda t: matches(t, CANDIDATE)), holds)


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with array column ``name``: the spans (s, k, e) of each text.

    Any other columns pass through; empty and null texts have no spans. Spans of one start
    tie and are in the order of ``KINDS``. Repeated rows are searched each, very long texts
    whole, and an empty table gives an empty one. Where ``docs`` has a column ``name``, the
    new one gets underscores.
    """
    name = common.free_name(docs, name)
    whole = F.coalesce(F.col(text), F.lit(""))
    base, spare = common.free_name(docs, "base_spans"), common.free_name(docs, "extra_spans")
    tag = lambda spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    found = docs.withColumn(base, F.sort_array(F.concat(*[tag(spans, k) for k, spans in enumerate(base_spans(whole).values())])))
    found = found.withColumn(spare, tag(entropy_spans(whole), len(KINDS) - 1))
    return found.withColumn(name, F.sort_array(F.concat(base, spare))).drop(base, spare)


def written(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"], x["e"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each whole text of ``documents``; null and empty ones have none, see ``find_secrets``."""
    found = find_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("secrets", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(written(F.filter("secrets", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )
