"""Spelling variants: words at one edit from each other, found by bands of letter parities.

The mask of a word holds, for each of 63 bits, whether the letters of that bit occur an odd
number of times. Every letter has one bit, so an edit flips two bits at most, and one of the
mask's three bands of 21 bits stays as it is. Words with an equal band and lengths that
differ by one at most meet, and Levenshtein's distance verifies them.

A band of a natural alphabet has some hundred values, so buckets of a length and a band alone
would grow with the vocabulary, and their pairs with its square. An edit also leaves one half
of a word as it was: a bucket is a length, a band and what stands outside of one of ``2``
pieces of the word. Buckets of more than ``BUCKET`` words are cut again, into pieces of half
the length, until they are small or the piece is a single letter, so that at most the letters
of the alphabet meet. No pair is lost: an edit within a piece is within one of its halves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters of a run, lower-cased from A to Z.
LETTER = "[a-z\u00C0-\u00FF]"
LENGTH, OFTEN, RATIO = 5, 3, 2
#: Of the runs of a document, those whose hash it divides lose a letter.
EVERY = 97
#: Sums a task holds before it hands them on.
TABLE = 400_000
#: Words of a bucket that meet; larger buckets are cut again.
BUCKET = 32
BANDS, BITS = 3, 21
#: Copies of a large bucket's mark, among which its words are dealt.
DEALT = 16


def altered(run: str, prefix: int, every: int) -> str:
    """The run, without one letter if ``every`` divides the hash of id and run."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counting(every: int | None, length: int):
    """Arrow function of batches (id, text): words and the sums of their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

        sums, long_runs = Counter(), re.compile(f"{LETTER}{{{length},}}")
        for batch in batches:
            at = 0
            for part in common.pieces(batch.column(1)):
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                for doc_id, text in zip(ids, common.texts(part)):
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    sums.update(runs := long_runs.findall(text.lower().decode()))
                    changed = [(run, word) for run in set(runs) if (word := altered(run, prefix, every)) is not run] if every else []
                    own = Counter(runs) if changed else {}
                    for run, word in changed:
                        sums[run] -= own[run]
                        if len(word) >= length:
                            sums[word] += own[run]
                    if len(sums) > TABLE:
                        yield out()
                        sums.clear()
        yield out()

    return count


def word_counts(docs: DataFrame, every: int | None = None, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with so many letters and occurrences.

    With ``every``, a fixed part of the runs loses a letter first (see ``altered``). Null
    and empty texts have no words, a null id is written as nothing, and the words of
    repeated rows count each time.
    """
    words = docs.select(F.col("doc_id"), F.col("text")).mapInArrow(counting(every, length), "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.col("n") >= often) & (F.char_length("word") >= length))


def letter_mask(word: Column) -> Column:
    """Parities of the letters; a-z and U+00C0 to U+00FF are spread over the bands in turn."""

    def bit(letter: Column) -> Column:
        i = F.when(letter < 123, letter - 97).otherwise(letter - 0xC0 + 26)
        i = F.pmod(i, F.lit(BANDS * BITS))
        return (BITS * (i % BANDS) + F.floor(i / BANDS)).cast("int")

    flip = lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.ascii(c))))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), flip)


def bucket(level: Column, piece: Column) -> Column:
    """Hash of a band, a length and the letters of ``word`` outside of a piece.

    Boundaries are those of a word of the bucket's length ``m``; a longer word (by one)
    has its extra letter in the piece. Equal hashes of other buckets cost a comparison.
    """
    pieces = F.call_function("shiftleft", F.lit(1), level)
    low, high = (F.floor(F.col("m") * p / pieces).cast("int") for p in (piece, piece + 1))
    head, tail = F.substring(F.col("word"), F.lit(1), low), F.substring(F.col("word"), F.col("len") - F.col("m") + high + 1, F.col("m") - high)
    value = F.call_function("shiftright", F.col("mask"), F.col("band") * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.xxhash64("m", "band", value, level, piece, head, tail)


def met(rows: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) at one edit of words in equal buckets, ``a`` not the longer."""
    a, b = (rows.where("m = len") if s == "a" else rows for s in "ab")
    a, b = (df.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("word", "n", "len", "mask")]) for df, s in ((a, "a"), (b, "b")))
    first = (F.col("len_a") < F.col("len_b")) | (F.col("len_a") == F.col("len_b")) & (F.col("word_a") < F.col("word_b"))
    near = (F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2) & (F.levenshtein("word_a", "word_b", 1) == 1)
    return a.join(b, "bucket").where(first & near).select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b"))


def near_words(words: DataFrame, most: int = BUCKET) -> DataFrame:
    """Stored pairs (word, n, other, n_other) of ``words`` (word, n) at one edit, both ways.

    Words are distinct and of the letters a-z and U+00C0 to U+00FF.
    """
    spread = words.select("word", "n", F.char_length("word").alias("len"), letter_mask(F.col("word")).alias("mask"))
    spread = spread.withColumn("m", F.explode(F.array(F.col("len"), F.col("len") - 1)))
    spread = spread.withColumn("band", F.explode(F.array(*map(F.lit, range(BANDS)))))
    rows = spread.select("*", F.lit(1).alias("level"), F.explode(F.array(F.lit(0), F.lit(1))).alias("piece"))
    rows, found = rows.withColumn("bucket", bucket(F.col("level"), F.col("piece"))), []
    while True:
        rows = common.stored(rows, "buckets")
        # a piece of one letter is not cut again
        whole = F.col("m") <= F.call_function("shiftleft", F.lit(1), F.col("level"))
        sizes = rows.where(~whole).groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most)
        large = common.stored(sizes.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal")), "large")
        if not large.limit(1).count():
            found.append(common.stored(met(rows), "near"))
            break
        marks = common.small(large, 1_000_000).withColumn("large", F.lit(True))
        marked = rows.withColumn("deal", F.pmod(F.xxhash64("word"), F.lit(DEALT)).cast("int")).join(marks, ["bucket", "deal"], "left").drop("deal")
        again = F.coalesce("large", F.lit(False)) & ~whole
        found.append(common.stored(met(marked.where(~again).drop("large")), "near"))
        cut = marked.where(again).drop("bucket", "large").withColumn("level", F.col("level") + 1)
        cut = cut.withColumn("piece", F.explode(F.array(F.col("piece") * 2, F.col("piece") * 2 + 1)))
        rows = cut.withColumn("bucket", bucket(F.col("level"), F.col("piece"))).select(rows.columns)
    pairs = reduce(DataFrame.union, found)
    pairs = pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"n_{a}").alias("n"), F.col(b).alias("other"), F.col(f"n_{b}").alias("n_other"))
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each chain, by doubled steps.

    A form has more occurrences than its word, so chains end.
    """
    now = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(step, "root", "left")
        after = common.stored(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with ``n_near``, ``form``, ``form_n`` and ``root``.

    A word's form is its near word of largest n, of ties the least in code-point order, if
    that n is at least ``ratio`` times the word's (more than one, else ties would form
    rings); else null. An empty table gives an empty one.
    """
    best = F.min(F.struct((-F.col("n_other")).alias("least"), "other"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("own"))
    fits = -F.col("best.least") >= ratio * F.col("own")
    near = near.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.least")).alias("form_n"))
    near = common.stored(near, "forms")
    ends = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, a part of their runs with a letter lost, and their forms.

    Null and empty texts have no words, very long ones are read whole, repeated rows count
    each time, and an empty table gives an empty result. Ties: see ``variants``.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(common.stored(word_counts(docs, EVERY), "words"))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps FROM range(256) r(n)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), own AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || [('0x' || bytes[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(length(bytes) // 2)],
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM own, crc
), counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
), words AS (
  SELECT word, n FROM counted WHERE length(word) >= 5 AND n >= 3
), less AS (
  SELECT word, n, k, left(word, k::INT) || substr(word, k::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)
), pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS n_other FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON b.word = a.rest
), near AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, max(n_other) AS top FROM pairs GROUP BY word
), forms AS (
  SELECT p.word, min(p.other) AS form, max(p.n_other) AS form_n FROM pairs p JOIN near t ON t.word = p.word AND p.n_other = t.top WHERE t.top >= 2 * t.n GROUP BY p.word
), chains AS (
  SELECT word, form AS root, 1 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chains c JOIN forms f ON f.word = c.root
), ends AS (
  SELECT word, arg_max(root, depth) AS root FROM chains GROUP BY word
)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(t.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN near t USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""
