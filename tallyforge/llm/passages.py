"""Substring dedup: passages of 50 words that an earlier document has lose their words.

Every window of 50 words holds 26 phrases of 25 words. The one of least hash is the window's
phrase; equal windows have equal phrases, and neighbours mostly share theirs, so a text has
one for every thirteen words. A phrase that occurs in two documents is a recurring one, and
the least of its documents is its owner. A window whose phrase does not recur does not recur.

1. Each document gives its windows' phrases, a shuffle confirms those that recur, and a join
   tells each document the owners of its own.
2. Documents cut out the stretches of their windows by owner. The stretches of an owner meet
   in one shard; those of an owner with many meet in several, each with a copy of the
   owner's own.
3. A shard compiles the blocks of 25 words of its owners' stretches into an Aho-Corasick
   automaton of word hashes and streams all other stretches through it. A window that holds
   an occurrence, and that its owner has, is to go. A window of 50 words holds a whole
   block, whatever its place.
4. A window that the owner of its phrase does not have may still be in other documents.
   What is left of the windows meets by a 128-bit hash, and all but the least document's go.

What is shuffled is phrases, stretches that recur and their left windows; texts without
a recurring phrase are never moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mixed, words_of

WINDOW, PHRASE = 50, 25
#: Keys that go to every task when phrases or windows are joined with their counts (24 bytes each).
HEAD = 65_536
#: Bytes of stretches that are streamed through an owner's copy, and of all stretches of a shard.
PART_BYTES, SHARD_BYTES = 2 << 20, 6 << 20
#: Ids of documents with recurring phrases that are broadcast, so that other texts stay where they are.
FEW = 4_000_000
NO_ID = -(2**63)
_Q = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)
STRETCH = "owner long, doc long, h long, start int, words string"
FOUND = "w long, v long, doc long, h long, start int, end int"


def grams(hashes: np.ndarray, k: int, q: int = _Q[0]) -> np.ndarray:
    """A hash of each ``k`` words in a row, by differences of a running polynomial."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    one = np.ones(1, np.uint64)
    powers, back = (np.cumprod(np.concatenate([one, np.full(n, x, np.uint64)])) for x in (q, pow(q, -1, 2**64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])])
    return mixed((sums[k:] - sums[:-k]) * back[: n - k + 1])


def phrases(hashes: np.ndarray) -> np.ndarray:
    """The least hash of the 26 phrases of each window."""
    least = grams(hashes, PHRASE)
    width, wanted = 1, WINDOW - PHRASE + 1
    while width < wanted and len(least):
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc, h, text): a row (a, doc, h) for each phrase of a document's windows, some twice."""
    for batch in batches:
        at = 0
        for part in common.pieces(batch.column(2)):
            hashes, doc, *_ = words_of(common.texts(part), fold=False)
            least = phrases(hashes)
            of = doc[: len(least)]
            whole = of == doc[WINDOW - 1 :] if len(least) else of.astype(bool)
            least, of = least[whole], of[whole]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
            rows = pa.array(of[new] + at)
            yield pa.record_batch({"a": pa.array(least[new].view(np.int64)), "doc": batch.column(0).take(rows), "h": batch.column(1).take(rows)})
            at += len(part)


def stretches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc, h, text, owned): the stretches of windows whose phrases have one owner."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for k in range(batch.num_rows):
            doc, h, text, owned = (c[k].as_py() for c in batch.columns)
            raw = text.encode()
            hashes, _, starts, ends = words_of([raw], fold=False)
            phrase = np.array([x["a"] for x in owned], np.int64).view(np.uint64)
            owner = np.array([x["first"] for x in owned], np.int64)
            order = np.argsort(phrase)
            phrase, owner = phrase[order], owner[order]
            least = phrases(hashes)
            at = np.minimum(np.searchsorted(phrase, least), len(phrase) - 1)
            known = phrase[at] == least
            cuts = np.flatnonzero((known[1:] != known[:-1]) | (owner[at][1:] != owner[at][:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(least)]):
                if known[a]:
                    words = raw[starts[a] : ends[b + WINDOW - 2]]
                    out.append((int(owner[at[a]]), doc, h, a, words))
                    held += len(words)
            if held > 4 << 20:
                yield stretch_batch(out)
                out, held = [], 0
        yield stretch_batch(out)


def stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"owner": pa.int64(), "doc": pa.int64(), "h": pa.int64(), "start": pa.int32(), "words": pa.string()}
    columns = list(zip(*rows)) or [()] * 5
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def automaton(texts: list[bytes]):
    """Automaton of the blocks of word hashes of the texts; a block's end is all that it tells."""
    import ahocorasick

    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    hashes, doc, *_ = words_of(texts, fold=False)
    short = (hashes >> np.uint64(33)).tolist()
    ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
    for a, b in zip([0, *ends], ends):
        for k in range(a, b - PHRASE + 1, PHRASE):
            search.add_word(tuple(short[k : k + PHRASE]), 1)
    search.make_automaton()
    return search


def located(search, hashes: np.ndarray) -> np.ndarray:
    """Which windows of a stretch hold an occurrence of a block."""
    n = len(hashes) - WINDOW + 1
    ends = np.array([end for end, _ in search.iter(tuple((hashes >> np.uint64(33)).tolist()))], np.int64)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.maximum(ends - WINDOW + 1, 0), 1)
    np.add.at(marks, np.minimum(ends - PHRASE + 2, n), -1)
    return np.cumsum(marks[:n]) > 0


def matched(table: pa.Table) -> pa.Table:
    """Rows (pattern, owner, doc, h, start, words) of a shard: places to remove, and windows left."""
    own = table.filter(table["pattern"])
    rest = table.filter(pc.invert(table["pattern"]))
    patterns = common.texts(own["words"].combine_chunks())
    hashes, of, *_ = words_of(patterns, fold=False)
    windows, inner = grams(hashes, WINDOW), of[: max(0, len(of) - WINDOW + 1)] == of[WINDOW - 1 :]
    owner = np.array(own["doc"].to_pylist(), np.int64)[of[: len(windows)]]
    windows, owner = windows[inner], owner[inner]
    order = np.lexsort((owner, windows))  # the least owner of equal windows comes first
    windows, owner = windows[order], owner[order]
    search = automaton(patterns)
    out: list[tuple] = []
    for doc, h, start, words in zip(*(rest[c].to_pylist() for c in ("doc", "h", "start", "words"))):
        hashes = words_of([words.encode()], fold=False)[0]
        mine = grams(hashes, WINDOW)
        gone = located(search, hashes) if len(patterns) else np.zeros(len(mine), bool)
        if gone.any():
            at = np.minimum(np.searchsorted(windows, mine), len(windows) - 1)
            gone &= (windows[at] == mine) & (owner[at] < doc)
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        out += [(None, None, doc, h, start + a, start + b + WINDOW - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        left = np.flatnonzero(~gone)
        if len(left):
            v = grams(hashes, WINDOW, _Q[1])
            out += zip(mine[left].view(np.int64).tolist(), v[left].view(np.int64).tolist(), [doc] * len(left), [h] * len(left), (left + start).tolist(), (left + start + WINDOW).tolist())
    kinds = {"w": pa.int64(), "v": pa.int64(), "doc": pa.int64(), "h": pa.int64(), "start": pa.int32(), "end": pa.int32()}
    columns = list(zip(*out)) or [()] * 6
    return pa.table({name: pa.array(c, k) for (name, k), c in zip(kinds.items(), columns)})


def with_first(rows: DataFrame, keys: list[str], name: str, head: int) -> DataFrame:
    """``rows`` (keys, doc, ...) whose keys are of two documents or more, with the least, ``first``.

    The most frequent keys are joined by broadcast, so no task gets all rows of one.
    """
    counts = rows.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    counts = common.stored(counts.where(F.col("first") < F.col("last")).drop("last"), name)
    floor = common.floor_of(counts, head)
    often, rarer = counts.where(F.col("n") >= floor).drop("n"), counts.where(F.col("n") < floor).drop("n")
    out = rows.join(F.broadcast(often), keys)
    return out.union(rows.join(rarer, keys).select(out.columns)) if rarer.limit(1).count() else out


def shards(stretches: DataFrame, part_bytes: int, shard_bytes: int) -> DataFrame:
    """``stretches`` with a shard; those of their owners (``pattern``) once for each of its parts."""
    size, pattern = F.octet_length("words").cast("long"), F.col("doc") == F.col("owner")
    sizes = stretches.groupBy("owner").agg(F.sum(F.when(~pattern, size)).alias("bytes"))
    total = stretches.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = sizes.where(F.col("bytes") > part_bytes).select("owner", F.ceil(F.col("bytes") / part_bytes).alias("parts"))
    parts = common.small(common.stored(parts, "parts"), 1_000_000)
    count = F.coalesce("parts", F.lit(1))
    copies = F.when(pattern, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array(F.pmod(F.xxhash64("salt"), count)))
    dealt = stretches.join(parts, "owner", "left").select("owner", "doc", "h", "start", "words", pattern.alias("pattern"), F.explode(copies).alias("part"))
    n = max(1, math.ceil(total / shard_bytes))
    return dealt.withColumn("shard", F.pmod(F.xxhash64("owner", "part"), F.lit(n)))


def repeated(docs: DataFrame, head: int = HEAD, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(doc, h) of ``docs`` (doc, h, text) with recurring phrases, and their places (doc, h, start, end).

    ``doc`` is the id, ``h`` a hash of the text. Places count words, the end is exclusive.
    """
    found = common.stored(docs.select("doc", "h", "text").mapInArrow(phrases_of, "a long, doc long, h long"), "phrases")
    recurring = with_first(found, ["a"], "recurring", head)
    owned = common.stored(recurring.groupBy("doc", "h").agg(F.collect_set(F.struct("a", "first")).alias("owned")), "owned")
    ids = common.small(owned.select("doc", "h"), few)
    texts = docs.select("doc", "h", "text").join(ids, ["doc", "h"], "left_semi").join(owned, ["doc", "h"])
    stretches = texts.select("doc", "h", "text", "owned").mapInArrow(stretches_of, STRETCH).withColumn("salt", F.monotonically_increasing_id())
    stretches = common.stored(stretches, "stretches")
    hits = shards(stretches, part_bytes, shard_bytes).groupBy("shard").applyInArrow(matched, FOUND)
    hits = common.stored(hits, "hits")
    left = with_first(hits.where("w is not null").select("w", "v", "doc", "h", "start", "end"), ["w", "v"], "left", head)
    places = hits.where("w is null").select("doc", "h", "start", "end").union(left.where(F.col("doc") > F.col("first")).select("doc", "h", "start", "end"))
    return ids, places


MADE = "struct<n_words:bigint,n_removed:bigint,text:string,sha256:string>"


def removing(keep: bool):
    """Arrow function of (text, places): the words outside of the places."""

    @F.arrow_udf(MADE)
    def remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, places in batches:
            rows, at = [], 0
            for part in common.pieces(values):
                for raw, own in zip(common.texts(part), places.slice(at, len(part))):
                    words = raw.split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if len(own.values or ()):
                        starts, ends = (own.values.field(c).to_numpy() for c in ("start", "end"))
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, ends, -1)
                    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    text = b" ".join(words if len(kept) == len(words) else [words[k] for k in kept.tolist()])
                    rows.append((len(words), len(words) - len(kept), text.decode() if keep else None, hashlib.sha256(text).hexdigest()))
                at += len(part)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [()] * 4
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_words", "n_removed", "text", "sha256"])

    return remove


def dedup_passages(docs: DataFrame, name: str = "passages", keep: bool = True, **limits) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a struct: n_words, n_removed, text, sha256.

    ``text`` holds the words that are left, joined by single spaces (null unless ``keep``),
    and ``sha256`` is its digest. Windows are judged on the texts as they come.

    Null and empty texts have no words. Rows of one doc_id are one document, which removes
    nothing from itself, so ties and repeated rows alone lose nothing; a null id is less
    than any. Very long texts are read whole. An empty table gives an empty one. Where
    ``docs`` has a column ``name``, the new one gets underscores. ``limits``: see ``repeated``.
    """
    name = common.free_name(docs, name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*columns).alias("whole"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))
    ids, places = repeated(rows, **limits)
    places = common.stored(places.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "end")).alias("places")), "places")
    gone = common.small(places.select("doc", "h"), limits.get("few", FEW))
    kind = places.schema["places"].dataType
    made = lambda df: df.select("whole", removing(keep)(F.col("text"), F.col("places")).alias("made"))
    whole = made(rows.join(gone, ["doc", "h"], "left_anti").withColumn("places", F.array().cast(kind)))
    cut = made(rows.join(gone, ["doc", "h"], "left_semi").join(places, ["doc", "h"]))
    return whole.union(cut).select("whole.*", F.col("made").alias(name))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document before and after; null and empty texts have none, see ``dedup_passages``."""
    found = dedup_passages(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return found.select("doc_id", "passages.n_words", "passages.n_removed", F.col("passages.sha256").alias("kept_sha256"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS k
  FROM documents
), windows AS (
  SELECT doc_id, k, string_agg(word, ' ') OVER w AS passage, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), judged AS (
  SELECT doc_id, k, doc_id > min(doc_id) OVER (PARTITION BY passage) AS gone FROM windows WHERE n = 50
), marked AS (
  SELECT doc_id, k, word, coalesce(max(j.gone::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words LEFT JOIN judged j USING (doc_id, k)
), left_over AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
         string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN left_over USING (doc_id)
"""
