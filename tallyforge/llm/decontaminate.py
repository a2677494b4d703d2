"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a document with at most ``k`` edits leaves at least one of
its ``k + 1`` pieces unchanged. All pieces of a block of items are searched in one pass
over a text (Aho-Corasick); each hit fixes where the item would lie, and Myers'
bit-parallel algorithm finds its least edit distance there.

Texts and items are compared in lower case with white space as single spaces. The
budget is one edit for every ``1 / RATE`` characters of an item. An item stands between
two word edges: any character but a letter or digit, or an end of the text. An edge that
is not there costs one edit, so "cat" is not found in "concatenate".

Benchmarks of more than ``BLOCK_BYTES`` are searched in blocks. Each block is a job of
its own that reads the texts and writes its hits; only its items are held, by the driver
and by the tasks, and they are given up before the next block is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 0.05
#: Characters of a plain item that is searched. Items of fewer than 20 have no edit to
#: spare: they are found as they are, between word edges.
SHORTEST = 1
#: Bytes of items that one pass holds in each task; more items take more passes.
BLOCK_BYTES = 8 << 20
HITS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def plain(text: str) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return int(len(item) * RATE)


def cut(item: str) -> list[tuple[int, str]]:
    """Start and text of the ``budget + 1`` pieces, whose lengths differ by one at most."""
    n = budget(item) + 1
    at = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def masks_of(item: str) -> tuple[dict[str, int], int]:
    """Bits of each character's places in the item between two edges, and the bits of the edges."""
    masks: dict[str, int] = {}
    for k, c in enumerate(item, 1):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks, 1 | 1 << len(item) + 1


def myers(masks: dict[str, int], edges: int, m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of ``text``, and its first end."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        if not c.isalnum():
            eq |= edges
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a match may start anywhere
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Searches a block of items (id, text)."""

    def __init__(self, items: list[tuple[int | None, str]], shortest: int = SHORTEST):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, plain(t)) for i, t in items) if len(t) >= max(1, shortest)]
        self.masks = [masks_of(item) for _, item in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(self.items):
            for at, piece in cut(item):
                pieces.setdefault(piece, []).append((n, at))
        self.search = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.search.add_word(piece, (len(piece), places))
        self.search.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, start, end) of the best place of each item within its budget.

        Places are code points of the plain text; of equal ones the first counts.
        """
        if not self.items:
            return []
        text = plain(text)
        spots: dict[int, set[int]] = {}
        for last, (length, places) in self.search.iter(text):
            for n, at in places:
                spots.setdefault(n, set()).add(last + 1 - length - at)
        out = []
        padded = f" {text} "  # place s of the text is s + 1 here, its edge s
        for n, starts in spots.items():
            item_id, item = self.items[n]
            (masks, edges), k, m = self.masks[n], budget(item), len(item) + 2
            best, seen = None, None
            for s in sorted(starts):
                if seen is not None and s <= seen:  # lies in the window looked at last
                    continue
                low, high = max(0, s - 2 * k), min(len(padded), s + m + 3 * k)
                seen = s + k
                if s >= 0 and text.startswith(item, s) and not padded[s].isalnum() and not padded[s + m - 1].isalnum():
                    best = (0, s, s + len(item))
                    break
                distance, end = myers(masks, edges, m, padded[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low, low + end)
            if best and best[0]:
                # the same search from the end backwards finds the start
                distance, low, end = best
                back, length = masks_of(item[::-1])[0], padded[low:end][::-1]
                start = end - myers(back, edges, m, length)[1]
                # what stands there is the edge, or the item where the edge is missing
                start, end = start - padded[start].isalnum(), end - 1 - (not padded[end - 1].isalnum())
                best = (distance, start, end)
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda h: (h[0] is not None, h))


def finder(items: list[tuple[int | None, str]], shortest: int):
    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items, shortest)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("item_id", "distance", "start", "end"), h)) for h in matcher.find(x or "")] for x in batch.to_pylist()]
            yield pa.array(found, kind)

    return hits


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (text, ...) with the array of items found in each whole text, by id, null first.

    Null and empty texts, and null items, match nothing, nor do items of fewer than
    ``shortest`` plain characters. Items without an id are searched and reported with a
    null id; items of one id are searched separately. Repeated documents are separate
    rows, each with its hits; very long texts and items are searched whole (an item longer
    than a block is a block). An empty table of either kind gives no hits. Where ``docs``
    has a column ``name``, the new one gets underscores.
    """
    name = common.free_name(docs, name)
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks, text = max(1, -(-size // block_bytes)), F.coalesce("text", F.lit(""))

    def block(b: int):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return finder(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is not None, r)), shortest)

    if blocks == 1:
        return docs.withColumn(name, block(0)(text))
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    numbered = common.stored(doc.select(F.monotonically_increasing_id().alias("row"), "doc"), "numbered")
    found = []
    for b in range(blocks):
        hits = numbered.select("row", block(b)(F.coalesce("doc.text", F.lit(""))).alias("hits")).where(F.size("hits") > 0)
        found.append(common.stored(hits, "hits"))
    merged = reduce(DataFrame.union, found).groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    out = numbered.join(merged, "row", "left").select("doc.*", F.coalesce("hits", F.array().cast(HITS)).alias(name))
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item found in it; clean documents have none.

    Null and empty texts have no row, repeated rows have theirs each, very long texts are
    searched whole, and an empty table gives an empty result; see ``with_hits``.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("h"))
    return found.select("doc_id", "h.item_id", "h.distance", F.col("h.end").alias("end_at"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold an item go."""
    name = common.free_name(docs, "hits")
    return with_hits(docs, common.table(spark, sf_dir, "benchmark"), name).where(F.size(name) == 0).drop(name)
