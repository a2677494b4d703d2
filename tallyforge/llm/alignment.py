"""Alignment of two tokenizers by the byte offsets at which tokens of both end.

The ends of each tokenizer's tokens are bits of a packed set. Their AND holds the shared
cuts, and the popcount rank of a cut in either set is the number of tokens up to it. Cuts
so become token ranges, the groups; the two tokens that end at a cut are linked.

No token of either tokenizer reaches from a character into white space that follows it, so a
text is cut there into chunks that are encoded on their own. A task keeps the chunks that
it has seen, and aligns all new ones of a part of its rows at once.

1. Each row gets its numbers, the digest of its groups and its distinct links with their
   frequencies. This table is stored.
2. A shuffle sums the links of the corpus; each link is compared with the most frequent one
   of its second token (as many rows as that vocabulary has).
3. The counts of the most frequent links, at most ``HEAD``, go to every task, the others
   join by shuffle, and both are summed by row.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links whose counts every task holds (two numbers each, so 6 MB and their hash table).
HEAD = 262_144
#: Chunks that a task remembers, the bytes of their groups, and the characters of the longest of them.
SEEN, SEEN_BYTES, LONG = 300_000, 64 << 20, 64
#: White space and what follows it; only white space that starts with a space or line feed begins a chunk.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
PARTS = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,sha256:string,groups:string,links:array<struct<link:bigint,n:bigint>>>"


class ByteLevel:
    """Ids of a byte-level vocabulary; each character of its tokens stands for a byte."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.tokens = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            self.tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch(chunks, add_special_tokens=False)]


class Pieces:
    """Ids of a sentencepiece vocabulary with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece of this model reaches over a space mark or line feed")
        self.tokens = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """A leading line feed keeps the model's own space mark apart: two pieces more."""
        return [ids[2:] for ids in self.model.encode(["\n" + c for c in chunks], num_threads=1)]


def load(name: str):
    import public_tokenizers

    path = public_tokenizers.path(name)
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class Bits:
    """A packed set of places with popcount ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros(-(-n // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many members are at each place or before it."""
        word, upto = places >> 6, np.uint64(2**64 - 1) >> (np.uint64(63) - (places & 63).astype(np.uint64))
        return self.before[word] + np.bitwise_count(self.words[word] & upto)


def shared_cuts(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets at which tokens of both sides end, and how many tokens of each are before them."""
    n = int(sizes_a.sum())
    a, b = (Bits.of(np.cumsum(s) - 1, n) for s in (sizes_a, sizes_b))
    at = (a & b).places()
    return at + 1, a.rank(at), b.rank(at)


class Aligner:
    """Aligns texts of two tokenizers and remembers their chunks."""

    def __init__(self, first, second):
        self.sides = first, second
        self.sizes = [np.array([len(t) for t in side.tokens], np.int64) for side in self.sides]
        self.width = len(second.tokens)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.held = 0
        self.counts, self.links = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)]

    def learn(self, chunks: list[str]) -> None:
        """Aligns chunks that are not known yet, all at once."""
        if not chunks:
            return
        ids = [side.encode(chunks) for side in self.sides]
        same = np.array([all(b"".join([side.tokens[i] for i in own]) == raw for side, own in zip(self.sides, pair)) for raw, *pair in zip((c.encode() for c in chunks), *ids)])
        good = np.flatnonzero(same)
        flat = [np.array([i for k in good for i in own[k]], np.int64) for own in ids]
        upto = [np.cumsum([0, *(len(own[k]) for k in good)]) for own in ids]
        cuts, ranks_a, ranks_b = shared_cuts(*(s[f] for s, f in zip(self.sizes, flat))) if len(good) else [np.zeros(0, np.int64)] * 3
        linked = flat[0][ranks_a - 1] * self.width + flat[1][ranks_b - 1]
        a, b = ([str(i) for i in f.tolist()] for f in flat)
        x, y = ([0, *r.tolist()] for r in (ranks_a, ranks_b))
        shown = [",".join(a[p:q]) + "|" + ",".join(b[r:s]) for p, q, r, s in zip(x, x[1:], y, y[1:])]
        ends = [0, *np.searchsorted(ranks_a, upto[0][1:], "right").tolist()]  # a chunk's end is a cut
        counts, at = np.zeros((len(chunks), 4), np.int64), len(self.shown)
        counts[good] = np.stack([np.diff(upto[0]), np.diff(upto[1]), np.diff(ends), np.ones(len(good), np.int64)], 1)
        texts = [b""] * len(chunks)
        for k, p, q in zip(good.tolist(), ends, ends[1:]):
            texts[k] = ";".join(shown[p:q]).encode()
        self.number.update(zip(chunks, range(at, at + len(chunks))))
        self.shown += texts
        self.held += sum(map(len, texts))
        self.counts.append(counts)
        self.links.append(linked)

    def align(self, texts: list[str], keep: bool = False) -> list[tuple]:
        """(n_a, n_b, n_groups, digest, groups, links, frequencies) of each text.

        Empty texts, and those that either tokenizer does not give back, have no tokens.
        """
        chunks = [CHUNK.findall(" " + t) if t else [] for t in texts]
        if len(self.shown) > SEEN or self.held > SEEN_BYTES:
            self.forget()
        self.learn(list(dict.fromkeys(c for own in chunks for c in own if c not in self.number)))
        self.counts, self.links = [np.concatenate(self.counts)], [np.concatenate(self.links)]
        counts, links = self.counts[0], self.links[0]
        starts = np.cumsum(counts[:, 2]) - counts[:, 2]
        out = []
        for own in chunks:
            numbers = [self.number[c] for c in own]
            at = np.array(numbers, np.int64)
            sums = counts[at].sum(axis=0)
            if not numbers or sums[3] < len(numbers):
                out.append((0, 0, 0, "", "", [], []))
                continue
            groups = b";".join([self.shown[k] for k in numbers])
            kinds, times = np.unique(at, return_counts=True)
            n = counts[kinds, 2]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[kinds], n)
            link, which = np.unique(links[place], return_inverse=True)
            often = np.bincount(which, np.repeat(times, n), len(link)).astype(np.int64)
            out.append((*sums[:3].tolist(), hashlib.sha256(groups).hexdigest(), groups.decode() if keep else None, link, often))
        for c in [c for c in self.number if len(c) > LONG]:
            del self.number[c]  # its place in the arrays stays until all are forgotten
        return out


def aligning(first: str, second: str, keep: bool):
    @F.arrow_udf(PARTS)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = Aligner(load(first), load(second))
        for batch in batches:
            rows = [row for part in common.pieces(batch, 2 << 20) for row in aligner.align([x or "" for x in part.to_pylist()], keep)]
            n_a, n_b, n_groups, digests, groups, links, often = list(zip(*rows)) or [()] * 7
            flat = [np.concatenate([np.zeros(0, np.int64), *map(np.asarray, side)]).astype(np.int64) for side in (links, often)]
            pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["link", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, links)]), pa.int32()), pairs)
            numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
            yield pa.StructArray.from_arrays([*numbers, pa.array(digests, pa.string()), pa.array(groups, pa.string()), lists], ["n_a", "n_b", "n_groups", "sha256", "groups", "links"])

    return align


def link_counts(links: DataFrame, width: int) -> DataFrame:
    """Stored table (link, count, best) of ``links`` (link, n); best: of the most frequent of its second token."""
    counts = common.stored(links.groupBy("link").agg(F.sum("n").alias("n")).withColumn("second", F.col("link") % width), "link-sums")
    tops = counts.groupBy("second").agg(F.max("n").alias("top"))
    # at most one row for each token of the second vocabulary
    return common.stored(counts.join(F.broadcast(tops), "second").select("link", "n", (F.col("n") == F.col("top")).alias("best")), "link-counts")


def align_tokens(docs: DataFrame, name: str = "aligned", text: str = "text", first: str = FIRST, second: str = SECOND, head: int = HEAD, keep: bool = True) -> DataFrame:
    """``docs`` with a struct of the alignment of each row's whole text.

    It holds n_a, n_b, n_groups, n_links, n_best, count_sum, sha256 and groups (null unless
    ``keep``): ``a1,a2|b1;a3|b2,b3``, and sha256 its digest. n_best counts the links whose
    frequency in all rows is the highest of their second token, ties included; count_sum
    adds these frequencies over the links.

    ``first`` is the name of a byte-level vocabulary file and encodes a space and the text,
    ``second`` that of a sentencepiece model, which adds the space. Null and empty texts,
    and texts that either does not give back byte for byte, have zeros and empty strings.
    Very long texts are read whole, repeated rows count each time, and an empty table gives
    an empty one. Where ``docs`` has a column ``name``, the new one gets underscores.
    """
    name, width = common.free_name(docs, name), len(load(second).tokens)
    columns = [F.col(f"`{c}`") for c in docs.columns if keep or c != text]
    found = aligning(first, second, keep)(F.col(f"`{text}`"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc"), found.alias("f"))
    rows = common.stored(rows, "alignments")
    links = rows.select("row", F.inline("f.links")).select("row", "link", F.col("n").alias("times"))
    counts = link_counts(links.select("link", F.col("times").alias("n")), width)
    floor = common.floor_of(counts, head)
    often, rarer = F.broadcast(counts.where(F.col("n") >= floor)), counts.where(F.col("n") < floor)
    probed = links.join(often, "link", "left")
    summed = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = summed(probed.where("n is not null"))
    if rarer.limit(1).count():
        rest = probed.where("n is null").select("row", "link", "times").join(rarer, "link")
        sums = sums.union(summed(rest)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    numbers = F.struct("f.n_a", "f.n_b", "f.n_groups", F.col("f.n_groups").alias("n_links"), zero("n_best").alias("n_best"), zero("count_sum").alias("count_sum"), "f.sha256", "f.groups")
    out = rows.withColumn("f", F.col("f").dropFields("links")).join(sums, "row", "left").select("doc", numbers.alias("made"))
    return out.select("doc.*", F.col("made").alias(name))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of each document's tokens; null and empty texts have zeros, see ``align_tokens``."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = align_tokens(docs, keep=False)
    return made.select("doc_id", *[f"aligned.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.col("aligned.sha256").alias("groups_sha256"))
