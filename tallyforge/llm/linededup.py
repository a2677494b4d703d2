"""Line dedup with a sharded minimal perfect hash.

The key of each line is hashed to 128 bits, and each distinct hash is dealt to a shard.
A shard has a minimal perfect hash (hash and displace): a displacement for every four
keys on average sends its keys to distinct slots. The slots index three arrays: a 64-bit
fingerprint, the number of documents and the greatest doc_id. Documents look their lines
up in these arrays, and the count that is read decides; lines and texts are never joined.
A hash of one document alone needs no slot: where no fingerprint is found, the count is one.

The arrays are 21 bytes a hash. Those of the most frequent hashes, ``HEAD_BYTES`` of them,
go to every task, and documents probe them while they are scanned. If there are more, the
hashes that were not found go to their shards instead, 16 bytes and two numbers each, and
are probed there; the numbers of the lines to drop come back by row. A hash that goes to a
shard is rarer than each of the head, so no shard is hot. Which hashes are in the head is a
power of two of their counts and changes no result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mixed

LEAST, LENGTH = 3, 20
#: Keys of a shard, and keys that share a displacement, on average.
SHARD_KEYS, SHARE = 20_000, 4
#: Lines that a shard is asked for on average, where lines go to the shards.
SHARD_PROBES = 1_000_000
#: Bytes of arrays that every task holds.
HEAD_BYTES = 48 << 20
KEY_BYTES = 21
_STRIP = common.BLANKS.encode()
_GOLD = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)


def line_key(line: bytes, length: int = LENGTH) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    key = line.strip(_STRIP)
    if len(key) < length or (len(key) < 4 * length and len(key.decode("utf-8", "replace")) < length):
        return None
    return key.lower()  # of bytes: A-Z only


def text_keys(text: bytes, length: int = LENGTH) -> list[bytes | None]:
    """A 16-byte hash for each line, None for short ones."""
    return [None if (k := line_key(x, length)) is None else xxhash.xxh3_128_digest(k) for x in text.split(b"\n")]


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def places(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of both halves; hashes that differ get other places under another seed."""
    return mixed(a ^ mixed(b + np.uint64(seed)))


def slots(place: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return ((mixed(place ^ (displacement.astype(np.uint64) * _GOLD)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """A seed, and displacements that send distinct hashes to slots 0 to n - 1."""
    n, seed = len(a), 0
    while len(np.unique(place := places(a, b, seed))) < n:
        seed += 1  # equal places can never be told apart; another seed has others
    groups = max(1, -(-n // SHARE))
    group = (place % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    starts = np.cumsum(sizes) - sizes
    taken, out = np.zeros(n, bool), np.zeros(groups, np.uint32)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        keys = place[order[starts[g] : starts[g] + sizes[g]]]
        first, width = 0, 64
        while True:
            tries = np.arange(first, first + width, dtype=np.uint64)
            at = slots(keys[None, :], tries[:, None], n)
            good = ~taken[at].any(axis=1)
            if sizes[g] > 1:
                ordered = np.sort(at, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                out[g], taken[at[k]] = first + k, True
                break
            first, width = first + width, min(width * 2, 4096)
    return seed, out


class Shard:
    """The arrays of one shard."""

    def __init__(self, seed: int, displacements: bytes, prints: bytes, counts: bytes, most: bytes):
        self.seed, self.displacements, self.prints = seed, np.frombuffer(displacements, np.uint32), np.frombuffer(prints, np.uint64)
        self.counts, self.most = np.frombuffer(counts, np.uint32), np.frombuffer(most, np.int64)

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (1 where the hash has no slot) and greatest doc_id of each hash."""
        place = places(a, b, self.seed)
        at = slots(place, self.displacements[(place % np.uint64(len(self.displacements))).astype(np.int64)], len(self.prints))
        known = self.prints[at] == b
        return np.where(known, self.counts[at], 1), np.where(known, self.most[at], NO_ID)


class Index:
    """Some shards of ``n_shards``; hashes of other shards count as unknown."""

    def __init__(self, shards: list[tuple], n_shards: int):
        self.n_shards, self.shards = n_shards, {s: Shard(*arrays) for s, *arrays in shards}

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, most = np.ones(len(a), np.int64), np.full(len(a), NO_ID)
        shard = (a % np.uint64(self.n_shards)).astype(np.int64)
        for s in np.unique(shard):
            if int(s) in self.shards:
                of = np.flatnonzero(shard == s)
                counts[of], most[of] = self.shards[int(s)].probe(a[of], b[of])
        return counts, most


ARRAYS = "seed long, displacements binary, prints binary, counts binary, most binary"


def build_shard(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    a, b = (np.array(table[c].to_pylist(), np.int64).view(np.uint64) for c in ("a", "b"))
    seed, displacements = build(a, b)
    place = places(a, b, seed)
    at = slots(place, displacements[(place % np.uint64(len(displacements))).astype(np.int64)], len(a))
    prints, counts, most = np.empty(len(a), np.uint64), np.empty(len(a), np.uint32), np.empty(len(a), np.int64)
    prints[at], counts[at], most[at] = b, np.minimum(table["n"].to_numpy(), 2**32 - 1), table["most"].to_numpy()
    arrays = {"displacements": displacements, "prints": prints, "counts": counts, "most": most}
    return pa.table({"shard": pa.array([keys[0].as_py()], pa.int64()), "seed": pa.array([seed], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})


def shard_of(n_shards: int) -> F.Column:
    """The shard of a hash by its first half, as numpy takes it unsigned."""
    return F.pmod(F.pmod("a", F.lit(n_shards)) + F.when(F.col("a") < 0, F.lit(2**64 % n_shards)).otherwise(0), F.lit(n_shards))


def line_counts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Stored table (a, b, n, most) of the hashes of more than one document.

    ``n`` counts distinct doc_ids; rows without one count as one document.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in common.pieces(batch.column("text")):
                keys, ids = [], []
                for doc_id, text in zip(batch.column("doc_id").slice(at, len(part)).to_pylist(), common.texts(part)):
                    own = set(text_keys(text, length)) - {None}
                    keys += own
                    ids += [doc_id] * len(own)
                at += len(part)
                if keys:
                    a, b = halves(keys)
                    yield pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64), "doc_id": pa.array(ids, pa.int64())})

    lines = docs.select("doc_id", "text").mapInArrow(distinct, "a long, b long, doc_id long").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    counted = lines.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("most"))
    return common.stored(counted.where("n > 1"), "lines")


def shards_of(counted: DataFrame, n_shards: int) -> DataFrame:
    return common.stored(counted.withColumn("shard", shard_of(n_shards)).groupBy("shard").applyInArrow(build_shard, f"shard long, {ARRAYS}"), "shards")


MARKED = "struct<gone:array<int>,rest:array<struct<line:int,a:bigint,b:bigint>>>"
MADE = "struct<n_lines:bigint,n_dropped:bigint,text:string,sha256:string>"


def marks(values: list[bytes], ids: list[int | None], held: Index, least: int, length: int) -> tuple[list[np.ndarray], list[tuple]]:
    """For each text the lines that ``held`` drops, and (lines, a, b) of those it has no slot for.

    All lines of the texts are probed at once.
    """
    keys = [text_keys(value, length) for value in values]
    lines = [np.array([k for k, x in enumerate(own) if x], np.int32) for own in keys]
    ends = np.cumsum([0, *map(len, lines)])
    if not ends[-1]:
        return lines, [(x, x, x) for x in lines]
    a, b = halves([x for own in keys for x in own if x])
    counts, most = held.probe(a, b)
    owner = np.repeat(np.array([NO_ID if i is None else i for i in ids], np.int64), np.diff(ends))
    drop, other = (counts >= least) & (most != owner), counts < 2
    spans = [slice(x, y) for x, y in zip(ends, ends[1:])]
    return [x[drop[s]] for x, s in zip(lines, spans)], [(x[other[s]], a[s][other[s]], b[s][other[s]]) for x, s in zip(lines, spans)]


def marker(index, least: int, length: int):
    """Arrow function of (text, doc_id): lines that the head drops, and those to ask the shards for."""

    @F.arrow_udf(MARKED)
    def mark(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, ids in batches:
            gone, rest, at = [], [], 0
            for part in common.pieces(values):
                out, other = marks(common.texts(part), ids.slice(at, len(part)).to_pylist(), index.value, least, length)
                gone += [x.tolist() for x in out]
                rest += [[{"line": x, "a": y, "b": z} for x, y, z in zip(n.tolist(), a.view(np.int64).tolist(), b.view(np.int64).tolist())] for n, a, b in other]
                at += len(part)
            kind = pa.list_(pa.struct([("line", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
            yield pa.StructArray.from_arrays([pa.array(gone, pa.list_(pa.int32())), pa.array(rest, kind)], ["gone", "rest"])

    return mark


def without(values: list[bytes], gone: list, keep: bool) -> list[tuple]:
    """(lines, dropped, text, digest) of each text without the lines of those numbers."""
    rows = []
    for value, away in zip(values, gone):
        lines, n = value.count(b"\n") + 1, len(away)
        if n:
            away = set(away)
            value = b"\n".join(x for k, x in enumerate(value.split(b"\n")) if k not in away)
        rows.append((lines, n, value.decode() if keep else None, hashlib.sha256(value).hexdigest()))
    return rows


def made(rows: list[tuple]) -> pa.Array:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows)) or [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_lines", "n_dropped", "text", "sha256"])


def probing(index, least: int, length: int, keep: bool):
    """Arrow function of (text, doc_id): the text without the lines that the head drops."""

    @F.arrow_udf(MADE)
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, ids in batches:
            rows, at = [], 0
            for part in common.pieces(values):
                texts = common.texts(part)
                rows += without(texts, [x.tolist() for x in marks(texts, ids.slice(at, len(part)).to_pylist(), index.value, least, length)[0]], keep)
                at += len(part)
            yield made(rows)

    return probe


def dropping(keep: bool):
    """Arrow function of (text, numbers of lines): the text without them."""

    @F.arrow_udf(MADE)
    def drop(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, drops in batches:
            rows, at = [], 0
            for part in common.pieces(values):
                rows += without(common.texts(part), drops.slice(at, len(part)).to_pylist(), keep)
                at += len(part)
            yield made(rows)

    return drop


def prober(least: int):
    """Probes one shard's arrays with the lines (row, line, doc_id, a, b) that are sent to it."""

    def run(keys: tuple[pa.Scalar, ...], lines: pa.Table, arrays: pa.Table) -> pa.Table:
        drop = np.zeros(len(lines), bool)
        if len(lines) and len(arrays):
            shard = Shard(*(arrays[c][0].as_py() for c in ("seed", "displacements", "prints", "counts", "most")))
            a, b = (lines[c].to_numpy().view(np.uint64) for c in ("a", "b"))
            counts, most = shard.probe(a, b)
            drop = (counts >= least) & (most != lines["doc_id"].to_numpy())
        return lines.select(["row", "line"]).filter(pa.array(drop))

    return run


def dedup_lines(docs: DataFrame, name: str = "lines", least: int = LEAST, length: int = LENGTH, head_bytes: int = HEAD_BYTES, shard_keys: int = SHARD_KEYS, keep: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a struct: n_lines, n_dropped, text, sha256.

    ``text`` is what is left of each text, null unless ``keep``; ``sha256`` its digest.

    Null and empty texts are one empty line. Rows of one doc_id are one document when
    documents are counted and separate rows of the result; all those of the greatest
    doc_id that holds a key keep its lines, so ties and repeated rows lose nothing. A null
    id is less than any. Very long texts are split whole. An empty table gives an empty
    one. Where ``docs`` has a column ``name``, the new one gets underscores. ``least`` is 2
    or more.
    """
    name, spark = common.free_name(docs, name), docs.sparkSession
    counted = line_counts(docs, length)
    floor = common.floor_of(counted, max(0, head_bytes // KEY_BYTES))
    often, rarer = counted.where(F.col("n") >= floor), counted.where(F.col("n") < floor)
    n_often, n_rarer = (counted.agg(F.count(F.when(c, 1))).first()[0] for c in (F.col("n") >= floor, F.col("n") < floor))
    n_shards = max(1, math.ceil(n_often / shard_keys))
    head = spark.sparkContext.broadcast(Index([tuple(r) for r in shards_of(often, n_shards).toLocalIterator()], n_shards))
    text, doc = F.coalesce("text", F.lit("")), "doc"
    if not n_rarer:
        return docs.withColumn(name, probing(head, least, length, keep)(text, F.col("doc_id")))
    # what the head does not hold goes to the shards of the rest
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(doc), marker(head, least, length)(text, F.col("doc_id")).alias("m"))
    rows = common.stored(rows, "marked")
    head.unpersist()
    asked = rows.select("row", F.coalesce("doc.doc_id", F.lit(NO_ID)).alias("doc_id"), F.explode("m.rest").alias("x")).select("row", "doc_id", "x.line", "x.a", "x.b")
    n_asked = rows.agg(F.coalesce(F.sum(F.size("m.rest")), F.lit(0))).first()[0]
    n_shards = max(1, math.ceil(n_rarer / shard_keys), math.ceil(n_asked / SHARD_PROBES))
    arrays = shards_of(rarer, n_shards)
    drops = asked.withColumn("shard", shard_of(n_shards)).groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(prober(least), "row long, line int")
    drops = common.stored(drops, "drops").groupBy("row").agg(F.collect_list("line").alias("lines"))
    joined = rows.select("row", doc, "m.gone").join(drops, "row", "left").withColumn("gone", F.concat("gone", F.coalesce("lines", F.array().cast("array<int>"))))
    left = dropping(keep)(F.coalesce("doc.text", F.lit("")), F.col("gone"))
    return joined.select(doc, left.alias("made")).select("doc.*", F.col("made").alias(name))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document before and after; null or empty texts are one empty line.

    See ``dedup_lines`` for ties, repeated rows, very long texts and empty tables.
    """
    found = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.col("lines.sha256").alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS most FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, coalesce(l.doc_id <> o.most, false) AS gone FROM keyed l LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
