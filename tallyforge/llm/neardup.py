"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Sketch. The five-word shingles of a text are the elements. Element ``e`` of weight
``w`` has a Poisson process of rate ``w``; each arrival falls into a uniformly drawn
register. A register keeps the element of its earliest arrival, and an element stops
as soon as its next arrival is later than every register's earliest. Two texts agree
in a register with the probability Jaccard similarity of their weights. Every shingle
has weight 1 however often it occurs, so that this is the Jaccard similarity of the
sets, which is what is verified.

Candidates. Registers are cut into bands; texts that share a band are candidates.
Equal texts are one node of the graph from the start. Within a band's bucket every
node meets the bucket's leader, the node that shares most bands with others (in a
group of copies the text that they vary). A pair is dropped if its registers agree
in fewer than ``LEAST`` places (five standard deviations below the threshold), else
verified by the exact Jaccard similarity of the sets of shingles.

The rest. Nodes that share a leader form a group, and some may still be in another
component than the leader. These meet every node of the group, in blocks of bounded
size that yield only links, so no pair of a bucket is left out unless both are known
to be in one class, and pairs are not made into rows. This costs the product of such
nodes and their group, where all pairs would cost the square of the group.

Classes are the connected components of the links, found with large-star and
small-star rounds, each stored in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .shingles import mixed, shingles

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Registers of 96 that agree at least: 0.8 less five standard deviations of 0.041.
LEAST = 57
#: Texts, and bytes of texts, on either side of a block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Members that meet one copy of a leader; of leaders with more, at most ``BROADCAST_ROWS``
#: are copied.
GROUP_ROWS, BROADCAST_ROWS = 512, 100_000
SKETCH = "struct<bands:array<bigint>,registers:binary>"


def prob_minhash(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Register contents (n x m element hashes) for the weighted elements of ``n`` texts.

    One round draws the next arrival of every element that is still running, for all
    texts at once. Texts without elements keep zeros.
    """
    earliest, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    h, state = np.zeros(len(elements)), elements.copy()
    live = np.arange(len(elements))
    while len(live):
        state = mixed(state)
        gap = -np.log1p(-(state >> np.uint64(11)).astype(float) * 2.0**-53) / weights[live]
        h = h + gap
        cell = doc[live] * m + ((mixed(state ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, cell, h)
        won = h == earliest[cell]
        kept[cell[won]] = elements[live[won]]
        on = h < earliest.reshape(n, m).max(axis=1)[doc[live]]
        live, h, state = live[on], h[on], state[on]
    return kept.reshape(n, m)


def sketches(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and 16-bit registers (n x REGISTERS)."""
    doc, elements, _ = shingles(values)
    kept = prob_minhash(doc, elements, np.ones(len(elements)), len(values))
    bands = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(values), 0)
    for k in range(ROWS):
        bands = mixed(bands * np.uint64(0x9E3779B97F4A7C55) + kept[:, k::ROWS])
    return bands.view(np.int64), (kept >> np.uint64(48)).astype(np.uint16)


@common.arrow_function(SKETCH)
def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        bands, registers = [], []
        for part in common.pieces(batch):
            b, r = sketches(common.texts(part))
            bands.append(b)
            registers.append(r)
        b = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.int64)
        offsets = pa.array(np.arange(0, b.size + 1, BANDS), pa.int32())
        rows = [x.tobytes() for r in registers for x in r]
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(b.reshape(-1))), pa.array(rows, pa.binary())], ["bands", "registers"])


@common.arrow_function("int")
def agreement(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Registers in which two sketches agree."""
    for a, b in batches:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint16).reshape(-1, REGISTERS) for v in (a, b))
        yield pa.array((x == y).sum(axis=1).astype(np.int32))


def similarity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of each pair of texts."""
    both = list(dict.fromkeys([*a, *b]))
    at = {x: i for i, x in enumerate(both)}
    doc, hashes, _ = shingles(both)
    edges = np.searchsorted(doc, np.arange(len(both) + 1))
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b)):
        i, j = at[x], at[y]
        s, t = hashes[edges[i] : edges[i + 1]], hashes[edges[j] : edges[j + 1]]
        if min(len(s), len(t)) >= THRESHOLD * max(len(s), len(t)) and len(s):
            shared = len(np.intersect1d(s, t, assume_unique=True))
            out[k] = shared / (len(s) + len(t) - shared)
    return out


@common.arrow_function("double")
def jaccard(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        out, at = [np.zeros(0)], 0
        for part in common.pieces(a, 2 << 20):
            out.append(similarity(common.texts(part), common.texts(b.slice(at, len(part)))))
            at += len(part)
        yield pa.array(np.concatenate(out))


def block_links(seeks: list[tuple], group: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Links between rows (node, root, text) of ``seeks`` and of ``group`` with other roots.

    Shared shingles are counted as a product of 0/1 matrices over the shingles that
    occur in more than one of the texts, some columns at a time.
    """
    both = [*seeks, *group]
    doc, hashes, _ = shingles([t for *_, t in both])
    sizes = np.bincount(doc, minlength=len(both))
    _, column, often = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    doc, column = doc[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    m, total, width = len(seeks), int(shared.sum()), 2048
    common_count = np.zeros((m, len(group)), np.float32)
    for a in range(0, total, width):
        i, j = np.searchsorted(column, [a, a + width])
        table = np.zeros((len(both), width), np.float32)
        table[doc[i:j], column[i:j] - a] = 1
        common_count += table[:m] @ table[m:].T
    union = sizes[:m, None] + sizes[None, m:] - common_count
    found = (common_count >= THRESHOLD * union - 1e-6) & (common_count > 0)
    roots = {r: k for k, r in enumerate(dict.fromkeys(r for _, r, _ in both))}
    number = np.array([roots[r] for _, r, _ in both])
    found &= number[:m, None] != number[None, m:]
    return [(seeks[x][0], group[y][0]) for x, y in zip(*np.nonzero(found))]


def links_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, seeks, node, root, text) sorted by block; one block is held at a time."""
    now, rows = None, ([], [])

    def done():
        links = block_links(*rows) if rows[0] and rows[1] else []
        return pa.record_batch({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    for batch in batches:
        for part_at in range(0, batch.num_rows, 512):
            for block, seeks, node, root, text in zip(*(c.to_pylist() for c in batch.slice(part_at, 512).columns)):
                if block != now:
                    if now is not None:
                        yield done()
                    now, rows = block, ([], [])
                rows[0 if seeks else 1].append((node, root, (text or "").encode()))
    if now is not None:
        yield done()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root: least node."""
    now = common.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        # large star: larger neighbours of a node to the least of all its neighbours and itself
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = dealt(both, least, "a", "b").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = dealt(large, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()
        now = common.stored(small.select("a", "b"), "edges")
        if (after := mark(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = after


def text_node(text: F.Column) -> F.Column:
    """A 128-bit key of the text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def crowds(members: DataFrame, key: str = "leader") -> DataFrame:
    """(key, parts) of the keys with more than ``GROUP_ROWS`` of ``members``, to be broadcast.

    Where more than ``BROADCAST_ROWS`` keys have as many, the largest of them are given,
    down to a power of two. Of a key left out there are then more than ``BROADCAST_ROWS``
    with half as many members at least, so it has less than two in ``BROADCAST_ROWS`` of all rows.
    """
    counts = members.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS)
    counts = common.stored(counts, "crowds")
    return F.broadcast(counts.where(F.col("n") >= common.floor_of(counts, BROADCAST_ROWS)).select(key, F.ceil(F.col("n") / GROUP_ROWS).alias("parts")))


def meet(rows: DataFrame, crowded: DataFrame, leaders: DataFrame, key: str = "leader", deal: str = "node") -> DataFrame:
    """``rows`` (key, deal, ...) joined with ``leaders`` (key, ...), a crowded one in parts.

    The rows of a key in ``crowded`` are dealt by a hash of ``deal`` to its parts, each with
    a copy of the leader, so no task gets a group whole.
    """
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64(deal), parts)).drop("parts")
    leaders = leaders.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return rows.join(leaders, [key, "part"]).drop("part")


def dealt(rows: DataFrame, leaders: DataFrame, key: str, deal: str) -> DataFrame:
    """``rows`` joined with ``leaders`` on ``key``; the rows of a frequent key are dealt to parts."""
    return meet(rows, crowds(rows, key), leaders, key, deal)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, leader) for each row of ``docs`` (doc_id, text).

    Equal texts have one class, empty and null ones too; texts without words are
    linked to nothing else. ``class_id`` is the least doc_id of the class, and
    ``leader`` marks the rows with that doc_id and its first text: ties of the least id
    have the text of least key. Rows may repeat, and ids may be null, which is less than
    any. Very long texts are read whole. An empty table gives an empty one. Other columns
    are not looked at.
    """
    spark, text = docs.sparkSession, F.col("text")
    rows = common.stored(docs.select("doc_id", text_node(text).alias("node"), sketch(F.coalesce(text, F.lit(""))).alias("k"), (F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(common.BLANKS))) > 0).alias("full")).select("doc_id", "node", "full", "k.bands", "k.registers"), "sketch")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    filled = rows.where("full").groupBy("node").agg(F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    filled = common.stored(filled, "nodes")

    banded = filled.select("node", F.explode("bands").alias("band"))
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = common.stored(dealt(banded, counts, "band", "node"), "buckets")
    shares = buckets.groupBy("node").agg(F.sum("n").alias("shares"))
    leaders = buckets.join(shares, "node").groupBy("band").agg(F.max(F.struct("shares", F.xxhash64("node").alias("order"), "node"))["node"].alias("leader"))
    members = common.stored(dealt(buckets, leaders, "band", "node").select("leader", "node").distinct(), "members")

    # the text of each member, once, from the row of its least doc_id
    wanted = members.select("node").distinct().join(nodes, "node")
    held = docs.select("doc_id", "text").withColumn("node", text_node(F.col("text")))
    held = held.join(wanted, (held["node"] == wanted["node"]) & held["doc_id"].eqNullSafe(wanted["first"])).select(held["node"], "text")
    one = Window.partitionBy("node").orderBy(F.lit(0))
    held = common.stored(held.withColumn("i", F.row_number().over(one)).where("i = 1").drop("i"), "texts")

    crowded = crowds(members)
    leading = lambda of, column, rows: of.select(F.col("node").alias("leader"), F.col(column).alias("other")).join(rows.select("leader").distinct(), "leader", "left_semi")
    registers = filled.select("node", "registers")
    stars = meet(members.where("node <> leader").join(registers, "node"), crowded, leading(registers, "registers", members))
    stars = common.stored(stars.where(agreement("registers", "other") >= LEAST).select("leader", "node"), "stars")
    pairs = meet(stars.join(held, "node"), crowded, leading(held, "text", stars))
    links = common.stored(pairs.where(jaccard("text", "other") >= THRESHOLD).select(F.col("leader").alias("a"), F.col("node").alias("b")), "links")
    roots = components(links)

    placed = members.join(roots, "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root"))
    heads = placed.where("node = leader").select("leader", F.col("root").alias("head"))
    placed = common.stored(meet(placed, crowded, heads).withColumn("apart", F.col("root") != F.col("head")), "placed")
    sizes = held.select("node", F.octet_length("text").cast("long").alias("size"))
    groups = placed.join(sizes, "node").groupBy("leader").agg(
        F.sum(F.col("apart").cast("long")).alias("m"), F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)).alias("m_size"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_size")
    ).where("m > 0")
    chunks = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK_ROWS, F.col(size) / BLOCK_BYTES))
    groups = groups.select("leader", chunks("m", "m_size").alias("m_chunks"), chunks("n", "n_size").alias("n_chunks"))
    rest = meet(placed, crowded, groups).select("*", F.xxhash64("node").alias("h"))
    seeks = rest.where("apart").select("leader", F.pmod("h", "m_chunks").alias("x"), F.explode(F.expr("sequence(0, n_chunks - 1)")).alias("y"), F.lit(True).alias("seeks"), "node", "root")
    sought = rest.select("leader", F.explode(F.expr("sequence(0, m_chunks - 1)")).alias("x"), F.pmod("h", "n_chunks").alias("y"), F.lit(False).alias("seeks"), "node", "root")
    blocks = seeks.union(sought).join(held, "node").select(F.struct("leader", "x", "y").alias("block"), "seeks", "node", "root", "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.repartition(parts, "block").sortWithinPartitions("block").select(F.to_json(F.struct(F.hex("block.leader").alias("l"), "block.x", "block.y")).alias("block"), "seeks", "node", "root", "text")
    more = common.stored(blocks.mapInArrow(links_of_blocks, "a binary, b binary"), "more")
    if more.limit(1).count():
        roots = components(links.union(more))
    classes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    head = classes.groupBy("root").agg(F.min(F.struct("first", "node")).alias("head"))
    classes = common.stored(classes.join(head, "root").select("node", F.col("head.first").alias("class_id"), (F.col("head.node") == F.col("node")).alias("is_head")), "classes")
    found = dealt(rows.select("doc_id", "node", F.monotonically_increasing_id().alias("row")), classes, "node", "row")
    return found.select("doc_id", "node", "class_id", (F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("leader"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document; null and empty texts are one class, see ``near_duplicates``."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "leader")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one of the least doc_id.

    Of rows with its id and text the one stays whose columns as JSON have the least hash,
    then come first, so reruns keep the same.
    """
    keep = near_duplicates(docs.select("doc_id", "text")).where("leader").select(F.col("doc_id").alias("i"), F.col("node").alias("n")).distinct()
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    doc = doc.select("doc", F.col("doc.doc_id").alias("id"), text_node(F.col("doc.text")).alias("node"))
    kept = doc.join(keep, (F.col("id").eqNullSafe(F.col("i"))) & (F.col("node") == F.col("n")), "left_semi")
    as_json = F.to_json("doc", {"ignoreNullFields": "false"})
    one = kept.groupBy("id", "node").agg(F.min_by("doc", F.struct(F.xxhash64(as_json).alias("h"), as_json.alias("j"))).alias("doc"))
    return one.select("doc.*")
