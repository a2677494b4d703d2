"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks of about ``block_words`` words by a seeded
hash, and the blocks of each pass are permuted by another. A source's exact quota is the
number of blocks, in this order and over whole passes, until the words of its target are
reached; of the last block only the documents up to the target are taken, in hash order.

The quotas of all sources are split among the output shards by a binary tree. A node
holds a number of blocks of each source, and its left child gets the share of its shards:
how many of each source are among them is one multivariate hypergeometric draw, made of a
hypergeometric draw a source, each given the ones before. The leaves' quotas cut every
source's order of blocks into disjoint ranges, and a document is taken as often as leaves
hold its block. Each leaf's documents are shuffled locally by hash.

DataFrame operations only. The tree is a table of one row a node with an array of quotas,
made for up to thousands of sources. All draws are hashes, so reruns and retries agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SEED = 611
SHARE = 1.5
WEIGHTS = (5, 2, 1)
LIMIT = 2
#: Words of a block (about 6 MB of text).
BLOCK_WORDS = 1_000_000
SHARDS = 16
#: Parts of a cut block that are summed before its documents are looked at.
PARTS = 1024
#: Source and block tables of at most this many rows are broadcast.
BROADCAST_ROWS = 100_000


def source_key(source: F.Column) -> F.Column:
    """A key that equals itself for null too, in code point order with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Targets of the sources in ``sizes`` (key, source_size), one row each.

    Resharing an excess by weight until no target is above its stop ends at
    ``min(stop, level * weight)``: the sources with the least stop a weight are
    stopped, and the level is what is left over by the weights left. It is found
    with running sums over the sources, a table of one row a source.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    numbered = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    ranked = numbered.withColumn("stop", F.col("source_size") * limit).withColumn("ratio", F.col("stop") / F.col("weight"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # the first source whose stop is not below the level so far fixes the level for the rest
    fixed = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "key", "level"))).over(everything)["level"])
    target = F.least(F.col("stop").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return fixed.select("key", F.col("source_size").cast("long").alias("source_size"), "weight", target.alias("target"))


def log_factorial(x: Column) -> Column:
    """ln(x!) for whole x of 0 or more, by Stirling's series eight places on."""

    def series(z):
        product = z - 1
        for k in range(2, 9):
            product = product * (z - k)
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - F.log(product)

    return common.bound(x.cast("double") + 9, series)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a draw of ``drawn``, by inversion of ``uniform``.

    The probabilities are summed over ten standard deviations and 20 on either side of the
    mean, so over a number of terms that grows with the root of ``total``.
    """
    n = F.greatest(total, F.lit(1)).cast("double")
    mean = drawn * (marked / n)
    spread = F.sqrt(F.greatest(mean * (1 - marked / n) * (n - drawn) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) * 10 + 20
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - spread)).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + spread)).cast("long")
    mode = F.floor((drawn + 1) * ((marked + 1) / (n + 2))).cast("long")
    weight = lambda k: -(log_factorial(k) + log_factorial(marked - k) + log_factorial(drawn - k) + log_factorial(total - marked - drawn + k))

    def terms(r):
        top = F.greatest(r["low"], F.least(r["high"], r["mode"]))
        return common.bound(weight(top), lambda most: F.transform(F.sequence(r["low"], r["high"]), lambda k: F.exp(weight(k) - most)))

    def invert(r, p):
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))

        def found(goal):
            step = lambda a, t: F.struct((a["sum"] + t).alias("sum"), (a["k"] + (a["sum"] + t < goal).cast("long")).alias("k"))
            return F.least(r["high"], r["low"] + F.aggregate(p, start, step, lambda a: a["k"]))

        return common.bound(uniform * F.aggregate(p, F.lit(0.0), lambda a, t: a + t), found)

    limits = F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"))
    return common.bound(limits, lambda r: common.bound(terms(r), lambda p: invert(r, p)))


def uniform(*keys: Column) -> Column:
    """A number between 0 and 1 that the keys decide."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, starts, counts) from one row with an array ``counts`` of the sources' quotas.

    ``starts`` are the places in the sources' orders of blocks where the shard's begin.
    """
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("counts", lambda c: c * 0).alias("starts"), "counts")
    for level in range(max(0, (shards - 1).bit_length())):
        half = F.when(F.col("hi") - F.col("lo") > 1, F.expr("(lo + hi + 1) div 2").cast("int")).otherwise(F.col("hi"))
        nodes = nodes.withColumn("half", half).withColumn("all", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))
        share = F.bround(F.col("all") * (F.col("half") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        begin = F.struct(F.col("all").alias("total"), share.alias("room"), F.array().cast("array<bigint>").alias("out"))

        def draw(state, x):  # noqa: B023  used within this round
            got = hypergeometric(state["total"], x["c"], state["room"], uniform(F.lit(seed), F.lit(level), F.col("lo"), x["i"]))
            after = lambda k: F.struct((state["total"] - x["c"]).alias("total"), (state["room"] - k).alias("room"), F.concat(state["out"], F.array(k)).alias("out"))
            return common.bound(got, after)

        numbered = F.transform("counts", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        left = F.when(F.col("half") == F.col("hi"), F.col("counts")).otherwise(F.aggregate(numbered, begin, draw, lambda s: s["out"]))
        nodes = nodes.withColumn("left", left)
        first = F.struct("lo", F.col("half").alias("hi"), "starts", F.col("left").alias("counts"))
        second = F.struct(F.col("half").alias("lo"), "hi", F.zip_with("starts", "left", lambda a, b: a + b).alias("starts"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"))
        nodes = nodes.select(F.explode(F.array(first, second)).alias("n")).select("n.*").where("lo < hi")
    return nodes.select(F.col("lo").alias("shard"), "starts", "counts")


def cut_hashes(dealt: DataFrame, partial: DataFrame) -> DataFrame:
    """(key, block, cut): the greatest hash that is taken in each cut block.

    ``partial`` has the words before the block (``had``) and the words wanted (``rest``).
    The block's rows are summed in parts by the top of another hash, then those of the part
    where the words are reached by that hash, so nothing larger than a part is sorted. A
    document that goes beyond the target is taken if that is nearer than to stop before it.
    """
    rows = dealt.where("size > 0").drop("had", "rest").join(common.small(partial, BROADCAST_ROWS), ["key", "block"])
    rows = rows.select("key", "block", "h", F.pmod(F.shiftrightunsigned("h", 32), F.lit(PARTS)).alias("part"), "size", "had", "rest")
    parts = rows.groupBy("key", "block", "part").agg(F.sum("size").alias("n"), F.first("had").alias("had"), F.first("rest").alias("rest"))
    running = Window.partitionBy("key", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("had", F.col("had") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    parts = common.stored(parts.where("had <= rest and had + n > rest").select("key", "block", "part", "had", "rest"), "parts")
    inside = rows.drop("had", "rest").join(common.small(parts, BROADCAST_ROWS), ["key", "block", "part"])
    # rows of equal hash are summed before the running sum
    inside = inside.groupBy("key", "block", "part", "h").agg(F.sum("size").alias("n"), F.first("had").alias("had"), F.first("rest").alias("rest"))
    running = Window.partitionBy("key", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("sum", F.col("had") + F.sum("n").over(running)).where(F.col("sum") - F.col("n") / 2 <= F.col("rest"))
    cuts = inside.groupBy("key", "block").agg(F.max("h").alias("cut"))
    return common.stored(parts.select("key", "block", "part").join(cuts, ["key", "block"], "left"), "cuts")


def plan_blocks(slim: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """One row a block: key, block, n_blocks, source_size, target, draws.

    ``draws`` has an entry (shard, whole, part, cut) for each time that a leaf holds the
    block; in one that is not whole, documents up to (part, cut) are taken.
    """
    sizes = targets(slim.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).select("key", "source_size"))
    number = F.row_number().over(Window.orderBy("key")) - 1
    sizes = sizes.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")).withColumn("number", number)
    sizes = common.stored(sizes, "sources")
    dealt = slim.join(common.small(sizes.select("key", "n_blocks"), BROADCAST_ROWS), "key").withColumn("block", F.pmod("h", "n_blocks"))
    words = common.stored(dealt.groupBy("key", "block").agg(F.sum("size").alias("words")), "blocks")
    # a block's places in its source's order: one a pass, each pass permuted anew
    order = words.join(common.small(sizes, BROADCAST_ROWS), "key").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(LIMIT - 1))))
    before = Window.partitionBy("key").orderBy("pass", F.xxhash64(F.lit(seed), "pass", "key", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    order = order.withColumn("had", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("place", F.count(F.lit(1)).over(before))
    order = order.where((F.col("words") > 0) & (F.col("had") < F.col("target")))
    order = common.stored(order.select("key", "number", "block", "words", "had", "target", "place"), "order")
    quotas = order.groupBy("key", "number").agg(F.max("place").alias("n")).select("number", (F.col("n") + 1).alias("n"))
    # sources that give nothing have a quota of none
    quotas = sizes.select("number").join(quotas, "number", "left").select("number", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    root = quotas.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "n"))), lambda x: x["n"]).alias("counts"))
    leaves = common.stored(split_tree(root, shards, seed), "leaves")
    ranges = leaves.select("shard", F.posexplode(F.arrays_zip("starts", "counts")).alias("number", "r")).select("number", "shard", F.col("r.starts").alias("start"), (F.col("r.starts") + F.col("r.counts")).alias("stop"))
    ranges = common.stored(ranges.where("start < stop").groupBy("number").agg(F.collect_list(F.struct("shard", "start", "stop")).alias("ranges")), "ranges")
    drawn = order.join(common.small(ranges, BROADCAST_ROWS), "number")
    drawn = drawn.withColumn("leaf", F.filter("ranges", lambda r: (r["start"] <= F.col("place")) & (F.col("place") < r["stop"]))).where(F.size("leaf") > 0)
    drawn = drawn.select("key", "block", F.col("leaf")[0]["shard"].alias("shard"), "had", "words", F.col("target").alias("rest"))
    drawn = common.stored(drawn.withColumn("whole", F.col("had") + F.col("words") <= F.col("rest")), "drawn")
    cuts = cut_hashes(dealt, drawn.where("not whole").select("key", "block", "had", "rest"))
    drawn = drawn.join(cuts, ["key", "block"], "left")
    draws = drawn.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("whole").cast("int").alias("whole"), "shard", "part", "cut"))).alias("draws"))
    blocks = words.select("key", "block").join(common.small(sizes.select("key", "n_blocks", "source_size", "target"), BROADCAST_ROWS), "key")
    return common.stored(blocks.join(draws, ["key", "block"], "left"), "quota")


def mix(docs: DataFrame, source: F.Column, size: F.Column, identity: list[F.Column], *, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with a struct column ``mix``: size, source_size, target, copies, taken, shards.

    ``copies`` is how often the document is taken (0 to 2), ``shards`` where each copy
    goes. Null sources form one source, the last. Rows equal in ``identity`` are taken
    alike, repeated or not; documents of one hash tie. Sources without words and empty
    tables give no words. A very long text is one document, taken whole or not at all.
    Where ``docs`` has a column ``mix``, the struct gets underscores.
    """
    name = common.free_name(docs, "mix")
    facts = F.struct(source_key(source).alias("key"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), *identity).alias("h"))
    # the columns of ``docs`` are one struct here, so names cannot clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), facts.alias("own")).select("doc", "own.*")
    slim = common.stored(keyed.select("key", "size", "h"), "sizes")
    quota = plan_blocks(slim, block_words, shards, seed)
    sources = common.stored(quota.groupBy("key").agg(F.first("n_blocks").alias("n_blocks")), "counts")
    rows = keyed.join(common.small(sources, BROADCAST_ROWS), "key").withColumn("block", F.pmod("h", "n_blocks"))
    plan = common.stored(quota.select("key", "block", "source_size", "target", "draws"), "facts")
    joined = rows.join(common.small(plan, BROADCAST_ROWS), ["key", "block"])
    part = F.pmod(F.shiftrightunsigned("h", 32), F.lit(PARTS))
    before = lambda d: (part < d["part"]) | ((part == d["part"]) & (F.col("h") <= d["cut"]))
    mine = F.filter("draws", lambda d: (d["whole"] == 1) | F.coalesce(before(d), F.lit(False)))
    none = F.array().cast("array<int>")
    joined = joined.withColumn("shards", F.when(F.col("size") > 0, F.coalesce(F.transform(mine, lambda d: d["shard"]), none)).otherwise(none))
    copies = F.size("shards")
    made = F.struct("size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "shards")
    return joined.select("doc.*", made.alias(name))


def words_of(text: F.Column) -> F.Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; null and empty texts have none, see ``mix``."""
    docs = common.table(spark, sf_dir, "documents")
    slim = common.stored(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "slim")
    mixed = mix(slim, F.col("source"), F.col("size"), [F.col("doc_id"), F.col("text_hash")])
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.shards")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus; a document taken twice is there twice.

    Each leaf's copies are dealt by hash to parts of about a block, which are shuffled by
    hash within.
    """
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mixed = mix(slim, F.col("doc.source"), words_of(F.col("doc.text")), [F.col("doc.doc_id"), F.xxhash64("doc.text")])
    drawn = mixed.select("doc", F.posexplode("mix.shards").alias("copy", "leaf"), F.col("mix.target").alias("target"))
    sources = mixed.select(F.col("doc.source").alias("source"), "mix.target").groupBy("source").agg(F.first("target").alias("target"))
    words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    parts = max(1, math.ceil(words / BLOCK_WORDS / SHARDS))
    order = F.xxhash64(F.lit(SEED), "doc.doc_id", "copy")
    return drawn.repartition("leaf", F.pmod(order, F.lit(parts))).sortWithinPartitions("leaf", order).select("doc.*")
