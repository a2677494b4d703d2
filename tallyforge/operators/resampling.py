"""Resampling dealt to tasks: bootstrap intervals of one generator, and weighted draws."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import positions

#: Values of a group that a task holds, those that are sent together, and draws that it makes before another shares its replicates.
BLOCK, CHUNK, DRAWS = 8_000_000, 100_000, 1_000_000_000
#: Words of the generator that are looked at together.
STEP = 1 << 18


class Draws:
    """The numbers that ``RandomState(seed).randint(0, n, n)`` gives again and again, as the words they are taken from.

    A number is a word of 32 bits (64 beyond that) under a mask, and the next one where it is not
    below ``n``. Words are made in steps; ``state`` is the generator's at a step's start, and how many are used since.
    """

    def __init__(self, n: int, seed: int, state: bytes | None = None):
        self.n, self.draw, self.words, self.used = n, np.random.RandomState(seed), (), 0
        if state:
            place, used = np.frombuffer(state[-16:], np.int64).tolist()
            self.draw.set_state(("MT19937", np.frombuffer(state[:-16], np.uint32), place))
            self._step()
            self._use(used)

    def _step(self):
        _, key, place, *_ = self.draw.get_state()
        self.start, self.used = (key.tobytes(), place), 0
        wide = self.n > 2**32
        words = self.draw.randint(0, 2**32, STEP * (1 + wide), dtype=np.uint32)
        if wide:
            words = (words[0::2].astype(np.uint64) << np.uint64(32)) | words[1::2]
        self.words = words & words.dtype.type((1 << (self.n - 1).bit_length()) - 1)

    def _use(self, count: int):
        self.words, self.used = self.words[count:], self.used + count

    def state(self) -> bytes:
        if not len(self.words):
            self._step()
        return self.start[0] + np.array([self.start[1], self.used], np.int64).tobytes()

    def replicate(self):
        """Words with the next ``n`` numbers, those that are not below ``n`` among them."""
        left = self.n
        while left:
            if not len(self.words):
                self._step()
            words, good = self.words, np.count_nonzero(self.words < self.n)
            if good > left:
                words, good = words[: np.flatnonzero(words < self.n)[left - 1] + 1], left
            self._use(len(words))
            left -= good
            yield words


def states(n: int, starts: list[int], seed: int) -> list[bytes]:
    """The state before each of the replicates ``starts`` (rising), by drawing once up to the last."""
    draws, out, r = Draws(n, seed), [], 0
    for start in starts:
        for _ in range(start - r):
            for _ in draws.replicate():
                pass
        r = start
        out.append(draws.state())
    return out


def replicate_sums(values: np.ndarray, low: int, n: int, first: int, last: int, seed: int, state: bytes | None = None) -> np.ndarray:
    """Sums of the drawn ``values`` (places low, low + 1, ... of n) for replicates first to last - 1.

    The generator's stream is that of ``n`` draws a replicate from 0 on. It begins with
    ``state``, that before ``first``; without one, earlier replicates are drawn and left.
    """
    draws, out = Draws(n, seed, state or states(n, [first], seed)[0]), np.zeros((last - first, values.shape[1]))
    columns = [np.ascontiguousarray(c) for c in values.T]
    for r in range(last - first):
        for words in draws.replicate():
            at = words - words.dtype.type(low)  # below ``low`` an unsigned number turns to a great one
            at = np.compress(at < len(values), at)
            out[r] += [column.take(at).sum() for column in columns]
    return out


def bootstrap(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], statistic: Column, rounds: int = 2000, seed: int = 42, alpha: float = 0.05, block: int = BLOCK, draws: int = DRAWS) -> DataFrame:
    """(by, n, value, ci_lower, ci_upper): a statistic of sums with its percentile interval.

    ``sums`` names numbers of a row, and ``statistic`` is written over their totals and ``n``.
    It is resampled by one generator a group, seeded with ``seed``, over the rows in
    ``order`` (a number without nulls). Groups of fewer than two rows have no interval.

    A group's values are packed in order and dealt to blocks, and its replicates to
    stretches. The stream is drawn once to keep the generator's state where a stretch starts.
    A task has a block and a stretch, draws the stretch's part of the stream, and adds up what
    falls into its block; the blocks' sums meet by replicate. So the draws of a group of n
    rows are made once for each block of ``block`` rows, and once more for the states where a
    task would have more than ``draws`` of them for each block.
    """
    names = list(sums)
    # of the row's columns only the order, the group and the numbers are carried
    rows = df.select(*by, F.col(order).alias("_o"), *[c.cast("double").alias(name) for name, c in sums.items()])
    kinds = dict(rows.dtypes)
    groups = "".join(f"`{c}` {kinds[c]}, " for c in by)
    chunk = min(CHUNK, block)
    placed = positions(rows, by, "_o", "_at").select(*by, "_at", *names, F.floor(F.col("_at") / block).alias("_block"))
    placed = placed.withColumn("_chunk", F.floor(F.col("_at") % block / chunk))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        values = np.column_stack([table[c].to_numpy() for c in names])
        row = {c: table[c][:1] for c in (*by, "_block", "_chunk")}
        return pa.table(row | {"_at": table["_at"][:1], "_values": pa.array([values.tobytes()], pa.binary())})

    packed = placed.groupBy(*by, "_block", "_chunk").applyInArrow(pack, f"{groups}_block long, _chunk long, _at long, _values binary")
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
    keys = [f"_k{i}" for i in range(len(by))]
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]

    def stretched(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        parts = min(rounds, -(-n * rounds // (draws * -(-n // block))))
        ends = [rounds * part // parts for part in range(parts + 1)]
        found = {k: pa.repeat(table[c][0], parts) for c, k in zip(by, keys)}
        return pa.table(found | {"_n": pa.repeat(pa.scalar(n, pa.int64()), parts), "_first": pa.array(ends[:-1], pa.int32()), "_last": pa.array(ends[1:], pa.int32()), "_state": pa.array(states(n, ends[:-1], seed), pa.binary())})

    dealt = "".join(f"{k} {kinds[c]}, " for c, k in zip(by, keys))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    stretches = sizes.groupBy(*by).applyInArrow(stretched, f"{dealt}_n long, _first int, _last int, _state binary")
    held = packed.join(stretches, same).drop(*keys)

    def resample(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        n, first, last, low, state = (table[c][0].as_py() for c in ("_n", "_first", "_last", "_at", "_state"))
        values = np.concatenate([np.frombuffer(v.as_buffer()) for v in table["_values"]]).reshape(-1, len(names))
        found = replicate_sums(values, low, n, first, last, seed, state)
        group = {c: pa.repeat(table[c][0], last - first) for c in by}
        return pa.table(group | {"_r": pa.array(range(first, last), pa.int32()), "n": pa.array([n] * (last - first), pa.int64())} | {c: pa.array(found[:, k]) for k, c in enumerate(names)})

    schema = ", ".join([f"{groups}_r int, n long", *(f"`{c}` double" for c in names)])
    parts = held.groupBy(*by, "_block", "_first").applyInArrow(resample, schema)
    means = parts.groupBy(*by, "_r", "n").agg(*[F.sum(c).alias(c) for c in names]).select(*by, statistic.alias("_value"))
    # one number a replicate
    ordered = means.groupBy(*by).agg(F.sort_array(F.collect_list("_value")).alias("_values"))
    low, high = max(0, int(rounds * alpha / 2)), min(rounds - 1, int(rounds * (1 - alpha / 2)) - 1)
    ends = ordered.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("_values")[low].alias("ci_lower"), F.col("_values")[high].alias("ci_upper"))
    return totals.join(ends, same, "left").select(*by, "n", statistic.alias("value"), "ci_lower", "ci_upper")


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how likely it stays itself, and the place that it gives way to."""
    n = len(weights)
    share, other = weights * (n / weights.sum()), np.arange(n)
    small, large = [k for k in range(n) if share[k] < 1], [k for k in range(n) if share[k] >= 1]
    while small and large:
        s, b = small.pop(), large[-1]
        other[s] = b
        share[b] -= 1 - share[s]
        if share[b] < 1:
            small.append(large.pop())
    share[small + large] = 1  # what rounding has left
    return share, other


def weighted_draws(df: DataFrame, key: str, weight: Column, size: int, seed: int, buckets: int = 64, draws: int = 5_000_000) -> DataFrame:
    """``df`` with ``times``: how often each row is taken by exactly ``size`` weighted draws with replacement.

    Rows of no times are left out; null, negative and zero weights are never drawn, and an
    empty or weightless table is an error unless ``size`` is 0. ``key`` tells rows apart.

    Rows are dealt to ``buckets`` by a hash of the key. The number of draws from each is one
    multinomial draw over their weights, which the driver makes (as many numbers as
    buckets). Within a bucket rows are drawn by an alias table; a bucket of more than
    ``draws`` draws is drawn in parts with generators of their own. Reruns agree.
    """
    w = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(F.col(key).alias("_k"), w.alias("_w"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b")).where("_w > 0")
    # summed as decimals, whose order does not matter
    found = rows.groupBy("_b").agg(F.sum(F.col("_w").cast("decimal(38,12)")).cast("double").alias("w")).orderBy("_b").collect()
    if not found:
        if size:
            raise ValueError("no row has a weight")
        return df.withColumn("times", F.lit(0).cast("long")).limit(0)
    total = np.array([r["w"] for r in found])
    counts = np.random.default_rng(seed).multinomial(size, total / total.sum())
    parts = [(r["_b"], p, int(n * (p + 1) // m - n * p // m)) for r, n in zip(found, counts.tolist()) for m in [max(1, -(-n // draws))] for p in range(m)]
    dealt = rows.join(F.broadcast(df.sparkSession.createDataFrame(parts, "_b long, _p int, _n long")), "_b")  # a few numbers a bucket
    kind = dict(rows.dtypes)["_k"]

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("_k")
        n, rng = table["_n"][0].as_py(), np.random.default_rng([seed, table["_b"][0].as_py(), table["_p"][0].as_py()])
        share, other = alias_table(table["_w"].to_numpy())
        times = np.zeros(len(share), np.int64)
        while n:
            at = rng.integers(0, len(share), min(n, STEP))
            n -= len(at)
            at = np.where(rng.random(len(at)) < share[at], at, other[at])
            times += np.bincount(at, minlength=len(share))
        taken = times > 0
        return pa.table({"_k": table["_k"].filter(pa.array(taken)), "_t": pa.array(times[taken])})

    times = dealt.groupBy("_b", "_p").applyInArrow(draw, f"_k {kind}, _t long").groupBy("_k").agg(F.sum("_t").alias("times"))
    return df.join(times, F.col(key) == F.col("_k")).drop("_k")
