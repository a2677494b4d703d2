"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted regression trees of depth three are grown on a bounded sample of labelled
documents. Every path from a root becomes a rule, a conjunction of comparisons of
statistics. A logistic model with an L1 penalty is fitted on the rules' 0/1 values,
which leaves few of them, and these are compiled into one Spark column expression.
The statistics of each whole text come from one Arrow function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STATS = ("log_words", "word_bytes", "long_words", "upper", "digits", "marks", "bangs", "bars", "symbols", "foreign", "line_words", "distinct", "top_word", "marked_words", "lone_marks", "distinct_lines", "doubled")
KIND = "struct<" + ",".join(f"{s}:double" for s in STATS) + ">"
#: Labelled documents that the model is fitted on at most, those of least hash.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF = 30, 3, 32, 0.3, 5
PENALTY, ROUNDS = 0.002, 400
CUT = 0.3
_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT
_SYMBOL = np.isin(_BYTES, list(b"#$%&*+<=>@\\^_`{}~"))


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of STATS; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = sum(map(len, words))
    letters = max(1, int(counts[_LETTER].sum()))
    frequencies = Counter(words)
    lines = text.split(b"\n")
    marks = b"!#$%&*|~^=+<>"
    return [
        float(np.log1p(n)),
        size / n,
        sum(len(w) > 20 for w in words) / n,
        int(counts[_UPPER].sum()) / letters,
        int(counts[_DIGIT].sum()) / size,
        int(counts[_MARK].sum()) / size,
        int(counts[33]) / n,
        int(counts[124]) / n,
        int(counts[_SYMBOL].sum()) / n,
        int(counts[128:].sum()) / size,
        n / len(lines),
        len(frequencies) / n,
        frequencies.most_common(1)[0][1] / n,
        sum(w[-1] in marks for w in words) / n,
        sum(n for w, n in frequencies.items() if len(w) == 1 and w in marks) / n,
        len(set(lines)) / len(lines),
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ]


@common.arrow_function(KIND)
def text_statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = np.array([statistics(x) for part in common.pieces(batch) for x in common.texts(part)]).reshape(-1, len(STATS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], list(STATS))


def grow(x: np.ndarray, edges: list[np.ndarray], bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: dict, step: np.ndarray) -> None:
    """Split ``rows`` while that gains; put each node's path into ``rules`` and the leaves' values into ``step``.

    A path is a tuple of (statistic, is greater, edge).
    """
    best = (1e-6, None, None)
    g, h = gradient[rows], hessian[rows]
    if depth and len(rows) >= 2 * LEAF:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for k in range(x.shape[1]):
            if len(edges[k]):
                b, size = bins[rows, k], len(edges[k]) + 1
                sums = [np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, None)]
                left = sums[0] ** 2 / (sums[1] + 1)
                right = (g.sum() - sums[0]) ** 2 / (h.sum() - sums[1] + 1)
                gain = np.where((sums[2] >= LEAF) & (len(rows) - sums[2] >= LEAF), left + right - whole, 0)
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
    _, k, cut = best
    if k is None:
        step[rows] = g.sum() / (h.sum() + 1)
        return
    for greater in (False, True):
        longer = (*path, (k, greater, float(edges[k][cut])))
        rules[longer] = None
        grow(x, edges, bins, gradient, hessian, rows[(bins[rows, k] > cut) == greater], longer, depth - 1, rules, step)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    rules: dict = {}
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        grow(x, edges, bins, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, rules, step)
        score += RATE * step
    return list(rules)


def rule_values(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    return np.stack([reduce(and_, [(x[:, k] > e) == greater for k, greater, e in rule]) for rule in rules], 1).astype(float) if rules else np.zeros((len(x), 0))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Intercept and weights of the L1-penalised logistic model, by accelerated proximal steps."""
    scale = np.maximum(r.std(axis=0), 0.05)
    z = np.hstack([np.ones((len(r), 1)), (r - r.mean(axis=0)) / scale])
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(v @ (z.T @ (z @ v))) / len(y) * 1.05)
    w = last = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = w + (t - 1) / u * (w - last)
        g = z.T @ (1 / (1 + np.exp(-np.clip(z @ at, -40, 40))) - y) / len(y)
        new = at - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        w, last, t = new, w, u
    return float(w[0] - (w[1:] / scale * r.mean(axis=0)).sum()), w[1:] / scale


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and weighted rules. One class or no rows: the constant is all there is."""
    if not len(y):
        return 0.0, []
    if y.min() == y.max():
        return (5.0 if y[0] else -5.0), []
    rules = tree_rules(x, y)
    constant, weights = lasso(rule_values(rules, x), y)
    return constant, [(rule, float(w)) for rule, w in zip(rules, weights) if w]


def compiled(model: tuple, stats: str = "stats") -> Column:
    """The model's probability as a column over the struct ``stats``."""
    constant, rules = model
    total = F.lit(constant)
    for rule, weight in rules:
        terms = [F.col(f"{stats}.{STATS[k]}") > e if greater else F.col(f"{stats}.{STATS[k]}") <= e for k, greater, e in rule]
        total = total + F.when(reduce(and_, terms), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """Fit on at most ``sample`` labelled documents outside the held-out fold.

    Labels of one doc_id that differ count as 1; null ids and labels are left out. Where
    rows of a doc_id repeat, the least statistics of them are learned from, once.
    """
    marked = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # bounded by the sample
    found = found.select("doc_id", "quality", text_statistics(F.coalesce("text", F.lit(""))).alias("s")).groupBy("doc_id", "quality").agg(F.min("s").alias("s"))
    rows = found.select("quality", "s.*").collect()
    data = np.array(sorted(tuple(map(float, r)) for r in rows)).reshape(-1, len(STATS) + 1)
    return fit(data[:, 1:], (data[:, 0] > 0).astype(float))


def with_score(docs: DataFrame, model: tuple, name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each whole text.

    Null and empty texts have the statistics of no words, all zero. Equal texts have equal
    scores, repeated rows are scored each, very long texts whole, and an empty table gives
    an empty one. Where ``docs`` has a column ``name``, the new one gets underscores.
    """
    stats, name = common.free_name(docs, "stats"), common.free_name(docs, name)
    return docs.withColumn(stats, text_statistics(F.coalesce("text", F.lit("")))).withColumn(name, compiled(model, stats)).drop(stats)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document; null and empty texts have one too, see ``with_score`` and ``learn``."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of a score below the cut go."""
    name = common.free_name(docs, "score")
    scored = with_score(docs, learn(docs, common.table(spark, sf_dir, "labels")), name)
    return scored.where(F.col(name) >= CUT).drop(name)
