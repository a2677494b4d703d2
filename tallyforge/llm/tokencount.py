"""Token counts of whole texts without their token ids.

No vocabulary piece has a character before a space mark, so a merge never crosses
the start of a run of spaces; nor a line feed where no piece holds one. A text is
therefore cut into pre-tokens there, and its count is the sum over its distinct
pre-tokens of their frequency times their number of pieces.

1. Tasks add up the pre-tokens of their texts, a shuffle merges these sums, and the
   library counts each distinct pre-token of the corpus once. The table is stored.
2. Its most frequent entries, at most ``HEAD``, go to every task; each document sums
   the frequencies of those in place and keeps its others as (key, frequency).
3. The kept ones join the rest of the table by shuffle and are summed per document.

Few words make up most of a text, so the shuffles carry the rare ones alone. A key
is the pre-token, or for a long one its digest, so that what is sent has a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LIMIT = 4096
#: Entries sent to every task (at most 128 bytes of key each, so 34 MB).
HEAD = 262_144
#: Sums a task holds before it hands them on.
TABLE = 400_000
#: Characters from which a pre-token's key is its digest.
LONG = 33
FOUND = "struct<n_bytes:bigint,n_head:bigint,rest:array<struct<key:string,n:bigint>>>"


class Pieces:
    """Pre-tokens of a sentencepiece model and their numbers of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in vocabulary) or any("\n" in p for p in vocabulary):
            raise ValueError("a piece of this model reaches over a space mark or line feed")

    def count(self, words: list[str]) -> list[int]:
        """A leading line feed keeps the model's own space mark apart: two pieces more."""
        return [len(ids) - 2 for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]


CUT = re.compile(r"\n| *[^ \n]+| +")


def pretokens(text: str | None) -> list[str]:
    """The model puts a space mark before a text that isn't empty."""
    return CUT.findall(" " + text.replace("▁", " ")) if text else []


def key(word: str) -> str:
    """Same as ``key_column``; no pre-token but the line feed itself holds one."""
    return word if len(word) < LONG else "\n" + hashlib.sha256(word.encode()).hexdigest()


def key_column(word: Column) -> Column:
    return F.when(F.char_length(word) < LONG, word).otherwise(F.concat(F.lit("\n"), F.sha2(word, 256)))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    sums: Counter = Counter()
    for batch in batches:
        for part in common.pieces(batch.column(0)):
            for text in part.to_pylist():
                sums.update(pretokens(text))
            if len(sums) > TABLE:
                yield out()
                sums.clear()
    yield out()


def vocabulary(docs: DataFrame, text: str, model: str) -> DataFrame:
    """Stored table of every distinct pre-token: ``key``, occurrences ``n`` and ``pieces``."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import public_tokenizers

        pieces = Pieces(public_tokenizers.path(model))
        for batch in batches:
            yield pa.array(pieces.count(batch.to_pylist()), pa.int64())

    words = docs.select(text).mapInArrow(_summed, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return common.stored(words.select(key_column(F.col("word")).alias("key"), "n", counted("word").alias("pieces")), "pretokens")


def count_tokens(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = "piece_bpe_32k.model", head: int = HEAD) -> DataFrame:
    """The columns ``keep`` (all but ``text``; one at least), ``n_bytes`` and ``n_tokens`` of each row.

    ``model`` is the name of a vocabulary file, found on the machine that runs the task.
    ``docs`` is read twice and must give the same texts. Null counts as an empty text: no
    bytes, no tokens. Repeated rows and ties stay apart, very long texts are counted whole; an empty
    table gives an empty one. Where
    ``keep`` has a column of these names, underscores are added to the new ones.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    words = vocabulary(docs, text, model)
    floor = common.floor_of(words, head)
    often = words.where(F.col("n") >= floor).select("key", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(often["key"].to_pylist(), often["pieces"].to_pylist())))

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = known.value
        for batch in batches:
            sizes, heads, keys, ns, ends = [], [], [], [], [0]
            for part in common.pieces(batch):
                for x in part.to_pylist():
                    sizes.append(len((x or "").encode()))
                    total = 0
                    for word, n in Counter(pretokens(x)).items():
                        k = key(word)
                        if k in pieces:
                            total += n * pieces[k]
                        else:
                            keys.append(k)
                            ns.append(n)
                    heads.append(total)
                    ends.append(len(keys))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(ns, pa.int64())], ["key", "n"]))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(heads, pa.int64()), rest], ["n_bytes", "n_head", "rest"])

    parts = common.stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("doc"), found(text).alias("f")), "token-parts")
    known.unpersist()
    rest = parts.select("row", F.explode("f.rest").alias("w")).select("row", "w.key", "w.n")
    rest = rest.join(words.where(F.col("n") < floor).select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_rest"))
    total = F.col("f.n_head") + F.coalesce("n_rest", F.lit(0))
    out = parts.join(rest, "row", "left")
    kept = docs.select(*keep)
    return out.select("doc.*", F.col("f.n_bytes").alias(common.free_name(kept, "n_bytes")), total.alias(common.free_name(kept, "n_tokens")))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document; null and empty texts have none, see ``count_tokens``."""
    docs = count_tokens(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return docs.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
