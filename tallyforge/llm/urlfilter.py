"""URL filters: rules, then naive Bayes over segmented host and path tokens.

Rules decide the urls that they fit, the longest rule first, and these urls are the
labelled examples of the model. Host labels are segmented into words by a unigram
Viterbi search over the word frequencies of all page texts; a multinomial naive Bayes
model with add-one smoothing scores the words of the host and the tokens of the path.

Distinct hosts are segmented in blocks. Each block gets, by a shuffle join, the words
that occur in its hosts, whatever their frequency; no task holds all words. A word of
more than ``LONGEST`` letters is found by its first ``LONGEST``.

Every token has its own counts and weight. A url's score is that of its host plus that of
its path, so tokens are looked up for the distinct hosts and paths only: the weights of
the most frequent tokens, ``HEAD_TOKENS`` at most, are sent to the tasks, and the others
join by shuffle, where each is rare. Which tokens are sent changes no result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Letters by which words and parts of hosts are joined.
LONGEST = 24
#: Hosts of a block.
BLOCK_HOSTS = 1024
#: Host and path tables of at most this many rows, and as many weights, are broadcast if they are small.
BROADCAST_ROWS, HEAD_TOKENS = 20_000, 65_536
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What of a page is not text: scripts, styles, comments, tags, entities.
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n) over the whole texts of all pages: runs of ASCII letters, lower case."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), MARKUP, " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Segmenter:
    """Most likely split of a name into words; what no word covers goes letter by letter.

    ``total`` is the number of all words, where ``counts`` has only some of them.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total) - math.log(n) for w, n in counts.items()}
        self.other = math.log(total) + math.log(10)
        self.longest = max(map(len, counts), default=1)

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = best[end - 1] + self.cost.get(name[end - 1], self.other), end - 1
            for a in range(max(0, end - self.longest), end - 1):
                c = self.cost.get(name[a:end])
                if c is not None and best[a] + c < cost:
                    cost, start = best[a] + c, a
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, host: str) -> list[str]:
        """Words of the host's labels, marked h; digits become 0."""
        out = []
        for label in host.split("."):
            for run in re.findall(r"[a-z]+|[0-9]+|[^a-z0-9]+", label):
                out += ["h:" + w for w in self.split(run)] if run.isalpha() and run.isascii() else ["h:0" if run.isdigit() else "h:" + run]
        return out


def path_tokens(path: Column) -> Column:
    """Tokens of the path, marked p; digits become 0."""
    runs = F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), r"[/._\-]+")
    return F.transform(F.filter(runs, lambda t: t != ""), lambda t: F.concat(F.lit("p:"), t))


def tokens_of_blocks(total: int):
    """Rows (block, host, word, n) sorted by block, words before hosts; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, model = None, {}, None
        for batch in batches:
            hosts, found = [], []
            for block, host, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    now, words, model = block, {}, None
                if host is None:
                    words[word] = n
                    continue
                model = model or Segmenter(words, total)
                hosts.append(host)
                found.append(model.tokens(host))
            yield pa.record_batch({"host": pa.array(hosts, pa.string()), "tokens": pa.array(found, pa.list_(pa.string()))})

    return run


def host_tokens(hosts: DataFrame, words: DataFrame, block_hosts: int = BLOCK_HOSTS) -> DataFrame:
    """(host, tokens) of the distinct ``hosts`` by all ``words`` (word, n)."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-hosts.count() // block_hosts))
    placed = hosts.select(F.pmod(F.xxhash64("host"), F.lit(blocks)).alias("block"), "host")
    runs = placed.select("block", F.explode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("run")).distinct()
    rests = runs.select("block", F.explode(F.expr("transform(sequence(1, length(run)), i -> substring(run, i, %d))" % LONGEST)).alias("rest")).distinct()
    parts = rests.select("block", F.explode(F.expr("transform(sequence(1, length(rest)), k -> left(rest, k))")).alias("part")).distinct()
    known = parts.join(words.withColumn("part", F.left("word", F.lit(LONGEST))), "part").select("block", F.lit(None).cast("string").alias("host"), "word", "n")
    rows = known.union(placed.select("block", "host", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n")))
    rows = rows.repartition(min(blocks, max(1, int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block").sortWithinPartitions("block", F.asc_nulls_first("host"))
    return rows.mapInArrow(tokens_of_blocks(total), "host string, tokens array<string>")


def naive_bayes(tokens: DataFrame, urls: tuple[int, int]) -> tuple[DataFrame, float]:
    """``tokens`` (token, blocked, allowed, ...) with the log odds ``w`` of blocking, and the prior's.

    Add-one smoothing over all tokens of the table; ``urls`` are the allowed and blocked examples.
    """
    n, blocked, allowed = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
    odds = F.log((F.col("blocked") + 1) / F.lit(float(blocked + n))) - F.log((F.col("allowed") + 1) / F.lit(float(allowed + n)))
    return tokens.withColumn("w", odds), math.log(urls[1] + 1) - math.log(urls[0] + 1)


def scores(parts: DataFrame, weights: DataFrame, head: int = HEAD_TOKENS) -> DataFrame:
    """(part, score): the sum of the weights (token, n, w) of each part's tokens."""
    floor = common.floor_of(weights, head)
    often = common.small(common.stored(weights.where(F.col("n") >= floor).select("token", "w"), "head"), head)
    found = parts.select("part", F.explode("tokens").alias("token")).join(often, "token", "left")
    near = found.where("w is not null").select("part", "w")
    far = found.where("w is null").select("part", "token").join(weights.where(F.col("n") < floor).select("token", "w"), "token").select("part", "w")
    return near.union(far).groupBy("part").agg(F.sum("w").alias("score"))


def with_score(page: DataFrame, table: DataFrame, parts: DataFrame, column: str, most: int) -> DataFrame:
    """``page`` (part, ...) with the score of ``table`` (part, score) as ``column``, null where it has none.

    A table of few rows is broadcast. Of a larger one the scores of its most frequent parts
    (``parts``: part, n) are, and only pages that do not find theirs join the others by
    shuffle, so the pages of one host never meet in one task.
    """
    scores_of = table.withColumnRenamed("score", column)
    if table.limit(most + 1).count() <= most:
        return page.join(common.small(scores_of, most), "part", "left")
    sized = common.stored(scores_of.join(parts.select("part", "n"), "part"), "sized-scores")
    floor = common.floor_of(sized, most)
    often = common.small(common.stored(sized.where(F.col("n") >= floor).drop("n"), "frequent"), most)
    rest = sized.where(F.col("n") < floor).drop("n")
    near = page.join(often, "part")
    return near.union(page.join(often, "part", "left_anti").join(rest, "part", "left").select(near.columns))


def judge_urls(pages: DataFrame, rules=RULES, block_hosts: int = BLOCK_HOSTS, head: int = HEAD_TOKENS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` (url, html, ...) with a struct ``judged``: host, path, rule, verdict, score.

    Null urls and urls without ``://`` have empty host and path, no rule and the
    prior's verdict; null and empty pages have no words. A tie of the two classes is
    allowed. Repeated rows count and are judged each; very long urls and pages are read
    whole. An empty table gives an empty one. Where ``pages`` has a column ``judged``, the
    new one gets underscores.
    """
    name = common.free_name(pages, "judged")
    both = F.struct(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host_part, path_part = (F.concat(F.lit(mark), column) for mark, column in (("h:", F.col("u.host")), ("p:", F.col("u.path"))))

    # hosts and paths are counted before anything is joined: a frequent one is one row
    verdict = ruled(F.col("u.host"), F.col("u.path"), rules)["verdict"]
    urls = pages.select(both.alias("u")).select(F.explode(F.array(host_part, path_part)).alias("part"), verdict.alias("verdict"))
    parts = urls.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "allow").alias("allowed"))
    parts = common.stored(parts, "parts")
    examples = parts.where(F.col("part").startswith("h:")).agg(F.coalesce(F.sum("allowed"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    hosts = common.stored(parts.where(F.col("part").startswith("h:")).select(F.substring("part", 3, 2**31 - 1).alias("host")), "hosts")
    split = host_tokens(hosts, common.stored(page_words(pages), "words"), block_hosts)
    split = split.select(F.concat(F.lit("h:"), "host").alias("part"), "tokens")
    paths = parts.where(F.col("part").startswith("p:")).select("part", path_tokens(F.substring("part", 3, 2**31 - 1)).alias("tokens"))
    named = common.stored(split.union(paths), "tokens")

    counted = named.join(parts, "part").select(F.explode("tokens").alias("token"), "n", "blocked", "allowed")
    counted = counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
    weights, prior = naive_bayes(common.stored(counted, "counts"), tuple(examples))
    scored = common.stored(scores(named, weights, head), "scores")
    host_scores = common.stored(scored.where(F.col("part").startswith("h:")), "host-scores")
    path_scores = common.stored(scored.where(F.col("part").startswith("p:")), "path-scores")

    page = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), both.alias("u"))
    for column, table, part in (("host_score", host_scores, host_part), ("path_score", path_scores, path_part)):
        page = with_score(page.withColumn("part", part), table, parts, column, broadcast_rows)
    # rounded, as the order of a sum is not fixed
    odds = F.round(F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)), 9)
    rule = ruled(F.col("u.host"), F.col("u.path"), rules)
    final = F.coalesce(rule["verdict"], F.when(odds > 0, F.lit("block")).otherwise(F.lit("allow")))
    return page.select("page.*", F.struct("u.host", "u.path", rule["rule"].alias("rule"), final.alias("verdict"), odds.alias("score")).alias(name))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page's url; see ``judge_urls`` for awkward rows."""
    judged = judge_urls(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")
