"""Mentions by a join with a table of aliases, against scans of each text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import relations
from tallyforge.operators import mentions


def plain(text, categories, aliases):
    low, found = (text or "").casefold(), []
    for c in categories:
        for a in aliases.get(c, (c, f"{c}s")):
            found += [(m.start(), m.end(), c, a) for m in re.finditer(rf"(?<!\w){re.escape(a)}(?!\w)", low)]
    taken = []
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
        if not any(m[0] < t[1] and t[0] < m[1] for t in taken):
            taken.append(m)
    return sorted(taken)


def test_the_table_of_categories(spark):
    rng, words = random.Random(4), ["Baseball", "bat", "bats", "glove", "hot", "dog", "dogs", "teddy", "bear", "computer", "mouse", "x", "STOP", "sign", "über", "Straße", "a"]
    texts = [None, "", "doggerel dog-dog hot  dog", *("".join(rng.choice(words) + rng.choice([" ", " ", ", ", "  ", "-"]) for _ in range(rng.randrange(30))) for _ in range(80))]
    order = sorted(mentions.CATEGORY_ALIASES, reverse=True) + ["über", "strasse"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, said string").repartition(3)
    got = mentions.find_mentions(df, ["k"], "said", mentions.alias_table(spark, order)).collect()
    wanted = {(k, *m) for k, t in enumerate(texts) for m in plain(t, order, mentions.CATEGORY_ALIASES)}
    assert {(r["k"], r["start"], r["end"], r["category"], r["alias"]) for r in got} == wanted and len(got) == len(wanted) > 300
    # the form for few categories finds the same
    few = ["hot dog", "dog", "teddy bear"]
    both = df.select("k", F.inline(relations.mentions(F.col("said"), few, {c: list(mentions.CATEGORY_ALIASES[c]) for c in few})))
    joined = mentions.find_mentions(df, ["k"], "said", mentions.alias_table(spark, few))
    assert both.select(joined.columns).exceptAll(joined).count() == joined.exceptAll(both.select(joined.columns)).count() == 0


def test_chains_of_overlaps_and_a_large_table(spark):
    rng = random.Random(5)
    names = [f"n{k}" for k in range(40)]
    aliases = {f"c{k}": tuple(" ".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(20)) for k in range(100)}
    texts = [(k, " ".join(rng.choice(names) for _ in range(200))) for k in range(30)]
    df = spark.createDataFrame(texts, "k int, said string")
    got = mentions.find_mentions(df, ["k"], "said", mentions.alias_table(spark, list(aliases), aliases)).collect()
    assert {(r["k"], r["start"], r["end"], r["category"], r["alias"]) for r in got} == {(k, *m) for k, t in texts for m in plain(t, list(aliases), aliases)}
    with pytest.raises(ValueError):
        mentions.find_mentions(df, ["k"], "said", mentions.alias_table(spark, ["c"], {"c": ("-x",)}))
