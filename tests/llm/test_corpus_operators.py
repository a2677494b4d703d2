"""Corpus operators on small tables of awkward rows, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, decontaminate, linededup, media, mixing, neardup, quality, secrets, sharding, tokencount, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, hits string, stats int, gone int, media int, mix_plan int"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree in the garden"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))


def awkward(spark):
    """Nulls, empty and long texts, ties, repeats and columns of clashing names."""
    texts = [None, "", " \n\t ", "one", LONG, LONG + " end", PASSAGE, PASSAGE, PASSAGE.upper(), "é" * 40 + "\n" + "é" * 40, "a b c d", "a b c d e f"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, 1, 1.0, "h", 1, 1, 1, 1) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, 1, 1.0, "h", 1, 1, 1, 1), rows[6], rows[6], rows[7]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("bucket", [1 << 30, 300_000, 50])
def test_sharding_is_a_balanced_permutation(spark, bucket):
    df = awkward(spark)
    out = sharding.shuffle_into_shards(df, 5, bucket_bytes=bucket)
    assert out.columns == [*df.columns, "shard_", "slot"]
    rows = out.collect()
    assert sorted(key(r[:-2]) for r in rows) == sorted(map(key, df.collect()))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard_"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shuffle_into_shards(empty(spark), 5).count() == 0


def test_sharding_splits_a_hot_row_and_agrees_with_itself(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"))
    out = [sorted(map(tuple, sharding.shuffle_into_shards(df, 4, bucket_bytes=800).collect())) for _ in range(2)]
    assert out[0] == out[1] and Counter(r[1] for r in out[0]) == {k: 750 for k in range(4)}


def plain_targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("block", [10_000_000, 200])
def test_mixing_meets_targets(spark, block):
    data = [(i, "w " * (1 + i * 7 % 23), None if i % 11 == 0 else f"s{i % 5}") for i in range(900)] + [(900, None, "empty"), (901, "", "empty")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    run = lambda: mixing.mix(df, F.col("source"), mixing.words_of(F.col("text")), [F.col("doc_id")], block_words=block).collect()
    rows = run()
    assert sorted(map(key, rows)) == sorted(map(key, run())) and len(rows) == len(data)
    sizes, taken = Counter(), Counter()
    for r in rows:
        n = len(re.findall(common.WORD, r["text"] or ""))
        assert r["mix"]["size"] == n and r["mix"]["taken"] in (0, n, 2 * n) and len(r["mix"]["shards"]) == r["mix"]["copies"]
        sizes[r["source"]] += n
        taken[r["source"]] += r["mix"]["taken"]
    wanted = plain_targets(sizes)
    for r in rows:
        assert r["mix"]["source_size"] == sizes[r["source"]] and r["mix"]["target"] == pytest.approx(wanted[r["source"]])
    assert all(abs(taken[s] - wanted[s]) <= 23 for s in sizes)


def test_mixing_tree_has_exact_shares_and_awkward_rows(spark):
    for shards in (16, 7, 1):
        leaves = sorted(mixing.split_tree(spark.createDataFrame([([112, 0, 900, 108],)], "counts array<bigint>"), shards).collect())
        assert [r["shard"] for r in leaves] == list(range(shards))
        assert all(abs(sum(r["counts"]) - 1120 / shards) <= 2 for r in leaves)
        at = [0, 0, 0, 0]
        for r in leaves:  # disjoint ranges, one after the other, up to the quotas
            assert r["starts"] == at and min(r["counts"]) >= 0
            at = [a + n for a, n in zip(at, r["counts"])]
        assert at == [112, 0, 900, 108]
    got = mixing.stage(spark, awkward(spark), "")
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", ")
    assert got.count() > 0 and mixing.stage(spark, empty(spark), "").count() == 0


def test_secrets_match_the_patterns(spark):
    texts = [None, "", "token=secret: abcdefghijklmnop", 'api_key = "ABCDEFGHIJKL" x password:abc', "AKIA" + "A1" * 9, "é\U0001f600 " + "0af" * 9 + "z" + "b" * 16, "TOKEN='x" + "y" * 30, "id 123e4567-e89b-12d3-a456-426614174000 ok", "key q7Rk2LxP9vTzW4mNc8Yb" "s", "a" * 60, LONG]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, base_spans int, extra_spans int")
    rows = {r["doc_id"]: r for r in secrets.find_secrets(df).collect()}
    assign = re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [tuple(s) for s in rows[i]["secrets"] if s["k"] < 3] == sorted(spans), t[:80]
        assert rows[i]["base_spans"] == 1
    assert [s["k"] for s in rows[8]["secrets"]] == [3] and not [s for s in rows[7]["secrets"] if s["k"] == 3]
    word = "q7Rk2LxP9vTzW4mNc8YbaaaaabQ1"
    plain = max(-sum(c / 20 * np.log2(c / 20) for c in Counter(word[i : i + 20]).values()) for i in range(len(word) - 19))
    assert spark.range(1).select(secrets.window_entropy(F.lit(word))).first()[0] == pytest.approx(plain)


def test_hypergeometric_draws_have_the_right_law(spark):
    from math import comb

    for total, marked, drawn in ((50, 20, 10), (30, 29, 15), (9, 4, 9), (7, 0, 3), (40, 40, 13)):
        column = mixing.hypergeometric(*[F.lit(x).cast("long") for x in (total, marked, drawn)], mixing.uniform(F.col("id")))
        found = Counter(r["k"] for r in spark.range(20_000).select(column.alias("k")).collect())
        for k in range(drawn + 1):
            p = comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) if k <= marked else 0
            assert abs(found[k] - 20_000 * p) <= 5 * (20_000 * p * (1 - p)) ** 0.5 + 1e-6, (total, marked, drawn, k)
    big = mixing.hypergeometric(F.lit(10**9), F.lit(4 * 10**8), F.lit(10**7), mixing.uniform(F.col("id")))
    drawn = [r["k"] for r in spark.range(40).select(big.alias("k")).collect()]
    assert all(abs(k - 4_000_000) < 6 * 1550 for k in drawn) and len(set(drawn)) > 30


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    df = spark.createDataFrame([(i, 1 + i % 9, f"s{i % 3}") for i in range(600)], "doc_id long, size long, source string")
    run = lambda: mixing.mix(df, F.col("source"), F.col("size"), [F.col("doc_id")], block_words=50).select("mix.copies", "mix.shards").collect()
    whole = sum(r["copies"] for r in run())
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: tree(*a).where("shard < 8"))
    rows = run()
    assert 0.4 * whole < sum(r["copies"] for r in rows) < 0.6 * whole and {s for r in rows for s in r["shards"]} == set(range(8))


def found_by_entropy(spark, words):
    df = spark.createDataFrame([(i, f"see {w} here") for i, w in enumerate(words)], "doc_id int, text string")
    rows = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.find_secrets(df).collect()}
    return [rows[i] == [(4, 3, 4 + len(w))] for i, w in enumerate(words)]


def test_labels_do_not_hide_hex_secrets(spark):
    rng = np.random.default_rng(1)
    draw = lambda n: "".join(rng.choice(list("0123456789ABCDEF"), n))
    labelled = [f"{label}{draw(n)}" for label, n in (("k=", 32), ("sig=", 32), ("KEY_", 32), ("id-", 40)) for _ in range(25)]
    assert sum(found_by_entropy(spark, labelled)) >= 98
    assert not any(found_by_entropy(spark, ["k=" + "0" * 31 + "A", "KEY_" + "AB12" * 8, "deadbeef-cafe-" + "1" * 24]))


def test_what_is_left_around_base_spans_is_scanned(spark):
    text = "é sess_0123456789abcdef-Q7rkLxP9vTzW4mNc8Yb5Jd token=abcdefghijkl0123 end"
    rows = secrets.find_secrets(spark.createDataFrame([(text,)], "text string")).first()["secrets"]
    found = {(r["k"], text[r["s"] : r["e"]]) for r in rows}
    assert found == {(2, "0123456789abcdef"), (3, "-Q7rkLxP9vTzW4mNc8Yb5Jd"), (0, "token=abcdefghijkl0123")}
    many = "x " + "AKIA" + "A" * 14 + " é "
    rows = secrets.find_secrets(spark.createDataFrame([(many * 1000,)], "text string")).first()["secrets"]
    assert [(r["s"], r["e"]) for r in rows] == [(2 + len(many) * k, 20 + len(many) * k) for k in range(1000)]
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_slashes_and_labels_do_not_hide_base64_secrets(spark):
    rng = np.random.default_rng(2)
    draw = lambda n: "".join(rng.choice(list(secrets.ALPHABET[:64]), n))
    keys = [k for k in (draw(86) + "==" for _ in range(400)) if k.count("/") >= 3][:30] + ["/" + draw(39) for _ in range(30)]
    keys += [f"sample_db_key={draw(40)}" for _ in range(20)]
    assert len(keys) == 80 and sum(found_by_entropy(spark, keys)) >= 78
    paths = ["/usr/lib/python3/site-packages/numpy/core", "src/main/java/org/Example/UserService2", "/var/log/2024/11/26/server-01/access", "PATH=/opt/tools/bin/v2/share"]
    assert not any(found_by_entropy(spark, [*paths, "db_key=sampleQ7rkLxP9vTzW4mNc8Yb5Jd"]))


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, "", " ", "\n", "a  b\n\n c", "▁x ▁", "<s> </s> <unk>\t\x00", "  \n  end ", "é\U0001f600漢字" * 3, LONG, "x" * 5000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    for head in (0, 3, 1 << 18):  # all, most or none of the words join by shuffle
        rows = {r["doc_id"]: r for r in tokencount.count_tokens(df, head=head).collect()}
        assert rows[0].asDict().keys() == {"doc_id", "n_tokens", "n_bytes", "n_tokens_"} and len(rows) == len(texts)
        for i, t in enumerate(texts):
            assert (rows[i]["n_bytes"], rows[i]["n_tokens_"]) == (len((t or "").encode()), len(model.encode(t or ""))), repr(t)[:60]
    repeated = awkward(spark)
    assert sorted(r[0] for r in tokencount.count_tokens(repeated, keep=["text"]).select("n_tokens").collect()) == sorted(len(model.encode(r["text"] or "")) for r in repeated.collect())
    assert tokencount.count_tokens(empty(spark)).count() == 0


def plain_classes(texts):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    shingle, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = shingle[i], shingle[j]
            if (texts[i] or "") == (texts[j] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    out = defaultdict(set)
    for i in range(len(texts)):
        out[find(i)].add(i)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("group_rows,most", [(512, 100_000), (4, 100_000), (4, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group_rows, most):
    monkeypatch.setattr(neardup, "GROUP_ROWS", group_rows)  # groups whole, in parts, and without a table of the crowded
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(3)
    texts = [None, "", "a", "a b", "A b", "one two three four", "one two three four", LONG, LONG + " end"]
    for n in (40, 80, 200):
        base = [f"t{n}w{i}" for i in range(n)]
        for k in range(40):  # more and more edits, so that some copies link only to others than the first
            words = list(base)
            for at in rng.integers(0, n, k * n // 300):
                words[at] = f"e{rng.integers(5)}"
            texts.append(" ".join(words))
    texts += ["rep " * 300, "rep " * 310, " ".join(["x y z"] * 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = defaultdict(set)
    for r in neardup.near_duplicates(df).collect():
        found[r["class_id"]].add(r["doc_id"])
    assert {frozenset(v) for v in found.values()} == plain_classes(texts)
    assert all(k == min(v) for k, v in found.items())


def test_near_duplicates_with_differing_repeats_equal_brute_force(spark):
    texts = []
    for k in range(20):
        words, line = " ".join(f"b{k}w{i}" for i in range(200)), " " + " ".join(f"l{k}x{i}" for i in range(12))
        texts += [words + line, words + line * (10, 20, 50, 100)[k % 4], words + line * 3 + " " + words]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = defaultdict(set)
    for r in neardup.near_duplicates(df).collect():
        found[r["class_id"]].add(r["doc_id"])
    assert {frozenset(v) for v in found.values()} == plain_classes(texts) and len(found) == 20


def test_near_duplicate_blocks_give_the_same_links():
    rng = np.random.default_rng(5)
    rows = [(bytes([i]), bytes([i]), " ".join(f"w{j if rng.random() > 0.03 else 1000 + j}" for j in range(60)).encode()) for i in range(30)]
    links = {frozenset(x) for x in neardup.block_links(rows, rows)}
    plain = {frozenset((a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and neardup.similarity([a[2]], [b[2]])[0] >= 0.8}
    assert links == plain and links


def test_prob_minhash_estimates_probability_jaccard():
    e = np.arange(1, 61, dtype=np.uint64)
    wa, wb = np.where(e < 40, 3.0, 1.0), np.where(e < 20, 1.0, 2.0)
    doc = np.repeat([0, 1], 60)
    r = neardup.prob_minhash(doc, np.concatenate([e, e]), np.concatenate([wa, wb]), 2, 4096)
    exact = sum(1 / sum(max(wa[y] / wa[x], wb[y] / wb[x]) for y in range(60)) for x in range(60))
    assert (r[0] == r[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicate_stage_keeps_one_of_each(spark):
    df = awkward(spark)
    kept = neardup.stage(spark, df, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["0", "2", "3", "4", "6", "9", "10", "11", "None"])
    assert neardup.stage(spark, empty(spark), "").count() == 0


def test_decontamination_equals_brute_force(spark):
    item = PASSAGE
    edited = item.replace("quick", "quikc").replace("owls", "owl")
    torn = item[:50]
    texts = [None, "", item, "x " + item.upper().replace(" ", "\n") + " y", "pre " + edited + " post", torn, "pre " + item[5:] + " z", "nothing here", LONG + " " + edited]
    lost = "an item without a number is searched as well as all the others are"
    texts += [f"({lost})", f"in{item}side", item + item[-6:], f"{lost}. {item}", f"x{edited}y"]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, lost), (4, "some other item that occurs nowhere in them"), (5, "one"), (6, " ".join(f"zq{i}" for i in range(2000)))], "item_id long, text string")

    def distance(p, t):
        t, row = f" {t} ", [0] * (len(t) + 3)
        for i, a in enumerate(f"\0{p}\0", 1):  # an edge is any character but a letter or digit
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (b.isalnum() if a == "\0" else a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for block in (1 << 20, 6000):
        got = decontaminate.with_hits(docs, bench, block_bytes=block).collect()
        assert len(got) == len(texts)
        rows = {r["doc_id"]: [(h["item_id"], h["distance"]) for h in r["hits_"]] for r in got}
        for i, t in enumerate(texts):
            wanted = [(n, distance(p, decontaminate.plain(t)[-400:]) if t else 999) for n, p in ((None, lost), (1, item))]
            assert rows[i] == [(n, d) for n, d in wanted if d <= decontaminate.budget(item if n else lost)], (i, texts[i][-200:])
        for r in got:
            plain = decontaminate.plain(r["text"])
            for h in r["hits_"]:
                assert h["distance"] or plain[h["start"] : h["end"]] == (item if h["item_id"] else lost)
                assert abs(h["end"] - h["start"] - len(item if h["item_id"] else lost)) <= 8
    repeated = decontaminate.with_hits(docs.union(docs), bench, block_bytes=6000).groupBy("doc_id").count().collect()
    assert {r["count"] for r in repeated} == {2}
    assert decontaminate.with_hits(empty(spark), bench.limit(0)).count() == 0
    # items without an edit to spare are found as they are
    short = decontaminate.with_hits(docs.union(spark.createDataFrame([(999, "well the answer is 42 ok", "h")], docs.schema)), spark.createDataFrame([(1, "the answer is 42"), (2, "cat"), (3, " \n")], "item_id long, text string")).collect()
    edged = lambda item, t: re.search(rf"(?<!\w){item}(?!\w)", decontaminate.plain(t).replace("_", " "))
    for r in short:
        assert [h["item_id"] for h in r["hits_"]] == [n for n, item in ((1, "the answer is 42"), (2, "cat")) if edged(item, r["text"])]
    assert [h["item_id"] for r in short if r["doc_id"] == 999 for h in r["hits_"]] == [1]


def test_decontamination_at_word_edges():
    find = lambda item, text: [h[1:] for h in decontaminate.Matcher([(1, item)], 1).find(text)]
    assert find("cat", "concatenate a category") == [] and find("cat", "a (cat)!") == [(0, 3, 6)] and find("cat", "cat") == [(0, 0, 3)]
    item = "a sentence of some thirty characters"
    assert find(item, f"x{item}") == [(1, 1, len(item) + 1)] and find(item, f"x{item}y") == []
    assert find(item, item.replace("some ", "some  ")) == [(0, 0, len(item))]


def test_line_dedup_equals_plain(spark):
    line = "a repeated line of some length"
    texts = [None, "", line, "x\n  " + line.upper() + "\t\ny", line + "\n" + line, "é" * 19, "é" * 19, "é" * 19, "ß" * 20, "ß" * 20 + "\r", "ß" * 20, LONG, LONG, LONG]
    texts += [f"line number {k % 7} of those that some have\nand a line of only one, {k}" for k in range(20)]
    two = "a line of two documents in three rows"
    rows = [*enumerate(texts), (-1, line), (100, two), (100, two), (101, two)]
    docs = spark.createDataFrame([(None if i < 0 else i, t, 1) for i, t in rows], "doc_id long, text string, gone int")
    ids, lines = defaultdict(set), defaultdict(list)
    for n, (i, t) in enumerate(rows):
        keys = [x.strip(common.BLANKS).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
        lines[n] = list(zip((t or "").split("\n"), keys))
        for k in {k for k in keys if len(k) >= 20}:
            ids[k].add(i)
    wanted = Counter()
    for n, (i, t) in enumerate(rows):
        kept = [x for x, k in lines[n] if len(ids[k]) < 3 or i == max(ids[k])]
        wanted[(i, "\n".join(kept), len(lines[n]), len(lines[n]) - len(kept))] += 1
    for head, keys in ((1 << 20, 20_000), (0, 3), (100, 20_000)):  # all hashes in the head, none, some
        found = linededup.dedup_lines(docs, head_bytes=head, shard_keys=keys).collect()
        assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["lines"]["text"], r["lines"]["n_lines"], r["lines"]["n_dropped"]) for r in found) == wanted, head
        assert all(r["lines"]["sha256"] == hashlib.sha256(r["lines"]["text"].encode()).hexdigest() and r["gone"] == 1 for r in found)
    for head in (1 << 20, 0):
        assert linededup.dedup_lines(empty(spark), head_bytes=head).count() == 0
    assert linededup.dedup_lines(awkward(spark).withColumn("lines", F.lit(1))).select("lines", "lines_.n_lines").count() == awkward(spark).count()


def test_minimal_perfect_hash_fills_its_slots():
    a = linededup.mixed(np.arange(5000, dtype=np.uint64))
    for b in (a[::-1].copy(), a):
        seed, d = linededup.build(a, b)
        place = linededup.places(a, b, seed)
        at = linededup.slots(place, d[(place % np.uint64(len(d))).astype(np.int64)], len(place))
        assert sorted(at) == list(range(5000))


def test_hashes_of_one_half_are_told_apart():
    a, b = np.array([7, 7, 7, 9, 9], np.uint64), np.array([1, 2, 3, 1, 2], np.uint64)
    seed, d = linededup.build(a, b)
    place = linededup.places(a, b, seed)
    at = linededup.slots(place, d[(place % np.uint64(len(d))).astype(np.int64)], 5)
    prints, counts, most = np.zeros(5, np.uint64), np.zeros(5, np.uint32), np.zeros(5, np.int64)
    prints[at], counts[at], most[at] = b, [2, 3, 4, 5, 6], [10, 20, 30, 40, 50]
    shard = linededup.Shard(seed, d.tobytes(), prints.tobytes(), counts.tobytes(), most.tobytes())
    assert [x.tolist() for x in shard.probe(a, b)] == [[2, 3, 4, 5, 6], [10, 20, 30, 40, 50]]
    assert shard.probe(a, b + np.uint64(100))[0].tolist() == [1] * 5


def test_media_round_trip(spark):
    df = awkward(spark)
    for r in media.with_media(df).collect():
        t = (r["text"] or "").encode()
        payload = t + b"\xff" * (576 - len(t) if len(t) < 576 else -len(t) % 576)
        m = r["media_"]
        assert (m["n_bytes"], m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        frames, fps = media.read_avi(m["media"])
        assert media.decode_frames(frames).tobytes() == payload and fps == 25
        assert media.decode_block_frame(*media.split_frame(frames[0]))[::8, ::8].tobytes() == payload[:576]
        clips = [(c["first"], c["end"]) for c in m["clips"]]
        assert clips[0][0] == 0 and clips[-1][1] == len(frames) and all(a[1] == b[0] for a, b in zip(clips, clips[1:]))
    assert media.clip_rows(empty(spark)).count() == 0


def test_every_byte_difference_and_shots():
    rng = np.random.default_rng(0)
    frames = rng.integers(0, 256, (50, 576), np.uint8)
    assert (media.decode_frames(media.encode_frames(frames)) == frames).all()
    still = np.concatenate([np.full((9, 576), 10, np.uint8), np.full((7, 576), 200, np.uint8)])
    assert media.shots(still) == [(0, 9), (9, 16)]


def test_a_frame_with_ac_terms_is_decoded():
    head = media.jpeg_head([8] + [4] * 63, (bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))), (bytes([0, 2] + [0] * 14), bytes([0, 2])), 8, 8)
    # DC category 3, value 5; AC run 0 size 2, value 3 at the first place; end of block
    bits = "0011" + "101" + "01" + "11" + "00"
    data = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    x = np.arange(8)
    wave = 0.5 * np.sqrt(1 / 8) * 12 * np.cos((2 * x + 1) * np.pi / 16) + 40 / 8 + 128
    assert (media.decode_block_frame(head, data) == np.tile(np.rint(wave), (8, 1))).all()
    frame = head + data + b"\xff\xd9"
    assert media.decode_frames([frame])[0, 0] == int(np.rint(wave[0]))


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/1?x#y", "http://a.example.net/de/", "x://net", "x://net/", "x://anet/", "http://example.com/de/1://2", "http://b.org/fr/?q", "http://org?fr/", "http://free-pills.example.com/buy/1\n2"]
    df = spark.createDataFrame([(i, u, "<title>free pills</title>", 1) for i, u in enumerate(urls)], "page_id int, url string, html string, odds int")
    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    for r in urlfilter.judge_urls(df).collect():
        u, j = r["url"], r["judged"]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = max((k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)), key=len, default=None)
        assert (j["host"], j["path"], j["rule"]) == (host, path, fit)
        assert j["verdict"] == rules[fit][2] if fit else j["verdict"] in ("allow", "block")
    assert urlfilter.judge_urls(df.limit(0)).count() == 0
    model = urlfilter.Segmenter({"cheap": 50, "pills": 40, "che": 2, "ap": 2})
    assert model.split("cheappills") == ["cheap", "pills"] and model.split("") == [] and model.split("zq") == ["z", "q"]


def test_rare_and_long_title_words_split_hosts(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rare, long = "zzyzx", "donaudampfschifffahrtsgesellschaft"
    titles = [" ".join(name(i) for i in range(k, 50_100, 30)) for k in range(30)] * 2 + [f"{rare} {long}"]
    pages = spark.createDataFrame([(f"http://{rare}{name(7)}.a{long}{rare}.{i % 7}q.com/", f"<title>{t}</title>") for i, t in enumerate(titles)], "url string, html string")
    words = common.stored(urlfilter.page_words(pages), "words")
    counts = {r["word"]: r["n"] for r in words.collect()}
    assert len(counts) == 50_102 and counts[long] == 1
    hosts = common.stored(pages.select(urlfilter.host_of(F.col("url")).alias("host")).distinct(), "hosts")
    model = urlfilter.Segmenter(counts)
    assert model.split(f"a{long}{rare}") == ["a", long, rare]
    for block in (2, 100):
        rows = {r["host"]: r["tokens"] for r in urlfilter.host_tokens(hosts, words, block).collect()}
        assert rows == {r["host"]: model.tokens(r["host"]) for r in hosts.collect()}
    assert urlfilter.judge_urls(pages).count() == len(titles)


def test_page_words_are_those_of_the_text(spark):
    html = "<title>Free pills</title><script type=x>var hidden = '</p>';</script><!-- no > note --><p class='tag'>free &amp; <b>new</b>s</p><style>p{}</style>"
    pages = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert {r["word"]: r["n"] for r in urlfilter.page_words(pages).collect()} == {"free": 2, "pills": 1, "new": 1, "s": 1}


def test_url_scores_equal_plain_naive_bayes(spark):
    urls = [f"http://{h}.{d}/{p}/{i}" for i, (h, d, p) in enumerate((h, d, p) for h in ("cheappills", "news", "m.blog") for d in ("net", "example.net", "b.org", "free.com") for p in ("en", "fr", "buy-now"))]
    urls += ["http://cheappills.com/buy-now/1"] * 40 + [None, "x", "http://" + "pills" * 400 + ".com/" + "en/" * 2000]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills news blog free example</p>") for i, u in enumerate(urls)], "page_id int, url string, html string")
    model = urlfilter.Segmenter({w: len(urls) for w in ("cheap", "pills", "news", "blog", "free", "example")})
    split = lambda p: ["p:" + t for t in re.split(r"[/._\-]+", re.sub("[0-9]+", "0", p)) if t]
    fits = lambda h, p: [(len(d + q), v) for v, d, q in urlfilter.RULES if (h == d or h.endswith("." + d)) and p.startswith(q)]
    seen, counts, n = set(), {"block": Counter(), "allow": Counter()}, Counter()
    rows = []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (m[1].lower(), m[2]) if m else ("", "")
        tokens = model.tokens(h) + split(p)
        if not h:
            tokens = split(p)
        seen |= set(tokens)
        fit = max(fits(h, p), default=None)
        if fit:
            counts[fit[1]].update(tokens)
            n[fit[1]] += 1
        rows.append(tokens)
    odds = lambda t: np.log((counts["block"][t] + 1) / (counts["block"].total() + len(seen))) - np.log((counts["allow"][t] + 1) / (counts["allow"].total() + len(seen)))
    for head in (1 << 16, 3, 0):
        found = {r["page_id"]: r["judged"] for r in urlfilter.judge_urls(pages, block_hosts=2, head=head).collect()}
        assert len(found) == len(urls)
        for i, tokens in enumerate(rows):
            wanted = np.log(n["block"] + 1) - np.log(n["allow"] + 1) + sum(map(odds, tokens))
            assert found[i]["score"] == pytest.approx(wanted, abs=1e-6), urls[i]
            if found[i]["rule"] is None:
                assert found[i]["verdict"] == ("block" if found[i]["score"] > 0 else "allow")


def test_quality_learns_rules_and_handles_awkward_rows(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 60}" for j in range(40))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"word{(i + j) % 60}***" for j in range(40))) for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (5, None), (6, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    rows = quality.with_score(docs, model).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] < 1000) for r in rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert model[1] and len(model[1]) < 60
    out = quality.with_score(awkward(spark), model)
    assert out.columns[-1] == "score_" and out.where("score_ is null").count() == 0
    assert quality.with_score(empty(spark), quality.learn(empty(spark), labels.limit(0))).count() == 0


def test_pipeline_runs_on_the_small_tables(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = common.stored(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        assert after.exceptAll(docs).count() == 0 and 0.5 * docs.count() < after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == {*docs.columns, "shard", "slot"} and out.count() > 0
