"""Spelling variants, passages and token alignment against plain loops."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import alignment, passages, spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(word):
    return word.encode().lower().decode()


def plain_variants(counts):
    near = {w: {v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and one_edit(w, v)} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        end = w
        while end in form:
            end = form[end]
        out.add((w, form.get(w), end, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_counts(rows, every=97):
    found = Counter()
    for i, text in rows:
        for run in map(lower, LETTERS.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


@pytest.fixture(scope="module")
def noisy():
    """Words with one and two edits, of one and two bytes a letter, some very long."""
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("abcdeéÿ"), rng.integers(4, 9))) for _ in range(60)] + ["lang" * 300, "aaaaaa", "ÀBCDE"]
    out = []
    for word in base:
        for _ in range(6):
            k, c = rng.integers(len(word)), str(rng.choice(list("abzß")))
            edited = (word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :], word[:k] + c + word[k:])[rng.integers(3)]
            out += [edited] * int(rng.integers(1, 12))
        out += [word] * int(rng.integers(3, 40))
    rng.shuffle(out)
    rows = [(i, " ".join(out[k : k + 40])) for i, k in enumerate(range(0, len(out), 40))]
    return [*rows, rows[3], rows[3], (None, "HELLO hello\tHello, hellO×helloo"), (None, "hello Hello"), (7, None), (8, "")]


@pytest.mark.parametrize("every", [97, 3])
def test_variants_equal_a_plain_loop(spark, noisy, every):
    docs = spark.createDataFrame(noisy, "doc_id long, text string")
    counts = plain_counts(noisy, every)
    words = spelling.word_counts(docs, every)
    assert {tuple(r) for r in words.collect()} == set(counts.items())
    assert {tuple(r) for r in spelling.variants(words).collect()} == plain_variants(counts)


def test_all_edits_of_one_word_meet_in_small_buckets(spark):
    """A third and more of all words share each half of theirs with hundreds of others."""
    word = "abcdefgh"
    edits = {word[:k] + c + word[k + j :] for k in range(9) for c in map(chr, range(97, 123)) for j in (0, 1)} | {word[:k] + word[k + 1 :] for k in range(8)}
    counts = {w: 3 + zlib.crc32(w.encode()) % 50 for w in edits | {word}}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(words).collect()} == plain_variants(counts)


def test_chains_end_at_their_root(spark):
    counts = {"a" * (5 + k): 3 * 2**k for k in range(40)}
    out = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["root"] for r in out} == {"a" * 44} and max(r["n_near"] for r in out) == 2


def plain_passages(rows, window=50):
    first, out = {}, Counter()
    key = lambda i: -(2**63) if i is None else i
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            p = tuple(w[k : k + window])
            first[p] = min(first.get(p, key(i)), key(i))
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < key(i) for j in range(k, k + window)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def shared():
    rng = np.random.default_rng(12)
    new = lambda n: [f"w{x}" for x in rng.integers(10**6, size=n)]
    passage, long_text = new(70), new(900)
    rows = []
    for i in range(40):  # 49, 50 and more words in a row, at any place, in any order of ids
        n = int(rng.integers(45, 70))
        at = int(rng.integers(0, 70 - n + 1))
        rows.append((int(rng.integers(1000)), " ".join([*new(rng.integers(0, 40)), *passage[at : at + n], *new(rng.integers(0, 40))])))
    for i in range(40):  # near copies, whose changed words two of them may share
        copy = list(long_text)
        for k in rng.integers(0, 900, 14):
            copy[k] = f"changed{rng.integers(2)}"
        rows.append((2000 + i // 2, "\n\t".join(copy)))
    rows += [(3000, " ".join(["same"] * 400)), (3001, " ".join(["same"] * 120)), (2999, " ".join(["same"] * 49)), (3002, " ".join(long_text)), (3002, " ".join(long_text))]
    rows += [(None, " ".join(passage)), (None, " ".join(passage)), (4000, None), (4001, ""), (4002, " \n "), (4003, "é x " * 60), (4004, "é x " * 60), (4005, "É x " * 60)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"head": 3, "part_bytes": 4000, "shard_bytes": 6000, "few": 2}])
def test_passages_equal_a_plain_loop(spark, shared, limits):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in shared], "doc_id long, text string, owner int, passages string").repartition(5)
    out = passages.dedup_passages(docs, **limits)
    assert out.columns == ["doc_id", "text", "owner", "passages", "passages_"]
    out = out.collect()
    assert Counter((r["doc_id"], r["passages_"]["n_words"], r["passages_"]["n_removed"], r["passages_"]["sha256"]) for r in out) == plain_passages(shared)
    assert all(hashlib.sha256(r["passages_"]["text"].encode()).hexdigest() == r["passages_"]["sha256"] for r in out)


def test_every_equal_window_has_an_equal_phrase():
    rng = np.random.default_rng(2)
    words = rng.integers(2**63, size=300).astype(np.uint64)
    both = np.concatenate([words, rng.integers(2**63, size=17).astype(np.uint64), words])
    assert (passages.phrases(both)[317:] == passages.phrases(words)).all() and len(passages.phrases(words)) == 251
    assert (passages.grams(both, 50)[317:] == passages.grams(words, 50)).all()
    assert len(passages.phrases(words[:49])) == 0


ODD = [None, "", " ", "<|endoftext|> a", "<s> </s> <0x41> <unk>", "x▁y", "  two  spaces ", "tab\tx \ty\t", "\r\n a\r\n\r\nb  c ", "it's we'll 'S", "\U0001f600 é ü 漢字 かな　x", "\x00\x01 \x1f y", "a b   c", "\n", "1234 56,78.9 %%%", "e" * 5000]


def plain_alignment(texts):
    first, second = alignment.load(alignment.FIRST), alignment.load(alignment.SECOND)
    found = []
    for t in texts:
        raw = (" " + t).encode() if t else b""
        a = first.model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.model.encode(t) if t else []
        ends = []
        for ids, side in ((a, first), (b, second)):
            lengths = [len(side.tokens[i]) for i in ids]
            ends.append([sum(lengths[: k + 1]) for k in range(len(ids))])
        if not t or b"".join(first.tokens[i] for i in a) != raw or b"".join(second.tokens[i] for i in b) != raw:
            found.append(None)
            continue
        groups, links, p, q = [], [], 0, 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
            links.append((a[x - 1], b[y - 1]))
            p, q = x, y
        found.append((len(a), len(b), ";".join(groups), links))
    total = Counter(link for f in found if f for link in f[3])
    top = defaultdict(int)
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    return [f and (f[0], f[1], len(f[3]), len(f[3]), sum(total[x] == top[x[1]] for x in f[3]), sum(total[x] for x in f[3]), f[2]) for f in found]


@pytest.mark.parametrize("head", [alignment.HEAD, 3])
def test_alignment_equals_whole_texts(spark, head):
    rng = np.random.default_rng(13)
    letters = list(" \n\t\r　 abcé漢.,'s1<>|")
    texts = [*ODD, *("".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(300))]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, row int")
    wanted = dict(enumerate(plain_alignment([*texts, texts[3], texts[3]])))
    out = alignment.align_tokens(docs, head=head).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        w, f = wanted[r["doc_id"]], r["aligned"]
        assert (f["n_a"], f["n_b"], f["n_groups"], f["n_links"], f["n_best"], f["count_sum"], f["groups"]) == (w or (0, 0, 0, 0, 0, 0, ""))
        assert f["sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w else "")


def test_packed_sets_rank_and_cut():
    rng = np.random.default_rng(3)
    flags = rng.random(1000) < 0.3
    bits = alignment.Bits.of(np.flatnonzero(flags), 1000)
    assert (bits.rank(np.arange(1000)) == np.cumsum(flags)).all() and (bits.places() == np.flatnonzero(flags)).all()
    cuts, a, b = alignment.shared_cuts(np.array([1, 2, 3, 4]), np.array([3, 1, 6]))
    assert (cuts.tolist(), a.tolist(), b.tolist()) == ([3, 10], [2, 4], [1, 3])


def test_the_queries_take_awkward_tables(spark, tmp_path):
    """Whole queries on nulls, ties and repeated rows; empty tables are in the other tests."""
    rows = [(1, "word " * 60, "x"), (2, "word " * 60, "x"), (2, "word " * 60, "x"), (3, None, None), (4, "", ""), (None, "wort " * 60, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    out = passages.op12_passages(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in out) == [(0, 60, 0), (1, 60, 0), (2, 60, 60), (2, 60, 60), (3, 0, 0), (4, 0, 0)]
    assert alignment.op13_alignment(spark, str(tmp_path)).agg(F.count("groups_sha256")).first()[0] == 6
    assert spelling.op11_spelling(spark, str(tmp_path)).count() == 0
