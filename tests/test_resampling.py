"""Bootstraps against plain loops of one generator, and weighted draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluation, metrics, resampling

ROUNDS = 200


def interval(found):
    found = sorted(found)
    return found[int(ROUNDS * 0.025)], found[int(ROUNDS * 0.975) - 1]


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(8)
    out = [(k, str(rng.choice(["a", "b"])), float(rng.normal()), bool(rng.random() < 0.6), bool(rng.random() < 0.5)) for k in range(700)]
    return [*out, (900, "one", 3.0, True, True), (901, "none", None, True, None), (902, "a", None, False, None)]


@pytest.mark.parametrize("limits", [{}, {"block": 60, "draws": 9_000}])
def test_bootstrap_equals_a_loop(spark, scored, limits):
    df = spark.createDataFrame(scored, "k long, g string, v double, t boolean, p boolean").repartition(5)
    known = df.where("v is not null")
    got = {r["g"]: r for r in resampling.bootstrap(known, ["g"], "k", {"x": F.col("v")}, F.col("x") / F.col("n"), ROUNDS, 42, **limits).collect()}
    assert set(got) == {"a", "b", "one"} and got["one"]["value"] == 3.0 and got["one"]["ci_lower"] is None
    for g in "ab":
        x = np.array([r[2] for r in scored if r[1] == g and r[2] is not None])
        draw = np.random.RandomState(42)
        assert (got[g]["ci_lower"], got[g]["ci_upper"]) == pytest.approx(interval([x[draw.randint(0, len(x), len(x))].mean() for _ in range(ROUNDS)]))
        assert got[g]["value"] == pytest.approx(x.mean()) and got[g]["n"] == len(x)


def test_bootstraps_of_means_and_f1(spark, scored):
    df = spark.createDataFrame(scored, "k long, g string, v double, t boolean, p boolean")
    means = {r["g"]: r for r in metrics.bootstrap_mean(df, "v", "k", "g", ROUNDS).collect()}
    assert set(means) == {"a", "b", "one", "none"} and means["none"]["mean"] is None
    f1 = {r["g"]: r for r in evaluation.bootstrap_f1(df, "t", "p", "k", "g", ROUNDS).collect()}
    rows = [(r[3], bool(r[4])) for r in scored if r[1] == "a"]
    t, p = np.array(rows).T
    draw, found = np.random.RandomState(42), []
    for _ in range(ROUNDS):
        i = draw.randint(0, len(t), size=len(t))
        hit, wrong = (t[i] & p[i]).sum(), (t[i] ^ p[i]).sum()
        found.append(2 * hit / (2 * hit + wrong) if hit or wrong else 0.0)
    assert (f1["a"]["f1_ci_lower"], f1["a"]["f1_ci_upper"]) == pytest.approx(interval(found))


def test_the_stream_of_draws_is_read_in_steps(monkeypatch):
    values, n = np.arange(50.0)[:, None], 50
    whole = resampling.replicate_sums(values, 0, n, 3, 9, 1)
    monkeypatch.setattr(resampling, "STEP", 7)
    parts = [resampling.replicate_sums(values[a:b], a, n, 3, 9, 1) for a, b in ((0, 20), (20, 50))]
    assert np.allclose(sum(parts), whole)


@pytest.mark.parametrize("n", [2, 5, 64, 1000, 2**32 + 3])
def test_draws_go_on_from_a_state(n, monkeypatch):
    """Words give the generator's own numbers, from the start and from a state within a step."""
    monkeypatch.setattr(resampling, "STEP", 37)
    if n > 2**32:  # no whole replicate of these is drawn
        draws = resampling.Draws(n, 3)
        draws._step()
        own = [int(w) for w in draws.words if w < n]
        assert own == np.random.RandomState(3).randint(0, n, len(own)).tolist()
        return
    own, draws = np.random.RandomState(3), resampling.Draws(n, 3)
    wanted = [own.randint(0, n, n).tolist() for _ in range(6)]
    below = lambda d: [int(w) for words in d.replicate() for w in words if w < n]
    assert [below(draws) for _ in range(6)] == wanted
    for k, state in zip((0, 2, 5), resampling.states(n, [0, 2, 5], 3)):
        assert below(resampling.Draws(n, 3, state)) == wanted[k]


def test_stretches_draw_no_earlier_replicates(monkeypatch):
    """A stretch that has its state makes the words of its own replicates only."""
    made, step = [], resampling.Draws._step
    monkeypatch.setattr(resampling, "STEP", 1024)
    monkeypatch.setattr(resampling.Draws, "_step", lambda self: (made.append(1), step(self)))
    state = resampling.states(5000, [90], 1)[0]
    made.clear()
    values = np.arange(5000.0)[:, None]
    found = resampling.replicate_sums(values, 0, 5000, 90, 92, 1, state)
    assert len(made) < 25
    draw = np.random.RandomState(1)
    wanted = [values[draw.randint(0, 5000, 5000), 0].sum() for _ in range(92)][90:]
    assert found[:, 0] == pytest.approx(wanted)


def test_weighted_draws_are_exact_in_size_and_near_in_rate(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") == 5, 1500.0).when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, 1.0).otherwise(2.5).alias("w"))
    size = 100_000
    for limits in ({}, {"buckets": 7, "draws": 3_000}):
        out = resampling.weighted_draws(df.repartition(6), "id", F.col("w"), size, 9, **limits)
        rows = {r["id"]: r for r in out.collect()}
        assert sum(r["times"] for r in rows.values()) == size and all(r["w"] > 0 for r in rows.values())
        assert {k: r["times"] for k, r in rows.items()} == {r["id"]: r["times"] for r in resampling.weighted_draws(df.repartition(2), "id", F.col("w"), size, 9, **limits).collect()}
        total = 1500 + 1000 + 2.5 * 999
        for ids, weight in (([5], 1500), ([k for k in range(3000) if k % 3 == 1], 1000), ([k for k in range(3000) if k % 3 == 2 and k != 5], 2.5 * 999)):
            p = weight / total
            assert abs(sum(rows[k]["times"] for k in ids if k in rows) - size * p) < 5 * (size * p * (1 - p)) ** 0.5
    with pytest.raises(ValueError):
        resampling.weighted_draws(df.where("w = 0"), "id", F.col("w"), 1, 9)
    assert resampling.weighted_draws(df.limit(0), "id", F.col("w"), 0, 9).count() == 0


def test_an_alias_table_gives_the_weights():
    w = np.array([0.0, 1, 5, 2, 1e-9, 3])
    share, other = resampling.alias_table(w)
    back = share.copy()
    np.add.at(back, other, 1 - share)
    assert back / len(w) == pytest.approx(w / w.sum())
