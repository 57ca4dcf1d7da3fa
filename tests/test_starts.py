"""Starts at groups of persons, replicates with errors of steps, and bands of graded answers, against plain loops."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_errors import patterns_of, rasch_answers
from test_mixtures import drawn, table
from test_nulls import packed_rows

from scalewright.operators import counts as C
from scalewright.operators import latent as L
from scalewright.operators import mixtures as M
from scalewright.operators import nulls as N

PLANTED = np.array([[0.1, 0.15, 0.2, 0.1, 0.2], [0.8, 0.2, 0.85, 0.15, 0.7], [0.9, 0.95, 0.8, 0.9, 0.85]])


def shares_of(people, n_cat=2):
    counts = np.array([[sum(row[j] == v for row in people) for v in range(n_cat)] for j in range(len(people[0]))], float)
    return M._shares(counts)


def test_cuts_are_quantiles_of_totals(spark):
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (2, 2), (7, 3), (200, 4)):
        people = rng.integers(0, 4, (n, 3)).tolist()
        want = np.quantile([sum(row) for row in people], np.arange(1, k) / k)
        assert np.allclose(M.score_cuts(table(spark, people), k), want)


def test_groups_by_scores_equal_plain_loops(spark):
    people = drawn(PLANTED, 400, missing=0.1)
    shares, tops = shares_of(people)
    got = M.grouped_starts(table(spark, people), "quantiles", shares, tops, 3, 2, seed=5)
    totals = np.array([sum(v or 0 for v in row) for row in people])
    cuts = np.quantile(totals, [1 / 3, 2 / 3])
    for s, tab in enumerate(got):
        move = np.random.default_rng(5 + s).uniform(-0.05, 0.05, (3, 5, 1))[:, :, 0]
        for k in range(3):
            rows = [row for row, t in zip(people, totals) if (t > cuts).sum() == k]
            for j in range(5):
                seen = [row[j] for row in rows if row[j] is not None]
                assert tab[k, j, 1] == pytest.approx(np.clip(np.mean(seen) + move[k, j], 0.01, 0.99))
        assert np.allclose(tab.sum(2), 1)


def test_groups_without_answers_take_a_level(spark):
    people = [[1, 1]] * 9 + [[None, None]]
    tab = M.grouped_starts(table(spark, people), "quantiles", *shares_of(people), 3, 1, seed=1)[0]
    assert tab.shape == (3, 2, 2) and (tab > 0).all() and np.allclose(tab.sum(2), 1)
    one = M.grouped_starts(table(spark, people), "kmeans", *shares_of(people), 1, 1, seed=1)[0]
    assert np.allclose(one[:, :, 1], 0.99)


def test_means_find_planted_clusters_and_fits_start_there(spark):
    people = drawn(PLANTED, 3000, missing=0.02)
    patterns = table(spark, people)
    tab = M.grouped_starts(patterns, "kmeans", *shares_of(people), 3, 1, seed=1)[0]
    again = M.grouped_starts(patterns.repartition(5), "kmeans", *shares_of(people), 3, 1, seed=1)[0]
    assert np.allclose(tab, again)
    assert min(np.abs(tab[list(o), :, 1] - PLANTED).max() for o in permutations(range(3))) < 0.25
    best = M.fit(patterns, "UN", n_classes=3, n_starts=10)
    for kind in ("kmeans", "quantiles"):
        f = M.fit(patterns, "UN", n_classes=3, n_starts=2, starts=kind)
        assert f.loglik == pytest.approx(best.loglik, abs=0.5)
    ordered = M.fit(patterns, "MON", n_classes=3, n_starts=2, starts="quantiles")
    assert (np.diff(ordered.probs[:, :, 1], axis=0) > -1e-8).all() and ordered.loglik > M.fit(patterns, "MON", n_classes=3, n_starts=5).loglik - 0.5
    with pytest.raises(ValueError, match="starts"):
        M.fit(patterns, "UN", starts="best")
    with pytest.raises(ValueError, match="abilities"):
        M.fit(patterns, "LCR", starts="kmeans")


def test_graded_answers_have_starts_at_groups(spark):
    rng = np.random.default_rng(8)
    people = rng.integers(0, 3, (300, 4)).tolist() + [[2, 2, 1, 0]] * 40
    for row in people:
        row[3] = min(row[3], 1)
    shares, tops = shares_of(people, 3)
    for kind in ("quantiles", "kmeans"):
        for tab in M.grouped_starts(table(spark, people), kind, shares, tops, 2, 2, seed=1):
            assert np.allclose(tab.sum(2), 1) and (tab[:, 3, 2] == 0).all() and (tab[:, :3] > 0).all()
        assert M.fit(table(spark, people), "DM", n_starts=2, starts=kind).fall < 1e-9


def test_steps_of_replicates_vary_as_their_errors(spark):
    rng = np.random.default_rng(6)
    steps = [np.array([b]) for b in (-1.0, -0.3, 0.4, 1.0)]
    people = packed_rows(spark, [[*row[:3], row[3] if k % 4 else None] for k, row in enumerate(rasch_answers(500, rng.normal(0, 1.2, 500), steps, rng))]).persist()
    f = M.fit(patterns_of(people), "RM")
    redrawn = L.redrawn_steps(people, f, 30, seed=3)
    assert sorted(redrawn) == list(range(30))
    # One of them by hand.
    provisional = L.marginal_replicates(people, f, 30, 3 + L._PROVISIONAL).where("rep = 7").collect()
    x, freq = np.array([[-1 if v is None else v for v in r["x"]] for r in provisional]), np.array([float(r["freq"]) for r in provisional])
    assert np.allclose(np.concatenate(redrawn[7]), np.concatenate(M.fit_here(x, freq, 2, "RM").steps), atol=1e-6)
    spread = np.std([np.concatenate(redrawn[k]) for k in range(30)], axis=0)
    assert (0.06 < spread).all() and (spread < 0.25).all()

    def easiness(drawn):
        long = drawn.select("rep", "freq", F.posexplode("x").alias("item", "v")).where("v is not null").groupBy("rep", "item").agg((F.sum(F.col("freq") * F.col("v")) / F.sum("freq")).alias("p"))
        return np.array([[r["p"] for r in sorted(rows, key=lambda r: r["item"])] for rows in ([r for r in long.collect() if r["rep"] == k] for k in range(30))])

    plain, varied = easiness(L.marginal_replicates(people, f, 30, 3)), easiness(L.marginal_replicates(people, f, 30, 3, item_errors=True))
    # The variance of the difference of two items is about doubled.
    ratio = np.var(varied[:, 0] - varied[:, 1]) / np.var(plain[:, 0] - plain[:, 1])
    assert 1.2 < ratio < 4
    masks = L.marginal_replicates(people, f, 2, 3, item_errors=True).select("rep", "freq", F.expr("x[3] is null").alias("gone")).groupBy("rep").agg(F.sum(F.when(F.col("gone"), F.col("freq"))).alias("n")).collect()
    assert {r["n"] for r in masks} == {125}
    observed, null = N.cancellation_null(people, patterns_of(people), "double", replicates=4, drawn=L.marginal_replicates(people, f, 4, item_errors=True))
    assert 0 <= observed <= 1 and null.count() > 0


def test_steps_follow_a_free_distribution_off_zero(spark):
    """Refits have abilities of mean zero; the steps come back to where the histogram lies."""
    rng = np.random.default_rng(12)
    steps = [np.array([b]) for b in (-0.5, 0.0, 0.5)]
    people = packed_rows(spark, rasch_answers(800, rng.normal(0, 1, 800), steps, rng))
    f = L.free_latent(patterns_of(people), M.fit(patterns_of(people), "RM"))
    shifted = M.Fit(f.model, f.weights, f.probs, f.loglik, f.n_par, f.n_obs, 1, True, f.theta + 2.0, [d + 2.0 for d in f.steps])
    for law in (f, shifted):
        mean = np.mean([np.concatenate(d) for d in L.redrawn_steps(people, law, 8).values()], axis=0)
        assert np.allclose(mean, np.concatenate(law.steps), atol=0.2)


@pytest.mark.parametrize("order", ["facility", "adjusted"])
def test_bands_of_graded_answers_equal_plain_loops(spark, order):
    rng = np.random.default_rng(3)
    x = [[None if rng.random() < 0.1 else int(v) for v in row] for row in rng.integers(0, 3, (240, 4))] + [[None] * 4]
    r = spark.createDataFrame([(i, j, v) for i, row in enumerate(x) for j, v in enumerate(row)], "person_id long, item_id int, x int")
    columns = [[row[j] for row in x if row[j] is not None] for j in range(4)]
    mean, var = [np.mean(c) for c in columns], [np.var(c, ddof=1) for c in columns]
    score = {}
    for i, row in enumerate(x):
        seen = [j for j in range(4) if row[j] is not None]
        if seen:
            total = sum(row[j] for j in seen)
            score[i] = round(total / len(seen) if order == "facility" else (total - sum(mean[j] for j in seen)) / np.sqrt(sum(var[j] for j in seen)), 9)
    target = max(10, np.ceil(len(score) / max(3, len({sum(v or 0 for v in x[i]) for i in score}))))
    band, held, of = 0, 0, {}
    for s in sorted(set(score.values())):
        of[s] = band
        held += sum(v == s for v in score.values())
        if held >= target and s < max(score.values()):
            band, held = band + 1, 0
    if held < target and band:
        of = {s: min(b, band - 1) for s, b in of.items()}
    want = {}
    for i, s in score.items():
        for j in range(4):
            for k in (1, 2):
                n, right = want.get((of[s], j, k), (0, 0))
                want[of[s], j, k] = (n + (x[i][j] in (k, k - 1)), right + (x[i][j] == k))
    rows = C.polytomous_bands(r, 4, order).collect()
    assert {(q["band"], q["item_id"], q["step"]): (q["n_total"], q["n_right"]) for q in rows} == want
    ability = {b: np.mean([s for s in score.values() if of[s] == b]) for b in set(of.values())}
    assert all(q["ability"] == pytest.approx(ability[q["band"]]) for q in rows) and len(ability) >= 3


def test_bands_of_graded_answers_at_the_edges(spark):
    empty = spark.createDataFrame([], "person_id long, item_id int, x int")
    assert C.polytomous_bands(empty, 4).count() == 0
    none = spark.createDataFrame([(1, 0, None), (2, 1, None)], "person_id long, item_id int, x int")
    assert C.polytomous_bands(none, 4, "adjusted").count() == 0
    with pytest.raises(ValueError, match="order"):
        C.polytomous_bands(none, 4, "best")
