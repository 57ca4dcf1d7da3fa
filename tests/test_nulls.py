"""Conditional likelihood, replicates and bootstrap tests against direct enumeration and planted structure."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mixtures import drawn, table

from scalewright.operators import mixtures as M
from scalewright.operators import nulls as N


def packed_rows(spark, answers):
    return spark.createDataFrame([(i, [None if v is None else int(v) for v in row]) for i, row in enumerate(answers)], "person_id long, x array<int>")


def conditional_loglik(answers, steps):
    """Sum over persons of the log probability of their answers given their total, by listing all answers."""
    w = [np.exp(-np.concatenate([[0], np.cumsum(d)])) for d in steps]
    value = 0.0
    for row in answers:
        items = [j for j, v in enumerate(row) if v is not None]
        weight = lambda xs: np.prod([w[j][v] for j, v in zip(items, xs)])
        mine = [row[j] for j in items]
        value += np.log(weight(mine) / sum(weight(xs) for xs in product(*[range(len(w[j])) for j in items]) if sum(xs) == sum(mine)))
    return value


def test_conditional_fit_is_the_best_by_enumeration(spark):
    rng = np.random.default_rng(3)
    answers = [[int(rng.random() < 1 / (1 + np.exp(b - t))) for b in (-1.0, 0.0, 1.2)] + [int(rng.integers(0, 3))] for t in rng.normal(0, 1, 150)]
    for i in range(0, 150, 7):
        answers[i][i % 4] = None
    people = packed_rows(spark, answers)
    patterns = people.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
    steps = N.fit_conditional(patterns)
    flat = np.concatenate(steps)
    assert [len(d) for d in steps] == [1, 1, 1, 2] and flat.sum() == pytest.approx(0, abs=1e-9)
    best = conditional_loglik(answers, steps)
    for k, move in product(range(5), (-0.05, 0.05)):
        near = flat.copy()
        near[k] += move
        assert conditional_loglik(answers, np.split(near, [1, 2, 3])) < best
    with pytest.raises(ValueError):
        N.fit_conditional(table(spark, [[1, 1], [0, 0]]))


def test_conditional_search_ends_where_digits_do(spark, monkeypatch):
    """Graded answers, the last steps of which few take: the search used to go on at the end of the digits."""
    rng = np.random.default_rng(4)
    deltas = [np.array([-1.6, -0.5, -1.2]) + 0.3 * j + np.array([0.0, 0.02, 0.2]) * j for j in range(8)]
    weights = np.exp(np.arange(4) * rng.normal(0.5, 0.6, 4000)[:, None, None] - [np.concatenate([[0], np.cumsum(d)]) for d in deltas])
    upto = np.cumsum(weights, axis=2)
    answers = (rng.random((4000, 8, 1)) * upto[:, :, -1:] >= upto).sum(2)
    people = packed_rows(spark, [[None if rng.random() < 0.02 else v for v in row] for row in answers])
    calls, loss = [], N._conditional_loss
    monkeypatch.setattr(N, "_conditional_loss", lambda *a: calls.append(1) or loss(*a))
    patterns = people.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
    steps = N.fit_conditional(patterns)
    assert len(calls) < 60 and np.abs(np.concatenate(steps) - np.concatenate(deltas) + np.concatenate(deltas).mean()).max() < 0.6
    groups = [(r["mask"], r["total"], r["n"]) for r in N.mask_totals(patterns).collect()]
    whole = loss(groups, steps)
    monkeypatch.setattr(N, "CELLS_AT_ONCE", 1000)
    parts = loss(groups, steps)
    assert parts[0] == pytest.approx(whole[0]) and parts[1] == pytest.approx(whole[1])


@pytest.mark.parametrize("items, top", [(3, 1), (8, 3), (40, 3), (2, 0)])
def test_patterns_are_counted_as_numbers_or_rows(items, top):
    rng = np.random.default_rng(items)
    answers = rng.integers(-1, top + 1, (500, items))
    answers[250:] = answers[:250]
    found, freq = N._counted(answers)
    rows, n = np.unique(answers, axis=0, return_counts=True)
    assert (found == rows).all() and (freq == n).all() and len(N._counted(answers[:0])[0]) == 0


def test_conditional_replicates_keep_masks_and_totals(spark):
    steps = [np.array([-0.5]), np.array([0.3]), np.array([0.2, -0.4])]
    answers = [[1, 0, 1]] * 3000 + [[None, 1, 1]] * 40 + [[0, 0, 0], [1, 1, 2], [None, None, 1], [None, None, None]]
    people = packed_rows(spark, answers)
    rows = N.conditional_replicates(people, steps, 3, seed=5).collect()
    assert {r["rep"] for r in rows} == {0, 1, 2} and sum(r["freq"] for r in rows) == 3 * len(answers)
    kept = N.mask_totals(people.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))).collect()
    for rep in range(3):
        again = {}
        for r in rows:
            if r["rep"] == rep:
                key = "".join("0" if v is None else "1" for v in r["x"]), sum(v or 0 for v in r["x"])
                again[key] = again.get(key, 0) + r["freq"]
        assert again == {(r["mask"], r["total"]): r["n"] for r in kept}
    w = [np.exp(-np.concatenate([[0], np.cumsum(d)])) for d in steps]
    all_of_two = {xs: w[0][xs[0]] * w[1][xs[1]] * w[2][xs[2]] for xs in product(range(2), range(2), range(3)) if sum(xs) == 2}
    for xs, weight in all_of_two.items():
        share = sum(r["freq"] for r in rows if tuple(r["x"]) == xs) / 9000
        assert share == pytest.approx(weight / sum(all_of_two.values()), abs=0.02)
    assert sorted(map(str, rows)) == sorted(map(str, N.conditional_replicates(people.repartition(5), steps, 3, seed=5).collect()))


def test_sets_of_items_are_laid_out_once_for_all_replicates(spark, monkeypatch):
    """Every replicate used to multiply the generating functions of every set of answered items again."""
    rng = np.random.default_rng(5)
    answers, ids = rng.integers(-1, 3, (400, 4)), rng.integers(-(10**12), 10**12, 400)
    steps = [np.array([-0.5, 0.4]), np.array([0.3, 0.1]), np.array([0.2, -0.4]), np.array([0.7, -0.8])]
    weights, masks, made, products = N._step_weights(steps), {tuple(row) for row in answers >= 0}, [], N._products
    monkeypatch.setattr(N, "_replicated", lambda people, replicates, prepare, *more: prepare)
    monkeypatch.setattr(N, "_products", lambda w: (made.append(1), products(w))[1])
    for at_once in (N.CELLS_AT_ONCE, 5 * 4 * 9 * 3):  # the latter holds five sets of items at a time
        monkeypatch.setattr(N, "CELLS_AT_ONCE", at_once)
        made.clear()
        draw = N.conditional_replicates(None, steps, 3, 2)(ids, answers)
        drawn_here = [draw(rep) for rep in range(3)]
        assert at_once < 1000 or len(made) == len(masks)
        for rep, new in enumerate(drawn_here):
            for mask in masks:
                rows, items = np.flatnonzero(((answers >= 0) == mask).all(1)), np.flatnonzero(mask)
                one_by_one = N.given_totals(answers[np.ix_(rows, items)].sum(1), [weights[j] for j in items], lambda place: N._uniform(ids[rows], rep, items[place], 2))  # noqa: B023
                assert (new[np.ix_(rows, items)] == one_by_one).all() and (new[rows][:, ~np.array(mask)] == -1).all()


def test_few_patterns_are_counted_over_the_task(spark, monkeypatch):
    """A replicate used to leave the task once per batch of persons."""
    rng = np.random.default_rng(6)
    people = packed_rows(spark, [[None if v < 0 else v for v in row] for row in rng.integers(-1, 3, (300, 3)).tolist()]).coalesce(1).persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        out = []
        for most in (N.COUNTS_HELD, 0):
            monkeypatch.setattr(N, "COUNTS_HELD", most)
            out.append(sorted(map(str, N.resampled(people, 4).collect())))
        assert out[0] == out[1] and len(out[0]) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        people.unpersist()
    batches = [N.pa.RecordBatch.from_pydict({"k": [k] * 20}) for k in range(5)]
    assert [b.num_rows for b in N._held(iter(batches))] == [100]


def test_model_replicates_follow_the_fit(spark):
    probs = np.array([[0.2, 0.15, 0.3], [0.9, 0.8, 0.85]])
    people = packed_rows(spark, [[1, 1, None]] * 500 + [[0, 0, 0]] * 4000)
    f = M.Fit("UN", np.array([0.3, 0.7]), np.stack([1 - probs, probs], 2), 0.0, 7, 4500, 1, True)
    rows = [r for r in N.model_replicates(people, f, 2).collect() if r["rep"] == 1]
    assert sum(r["freq"] for r in rows if r["x"][2] is None) == 500
    for j in range(2):
        assert sum(r["freq"] * r["x"][j] for r in rows) / 4500 == pytest.approx(0.3 * probs[0, j] + 0.7 * probs[1, j], abs=0.03)


def test_fit_here_equals_fit(spark):
    patterns = table(spark, drawn(np.array([[0.2, 0.15, 0.3, 0.1], [0.9, 0.8, 0.85, 0.75]]), 800))
    rows = patterns.collect()
    x, freq = np.array([r["x"] for r in rows]), np.array([float(r["freq"]) for r in rows])
    for model in ("UN", "DM", "LCR", "RM"):
        assert N.fit_here(x, freq, 2, model, n_starts=3).loglik == pytest.approx(M.fit(patterns, model, n_starts=3).loglik, abs=1e-3)


def test_bootstrap_tests_tell_planted_structure(spark):
    crossed = packed_rows(spark, drawn(np.array([[0.2, 0.8, 0.2, 0.8, 0.5], [0.8, 0.2, 0.8, 0.2, 0.5]]), 800))
    patterns = crossed.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
    low, high = (M.fit(patterns, m, n_starts=3) for m in ("MON", "UN"))
    observed, null = N.likelihood_ratio_test(crossed, patterns, low, high, replicates=19, n_starts=2)
    values = [r["statistic"] for r in null.collect()]
    assert len(values) == 19 and min(values) >= 0 and observed > max(values)
    observed, null = N.ordering_null(crossed, patterns, M.fit(patterns, "IIO", n_starts=2), replicates=19)
    assert null.count() == 19 and observed > 0


def test_cancellation_null_of_rasch_data(spark):
    rng = np.random.default_rng(4)
    answers = [[int(rng.random() < 1 / (1 + np.exp(b - t))) for b in np.linspace(-1, 1, 5)] for t in rng.normal(0, 1, 1200)]
    people = packed_rows(spark, answers)
    patterns = people.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
    observed, null = N.cancellation_null(people, patterns, "double", replicates=3)
    values = [r["statistic"] for r in null.collect()]
    assert len(values) == 3 and all(0 <= v <= 1 for v in [observed, *values])
    # Counts of the observed table, as the counting operators give them.
    rows = patterns.collect()
    total, right = N.counts_of_patterns(np.array([r["x"] for r in rows]), np.array([r["freq"] for r in rows]))
    scores = np.array(answers).sum(1)
    kept = [s for s in range(6) if (scores == s).sum() >= 10]
    order = np.argsort(np.array(answers).sum(0), kind="stable")
    assert total.tolist() == [[(scores == s).sum()] * 5 for s in kept]
    assert right.tolist() == [np.array(answers)[scores == s].sum(0)[order].tolist() for s in kept]
    assert N.violation_rates(spark.createDataFrame([(0, [1, 0, 1], 50)], N.REPLICATE_ROWS)).count() == 0


def test_scores_by_total():
    f = M.Fit("RM", np.ones(1), np.zeros((1, 3, 3)), 0.0, 1, 1, 1, True, np.zeros(1), [np.array([-0.5, 0.5]), np.array([0.2]), np.array([-0.2])], 1.0)
    ml, wle = ({t: (a, s) for t, a, s in M.score_abilities(f, kind)} for kind in ("ML", "WLE"))
    assert ml[0][0] == -np.inf and ml[4][0] == np.inf and wle[0] == (None, None)
    assert ml[2][0] == pytest.approx(0, abs=1e-9) and wle[2][0] == pytest.approx(0, abs=1e-9)
    assert abs(wle[1][0]) < abs(ml[1][0]) and M.step_table(np.array([ml[3][0]]), f.steps, 3)[0] @ np.arange(3) @ np.ones(3) == pytest.approx(3)
