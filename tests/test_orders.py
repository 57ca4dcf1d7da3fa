"""Constraints and the constrained maximum against grid search, closed forms and the rise of the likelihood."""

from itertools import product

import numpy as np
import pytest
from test_mixtures import table

from scalewright.operators import mixtures as M
from scalewright.operators.orders import Cell, Constraints, OrderedStep, expected_loglik, is_acyclic, ordering, projected, violations


def test_composed_orders():
    both = Constraints(True) & Constraints(item_order=(1, 0))
    assert both == ordering("DM", [1, 0]) and len(both.edges([1, 1], 3)) == 2 * 2 + 3
    assert len(ordering("MON", []).edges([2, 3], 3)) == 2 * 5 and ordering("UN", [0, 1]).edges([1, 1], 2) == []
    assert is_acyclic(both, [1, 1], 3)
    ring = Constraints(pairs=((Cell(0, 0), Cell(0, 1)), (Cell(0, 1), Cell(0, 0))))
    assert not is_acyclic(ring, [1, 1], 1)
    with pytest.raises(ValueError):
        Constraints(item_order=(0, 1)) & Constraints(item_order=(1, 0))
    with pytest.raises(ValueError):
        Constraints(item_order=(0, 0)).edges([1, 1], 1)
    p = np.array([[[0.5, 0.5], [0.2, 0.8]], [[0.7, 0.3], [0.1, 0.9]]])
    assert [(a, b, pytest.approx(d)) for a, b, d in violations(p, Constraints(True))] == [(Cell(0, 0, 1), Cell(1, 0, 1), pytest.approx(0.2))]


@pytest.mark.parametrize("model", ["MON", "IIO", "DM"])
def test_step_equals_grid_search(model):
    rng = np.random.default_rng(3)
    grid = [np.array([a, b, 20 - a - b]) / 20 for a in range(21) for b in range(21 - a)]
    for _ in range(4):
        counts = rng.integers(1, 30, (2, 1 if model == "MON" else 2, 3)).astype(float)
        if model == "DM":
            counts = counts[:, :, :]
        step = OrderedStep(counts.shape, np.full(counts.shape[1], 2), ordering(model, range(counts.shape[1])))
        p = step(counts)
        assert not violations(p, step.constraints, step.tops, 1e-7) and p.sum(2) == pytest.approx(np.ones(p.shape[:2]))
        value = expected_loglik(counts, p)
        if model == "MON":
            tables = (np.array(c)[:, None, :] for c in product(grid, repeat=2))
        else:  # classes one by one for IIO; for DM points near the solution
            tables = []
            for _ in range(3000):
                q = p * np.exp(rng.normal(0, 0.15, p.shape))
                tables.append(q / q.sum(2, keepdims=True))
        best = max((expected_loglik(counts, q) for q in tables if not violations(q, step.constraints, step.tops, 1e-12)), default=-np.inf)
        assert value >= best - 1e-6
        if model == "MON":
            assert value - best < 0.02 * abs(best)


def test_binary_step_equals_isotonic_regression():
    rng = np.random.default_rng(8)
    n = rng.integers(5, 60, (4, 3)).astype(float)
    k = np.round(n * rng.random((4, 3)))
    p = OrderedStep((4, 3, 2), np.ones(3), ordering("MON", []))(np.stack([n - k, k], 2))
    want = M.monotone(k / n, n)
    assert p[:, :, 1] == pytest.approx(want, abs=1e-5)
    order = np.array([2, 0, 1])
    for model, found in (("IIO", M.item_ordered(k / n, order, n)), ("DM", M.doubly_monotone(k / n, n, order))):
        p = OrderedStep((4, 3, 2), np.ones(3), ordering(model, order))(np.stack([n - k, k], 2))
        assert p[:, :, 1] == pytest.approx(found, abs=2e-5)
    pairs = [(i, i + 1) for i in range(3)]
    for j in range(3):
        assert projected(k[:, j] / n[:, j], n[:, j], pairs) == pytest.approx(want[:, j], abs=1e-6)
    # A partial order: one value below two others that aren't compared.
    assert projected([3.0, 1.0, 2.0], [1, 1, 1], [(0, 1), (0, 2)]) == pytest.approx([2.0, 2.0, 2.0])
    assert projected([1.0, 5.0, 0.0], [1, 1, 1], [(0, 1), (0, 2)]) == pytest.approx([0.5, 5.0, 0.5])


def test_empty_cells_and_classes():
    counts = np.zeros((3, 2, 4))
    counts[0, :, 0], counts[2, :, 1] = 5, 7
    for model in ("MON", "IIO", "DM"):
        p = OrderedStep(counts.shape, np.array([3, 2]), ordering(model, [0, 1]))(counts)
        assert np.isfinite(p).all() and p[:, 1, 3].max() == 0 and not violations(p, ordering(model, [0, 1]), [3, 2], 1e-6)


def graded_answers(n, rng):
    theta = rng.choice([-1.5, 0.0, 1.5], n)
    d = np.linspace(-1, 1, 5)
    top = M.step_table(theta, [b + np.array([-0.8, 0.0, 0.8]) for b in d], 4)
    return [[int(rng.choice(4, p=top[i, j])) for j in range(5)] for i in range(n)]


@pytest.mark.parametrize("model", ["MON", "IIO", "DM"])
def test_loglik_never_falls_along_a_graded_fit(model):
    answers = graded_answers(300, np.random.default_rng(2))
    rows, freq = np.unique(np.array(answers), axis=0, return_counts=True)
    seen = (rows[:, :, None] == np.arange(4)).reshape(len(rows), -1).astype(float)
    shape, starts, climb, _ = M._problem((freq @ seen).reshape(5, 4), model, 3, 2, 1e-9, 1, 60, None)
    for s in range(2):
        run, _ = climb(s)
        asked, path = next(run), []
        for _ in range(55):
            found = M._parted(M._sums(seen, freq.astype(float), [asked]), shape)[0]
            path.append(found[0])
            try:
                asked = run.send(found)
            except StopIteration:
                break
        # The start need not keep the orders; from the first update on all tables do.
        assert len(path) > 5 and np.diff(path[1:]).min() > -1e-7 * abs(path[-1])


def test_graded_fits_recover_and_take_own_orders(spark):
    answers = graded_answers(1200, np.random.default_rng(4))
    patterns = table(spark, answers)
    for model in ("MON", "DM"):
        f = M.fit(patterns, model, n_classes=3, n_starts=2)
        assert not violations(f.probs, Constraints(True), tolerance=1e-6)
        mean = np.sort((f.probs @ np.arange(4)).mean(1))
        assert mean == pytest.approx(np.array([0.66, 1.5, 2.34]), abs=0.35)
    own = (4, 3, 2, 1, 0)
    f = M.fit(patterns, "IIO", n_classes=2, n_starts=2, item_order=own)
    assert not violations(f.probs, Constraints(item_order=own), tolerance=1e-6)
    tied = Constraints(pairs=((Cell(0, 0), Cell(1, 0)), (Cell(1, 4), Cell(0, 4))))
    f = M.fit(patterns, "UN", n_classes=2, n_starts=2, constraints=tied)
    assert not violations(f.probs, tied, tolerance=1e-6)


def test_ordered_fits_of_incomplete_answers(spark):
    rng = np.random.default_rng(6)
    answers = [[None if rng.random() < 0.2 else v for v in row] for row in graded_answers(500, rng)]
    binary = [[None if v is None else int(v > 1) for v in row] for row in answers]
    f = M.fit(table(spark, binary), "DM", n_classes=2, n_starts=2)
    order = np.argsort(-f.probs[:, :, 1].mean(0), kind="stable")
    assert not violations(f.probs, ordering("DM", order), tolerance=1e-6)
    assert f.loglik <= M.fit(table(spark, binary), "UN", n_classes=2, n_starts=4).loglik + 1e-6
