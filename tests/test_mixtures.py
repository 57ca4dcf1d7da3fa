"""Fits recover known parameters, and one EM step equals a brute-force one."""

import numpy as np
import pytest

from scalewright.operators import mixtures as M


def table(spark, answers):
    """Answers of persons, None where missing, to patterns with their number."""
    kinds = {}
    for row in answers:
        kinds[tuple(row)] = kinds.get(tuple(row), 0) + 1
    return spark.createDataFrame([(list(k), n) for k, n in kinds.items()], "x array<int>, freq long")


def drawn(probs, n, seed=3, missing=0.0):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, probs.shape[1])) < probs[rng.integers(0, len(probs), n)]).astype(int)
    hidden = rng.random(x.shape) < missing
    return [[None if h else int(v) for v, h in zip(row, gone)] for row, gone in zip(x, hidden)]


@pytest.mark.parametrize(
    "y, w, out",
    [([1, 0, 2], [1, 3, 1], [0.25, 0.25, 2]), ([3, 2, 1], None, [2, 2, 2]), ([], None, []), ([2, 0], [0, 0], [1, 1])],
)
def test_pava(y, w, out):
    assert list(M.weighted_pava(np.array(y), w)) == out


def test_isotonic_orders_equal_x_by_y():
    assert list(M.isotonic_by(np.array([3, 1, 2]), np.array([2.0, 1, 0]), np.array([1, 1, 3]))) == [2, 0.25, 0.25]
    assert np.allclose(M.isotonic_by(np.array([1, 1, 2]), np.array([0, 1, 0.6]), np.ones(3)), [0, 0.8, 0.8])


def test_both_orders_hold_after_projection():
    p = np.random.default_rng(1).random((3, 5))
    out = M.doubly_monotone(p, np.ones_like(p), np.arange(5))
    assert (np.diff(out, axis=0) > -1e-8).all() and (np.diff(out, axis=1) < 1e-8).all()


def test_expected_counts_equal_brute_force(spark):
    probs = np.array([[0.2, 0.3, 0.4], [0.9, 0.8, 0.6]])
    people = drawn(probs, 60, missing=0.2)
    w, cube = np.array([0.4, 0.6]), np.stack([1 - probs, probs], 2)
    got = M.expected_counts(table(spark, people), [(w, cube), (w[::-1], cube)])
    for (loglik, n, e), weights in zip(got, (w, w[::-1])):
        want, total, classes = np.zeros_like(cube), 0.0, np.zeros(2)
        for row in people:
            joint = [weights[c] * np.prod([cube[c, j, v] for j, v in enumerate(row) if v is not None]) for c in range(2)]
            total += np.log(sum(joint))
            for c in range(2):
                classes[c] += joint[c] / sum(joint)
                for j, v in enumerate(row):
                    if v is not None:
                        want[c, j, v] += joint[c] / sum(joint)
        assert loglik == pytest.approx(total) and np.allclose(n, classes) and np.allclose(e, want)


def test_two_separated_classes_are_found(spark):
    probs = np.array([[0.2, 0.25, 0.3, 0.2], [0.8, 0.75, 0.7, 0.8]])
    f = M.fit(table(spark, drawn(probs, 3000)), "DM", n_starts=2)
    assert np.abs(np.sort(f.probs[:, :, 1], axis=0) - probs).max() < 0.1 and f.converged
    assert (np.diff(f.probs[:, :, 1], axis=0) >= -1e-8).all()


def test_rasch_difficulties_and_spread_are_found(spark):
    rng = np.random.default_rng(5)
    delta = np.linspace(-1.5, 1.5, 5)
    right = rng.random((2000, 5)) < 1 / (1 + np.exp(delta - rng.normal(0, 1, (2000, 1))))
    f = M.fit(table(spark, right.astype(int).tolist()), "RM")
    assert np.abs(np.concatenate(f.steps) - delta).max() < 0.2 and abs(f.sigma - 1) < 0.15


def test_wrong_requests_are_refused(spark):
    t = table(spark, [[0, 2], [1, 1]])
    with pytest.raises(ValueError):
        M.fit(t, "other")
    with pytest.raises(ValueError):
        M.fit(spark.createDataFrame([], "x array<int>, freq long"))


def test_runs_apart_and_together_agree(spark, monkeypatch):
    patterns = table(spark, drawn(np.array([[0.8] * 5, [0.3] * 5]), 300))
    for model in ("UN", "MON", "LCR"):
        monkeypatch.setattr(M, "PATTERNS_PER_TASK", 20_000)
        apart = M.fit(patterns, model, n_starts=2)
        monkeypatch.setattr(M, "PATTERNS_PER_TASK", 7)
        together = M.fit(patterns, model, n_starts=2)
        assert (apart.iterations, apart.converged) == (together.iterations, together.converged)
        assert apart.loglik == pytest.approx(together.loglik) and np.allclose(apart.probs, together.probs, atol=1e-6)
