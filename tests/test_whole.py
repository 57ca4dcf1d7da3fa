"""Cancellation checks of all sub-matrices, the whole reading as registered, and the kernels that make them bearable, against plain loops."""

import inspect
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_nulls import packed_rows

from scalewright.operators import cancellation as K
from scalewright.operators import choice as H
from scalewright.operators import nulls as N
from scalewright.operators import omnibus as O
from scalewright.plans import registry as R


def rasch(n, items, seed):
    rng = np.random.default_rng(seed)
    return (rng.random((n, items)) < 1 / (1 + np.exp(np.linspace(-1, 1, items) - rng.normal(0, 1, n)[:, None]))).astype(int)


def plain_rate(total, right, check, parts=1, rep=-1, seed=1):
    """The weighted violation rate over all sub-matrices that can be checked, listed one by one; and how many those are."""
    size = K.CHECKS[check][0]
    every = [(r, c) for r in combinations(range(total.shape[0]), size) for c in combinations(range(total.shape[1]), size)]
    checks, bad, sound = np.zeros(total.shape), np.zeros(total.shape), 0
    for turn in range(parts):
        here = [np.ix_(r, c) for r, c in every[turn::parts] if ((right[np.ix_(r, c)] > 0) & (right[np.ix_(r, c)] < total[np.ix_(r, c)])).all()]
        sound, rng = sound + len(here), np.random.default_rng([seed, ((rep + 1) << 32) + turn])
        low, high, _ = K.sampled_ranges(np.array([total[i] for i in here]), np.array([right[i] for i in here]), check, rng)
        for k, i in enumerate(here):
            rate = right[i] / total[i]
            checks[i] += 1
            bad[i] += ~((rate > low[k]) & (rate < high[k]))
    seen = checks > 0
    return (bad[seen] / checks[seen]) @ total[seen] / total[seen].sum(), sound


def test_hierarchy_checks_sub_matrices_that_do_not_stand_together(spark):
    x = rasch(1500, 5, 4)
    x = x[~((x.sum(1) == 2) & (x[:, 2] == 1))]  # a rate of 0 in the middle, which every adjacent sub-matrix meets
    people = packed_rows(spark, x.tolist())
    patterns = people.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
    total, right = N.counts_of_patterns(*np.unique(x, axis=0, return_counts=True))
    expected, sound = plain_rate(total, right, "single")
    assert right[2, 2] == 0 and sound > 10
    with pytest.raises(ValueError):
        N.cancellation_null(people, patterns, "single", replicates=2)
    row = H.check_hierarchy(people, patterns, ("single",), replicates=2).first()
    assert row["statistic"] == pytest.approx(expected)


def test_parts_check_every_sub_matrix_once(spark):
    x = rasch(125, 10, 1)
    total, right = N.counts_of_patterns(*np.unique(x, axis=0, return_counts=True), 5)
    number = K._number_of(total.shape, 3, False)
    parts = -(-number // N.NUMBERS_A_PART)
    expected, sound = plain_rate(total, right, "single", parts, 0)
    assert parts > 1 and parts < sound < parts * N.SIDE_BY_SIDE
    patterns = spark.createDataFrame([(0, list(map(int, p)), int(f)) for p, f in zip(*np.unique(x, axis=0, return_counts=True))], N.REPLICATE_ROWS)
    assert N.violation_rates(patterns, "single", 5, which="all", n=1).first()["statistic"] == pytest.approx(expected)


def test_the_registered_reading_leaves_out_nothing(spark, monkeypatch):
    x, given = rasch(60, R.ITEMS, 2), {}

    def reading(*args, **options):
        given.update(inspect.signature(whole).bind(*args, **options).arguments)
        return spark.createDataFrame([("verdict", "ORDINAL", None)], "route string, outcome string, supports boolean")

    whole = H.full_reading
    monkeypatch.setattr(H, "full_reading", reading)
    monkeypatch.setattr(R, "from_orders", lambda *_: spark.createDataFrame([(i, j, int(v), int(v)) for (i, j), v in np.ndenumerate(x)], "person_id long, item_id int, x int, xp int"))
    assert R.queries()["full_reading"](spark, "").count() == 1
    assert set(given) == {"packed", "patterns"}  # all else as the operator has it
    # With fewer replicates no level of three can be rejected, whatever the answers.
    assert 3 / (inspect.signature(whole).parameters["replicates"].default + 1) <= 0.05


def test_additive_fits_equal_logistic_fits():
    rng = np.random.default_rng(3)
    ability, item = np.repeat([1.2, 2.9, 4.4, 6.1], 5), np.tile(np.arange(5), 4)
    total = rng.integers(20, 300, 20).astype(float)
    right = rng.binomial(total.astype(int), 1 / (1 + np.exp(item - ability + 1.5 + rng.normal(0, 0.4, 20))), (40, 20)).astype(float)
    assert O.additive_fits(ability, item, total, right) == pytest.approx(O.logistic_fits(O._design(ability, item), total, right), abs=1e-7)


def test_draws_side_by_side_equal_single_ones(monkeypatch):
    rng = np.random.default_rng(5)
    ability, item = np.repeat([1.0, 2.0, 3.0], 4), np.tile(np.arange(4), 3)
    total = rng.integers(40, 90, 12).astype(float)
    right = rng.binomial(total.astype(int), 1 / (1 + np.exp(item - ability))).astype(float)
    found = []
    for cells in (1, 3 * 20 * 12, 1 << 20):
        monkeypatch.setattr(O, "CELLS_AT_ONCE", cells)
        found.append(O.block_sums(ability, item, total, right, 7, 20, 8, 8, np.random.default_rng(1)))
    assert found[1] == pytest.approx(found[0], rel=1e-6) and found[2] == pytest.approx(found[0], rel=1e-6)
