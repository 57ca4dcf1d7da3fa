"""The omnibus test and the selection procedures against direct computation and planted structure."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mixtures import drawn
from test_nulls import packed_rows

from scalewright.operators import choice as H
from scalewright.operators import mixtures as M
from scalewright.operators import omnibus as O
from scalewright.operators.fanout import kept


def test_batched_kernels_equal_single_ones():
    rng = np.random.default_rng(2)
    by, y, w = rng.integers(0, 6, (20, 15)).astype(float), rng.integers(0, 5, (20, 15)) / 4, rng.uniform(1, 9, 15)
    assert O.isotonic_rows(by, y, w) == pytest.approx(np.array([M.isotonic_by(a, b, w) for a, b in zip(by, y)]))
    design = O._design(np.repeat([0.2, 0.5, 0.8], 4), np.tile(np.arange(4), 3))
    total = rng.integers(20, 60, 12).astype(float)
    right = rng.binomial(total.astype(int), 0.4, (5, 12)).astype(float)
    fitted = O.logistic_fits(design, total, right)
    assert np.abs((right - total * fitted) @ design).max() < 1e-4  # the score is zero at the maximum
    samples = rng.normal(0, 1, (50, 3))
    samples[:, 2] = 0.5
    point = np.array([0.1, 5.0, 0.5])
    x = samples[:, 0]
    h = np.median(abs(x - np.median(x))) / 0.6745 * (4 / 150) ** 0.2
    assert O.density_at(samples, point)[0] == pytest.approx(np.mean([np.exp(-0.5 * ((0.1 - v) / h) ** 2) for v in x]) / h / np.sqrt(2 * np.pi))
    assert O.density_at(samples, point)[2] == pytest.approx(1 / np.sqrt(2 * np.pi))



def test_isotonic_rows_hold_no_square_of_the_cells():
    rng = np.random.default_rng(4)
    by, y, w = rng.normal(0, 1, (3, 1500)), rng.normal(0, 1, (3, 1500)), rng.uniform(1, 9, 1500)
    y[0] = -np.sort(by[0])[::-1]
    tracemalloc.start()
    got = O.isotonic_rows(by, y, w)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20
    assert got == pytest.approx(np.array([M.isotonic_by(a, b, w) for a, b in zip(by, y)]))


def test_small_tables_are_held_in_few_partitions(spark):
    rows = spark.range(40).selectExpr("id % 7 as k").repartition("k")
    with kept(rows) as held:
        assert held.count() == 40 and held.rdd.getNumPartitions() == 1
        with kept(held) as again:
            assert again is held


def cells(spark, rate):
    return spark.createDataFrame([(-1, float(i), j, 400.0, float(round(400 * p))) for (i, j), p in np.ndenumerate(rate)], O.CELLS)


def test_omnibus_tells_crossed_from_additive_tables(spark):
    ability, item = np.array([-1.5, -0.5, 0.5, 1.5]), np.array([-1.0, 0.0, 1.0])
    additive = 1 / (1 + np.exp(item - ability[:, None]))
    crossed = additive.copy()
    crossed[:, 0] = crossed[::-1, 0]
    sums = [O.summary(O.omnibus(cells(spark, t), 600, 30)).first() for t in (additive, crossed)]
    assert sums[0]["statistic"] < sums[1]["statistic"] and sums[0]["ess_min"] >= 1
    tested = O.omnibus(cells(spark, additive), 300, 30)
    assert sorted(map(str, tested.collect())) == sorted(map(str, O.omnibus(cells(spark, additive).repartition(3), 300, 30).collect()))
    assert tested.first()["theta_free"] == pytest.approx((0.5 + tested.first()["n_right"]) / 401)
    assert O.omnibus(spark.createDataFrame([], O.CELLS), 300, 30).count() == 0


def test_bands_of_replicates_equal_bands_of_answers(spark):
    answers = drawn(np.array([[0.2, 0.15, 0.3, 0.1], [0.9, 0.8, 0.85, 0.75]]), 400, missing=0.1)
    people = packed_rows(spark, answers)
    long = people.select("person_id", F.posexplode("x").alias("item_id", "x"))
    patterns = people.groupBy("x").agg(F.count(F.lit(1)).alias("freq")).withColumn("rep", F.lit(0)).select("rep", "x", "freq")
    key = lambda rows, item: sorted((round(r["ability"], 6), r[item], float(r["n_total"]), float(r["n_right"])) for r in rows)
    for bands in (3, 6):
        assert key(O.band_by_score(long, 4, bands).collect(), "item_id") == key(O.banded_replicates(patterns, bands).collect(), "item")
    assert O.band_by_score(long, 4, 3, "facility").agg(F.sum("n_total")).first()[0] == long.where("x is not null").count()
    # Three bands of 8 persons with scores 0 (5), 1 (1), 2 (1), 3 (1): the first closes at once, the last takes the rest.
    few = spark.createDataFrame([(i, j, int(j < s)) for i, s in enumerate([0, 0, 0, 0, 0, 1, 2, 3]) for j in range(3)], "person_id long, item_id int, x int")
    assert sorted({(r["band"], r["ability"], r["n_total"]) for r in O.band_by_score(few, 3, 3).collect()}) == [(0, 0.0, 5), (1, 2.0, 3)]


@pytest.mark.parametrize(
    "scale, axioms, out",
    [
        (None, [None, None], "INCONCLUSIVE"), ("classificatory", [True, True], "CLASSIFICATORY"), ("quantitative", [None, None], "QUANT_AXIOMS_UNAVAILABLE"),
        ("quantitative", [True, None], "QUANT_WELL_SUPPORTED"), ("quantitative", [True, False], "QUANT_QUALIFIED"), ("quantitative", [False, None], "QUANT_WEAK_AXIOMS"),
        ("ordinal", [None, None], "ORDINAL"), ("ordinal", [True, True], "BORDERLINE"), ("ordinal", [True, False], "ORDINAL"), (None, [True, None], "INCONCLUSIVE"),
    ],
)
def test_verdict(scale, axioms, out):
    assert H.verdict(scale, axioms) == out


def test_selection_finds_planted_structure(spark):
    crossed = packed_rows(spark, drawn(np.array([[0.2, 0.8, 0.2, 0.8], [0.8, 0.2, 0.8, 0.2]]), 600))
    patterns = crossed.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
    chosen = H.select_by_tests(crossed, patterns, range(2, 3), replicates=29, n_starts=2)
    assert chosen.where("selected is not null").first()["selected"] == "UN"
    row = H.read_properties(patterns, 2).first()
    assert not row["mon"] and row["selected"] == "UN" and row["scale"] == "classificatory"
    assert H.least_decrease(np.array([[0.9, 0.8], [0.2, 0.3], [0.5, 0.1]])) == pytest.approx(min(0.2 / 2, 0.2 / 2))
    rows = H.resampled(crossed, 3).collect()
    assert sum(r["freq"] for r in rows) == pytest.approx(1800, rel=0.1)


# Published counts of 65 persons per cell, 4 score groups x 3 items, score fastest.
RASCH_COUNTS = [31, 48, 55, 63, 8, 24, 37, 57, 2, 7, 9, 30]
CROSSING_COUNTS = [23, 42, 60, 63, 27, 35, 38, 32, 1, 7, 34, 57]


@pytest.mark.parametrize("counts, kl, violations", [(RASCH_COUNTS, 0.021, 0), (CROSSING_COUNTS, 0.297, 6)])
def test_omnibus_agrees_with_published_results(spark, counts, kl, violations):
    df = spark.createDataFrame([(-1, float(k % 4), k // 4, 65.0, float(n)) for k, n in enumerate(counts)], O.CELLS)
    row = O.summary(O.omnibus(df, 6000, 60)).first()
    # Published from 30,000 draws of 100 data sets.
    assert row["statistic"] == pytest.approx(kl, abs=max(0.02, 0.3 * kl)) and abs(row["n_violated"] - violations) <= 1
