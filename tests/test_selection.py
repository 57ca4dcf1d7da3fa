"""Comparison of fits, standard errors, and cancellation checks against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mixtures import drawn, table

from scalewright.operators import cancellation as K
from scalewright.operators import mixtures as M
from scalewright.operators import selection as S


@pytest.mark.parametrize("x, df, p", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (5.991464547107979, 2, 0.05), (200.0, 150, sum(math.exp(k * math.log(100) - 100 - math.lgamma(k + 1)) for k in range(75))), (1.3862943611198906, 2, 0.5)])
def test_chi2_tail(x, df, p):
    assert S.chi2_tail(x, df) == pytest.approx(p, abs=2e-5)


def test_comparison_of_models(spark):
    probs = np.array([[0.2, 0.15, 0.3, 0.1], [0.9, 0.8, 0.85, 0.75]])
    patterns = table(spark, drawn(probs, 2000))
    best, fits = S.compare_models(patterns, ("UN", "DM", "RM"), n_classes=2, n_starts=3)
    rows = {r["model"]: r for r in best.collect()}
    for f in fits:
        assert rows[f.model]["bic"] == pytest.approx(-2 * f.loglik + f.n_par * math.log(2000))
        assert rows[f.model]["sabic"] == pytest.approx(-2 * f.loglik + f.n_par * math.log(2002 / 24))
    assert sorted(r["rank"] for r in rows.values()) == [1, 2, 3] and min(rows.values(), key=lambda r: r["bic"])["rank"] == 1
    tests = {(r["restricted"], r["general"]): r for r in S.lr_test(best).collect()}
    assert len(tests) == 3 and tests["DM", "UN"]["p_value"] is None and tests["RM", "UN"]["df"] == fits[0].n_par - fits[2].n_par
    table_of_classes, chosen = S.select_n_classes(patterns, range(1, 4), n_starts=3)
    assert len(chosen.weights) == 2 and table_of_classes.count() == 3
    one = table_of_classes.where("n_classes = 1").first()
    share = np.array([[r["x"][j] for j in range(4)] for r in patterns.collect() for _ in range(r["freq"])]).mean(0)
    assert one["loglik"] == pytest.approx(2000 * (share * np.log(share) + (1 - share) * np.log(1 - share)).sum(), abs=0.01)
    with pytest.raises(ValueError):
        S.compare_models(patterns, ("NONE",))
    assert S.successive_comparison(best).where("step = 5").first()["decision"] == best.where("rank = 1").first()["model"]


def test_standard_errors(spark):
    answers = drawn(np.array([[0.3, 0.6, 0.8]]), 500)
    f = M.fit(table(spark, answers), "UN", n_classes=1, n_starts=1)
    rows = S.standard_errors(table(spark, answers), f).where("kind = 'probability'").orderBy("item_id").collect()
    share = np.array(answers).mean(0)
    assert [r["se"] for r in rows] == pytest.approx(list(np.sqrt(share * (1 - share) / 500)), rel=1e-3)
    # Two classes: near the spread of estimates over samples.
    probs = np.array([[0.2, 0.15, 0.3, 0.1, 0.2], [0.9, 0.8, 0.85, 0.75, 0.9]])
    estimates = [M.fit(table(spark, drawn(probs, 1000, seed=s)), "UN", n_starts=1).probs[:, :, 1] for s in range(12)]
    spread = np.std([e[np.argsort(e.mean(1))] for e in estimates], axis=0).mean()
    patterns = table(spark, drawn(probs, 1000, seed=3))
    se = [r["se"] for r in S.standard_errors(patterns, M.fit(patterns, "UN", n_starts=2)).where("kind = 'probability'").collect()]
    assert np.mean(se) == pytest.approx(spread, rel=0.35)


def test_recovery_of_free_ordered_and_rasch_classes(spark):
    theta, delta = np.array([-1.5, 1.0]), np.array([-1.0, -0.3, 0.2, 1.1])
    rasch = 1 / (1 + np.exp(-(theta[:, None] - delta[None])))
    patterns = table(spark, drawn(rasch, 6000))
    for model in ("UN", "MON", "IIO", "LCR"):
        f = M.fit(patterns, model, n_starts=3)
        got = f.probs[np.argsort(f.probs[:, :, 1].mean(1)), :, 1]
        assert np.abs(got - rasch).max() < 0.06, model


def slow_ranges(total, right, check, uniform, steps, burn):
    """One table, cell by cell, with plain numbers."""
    size, orders, rules = K.CHECKS[check]
    rate = right / total
    order = sorted(rate.ravel())
    old = np.zeros((size, size))
    for diagonal in range(2 * size - 1):
        for j in range(size):
            if 0 <= diagonal - j < size:
                old[diagonal - j, j] = order.pop(0)
    like = lambda v, i, j: right[i, j] * math.log(v) + (total[i, j] - right[i, j]) * math.log(1 - v)
    kept = []
    for step in range(2, steps + 1):
        for i in range(size):
            for j in range(size):
                lows, highs = [0.0], [1.0]
                if "R" in orders:
                    lows += [old[i, j - 1]] * (j > 0)
                    highs += [old[i, j + 1]] if j < size - 1 else []
                if "C" in orders:
                    lows += [old[i - 1, j]] * (i > 0)
                    highs += [old[i + 1, j]] if i < size - 1 else []
                cross = 1.0
                for premises, (small, large) in rules:
                    held = [old[a] < old[b] for a, b in premises]
                    if all(held) or not any(held):
                        lesser, greater = (small, large) if all(held) else (large, small)
                        if (i, j) == greater:
                            lows.append(old[lesser])
                        if (i, j) == lesser:
                            cross = min(cross, old[greater])
                low = max(lows)
                high = min([*highs, cross]) if cross > low else min(highs)
                high = 1.0 if high < low else high
                draw = low + (high - low) * uniform()
                ratio = math.exp(min(1.0, like(draw, i, j) - like(old[i, j], i, j)))
                if ratio > uniform():
                    old[i, j] = draw
        if step > burn and step % 4 == 0:
            kept.append(old.copy())
    return np.quantile(kept, 0.025, axis=0), np.quantile(kept, 0.975, axis=0)


@pytest.mark.parametrize("check", list(K.CHECKS))
def test_sampler_equals_plain_loops(check):
    rng = np.random.default_rng(5)
    size = K.CHECKS[check][0]
    total = rng.integers(30, 60, (size, size)).astype(float)
    right = np.clip(np.round(total * rng.random((size, size))), 1, total - 1)
    low, high, mean = K.sampled_ranges(total[None], right[None], check, np.random.default_rng(9), steps=90, burn=20)
    draw = np.random.default_rng(9)
    slow = slow_ranges(total, right, check, lambda: draw.random(1)[0], 90, 20)
    assert np.allclose(low[0], slow[0]) and np.allclose(high[0], slow[1]) and ((low <= mean) & (mean <= high)).all()


def cells_of(spark, rates, n=200):
    return spark.createDataFrame([(i, j, n, int(round(n * rates[i][j]))) for i in range(len(rates)) for j in range(len(rates[0]))], "row int, col int, n_total long, n_right long")


def test_additive_tables_pass_and_crossed_ones_fail(spark):
    logits = np.add.outer(np.linspace(-1.5, 1.5, 5), np.linspace(-1, 1, 5))
    good = 1 / (1 + np.exp(-logits))
    bad = good[:, ::-1].copy()
    found = {}
    for name, rates in (("good", good), ("bad", bad)):
        checks = K.conjoint_checks(cells_of(spark, rates), "double", steps=1200, burn=400)
        assert checks.count() == 9 * 9
        t = K.checked_cells(checks)
        rows = checks.collect()
        mine = {}
        for r in rows:
            mine.setdefault((r["row"], r["col"]), []).append(not r["low"] < r["rate"] < r["high"])
        assert {(r["row"], r["col"]): (r["n_checks"], r["n_violated"]) for r in t.collect()} == {k: (len(v), sum(v)) for k, v in mine.items()}
        found[name] = K.violation_means(t).first()
        assert found[name]["unweighted"] == pytest.approx(np.mean([np.mean(v) for v in mine.values()]))
        assert K.column_means(t).count() == 5
    assert found["good"]["weighted"] < 0.1 < 0.4 < found["bad"]["weighted"]
    status = {r["status"] for r in K.hierarchy(cells_of(spark, good), steps=600, burn=200).collect()}
    assert "SKIPPED" not in status and {r["status"] for r in K.hierarchy(cells_of(spark, bad), steps=600, burn=200).collect()} == {"FAILED_SINGLE"}
    ends = good.copy()
    ends[0][0] = 0
    assert K.conjoint_checks(cells_of(spark, ends), "double", steps=600, burn=200).select("sub_id").distinct().count() == 8
    assert K.conjoint_checks(cells_of(spark, ends), "double", adjust_extremes=True, steps=600, burn=200).select("sub_id").distinct().count() == 9
    assert K.sub_matrices(cells_of(spark, good), 3, "all").count() == 100 and K.sub_matrices(cells_of(spark, good), 3, 7).count() == 7


def test_dense_core(spark):
    n = np.full((5, 5), 9)
    n[0] = 1
    n[2, 4] = 1
    cells = spark.createDataFrame([(i, j, int(n[i, j])) for i in range(5) for j in range(5)], "row int, col int, n_total long")
    core = K.dense_core(cells)
    assert core.agg({"n_total": "min"}).first()[0] == 9
    assert {r["row"] for r in core.collect()} == {1, 3, 4} and core.count() == 15
    with pytest.raises(ValueError):
        K.dense_core(cells.withColumn("n_total", cells.n_total * 0))


def test_goodness_of_fit_of_a_small_table(spark):
    """Two items, eight people, one class: the statistic by hand, with one degree of freedom."""
    patterns = spark.createDataFrame([([0, 0], 2), ([0, 1], 1), ([1, 0], 1), ([1, 1], 4)], "x array<int>, freq long")
    f = M.fit(patterns, "UN", n_classes=1, n_starts=1)
    row = S.goodness_of_fit(patterns, f).first()
    expected = {(a, b): 8 * (5 / 8 if a else 3 / 8) * (5 / 8 if b else 3 / 8) for a in (0, 1) for b in (0, 1)}
    seen = {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 4}
    g2 = 2 * sum(n * math.log(n / expected[k]) for k, n in seen.items())
    assert row["g2"] == pytest.approx(g2, abs=1e-6) and row["df"] == 1
    assert row["p_g2"] == pytest.approx(math.erfc(math.sqrt(g2 / 2)), abs=1e-6)
    with pytest.raises(ValueError):
        S.goodness_of_fit(patterns, M.fit(patterns, "RM"))


def test_fits_of_one_comparison_read_their_answers_once(spark):
    """Patterns are counted once for all models and numbers of classes, however many fits there are."""
    read = spark.sparkContext.accumulator(0)

    def answers():
        seen = F.udf(lambda i: read.add(1) or [i % 2, i // 2 % 2, i // 4 % 2], "array<int>")
        return spark.range(0, 64, 1, 2).select(seen("id").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("freq"))

    for compare in (lambda t: S.compare_models(t, ("UN", "MON"), 2, n_starts=1), lambda t: S.select_n_classes(t, range(1, 3), n_starts=1), lambda t: S.compare_rm_lcr(t, 2, n_starts=1)):
        read.value = 0
        compare(answers())
        assert read.value == 64


def test_cells_of_checks_are_counted_once(spark):
    read = spark.sparkContext.accumulator(0)

    def cells():
        seen = F.udf(lambda i: read.add(1) or 40, "int")
        return spark.range(0, 16, 1, 2).select((F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), seen("id").alias("n_total")).groupBy("row", "col").agg(F.sum("n_total").alias("n_total")).withColumn("n_right", 8 + 3 * F.col("row") + 4 * F.col("col"))

    assert K.dense_core(cells()).count() == 16 and read.value == 16
    read.value = 0
    assert K.hierarchy(cells(), "all", steps=200, burn=100).count() == 1 and read.value == 16
