"""Standard errors, free abilities, replicates with masks by rank, and partial orders against direct computation and planted structure."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mixtures import drawn, table
from test_nulls import packed_rows

from scalewright.operators import cancellation as K
from scalewright.operators import errors as E
from scalewright.operators import latent as L
from scalewright.operators import mixtures as M
from scalewright.operators import nulls as N
from scalewright.operators import omnibus as O
from scalewright.operators import posets as P


def patterns_of(people):
    return people.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))


def test_matching_is_the_best_of_all_orders():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        p, q = rng.random((n, 3)), rng.random((n, 3))
        best = min(permutations(range(n)), key=lambda o: (np.abs(p[list(o)] - q).sum(), o))
        assert np.abs(p[E.matched(p, q)] - q).sum() == pytest.approx(np.abs(p[list(best)] - q).sum())
    assert E.matched(q[[2, 0, 1, 4, 3]], q) == [1, 2, 0, 4, 3]


def rasch_answers(n, theta, steps, rng):
    p = M.step_table(theta, steps, 1 + max(map(len, steps)))
    return [[int(rng.choice(p.shape[2], p=p[i, j])) for j in range(len(steps))] for i in range(n)]


def numeric_errors(loglik, at, h=1e-3):
    n = len(at)
    e = np.eye(n) * h
    hess = np.array([[(loglik(at + e[i] + e[j]) - loglik(at + e[i] - e[j]) - loglik(at - e[i] + e[j]) + loglik(at - e[i] - e[j])) / (4 * h * h) for j in range(n)] for i in range(n)])
    return np.linalg.inv(-hess)


@pytest.mark.parametrize("model", ["RM", "LCR"])
def test_rasch_errors_equal_the_numeric_hessian(spark, model):
    rng = np.random.default_rng(7)
    steps = [np.array([-0.8]), np.array([0.0, 0.6]), np.array([0.5]), np.array([-0.3])]
    theta = rng.normal(0, 1.2, 600) if model == "RM" else rng.choice([-1.4, 1.4], 600)
    patterns = table(spark, rasch_answers(600, theta, steps, rng))
    f = M.fit(patterns, model, n_classes=2, n_starts=2, tol=1e-12)
    rows = patterns.collect()
    x, freq = np.array([r["x"] for r in rows]), np.array([float(r["freq"]) for r in rows])
    seen = (x[:, :, None] == np.arange(3)).reshape(len(x), -1).astype(float)
    tops = np.array([1, 2, 1, 1])

    def loglik(eta):
        if model == "RM":
            probs, w = M.step_table(np.exp(eta[-1]) * f.theta / f.sigma, M._split(eta[:-1], 0, tops), 3), f.weights
        else:
            w = np.exp([eta[-1], 0.0])
            w, probs = w / w.sum(), M.step_table(eta[:2], M._split(np.concatenate([[-eta[2:-1].sum()], eta[2:-1]]), 0, tops), 3)
        return float(freq @ M._posterior(seen, w, probs)[1])

    flat = np.concatenate(f.steps)
    at = np.concatenate([flat, [np.log(f.sigma)]]) if model == "RM" else np.concatenate([f.theta, flat[1:], [np.log(f.weights[0] / f.weights[1])]])
    cov = numeric_errors(loglik, at)
    got = {(r["kind"], r["class_id"], r["item_id"], r["step"]): r["se"] for r in E.rasch_errors(patterns, f).collect()}
    se = np.sqrt(np.diag(cov))
    if model == "RM":
        assert got["step", None, 1, 2] == pytest.approx(se[2], rel=0.02) and got["log_sigma", None, None, None] == pytest.approx(se[-1], rel=0.02)
    else:
        assert got["ability", 1, None, None] == pytest.approx(se[1], rel=0.02) and got["step", None, 3, 1] == pytest.approx(se[5], rel=0.02)
        assert got["step", None, 0, 1] == pytest.approx(np.sqrt(cov[2:6, 2:6].sum()), rel=0.02)
        assert got["weight", 0, None, None] == pytest.approx(se[-1] * f.weights[0] * f.weights[1], rel=0.02)


def test_bootstrap_errors_agree_with_the_information(spark):
    from scalewright.operators import selection as S

    people = packed_rows(spark, drawn(np.array([[0.2, 0.15, 0.3, 0.25], [0.85, 0.8, 0.9, 0.75]]), 900)).persist()
    patterns = patterns_of(people)
    f = M.fit(patterns, "UN", n_starts=3)
    boot = {(r["kind"], r["class_id"], r["item_id"]): r for r in E.bootstrap_errors(people, patterns, f, 60, 2).collect()}
    hess = {(r["kind"], r["class_id"], r["item_id"]): r["se"] for r in S.standard_errors(patterns, f).collect()}
    assert set(boot) == set(hess) and all(r["replicates"] == 60 for r in boot.values())
    ratio = np.array([boot[k]["se"] / hess[k] for k in hess])
    assert 0.85 < np.median(ratio) < 1.15 and ratio.min() > 0.6 and ratio.max() < 1.5
    rasch = M.fit(patterns, "RM")
    kinds = {r["kind"]: r["se"] for r in E.bootstrap_errors(people, patterns, rasch, 20, 1).collect()}
    assert set(kinds) == {"step", "log_sigma"} and all(v > 0 for v in kinds.values())


def test_refits_take_one_python_process_per_task(spark, monkeypatch):
    """Classes used to be matched in a second process that waited beside that of the refit."""
    people = packed_rows(spark, drawn(np.array([[0.1] * 4, [0.5] * 4, [0.9] * 4]), 900)).persist()
    patterns = patterns_of(people)
    found, refit_table = [], N.refit_table
    monkeypatch.setattr(N, "refit_table", lambda *a, **k: (found.append(refit_table(*a, **k)), found[-1])[1])
    errors = E.bootstrap_errors(people, patterns, M.fit(patterns, "RM"), 20, 1)
    P.refine(people, patterns, 3, n_starts=1)
    for plan in (errors, *found):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" in text and "MapInPandas" not in text.replace("FlatMapGroupsInPandas", "")
    assert found[1].columns == ["rep", "side", "x", "y", "v"]
    # Tables that no task holds whole give the same rows.
    few = E.bootstrap_errors(people, patterns, M.fit(patterns, "UN", n_starts=1), 4, 1)
    monkeypatch.setattr(N, "is_large", lambda patterns: True)
    many = E.bootstrap_errors(people, patterns, M.fit(patterns, "UN", n_starts=1), 4, 1)
    key = lambda r: str((r["kind"], r["class_id"], r["item_id"]))
    for a, b in zip(sorted(few.collect(), key=key), sorted(many.collect(), key=key)):
        assert key(a) == key(b) and a["replicates"] == b["replicates"] == 4 and a["se"] == pytest.approx(b["se"], rel=1e-4)
    people.unpersist()


def test_free_abilities_show_two_peaks(spark):
    rng = np.random.default_rng(5)
    steps = [np.array([b]) for b in np.linspace(-1.5, 1.5, 12)]
    theta = rng.choice([-1.8, 1.8], 2500) + rng.normal(0, 0.2, 2500)
    patterns = table(spark, rasch_answers(2500, theta, steps, rng))
    rasch = M.fit(patterns, "RM")
    free = L.free_latent(patterns, rasch)
    assert free.loglik > rasch.loglik + 20 and free.weights.sum() == pytest.approx(1)
    shifted = free.theta - latent_mean(free)
    middle, sides = free.weights[np.abs(shifted) < 0.6].sum(), free.weights[(np.abs(shifted) > 1.2) & (np.abs(shifted) < 2.6)].sum()
    assert middle < 0.1 and sides > 0.8
    u, v = rng.random(20_000), rng.random(20_000)
    drawn_ = L.drawn_abilities(free, u, v)
    assert drawn_.mean() == pytest.approx(L.latent_moments(free)[0], abs=0.05) and drawn_.var() == pytest.approx(L.latent_moments(free)[1], rel=0.05)
    assert L.drawn_abilities(rasch, u, v).std() == pytest.approx(rasch.sigma, rel=0.03)
    with pytest.raises(ValueError):
        L.free_latent(patterns, M.fit(patterns, "UN", n_starts=1))


def latent_mean(f):
    return L.latent_moments(f)[0]


def test_masks_go_by_rank(spark):
    """Weak persons left out the last item; so do the weak ones of every replicate, as if persons were matched one by one."""
    rng = np.random.default_rng(9)
    steps = [np.array([b]) for b in (-1.0, -0.3, 0.4, 1.0)]
    theta = rng.normal(0, 1.5, 3000)
    answers = rasch_answers(3000, theta, steps, rng)
    answers = [[*row[:3], None if t < -0.5 else row[3]] for row, t in zip(answers, theta)] + [[None] * 4]
    people = packed_rows(spark, answers)
    f = M.Fit("RM", *M.normal_nodes()[::-1], 0.0, 5, 3001, 1, True, M.normal_nodes()[0] * 1.5, steps, 1.5)
    f.probs = M.step_table(f.theta, steps, 2)
    rows = N.model_replicates(people, f, 1).limit(0).collect() + L.marginal_replicates(people, f, 3, seed=4).collect()
    again = sorted(map(str, L.marginal_replicates(people.repartition(6), f, 3, seed=4).collect()))
    assert sorted(map(str, rows)) == again
    mean = lambda row: np.mean([v for v in row if v is not None] or [9])
    observed = sorted(answers, key=mean)
    for rep in range(3):
        mine = [(r["x"], r["freq"]) for r in rows if r["rep"] == rep]
        assert sum(n for x, n in mine if x[3] is None and x[0] is not None) == sum(a[3] is None for a in answers) - 1
        assert sum(n for x, n in mine if x == [None] * 4) == 1
        # Persons matched one by one, with other random numbers.
        full = sorted(rasch_answers(3001, rng.normal(0, 1.5, 3001), steps, rng), key=sum)
        want = [sum(row[:3]) for row, mask in zip(full, observed) if mask[3] is None and mask[0] is not None]
        got = np.repeat([sum(x[:3]) for x, n in mine if x[3] is None and x[0] is not None], [n for x, n in mine if x[3] is None and x[0] is not None])
        assert np.mean(got) == pytest.approx(np.mean(want), abs=0.08)
        whole = np.repeat([sum(x) for x, n in mine if None not in x], [n for x, n in mine if None not in x])
        assert np.mean(whole) == pytest.approx(np.mean([sum(row) for row, mask in zip(full, observed) if mask[3] is not None]), abs=0.1)


def test_nulls_of_graded_answers(spark):
    rng = np.random.default_rng(2)
    steps = [b + np.array([-0.7, 0.7]) for b in np.linspace(-0.6, 0.6, 4)]
    people = packed_rows(spark, rasch_answers(1500, rng.normal(0, 1, 1500), steps, rng)).persist()
    patterns = patterns_of(people)
    rows = patterns.collect()
    x, freq = np.array([r["x"] for r in rows]), np.array([float(r["freq"]) for r in rows])
    total, right, scores = N.counts_of_patterns(x, freq, 10, with_scores=True)
    assert total.min() >= 5 and (right <= total).all() and len(scores) == len(total) and (np.diff(right.sum(0) / total.sum(0)) >= 0).all()
    # One cell by hand: some column of the group with the most persons is a step of an item.
    s = scores[len(scores) // 2]
    cells = {(float((freq * (x[:, j] == k))[x.sum(1) == s].sum()), float((freq * ((x[:, j] == k) | (x[:, j] == k - 1)))[x.sum(1) == s].sum())) for j in range(4) for k in (1, 2)}
    assert {(a, b) for a, b in zip(right[len(scores) // 2], total[len(scores) // 2])} <= cells
    observed, null = N.cancellation_null(people, patterns, "single", replicates=4)
    assert null.count() == 4 and 0 <= observed <= 1
    rasch = M.fit(patterns, "RM")
    observed, null = N.cancellation_null(people, patterns, "single", replicates=3, which=20, drawn=L.marginal_replicates(people, L.free_latent(patterns, rasch), 3))
    assert null.count() == 3 and observed < 0.3
    tested = O.omnibus_null(people, patterns, replicates=2, draws=40, synthetic=10)
    assert sorted(r["rep"] for r in tested.collect()) == [-1, 0, 1]


@pytest.mark.parametrize(
    "name, probs, shape, kind",
    [
        ("chain", [[0.1] * 6, [0.5] * 6, [0.9] * 6], "chain", None),
        ("antichain", [[0.9, 0.9, 0.1, 0.1, 0.5, 0.1], [0.1, 0.1, 0.9, 0.9, 0.1, 0.5], [0.1, 0.9, 0.1, 0.9, 0.9, 0.9]], "antichain", None),
        ("one above two", [[0.95] * 6, [0.7, 0.7, 0.7, 0.05, 0.05, 0.05], [0.05, 0.05, 0.05, 0.7, 0.7, 0.7]], "partial", "V"),
    ],
)
def test_planted_partial_orders_are_told_apart(spark, name, probs, shape, kind):
    people = packed_rows(spark, drawn(np.array(probs), 1500)).persist()
    pairs, found = P.refine(people, patterns_of(people), 3, n_starts=2, sides=("class",))
    row = found.first()
    assert (row["shape"], row["kind"]) == (shape, kind), name
    assert row["comparable"] == pairs.count()
    people.unpersist()


def test_closure_of_a_relation(spark):
    rel = lambda *pairs: spark.createDataFrame([("item", a, b) for a, b in pairs], "side string, dominant int, dominated int")
    shape = lambda df, n=4: tuple(P.shapes(df, {"item": n}).first())[1:]
    assert P.added_by_closure(rel((0, 1), (1, 2), (0, 2))).count() == 0
    assert [(r["dominant"], r["dominated"]) for r in P.added_by_closure(rel((0, 1), (1, 2))).collect()] == [(0, 2)]
    assert shape(rel((0, 1), (1, 2))) == (2, 6, "nontransitive", None)
    assert shape(rel((0, 1), (1, 2), (2, 0))) == (3, 6, "nontransitive", None)
    assert shape(rel((0, 1), (0, 2)), 3) == (2, 3, "partial", "V") and shape(rel((0, 2), (1, 2)), 3) == (2, 3, "partial", "Lambda")
    assert shape(rel((0, 1)), 3) == (1, 3, "partial", "single") and shape(rel().where("false"), 3) == (0, 3, "antichain", None)
    two_sides = P.shapes(rel((0, 1)), {"item": 3, "class": 3}).collect()
    assert {(r["side"], r["shape"]) for r in two_sides} == {("item", "partial"), ("class", "antichain")}


def test_combinations_by_number():
    from itertools import combinations

    for n, k in ((5, 3), (7, 4), (3, 3)):
        assert [K.combination(i, n, k) for i in range(len(list(combinations(range(n), k))))] == [list(c) for c in combinations(range(n), k)]
    assert K.combination(10**15, 2000, 6)[0] == 3  # comb(1999, 5) and so on: the first three take 7.8e14
    sound = lambda rows, cols: 0 not in rows
    places = K.chosen_places(range(50), (9, 9), 3, 50, sound, (1,))
    assert len(places) == 50 and all(0 not in rows for _, rows, _ in places)
    assert places[20:30] == K.chosen_places(range(20, 30), (9, 9), 3, 50, sound, (1,))
    assert len(K.chosen_places(range(100), (5, 5), 3, 1000, sound, (1,))) == 100


def test_graded_errors_without_classes_are_those_of_shares(spark):
    rng = np.random.default_rng(1)
    answers = [[int(rng.choice(3, p=[0.2, 0.5, 0.3])), int(rng.choice(2, p=[0.6, 0.4]))] for _ in range(400)]
    patterns = table(spark, answers)
    f = M.fit(patterns, "UN", n_classes=1, n_starts=1)
    got = {(r["item_id"], r["step"]): (r["estimate"], r["se"]) for r in E.standard_errors(patterns, patterns, f).where("kind = 'probability'").collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 1)}
    for (j, x), (p, se) in got.items():
        assert p == pytest.approx(np.mean([a[j] == x for a in answers]), abs=1e-6) and se == pytest.approx(np.sqrt(p * (1 - p) / 400), rel=1e-3)
    assert f.fall < 1e-9
    with pytest.raises(ValueError):
        E.standard_errors(patterns, patterns, f, "other")


def test_tied_cells_have_no_error(spark):
    patterns = table(spark, drawn(np.array([[0.3, 0.6, 0.5], [0.8, 0.2, 0.5]]), 800))
    f = M.fit(patterns, "MON", n_starts=2)
    rows = {(r["class_id"], r["item_id"]): r["se"] for r in E.standard_errors(patterns, patterns, f).where("kind = 'probability'").collect()}
    tied = [j for j in range(3) if abs(f.probs[0, j, 1] - f.probs[1, j, 1]) < 1e-6]
    assert tied and all(rows[c, j] is None for c in (0, 1) for j in tied)


def test_severity_tells_real_from_negligible_departures(spark):
    crossed = packed_rows(spark, drawn(np.array([[0.2, 0.8, 0.2, 0.8, 0.5], [0.8, 0.2, 0.8, 0.2, 0.5]]), 600)).persist()
    patterns = patterns_of(crossed)
    low, high = (M.fit(patterns, m, n_starts=3) for m in ("MON", "UN"))
    _, null = N.likelihood_ratio_test(crossed, patterns, low, high, replicates=15, n_starts=2, reselect=(1, 2))
    row = N.severity(crossed, patterns, low, high, null, 15, 2).first()
    assert row["separated"] and row["power"] > 0.9 and row["effect"] > 0.95 and row["replicates"] == 15
    same = N.severity(crossed, patterns, low, low, null, 15, 2).first()
    assert same["effect"] < 0.9
    crossed.unpersist()


def test_severity_fits_every_replicate_once(spark, monkeypatch):
    fitted = spark.sparkContext.accumulator(0)
    draw = N.model_replicates

    def counted(*args, **options):
        made = F.udf(lambda rep: fitted.add(1) or rep, "int")
        return draw(*args, **options).withColumn("rep", made("rep"))

    people = packed_rows(spark, drawn(np.array([[0.2, 0.15, 0.3], [0.9, 0.8, 0.85]]), 300)).persist()
    patterns = patterns_of(people)
    low, high = (M.fit(patterns, m, n_starts=1) for m in ("MON", "UN"))
    null = spark.range(4).selectExpr("cast(id as int) as rep", "id / 2D as statistic", "false as failed")
    monkeypatch.setattr(N, "model_replicates", counted)
    row = N.severity(people, patterns, low, high, null, 4, 1).first()
    # A replicate of three binary items has eight patterns at most.
    assert row["replicates"] == 4 and row["cutoff"] == pytest.approx(1.425) and 0 < fitted.value <= 4 * 8
    people.unpersist()


def test_large_tables_are_refitted_by_replicate(spark, monkeypatch):
    """The path of large tables gives the statistics of the small one."""
    people = packed_rows(spark, drawn(np.array([[0.2, 0.15, 0.3, 0.1], [0.9, 0.8, 0.85, 0.75]]), 400)).persist()
    patterns = patterns_of(people)
    low, high = (M.fit(patterns, m, n_starts=1) for m in ("MON", "UN"))
    small = {r["rep"]: r["statistic"] for r in N.likelihood_ratio_test(people, patterns, low, high, 2, 1)[1].collect()}
    monkeypatch.setattr(N, "PATTERNS_PER_TASK", 3)
    large = {r["rep"]: r["statistic"] for r in N.likelihood_ratio_test(people, patterns, low, high, 2, 1)[1].collect()}
    assert set(small) == set(large) and all(large[k] == pytest.approx(v, abs=1e-6) for k, v in small.items())
    monkeypatch.setattr(N, "GROUPS_ON_DRIVER", 2)
    spread = np.concatenate(N.fit_conditional(patterns))
    monkeypatch.setattr(N, "GROUPS_ON_DRIVER", 2000)
    assert spread == pytest.approx(np.concatenate(N.fit_conditional(patterns)), abs=1e-5)
    people.unpersist()


def test_replicates_are_added_in_stages(spark):
    calls = []

    def stage(first, n):
        calls.append((first, n))
        return spark.createDataFrame([(first + k, float(first + k)) for k in range(n)], "rep int, statistic double")

    null, more = N.in_stages(stage, 45.5, 49, most=199)  # p = 4 / 50, too near to 0.05
    assert more and calls == [(0, 49), (49, 150)] and null.count() == 199
    calls.clear()
    assert not N.in_stages(stage, 10.0, 49)[1] and not N.in_stages(stage, 1000.0, 49)[1] and calls == [(0, 49)] * 2
