"""Comparing fitted models: criteria, tests, standard errors, and the choice of a model or a number of classes.

Fits are few, so their table is small; the fits themselves and the pass for standard errors run over pattern tables.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fanout import kept
from .mixtures import CLIP, PATTERNS_PER_TASK, Fit, expected_counts, fit, fit_measures
from .orders import ordering, values

FITS = "model string, n_classes int, loglik double, n_par int, n_obs long, converged boolean"


def fit_table(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    return spark.createDataFrame([(f.model, len(f.weights), float(f.loglik), int(f.n_par), int(f.n_obs), bool(f.converged)) for f in fits], FITS)


def compared(table: DataFrame, by: str = "bic") -> DataFrame:
    """A table of fits with aic, bic, sabic, delta and rank by the criterion ``by``, the best first."""
    ll, k, n = F.col("loglik"), F.col("n_par"), F.col("n_obs")
    out = table.withColumns({"aic": -2 * ll + 2 * k, "bic": -2 * ll + k * F.log(n), "sabic": -2 * ll + k * F.log((n + 2) / 24)})
    best = Window.partitionBy()
    return out.withColumn("delta", F.col(by) - F.min(by).over(best)).withColumn("rank", F.row_number().over(Window.orderBy(by, "n_par", "model")))


def chi2_tail(x: float, df: float) -> float:
    """Probability that a chi-square variable with ``df`` degrees of freedom is above ``x``."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - scale * total)
    # Lentz's continued fraction of the upper tail.
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def goodness_of_fit(patterns: DataFrame, f: Fit) -> DataFrame:
    """``fit_measures`` with p_g2 and p_x2, the tails of the chi-square law; null without degrees of freedom.

    A Rasch fit over a distribution of abilities is an error: its table of patterns has no such law.
    """
    if f.model == "RM":
        raise ValueError("G2 and X2 of a Rasch fit over a distribution of abilities have no chi-square law")
    measures = fit_measures(patterns, f)
    row = measures.first()
    tails = tuple(chi2_tail(row[c], row["df"]) if row[c] is not None and row["df"] > 0 else None for c in ("g2", "x2"))
    schema = measures.schema.add("p_g2", "double").add("p_x2", "double")
    return patterns.sparkSession.createDataFrame([(*row, *tails)], schema)


def lr_test(table: DataFrame) -> DataFrame:
    """(restricted, general, statistic, df, p_value) of every two fits of a table, the one with fewer parameters being restricted.

    With df 0 the two differ by inequalities alone, and no chi-square law holds; ``p_value`` is null then.
    """
    a, b = (table.select(F.col("model").alias(m), F.col("loglik").alias(f"l{m}"), F.col("n_par").alias(f"k{m}")) for m in ("restricted", "general"))
    pairs = a.join(b, (F.col("krestricted") < F.col("kgeneral")) | ((F.col("krestricted") == F.col("kgeneral")) & (F.col("restricted") < F.col("general"))))
    pairs = pairs.select("restricted", "general", (2 * (F.col("lgeneral") - F.col("lrestricted"))).alias("statistic"), (F.col("kgeneral") - F.col("krestricted")).alias("df"))
    rows = pairs.collect()  # as many as there are pairs of fits
    tail = [(r["restricted"], r["general"], r["statistic"], r["df"], chi2_tail(r["statistic"], r["df"]) if r["df"] else None) for r in rows]
    return table.sparkSession.createDataFrame(tail, "restricted string, general string, statistic double, df int, p_value double")


def relative_fit(measures: DataFrame, baseline: DataFrame) -> DataFrame:
    """(cfi, tli, rmsea) from two rows (g2, df, n_obs): a model and the model of independent items.

    A model without degrees of freedom has neither tli nor rmsea.
    """
    m = measures.select(F.col("g2").alias("g"), F.col("df").alias("d"), "n_obs", F.lit(1).alias("k"))
    b = baseline.select(F.col("g2").alias("g0"), F.col("df").alias("d0"), F.lit(1).alias("k"))
    g, d, g0, d0 = (F.col(c) for c in ("g", "d", "g0", "d0"))
    over, most = F.greatest(g - d, F.lit(0.0)), F.greatest(g - d, g0 - d0, F.lit(0.0))
    return m.join(b, "k").select(
        F.when(most > 0, 1 - over / most).otherwise(1.0).alias("cfi"),
        F.when((d > 0) & (d0 > 0) & (g0 != d0), (g0 / d0 - g / d) / (g0 / d0 - 1)).alias("tli"),
        F.when(d > 0, F.sqrt(over / (d * (F.col("n_obs") - 1)))).alias("rmsea"),
    )


def compare_models(patterns: DataFrame, models: tuple[str, ...] = ("UN", "MON", "IIO", "DM", "LCR", "RM"), n_classes: int = 3, by: str = "bic", **options) -> tuple[DataFrame, list[Fit]]:
    """The compared table of the models, and their fits.  A model that can't be fitted is left out; none at all is an error."""
    fits, failed = [], {}
    with kept(patterns) as patterns:
        for model in models:
            try:
                fits.append(fit(patterns, model, n_classes=n_classes, **options))
            except ValueError as error:
                failed[model] = str(error)
    if not fits:
        raise ValueError(f"no model could be fitted: {failed}")
    return compared(fit_table(patterns.sparkSession, fits), by), fits


def select_n_classes(patterns: DataFrame, classes: range = range(1, 7), by: str = "bic", **options) -> tuple[DataFrame, Fit]:
    """The compared table of free models by number of classes, and the best of them."""
    with kept(patterns) as patterns:
        fits = [fit(patterns, "UN", n_classes=c, **({**options, "n_starts": 1} if c == 1 else options)) for c in classes]
    table = compared(fit_table(patterns.sparkSession, fits), by)
    best = table.where("rank = 1").first()["n_classes"]
    return table, next(f for f in fits if len(f.weights) == best)


def successive_comparison(table: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(step, simpler, richer, gain, decision) of a compared table: does the richer of two models pay by bic?

    The last row names the model of least bic, which is what counts; the steps say how it came about.
    """
    bic = {r["model"]: r["bic"] for r in table.select("model", "bic").collect()}
    rows = []
    for step, (simpler, richer) in enumerate((("MON", "UN"), ("IIO", "UN"), ("DM", "MON"), ("LCR", "DM")), 1):
        if simpler in bic and richer in bic:
            gain = bic[simpler] - bic[richer]
            rows.append((step, simpler, richer, gain, richer if gain > threshold else simpler))
    best = min(bic, key=lambda m: bic[m])
    return table.sparkSession.createDataFrame([*rows, (5, None, None, None, best)], "step int, simpler string, richer string, gain double, decision string")


def coefficients(spark: SparkSession, f: Fit) -> DataFrame:
    """(class_id, item_id, p, logit) of a fit of binary answers."""
    p = np.clip(f.probs[:, :, 1], CLIP, 1 - CLIP)
    rows = [(c, j, float(p[c, j]), float(np.log(p[c, j] / (1 - p[c, j])))) for c, j in np.ndindex(p.shape)]
    return spark.createDataFrame(rows, "class_id int, item_id int, p double, logit double")


def rasch_departures(table: DataFrame) -> DataFrame:
    """(class_id, item_id, departure): what of the logit a class and an item effect don't explain; 0 under a Rasch structure."""
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("p")))
    logit = table.select("class_id", "item_id", F.log(p / (1 - p)).alias("logit"))
    mean = lambda *by: F.avg("logit").over(Window.partitionBy(*by))
    return logit.select("class_id", "item_id", (F.col("logit") - mean("class_id") - mean("item_id") + mean()).alias("departure"))


def compare_rm_lcr(patterns: DataFrame, n_classes: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """The compared table of RM and LCR, and (item_id, step, rm, lcr, difference) of their steps, both centred."""
    with kept(patterns) as patterns:
        rm, lcr = fit(patterns, "RM"), fit(patterns, "LCR", n_classes=n_classes, **options)
    spark = patterns.sparkSession
    flat = [[float(d) for item in f.steps for d in item] for f in (rm, lcr)]
    centred = [np.array(v) - np.mean(v) for v in flat]
    keys = [(j, k + 1) for j, item in enumerate(rm.steps) for k in range(len(item))]
    rows = [(j, k, float(a), float(b), float(a - b)) for (j, k), a, b in zip(keys, *centred)]
    return compared(fit_table(spark, [rm, lcr])), spark.createDataFrame(rows, "item_id int, step int, rm double, lcr double, difference double")


def standard_errors(patterns: DataFrame, f: Fit, h: float = 1e-4) -> DataFrame:
    """(kind, class_id, item_id, category, estimate, se) of a latent class fit.

    The information is the slope of the score in log ratios of weights and of categories to the lowest one.  The scores at
    all shifted parameters come from expected counts, so one pass over the patterns serves them all.  Distributions with
    a category at 0 or 1 and those that an ordering ties together have no error (null), as have all if the information
    is singular.  Abilities and steps have theirs by ``errors.rasch_errors``.
    """
    if f.theta is not None:
        raise ValueError("these standard errors are for latent class models without abilities")
    n_classes, n_items, n_cat = f.probs.shape
    tops = np.maximum(1, ((f.probs > CLIP).any(0) * np.arange(n_cat)).max(1))
    easy = np.argsort(-(f.probs @ np.arange(n_cat)).mean(0), kind="stable")
    free = np.array([[all(1e-6 < v < 1 - 1e-6 for v in f.probs[c, j, : tops[j] + 1]) for j in range(n_items)] for c in range(n_classes)])
    for low, high in ordering(f.model, easy).edges(tops, n_classes):
        if abs(values(f.probs, low) - values(f.probs, high)) < 1e-6:
            free[low.class_id, low.item_id] = free[high.class_id, high.item_id] = False
    cells = [(int(c), int(j)) for c, j in np.argwhere(free)]
    first = n_classes - 1 + np.concatenate([[0], np.cumsum([tops[j] for _, j in cells])]).astype(int)
    ratios = [np.log(f.probs[c, j, 1 : tops[j] + 1] / f.probs[c, j, 0]) for c, j in cells]
    base = np.concatenate([np.log(f.weights[:-1] / f.weights[-1]), *ratios])

    def parameters(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.exp(np.concatenate([eta[: n_classes - 1], [0.0]]))
        q = f.probs.copy()
        for k, (c, j) in enumerate(cells):
            v = np.exp(np.concatenate([[0.0], eta[first[k] : first[k + 1]]]))
            q[c, j, : tops[j] + 1] = v / v.sum()
        return w / w.sum(), q

    def score(q: np.ndarray, w: np.ndarray, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        left = e - e.sum(2, keepdims=True) * q
        return np.concatenate([(n - n.sum() * w)[:-1], *[left[c, j, 1 : tops[j] + 1] for c, j in cells]])

    points = [parameters(base + s * h * d) for d in np.eye(len(base)) for s in (1, -1)]
    small = patterns.coalesce(1) if patterns.limit(PATTERNS_PER_TASK + 1).count() <= PATTERNS_PER_TASK else patterns
    scores = [score(q, w, n, e) for (w, q), (_, n, e) in zip(points, expected_counts(small, points))] if len(base) else []
    slope = np.array([(scores[2 * k] - scores[2 * k + 1]) / (2 * h) for k in range(len(base))]).reshape(len(base), len(base))
    information = -(slope + slope.T) / 2
    sound = len(base) and np.isfinite(information).all() and np.linalg.cond(information) < 1e12
    cov = np.linalg.inv(information) if sound else np.full((len(base), len(base)), np.nan)
    spread = lambda jacobian, at: np.sqrt(np.maximum(np.einsum("ia,ab,ib->i", jacobian, cov[at, at], jacobian), 0))
    of_weights = spread(np.diag(f.weights)[:, :-1] - np.outer(f.weights, f.weights[:-1]), slice(0, n_classes - 1)) if n_classes > 1 else np.zeros(1)
    of_cells: dict[tuple[int, int], np.ndarray] = {}
    for k, (c, j) in enumerate(cells):
        p = f.probs[c, j, 1 : tops[j] + 1]
        of_cells[c, j] = spread(np.diag(p) - np.outer(p, p), slice(first[k], first[k + 1]))
    value = lambda x: None if not np.isfinite(x) else float(x)
    rows = [("weight", c, None, None, float(f.weights[c]), value(of_weights[c])) for c in range(n_classes)]
    rows += [("probability", c, j, x, float(f.probs[c, j, x]), value(of_cells[c, j][x - 1]) if (c, j) in of_cells else None) for c in range(n_classes) for j in range(n_items) for x in range(1, tops[j] + 1)]
    return patterns.sparkSession.createDataFrame([(k, c, j, None if x is None else int(x), v, s) for k, c, j, x, v, s in rows], "kind string, class_id int, item_id int, category int, estimate double, se double")
