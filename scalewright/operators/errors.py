"""Standard errors: from the information of Rasch fits, and from resamples whose classes are matched to the fit's.

The information is the slope of the score, and the score follows from expected counts, so one pass over the patterns
serves all shifted parameters.  Resamples are refitted a task each; Spark takes the spread over them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixtures as M
from . import nulls as N
from . import selection as S
from .mixtures import PATTERNS_PER_TASK, Fit, expected_counts, step_table

ERRORS = "kind string, class_id int, item_id int, step int, estimate double, se double"


def matched(p: np.ndarray, reference: np.ndarray) -> list[int]:
    """The order of the classes of ``p`` whose summed absolute distance to ``reference`` is least, the first of equal ones.

    ``p`` and ``reference`` are classes x values.  The best match of the first k classes of the reference with any set of k
    others is built up from the best ones of k - 1, so the cost grows with the sets of classes and not with the orders.
    """
    n = len(p)
    if n > 16:
        raise ValueError("at most 16 classes can be matched")
    cost = np.abs(reference[:, None, :] - p[None, :, :]).sum(2)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k in range(n):
        reached: dict[int, tuple[float, list[int]]] = {}
        for used, (value, order) in best.items():
            for c in range(n):
                if not used >> c & 1:
                    new = (value + cost[k, c], [*order, c])
                    if used | 1 << c not in reached or new < reached[used | 1 << c]:
                        reached[used | 1 << c] = new
        best = reached
    return best[(1 << n) - 1][1]


def _small(patterns: DataFrame) -> DataFrame:
    return patterns.coalesce(1) if patterns.limit(PATTERNS_PER_TASK + 1).count() <= PATTERNS_PER_TASK else patterns


def _value(x: float) -> float | None:
    return None if not np.isfinite(x) else float(x)


def rasch_errors(patterns: DataFrame, f: Fit, h: float = 1e-4) -> DataFrame:
    """``ERRORS`` of a latent-class Rasch fit (abilities, steps, weights) or a Rasch fit over the normal distribution (steps, log sigma).

    Coordinates are abilities, all steps but the first one, and log ratios of weights, or all steps and the log of sigma.
    The first step of a centred set is minus the sum of the others, and its error follows from theirs.  Errors are null if
    the information is singular.
    """
    if f.theta is None or f.model not in ("LCR", "RM"):
        raise ValueError("errors of abilities and steps need a Rasch fit")
    if f.model == "RM" and f.sigma is None:
        raise ValueError("errors need a normal distribution of abilities")
    tops = np.array([len(d) for d in f.steps])
    n_cat, n_steps, k = f.probs.shape[2], int(tops.sum()), len(f.weights)
    flat = np.concatenate(f.steps)
    classes = f.model == "LCR"
    nodes = None if classes else f.theta / f.sigma
    base = np.concatenate([f.theta, flat[1:], np.log(f.weights[:-1] / f.weights[-1])]) if classes else np.concatenate([flat, [math.log(f.sigma)]])

    def parts(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(abilities, steps, weights) at these coordinates."""
        if not classes:
            return math.exp(eta[-1]) * nodes, eta[:-1], f.weights
        rest = eta[k : k + n_steps - 1]
        w = np.exp(np.concatenate([eta[k + n_steps - 1 :], [0.0]]))
        return eta[:k], np.concatenate([[-rest.sum()], rest]), w / w.sum()

    def score(eta: np.ndarray, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        theta, steps, weights = parts(eta)
        p, at = step_table(theta, M._split(steps, 0, tops), n_cat), np.arange(n_cat)
        left = e - e.sum(2, keepdims=True) * p
        by_theta = (left @ at).sum(1)
        upper = left[:, :, ::-1].cumsum(2)[:, :, ::-1].sum(0)  # items x categories: of answers of at least that step
        by_step = -np.concatenate([upper[j, 1 : top + 1] for j, top in enumerate(tops)])
        if not classes:
            return np.concatenate([by_step, [by_theta @ theta]])
        return np.concatenate([by_theta, by_step[1:] - by_step[0], (n - n.sum() * weights)[:-1]])

    points = [base + s * h * d for d in np.eye(len(base)) for s in (1, -1)]
    tables = [(w, step_table(theta, M._split(steps, 0, tops), n_cat)) for theta, steps, w in map(parts, points)]
    scores = [score(eta, n, e) for eta, (_, n, e) in zip(points, expected_counts(_small(patterns), tables))]
    slope = np.array([(scores[2 * i] - scores[2 * i + 1]) / (2 * h) for i in range(len(base))])
    information = -(slope + slope.T) / 2
    sound = np.isfinite(information).all() and np.linalg.cond(information) < 1e12
    cov = np.linalg.inv(information) if sound else np.full_like(information, np.nan)
    se = lambda v: np.sqrt(np.where(v >= 0, v, np.nan))
    places = [(j, x + 1) for j, top in enumerate(tops) for x in range(top)]
    rows: list[tuple] = []
    if classes:
        steps_cov = cov[k : k + n_steps - 1, k : k + n_steps - 1]
        of_steps = np.concatenate([[steps_cov.sum()], np.diag(steps_cov)])
        jacobian = np.diag(f.weights)[:, :-1] - np.outer(f.weights, f.weights[:-1])
        of_weights = np.einsum("ia,ab,ib->i", jacobian, cov[k + n_steps - 1 :, k + n_steps - 1 :], jacobian)
        rows += [("ability", c, None, None, float(t), _value(s)) for c, (t, s) in enumerate(zip(f.theta, se(np.diag(cov)[:k])))]
        rows += [("weight", c, None, None, float(w), _value(s)) for c, (w, s) in enumerate(zip(f.weights, se(of_weights)))]
    else:
        of_steps = np.diag(cov)[:-1]
        rows += [("log_sigma", None, None, None, math.log(f.sigma), _value(se(cov[-1, -1])))]
    rows += [("step", None, j, x, float(d), _value(s)) for (j, x), d, s in zip(places, flat, se(of_steps))]
    return patterns.sparkSession.createDataFrame(rows, ERRORS)


def bootstrap_errors(packed: DataFrame, patterns: DataFrame, f: Fit, replicates: int = 100, n_starts: int = 3, seed: int = 1) -> DataFrame:
    """``ERRORS`` and replicates: the spread of every parameter over refits of resampled persons.

    Classes of a refit are matched to those of the fit by their tables of probabilities; Rasch classes are in order of their
    abilities anyway.  With fewer than two refits errors are null.
    """
    shape, n_cat = f.probs.shape, f.probs.shape[2]
    classes = f.model != "RM"
    tops = np.maximum(1, ((f.probs > M.CLIP).any(0) * np.arange(n_cat)).max(1))
    places = [(j, x + 1) for j, d in enumerate(f.steps) for x in range(len(d))]

    def parameters(weights: np.ndarray, probs: np.ndarray, theta: np.ndarray | None, steps: np.ndarray, sigma: float | None) -> list[tuple]:
        out: list[tuple] = []
        if classes:
            out += [("weight", c, None, None, float(w)) for c, w in enumerate(weights)]
        if f.theta is None:
            out += [("probability", c, j, x, float(probs[c, j, x])) for c in range(shape[0]) for j in range(shape[1]) for x in range(1, int(tops[j]) + 1)]
            return out
        if classes:
            out += [("ability", c, None, None, float(t)) for c, t in enumerate(theta)]
        else:
            out.append(("log_sigma", None, None, None, math.log(sigma)))
        return out + [("step", None, j, x, float(d)) for (j, x), d in zip(places, steps)]

    def spread(fits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for weights, probs, theta, steps, sigma in zip(fits["weights"], fits["probs"], fits["theta"], fits["steps"], fits["sigma"]):
            weights, probs = np.asarray(weights), np.asarray(probs)
            if probs.size != math.prod(shape) or len(steps) != len(places):
                continue  # a resample in which the highest answer of an item is absent
            probs = probs.reshape(shape)
            if f.theta is None:
                order = matched(probs.reshape(shape[0], -1), f.probs.reshape(shape[0], -1))
                weights, probs = weights[order], probs[order]
            rows += parameters(weights, probs, theta, steps, sigma)
        return pd.DataFrame(rows, columns=["kind", "class_id", "item_id", "step", "value"]).astype({"class_id": "Int32", "item_id": "Int32", "step": "Int32"})

    refit = N.Refit(f.model, shape[0] if classes else 2)
    values = N.refit_table(N.resampled(packed, replicates, seed), replicates, n_cat, refit, N.is_large(patterns), n_starts, seed, spread, "kind string, class_id int, item_id int, step int, value double")
    key = ["kind", "class_id", "item_id", "step"]
    spreads = values.groupBy(*key).agg(F.stddev_samp("value").alias("se"), F.count(F.lit(1)).alias("replicates"))
    flat = np.concatenate(f.steps) if f.steps else np.zeros(0)
    estimates = patterns.sparkSession.createDataFrame(parameters(f.weights, f.probs, f.theta, flat, f.sigma), "kind string, class_id int, item_id int, step int, estimate double")
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    joined = estimates.withColumn("key", F.concat_ws("/", *same)).join(spreads.withColumn("key", F.concat_ws("/", *same)).select("key", "se", "replicates"), "key", "left")
    return joined.select(*key, "estimate", "se", F.coalesce("replicates", F.lit(0)).cast("long").alias("replicates"))


def standard_errors(packed: DataFrame, patterns: DataFrame, f: Fit, method: str = "hessian", **options) -> DataFrame:
    """(kind, class_id, item_id, step, estimate, se) of any fit: by its information, or over resamples ("bootstrap")."""
    if method == "bootstrap":
        return bootstrap_errors(packed, patterns, f, **options).drop("replicates")
    if method != "hessian":
        raise ValueError(f"no method named {method}")
    return rasch_errors(patterns, f, **options) if f.theta is not None else S.standard_errors(patterns, f, **options).withColumnRenamed("category", "step")
