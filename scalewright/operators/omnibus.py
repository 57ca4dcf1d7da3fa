"""An omnibus test of additivity: synthetic likelihood over prior draws of all cells, by the divergence of each cell.

A table of counts is small, the draws are many: a task takes a block of draws and returns sums per cell, which
Spark adds up.  Many tables, such as bootstrap replicates, go side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts as C
from .fanout import per_key
from .nulls import REPLICATES, _sorted_patterns, conditional_replicates, counts_of_patterns, fit_conditional

#: Prior draws in a task, and cells of data sets that are fitted side by side.
BLOCK, CELLS_AT_ONCE = 250, 1 << 15
CELLS = "rep int, ability double, item int, n_total double, n_right double"


def logistic_fits(design: np.ndarray, total: np.ndarray, right: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Fitted rates of many logistic regressions on one design; ``right`` is data sets x cells.  Raw rates where one has no fit."""
    squares = (design[:, :, None] * design[:, None, :]).reshape(len(design), -1)
    raw = right / total
    eta = np.log((right + 0.5) / (total - right + 0.5))
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-eta))
        weight = np.maximum(total * mu * (1 - mu), 1e-10)
        curve = (weight @ squares).reshape(len(right), design.shape[1], -1) + 1e-9 * np.eye(design.shape[1])
        slope = (weight * eta + right - total * mu) @ design
        new = np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0] @ design.T, -30, 30)
        done = np.abs(new - eta).max() < 1e-8
        eta = new
        if done:
            break
    fitted = 1 / (1 + np.exp(-eta))
    return np.where(np.isfinite(fitted).all(1, keepdims=True), fitted, raw)


def additive_fits(ability: np.ndarray, item: np.ndarray, total: np.ndarray, right: np.ndarray, rounds: int = 12) -> np.ndarray:
    """What ``logistic_fits`` gives on a slope of ability and an intercept per item, without a system of equations per data set.

    Intercepts don't meet each other in the equations, so each is eliminated by a division; data sets that have ended are left alone.
    """
    raw = right / total
    member = (item[:, None] == np.unique(item)).astype(float)
    x = ability[:, None].astype(float)
    parts = np.hstack([member, member * x, x * x])
    k = member.shape[1]
    eta = np.log((right + 0.5) / (total - right + 0.5))
    going, held, hits = np.arange(len(right)), eta.copy(), right
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-held))
        weight = np.maximum(total * mu * (1 - mu), 1e-10)
        curve = weight @ parts
        own, cross = curve[:, :k] + 1e-9, curve[:, k : 2 * k]
        pull = weight * held + hits - total * mu
        slopes, share = pull @ parts[:, :k], cross / own
        slope = ((pull @ x)[:, 0] - (share * slopes).sum(1)) / (curve[:, 2 * k] + 1e-9 - (share * cross).sum(1))
        new = np.clip((slopes / own - share * slope[:, None]) @ member.T + slope[:, None] * x[:, 0], -30, 30)
        eta[going] = new
        moves = ~(np.abs(new - held).max(1) < 1e-8)
        if not moves.any():
            break
        going, held, hits = going[moves], new[moves], hits[moves]
    fitted = 1 / (1 + np.exp(-eta))
    return np.where(np.isfinite(fitted).all(1, keepdims=True), fitted, raw)


def isotonic_rows(by: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic regressions of the rows of ``y`` on those of ``by``; ties of ``by`` are ordered by y.

    Neighbours that fall are pooled, whole falling runs of all rows at once, until none is left.
    """
    order = np.lexsort((y, by))
    w = np.take_along_axis(np.broadcast_to(weight, y.shape), order, 1).astype(float).ravel()
    wy = w * np.take_along_axis(y, order, 1).ravel()
    # The blocks of all rows in one line: their weights, sums, numbers of cells and whether a row begins with them.
    cells, begins = np.ones(y.size, np.int64), np.arange(y.size) % y.shape[1] == 0
    while True:
        mean = wy / w
        falls = np.zeros(len(mean), bool)
        falls[1:] = (mean[1:] < mean[:-1]) & ~begins[1:]
        if not falls.any():
            break
        first = np.flatnonzero(~falls)
        w, wy, cells = (np.add.reduceat(v, first) for v in (w, wy, cells))
        begins = begins[first]
    out = np.empty(y.shape)
    np.put_along_axis(out, order, np.repeat(mean, cells).reshape(y.shape), 1)
    return out


def density_at(samples: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Gaussian kernel density of each column of ``samples``, one table or several, at ``point``, its width from the median deviation."""
    n = samples.shape[-2]
    sigma = np.median(np.abs(samples - np.median(samples, axis=-2, keepdims=True)), axis=-2) / 0.6745
    sigma = np.where(sigma > 0, sigma, np.ptp(samples, axis=-2))
    h = np.where(sigma > 0, sigma * (4 / (3 * n)) ** 0.2, 1.0)
    return np.exp(-0.5 * ((point - samples) / h[..., None, :]) ** 2).mean(-2) / (h * np.sqrt(2 * np.pi))


def _design(ability: np.ndarray, item: np.ndarray) -> np.ndarray:
    return np.column_stack([ability, item[:, None] == np.unique(item)]).astype(float)


def observed_summary(design: np.ndarray, total: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Isotonic rates by what ability and item predict."""
    first = logistic_fits(design, total, right[None])
    second = logistic_fits(np.column_stack([np.ones(len(total)), first[0]]), total, right[None])
    return isotonic_rows(second, (right / total)[None], total)[0]


def block_sums(ability: np.ndarray, item: np.ndarray, total: np.ndarray, right: np.ndarray, draws: int, synthetic: int, a: float, b: float, rng: np.random.Generator) -> np.ndarray:
    """Sums of w, w w, w theta and w Z per cell over prior draws; w is the density of synthetic summaries at the observed one.

    As many draws as have CELLS_AT_ONCE cells of data sets are fitted side by side.
    """
    target, sums = observed_summary(_design(ability, item), total, right), np.zeros((4, len(total)))
    at_once = max(1, CELLS_AT_ONCE // (synthetic * len(total)))
    for first in range(0, draws, at_once):
        theta, drawn = [], []
        for _ in range(min(at_once, draws - first)):
            theta.append(np.clip(rng.beta(a, b, len(total)), 1e-12, 1 - 1e-12))
            drawn.append(rng.binomial(total.astype(int), theta[-1], (synthetic, len(total))))
        theta, hits = np.array(theta), np.concatenate(drawn).astype(float)
        summary = isotonic_rows(additive_fits(ability, item, total, hits), hits / total, total)
        w = density_at(summary.reshape(len(theta), synthetic, -1), target) + np.finfo(float).eps
        sums += [v.sum(0) for v in (w, w * w, w * theta, w * (right - total * theta) / np.sqrt(total * theta * (1 - theta)))]
    return sums


def omnibus(cells: DataFrame, draws: int = 30_000, synthetic: int = 100, a: float = 0.5, b: float = 0.5, seed: int = 1, n_tables: int = 1) -> DataFrame:
    """(rep, ability, item, n_total, n_right, theta, theta_free, z, ess, kl, violated) of tables of counts ``CELLS``.

    ``theta`` is the mean under additivity, ``theta_free`` the one without; a cell is violated if they diverge by more
    than 0.01.  A table is small (groups by items); each of ``n_tables`` goes to draws / BLOCK tasks.
    """
    blocks = -(-draws // BLOCK)
    spread = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("unit", (F.col("rep") + 1) * blocks + F.col("block"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ability", "item"])
        rep, block = int(group["rep"].iloc[0]), int(group["block"].iloc[0])
        total, right = group["n_total"].to_numpy(float), group["n_right"].to_numpy(float)
        n = min(BLOCK, draws - block * BLOCK)
        sums = block_sums(group["ability"].to_numpy(), group["item"].to_numpy(), total, right, n, synthetic, a, b, np.random.default_rng([seed, rep + 2, block]))
        return group[["rep", "ability", "item", "n_total", "n_right"]].assign(w=sums[0], ww=sums[1], wt=sums[2], wz=sums[3])

    parts = per_key(spread.where("n_total > 0"), "unit", blocks * n_tables, run, CELLS + ", w double, ww double, wt double, wz double")
    summed = parts.groupBy("rep", "ability", "item", "n_total", "n_right").agg(*[F.sum(c).alias(c) for c in ("w", "ww", "wt", "wz")])
    clip = lambda c: F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), c))
    out = summed.withColumns({"theta": clip(F.col("wt") / F.col("w")), "theta_free": clip((a + F.col("n_right")) / (a + b + F.col("n_total"))), "z": F.col("wz") / F.col("w"), "ess": F.col("w") * F.col("w") / F.col("ww")})
    t, u = F.col("theta"), F.col("theta_free")
    out = out.withColumn("kl", u * F.log(u / t) + (1 - u) * F.log((1 - u) / (1 - t))).drop("w", "ww", "wt", "wz")
    return out.withColumn("violated", F.col("kl") > 0.01)


def summary(tested: DataFrame) -> DataFrame:
    """(rep, statistic, kl_median, kl_max, ess_min, ess_median, n_violated) per table; the statistic is the sum of divergences."""
    return tested.groupBy("rep").agg(
        F.sum("kl").alias("statistic"), F.percentile("kl", F.lit(0.5)).alias("kl_median"), F.max("kl").alias("kl_max"),
        F.min("ess").alias("ess_min"), F.percentile("ess", F.lit(0.5)).alias("ess_median"), F.sum(F.col("violated").cast("long")).alias("n_violated"),
    )


def band_by_score(r: DataFrame, n_items: int, n_bands: int = 6, person_order: str = "complete") -> DataFrame:
    """(band, item_id, ability, n_total, n_right): up to ``n_bands`` bands that never split a score, their mean score as ability.

    Distinct scores are taken in order; a band closes once it has as many persons as there are per band (or per distinct
    score, if those are fewer), the last band takes the rest.  ``complete`` orders persons without missing answers by their
    sum, ``facility`` and ``adjusted`` all persons by the scores of those names.  Fewer than two bands is an error.
    One array of distinct scores is folded in one task; ``adjusted`` scores are rounded to 9 places.
    """
    person = C.scores(r, n_items, person_order).select("person_id", F.round("score", 9).alias("score"))
    counts = person.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    gathered = counts.agg(F.sort_array(F.collect_list(F.struct("score", "n"))).alias("c"), F.sum("n").alias("total"))
    gathered = gathered.where(F.size("c") > 1).withColumn("target", F.col("total") / F.least(F.lit(n_bands), F.size("c")))
    fold = f"""aggregate(c, cast((0L, 0, array()) as struct<held: bigint, band: int, ends: array<double>>), (s, v) ->
        if(s.held + v.n >= target and s.band < {n_bands - 1} and v.score < c[size(c) - 1].score,
            named_struct('held', 0L, 'band', s.band + 1, 'ends', concat(s.ends, array(v.score))),
            named_struct('held', s.held + v.n, 'band', s.band, 'ends', s.ends)), s -> s.ends)"""
    ends = gathered.select(F.expr(fold).alias("ends"))
    banded = person.join(F.broadcast(ends)).select("person_id", "score", F.size(F.filter("ends", lambda e: e < F.col("score"))).alias("band"))
    ability = banded.groupBy("band").agg(F.avg("score").alias("ability"))
    cells = r.join(banded.select("person_id", "band"), "person_id").groupBy("band", "item_id").agg(F.count("x").alias("n_total"), F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("n_right"))
    return cells.join(F.broadcast(ability), "band").select("band", "item_id", "ability", "n_total", "n_right")


def bands_of(scores: np.ndarray, freq: np.ndarray, n_bands: int) -> np.ndarray:
    """The band of every pattern, as in ``band_by_score``."""
    values, of = np.unique(scores, return_inverse=True)
    if len(values) < 2:
        raise ValueError("fewer than two scores")
    counts = np.bincount(of.ravel(), freq)
    target, band, held, bands = counts.sum() / min(n_bands, len(values)), 0, 0.0, []
    for k, n in enumerate(counts):
        bands.append(band)
        held += n
        if held >= target and band < n_bands - 1 and k < len(values) - 1:
            band, held = band + 1, 0.0
    return np.array(bands)[of.ravel()]


def banded_replicates(replicates: DataFrame, n_bands: int = 6, least: int = 10, n: int = REPLICATES) -> DataFrame:
    """``CELLS`` of every replicate (rep, x, freq): complete patterns banded as in ``band_by_score``, those of graded answers by step.

    Graded answers have score groups of ``least`` persons in place of bands, and go by steps of the dense core of their counts.
    A replicate without two bands, or without a dense core, has no cells.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rep = int(group["rep"].iloc[0])
        x, freq = _sorted_patterns(group)
        whole = (x >= 0).all(1)
        x, freq = x[whole], freq[whole]
        rows = []
        try:
            if x.max(initial=0) > 1:
                total, right, scores = counts_of_patterns(x, freq, least, with_scores=True)
                rows = [(rep, float(s), j, total[i, j], right[i, j]) for i, s in enumerate(scores) for j in range(total.shape[1])]
            else:
                score = x.sum(1)
                bands = bands_of(score, freq, n_bands)
                for k in np.unique(bands):
                    here = bands == k
                    ability = (freq * score)[here].sum() / freq[here].sum()
                    rows += [(rep, ability, j, freq[here].sum(), float((freq * x[:, j])[here].sum())) for j in range(x.shape[1])]
        except ValueError:
            rows = []
        return pd.DataFrame(rows, columns=["rep", "ability", "item", "n_total", "n_right"])

    return per_key(replicates, "rep", n, run, CELLS)


def omnibus_null(packed: DataFrame, patterns: DataFrame, n_bands: int = 6, replicates: int = REPLICATES, draws: int = 10_000, synthetic: int = 100, seed: int = 1, drawn: DataFrame | None = None) -> DataFrame:
    """``summary`` of the banded table (rep -1) and of its replicates, all tested alike.

    Replicates are drawn given everyone's total, or given as ``drawn``.  They are drawn and banded once, so every block of draws
    reads a table of cells.
    """
    if drawn is None:
        drawn = conditional_replicates(packed, fit_conditional(patterns), replicates, seed)
    every = drawn.unionByName(patterns.select(F.lit(-1).cast("int").alias("rep"), "x", "freq"))
    return summary(omnibus(banded_replicates(every, n_bands, n=replicates + 1), draws, synthetic, seed=seed, n_tables=replicates + 1))
