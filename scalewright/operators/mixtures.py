"""Latent class and Rasch models fitted by EM on the table of distinct answer patterns.

Spark folds persons into patterns.  A small pattern table goes whole to one task per start.  Of a large one, every
step folds patterns into expected counts: each partition returns one vector of sums for all starts together.  What
reaches the driver has the size of the model (starts x classes x items x categories), whatever the number of persons.

Missing answers (NULL) contribute nothing.  Ordered models sort classes by level, the free one by prevalence;
under constraints of the caller's they keep their numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import pattern_frequencies
from .fanout import kept, per_key
from .orders import Constraints, OrderedStep, expected_loglik, ordering

#: Least probability of a category and least weight of a cell.
CLIP = 1e-10
#: Nodes of the normal distribution of abilities.
NODES = 61
#: Distinct patterns that one task turns into expected counts at least, and the most tasks of a step.
PATTERNS_PER_TASK, MOST_TASKS = 20_000, 512
MODELS = ("UN", "MON", "IIO", "DM", "LCR", "RM")
#: How starts of free and ordered classes are made, and runs of k-means of which the best is taken.
STARTS, KMEANS_RUNS = ("spread", "quantiles", "kmeans"), 5


def weighted_pava(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The nondecreasing sequence next to ``y`` in weighted least squares; blocks without weight take plain means."""
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    blocks: list[list[float]] = []  # weight, weighted sum, plain sum, length
    mean = lambda b: b[1] / b[0] if b[0] > 0 else b[2] / b[3]
    for value, weight in zip(np.asarray(y, float), w):
        blocks.append([weight, weight * value, value, 1])
        while len(blocks) > 1 and mean(blocks[-2]) > mean(blocks[-1]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.repeat([mean(b) for b in blocks], [int(b[3]) for b in blocks]) if blocks else np.zeros(0)


def isotonic_by(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression of y on x; equal x are ordered by y and not pooled."""
    order = np.lexsort((y, x))
    out = np.empty(len(order))
    out[order] = weighted_pava(np.asarray(y, float)[order], np.asarray(w, float)[order])
    return out


def monotone(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nondecreasing over classes, item by item."""
    return np.column_stack([weighted_pava(p[:, j], np.maximum(weight[:, j], CLIP)) for j in range(p.shape[1])])


def item_ordered(p: np.ndarray, order: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Nonincreasing from the easiest item to the hardest, class by class; ``order`` lists items easy to hard."""
    out = np.empty_like(p)
    weight = np.ones_like(p) if weight is None else weight
    out[:, order] = np.vstack([-weighted_pava(-row[order], np.maximum(w[order], CLIP)) for row, w in zip(p, weight)])
    return out


def doubly_monotone(p: np.ndarray, weight: np.ndarray, order: np.ndarray, tol: float = 1e-10, cycles: int = 500) -> np.ndarray:
    """The table nearest in weighted least squares in both orders, by alternating projections with corrections."""
    x, a, b = p.copy(), np.zeros_like(p), np.zeros_like(p)
    for k in range(cycles):
        y = monotone(x + a, weight)
        if not k and (np.diff(y[:, order], axis=1) <= 0).all():
            return y  # the nearest under one order alone keeps the other
        a = x + a - y
        z = item_ordered(y + b, order, weight)
        b = y + b - z
        if np.abs(z - x).max() < tol and np.abs(z - y).max() < tol:
            return z
        x = z
    return x


@dataclass
class Fit:
    """Parameters of the best start.  ``probs`` is classes x items x categories."""

    model: str
    weights: np.ndarray
    probs: np.ndarray
    loglik: float
    n_par: int
    n_obs: int
    iterations: int
    converged: bool
    theta: np.ndarray | None = None
    steps: list[np.ndarray] = field(default_factory=list)
    sigma: float | None = None
    #: How far the loglik fell in one step of this run at most, relative to its size: 0 but for rounding if all went well.
    fall: float = 0.0


def _one_hot(x: pd.Series, n_items: int, n_cat: int) -> np.ndarray:
    answers = np.nan_to_num(np.array([np.asarray(v, float) for v in x]), nan=-1).astype(int)
    return (answers[:, :, None] == np.arange(n_cat)).reshape(len(answers), n_items * n_cat).astype(float)


def _posterior(seen: np.ndarray, weights: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joint = seen @ np.log(np.maximum(probs, CLIP)).reshape(len(weights), -1).T + np.log(np.maximum(weights, 1e-300))
    top = joint.max(1, keepdims=True)
    loglik = top[:, 0] + np.log(np.exp(joint - top).sum(1))
    return np.exp(joint - loglik[:, None]), loglik


def _sums(seen: np.ndarray, freq: np.ndarray, starts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per start a row: loglik, class counts, counts per class, item and category, over one-hot patterns."""
    n_classes = len(starts[0][0])
    logs = np.log(np.maximum([p for _, p in starts], CLIP)).reshape(len(starts) * n_classes, -1)
    prior = np.log(np.maximum([w for w, _ in starts], 1e-300)).ravel()
    # All starts at once: one product for the logs, one for the counts.
    joint = (seen @ logs.T + prior).reshape(len(seen), len(starts), n_classes)
    top = joint.max(2, keepdims=True)
    loglik = top[..., 0] + np.log(np.exp(joint - top).sum(2))
    post = np.exp(joint - loglik[..., None]) * freq[:, None, None]
    cells = (post.reshape(len(seen), -1).T @ seen).reshape(len(starts), -1)
    return np.concatenate([(freq @ loglik)[:, None], post.sum(0), cells], axis=1)


def _parted(sums: np.ndarray, shape: tuple[int, ...]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    return [(v[0], v[1 : 1 + shape[0]], v[1 + shape[0] :].reshape(shape)) for v in sums]


def expected_counts(patterns: DataFrame, starts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per start (loglik, class counts, counts per class, item and category) over a table (x, freq)."""
    shape = starts[0][1].shape
    size = 1 + shape[0] * (1 + shape[1] * shape[2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(starts), size))
        for batch in batches:
            if len(batch):
                total += _sums(_one_hot(batch["x"], shape[1], shape[2]), batch["freq"].to_numpy(float), starts)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    # At most MOST_TASKS vectors of the model's size.
    total = np.zeros((len(starts), size))
    for row in patterns.mapInPandas(run, "sums binary").collect():
        total += np.frombuffer(row["sums"]).reshape(total.shape)
    return _parted(total, shape)


def _climb(weights: np.ndarray, probs: np.ndarray, update: Callable, fixed_weights: bool, tol: float, max_iter: int):
    """One EM run: yields parameters, gets their expected counts, returns (weights, probs, loglik, steps, converged, fall).

    The parameters of the start needn't keep the model's orders, so the first step may lose likelihood.
    """
    last, fall = -np.inf, 0.0
    for step in range(max_iter):
        loglik, n, e = yield weights, probs
        if step >= 2:
            fall = max(fall, (last - loglik) / (abs(loglik) + tol))
        if step >= 3 and abs(loglik - last) < tol * (abs(loglik) + tol):
            return weights, probs, loglik, step + 1, True, fall
        last, probs = loglik, update(e)
        if not fixed_weights:
            weights = n / n.sum()
    loglik, _, _ = yield weights, probs  # a run that was ended early is judged by the parameters it returns
    return weights, probs, loglik, max_iter, False, fall


def _climbed_together(patterns: DataFrame, runs: list) -> list[tuple]:
    """Results of all runs, which share every pass over the patterns."""
    ended: dict[int, tuple] = {}
    asked = {k: next(run) for k, run in enumerate(runs)}
    while asked:
        ids = sorted(asked)
        for k, found in zip(ids, expected_counts(patterns, [asked[k] for k in ids])):
            try:
                asked[k] = runs[k].send(found)
            except StopIteration as end:
                ended[k] = end.value
                del asked[k]
    return [ended[k] for k in range(len(runs))]


def _climbed_apart(patterns: DataFrame, n_starts: int, shape: tuple[int, ...], climb: Callable) -> list[tuple]:
    """Results of all runs, a task each, for a table of at most PATTERNS_PER_TASK patterns that each task gets whole."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen, freq, k = _one_hot(group["x"], shape[1], shape[2]), group["freq"].to_numpy(float), int(group["start"].iloc[0])
        one, pars = climb(k)
        asked = next(one)
        while True:
            try:
                asked = one.send(_parted(_sums(seen, freq, [asked]), shape)[0])
            except StopIteration as end:
                weights, probs, loglik, steps, done, fall = end.value
                return pd.DataFrame({"start": [k], "weights": [weights.tobytes()], "probs": [np.ascontiguousarray(probs).tobytes()], "loglik": [loglik], "steps": [steps], "done": [done], "fall": [fall], "pars": [pars().tobytes()]})

    each = patterns.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(n_starts - 1))))
    rows = {r["start"]: r for r in per_key(each, "start", n_starts, run, "start int, weights binary, probs binary, loglik double, steps int, done boolean, fall double, pars binary").collect()}
    return [(np.frombuffer(r["weights"]), np.frombuffer(r["probs"]).reshape(shape), r["loglik"], r["steps"], r["done"], r["fall"], np.frombuffer(r["pars"])) for r in (rows[k] for k in range(n_starts))]


def _free(e: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Shares of categories; equal shares where a class has no answers."""
    total = e.sum(2, keepdims=True)
    even = (np.arange(e.shape[2]) <= tops[:, None]) / (tops[:, None] + 1)
    return np.where(total > 0, e / np.where(total > 0, total, 1), even)


def step_table(theta: np.ndarray, steps: list[np.ndarray], n_cat: int) -> np.ndarray:
    """Partial-credit probabilities: category x weighs exp of the sum of theta minus the first x steps."""
    out = np.zeros((len(theta), len(steps), n_cat))
    for j, d in enumerate(steps):
        logit = np.arange(len(d) + 1) * theta[:, None] - np.concatenate([[0], np.cumsum(d)])
        weight = np.exp(logit - logit.max(1, keepdims=True))
        out[:, j, : len(d) + 1] = weight / weight.sum(1, keepdims=True)
    return out


def _newton(e: np.ndarray, par: np.ndarray, ability: np.ndarray, tops: np.ndarray, rounds: int = 3, fixed: np.ndarray | float = 0.0) -> np.ndarray:
    """Raise the expected loglik of a partial-credit table that is linear in ``par``.

    ``ability`` maps the first parameters to one ability per class, on top of what is ``fixed``; the rest are the steps
    item by item.
    """
    k = ability.shape[1]
    first = k + np.concatenate([[0], np.cumsum(tops)]).astype(int)

    def table(v: np.ndarray) -> np.ndarray:
        return step_table(ability @ v[:k] + fixed, [v[first[j] : first[j + 1]] for j in range(len(tops))], e.shape[2])

    def quality(v: np.ndarray) -> float:
        return float((e * np.log(np.maximum(table(v), 1e-300))).sum())

    value = quality(par)
    for _ in range(rounds):
        p, n = table(par), e.sum(2)
        slope, curve = np.zeros(len(par)), 1e-9 * np.eye(len(par))
        for j, top in enumerate(tops):
            at = np.arange(e.shape[2])
            design = np.zeros((e.shape[0], e.shape[2], len(par)))
            design[:, :, :k] = at[None, :, None] * ability[:, None, :]
            design[:, :, first[j] : first[j + 1]] = -1.0 * (np.arange(1, top + 1) <= at[:, None])[None]
            flat = design.reshape(-1, len(par))
            slope += (e[:, j] - n[:, j, None] * p[:, j]).ravel() @ flat
            mean = (p[:, j, None, :] @ design)[:, 0]
            spread = (design - mean[:, None, :]).reshape(flat.shape)
            curve += spread.T @ ((n[:, j, None] * p[:, j]).ravel()[:, None] * spread)
        move = np.linalg.lstsq(curve, slope, rcond=None)[0]
        for scale in (1.0, 0.5, 0.25, 0.1, 0.01):
            tried = par + scale * np.clip(move, -2, 2)
            if (new := quality(tried)) > value:
                break
        else:
            return par
        par, gain, value = tried, new - value, new
        if gain < 1e-10 * (abs(value) + 1):
            break
    return par


def normal_nodes(n: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the standard normal distribution."""
    z, w = np.polynomial.hermite_e.hermegauss(n)
    return z, w / w.sum()


def _starts(model: str, shares: np.ndarray, tops: np.ndarray, n_classes: int, n_starts: int, seed: int) -> list[np.ndarray]:
    """Tables around the overall shares: spread classes for ordered models, random ones for the free model."""
    out = []
    for s in range(n_starts):
        rng = np.random.default_rng(seed + s)
        level = np.linspace(-1.5, 1.5, n_classes) if n_classes > 1 else np.zeros(1)
        shift = rng.normal(0, 1.2, (n_classes, shares.shape[0])) if model == "UN" else (level + rng.uniform(-0.3, 0.3, n_classes) * (s > 0))[:, None] + rng.uniform(-0.2, 0.2, (n_classes, shares.shape[0]))
        p = shares[None] * np.exp(np.arange(shares.shape[1])[None, None] * shift[:, :, None])
        out.append(np.maximum(p / p.sum(2, keepdims=True), CLIP) * (np.arange(shares.shape[1]) <= tops[:, None]))
    return out


def _total() -> Column:
    return F.aggregate("x", F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))


def score_cuts(patterns: DataFrame, n_classes: int) -> list[float]:
    """Quantiles (with linear interpolation) of everyone's total that cut persons into ``n_classes`` parts; one row per total is collected."""
    rows = patterns.groupBy(_total().alias("total")).agg(F.sum("freq").alias("n")).orderBy("total").collect()
    totals, upto = np.array([r["total"] for r in rows], float), np.cumsum([r["n"] for r in rows])
    at = (upto[-1] - 1) * np.arange(1, n_classes) / n_classes
    low, high = (totals[np.searchsorted(upto, np.floor(k) if down else np.ceil(k), "right")] for k, down in ((at, True), (at, False)))
    return (low + (at - np.floor(at)) * (high - low)).tolist()


def _by_scores(patterns: DataFrame, n_classes: int) -> DataFrame:
    """(k, x, freq): patterns with the part of the totals in which they are; a total equal to a cut is below it."""
    cuts = score_cuts(patterns, n_classes)
    return patterns.select(sum((_total() > c).cast("int") for c in cuts) if cuts else F.lit(0), "x", "freq").toDF("k", "x", "freq")


def _by_means(patterns: DataFrame, n_classes: int, shares: np.ndarray, seed: int) -> DataFrame:
    """(k, x, freq): patterns with their cluster, of KMEANS_RUNS runs of k-means that with the least cost.

    Missing answers take the item's mean.  Rows lie in an order that doesn't depend on how they came, so reruns agree.
    """
    mean = F.array(*[F.lit(float(v)) for v in shares @ np.arange(shares.shape[1])])
    filled = F.zip_with("x", mean, lambda v, m: F.coalesce(v.cast("double"), m))
    parts = 1 + min(patterns.count() // PATTERNS_PER_TASK, MOST_TASKS - 1)
    rows = patterns.select("x", "freq", array_to_vector(filled).alias("features")).repartition(parts, "x").sortWithinPartitions("x")
    with kept(rows) as rows:
        runs = [KMeans(k=n_classes, seed=seed + s, weightCol="freq", predictionCol="k").fit(rows) for s in range(KMEANS_RUNS)]
        return min(runs, key=lambda m: m.summary.trainingCost).transform(rows).select("k", "x", "freq")


def grouped_starts(patterns: DataFrame, kind: str, shares: np.ndarray, tops: np.ndarray, n_classes: int, n_starts: int, seed: int) -> list[np.ndarray]:
    """Tables of the answers in ``n_classes`` groups of persons, lowest mean answers first, by quantiles of totals or by k-means.

    A group without answers to an item takes a level by its place.  Tables are moved by up to 0.05, by k-means all but the first
    one, and kept off 0 and 1 by 0.01.  Groups are counted by Spark: a row per group, item and answer is collected.
    """
    n_cat = shares.shape[1]
    possible = np.arange(n_cat) <= tops[:, None]
    if n_classes == 1:
        groups = patterns.select(F.lit(0).alias("k"), "x", "freq")
    else:
        groups = _by_scores(patterns, n_classes) if kind == "quantiles" else _by_means(patterns, n_classes, shares, seed)
    e = np.zeros((n_classes, *shares.shape))
    for r in groups.select("k", "freq", F.posexplode("x").alias("item", "v")).where("v is not null").groupBy("k", "item", "v").agg(F.sum("freq").alias("n")).collect():
        e[r["k"], r["item"], r["v"]] = r["n"]
    place = (np.arange(n_classes) + 0.5) / n_classes
    level = np.exp(np.arange(n_cat) * np.log(place / (1 - place))[:, None])[:, None, :] * possible
    total = e.sum(2, keepdims=True)
    table = np.where(total > 0, e / np.maximum(total, 1), level / level.sum(2, keepdims=True))
    table = table[np.argsort((table @ np.arange(n_cat)).sum(1), kind="stable")]
    out = []
    for s in range(n_starts):
        p = table.copy()
        if kind == "quantiles" or s:
            p[:, :, 1:] += np.random.default_rng(seed + s).uniform(-0.05, 0.05, p[:, :, 1:].shape)
        p[:, :, 1:] = np.clip(p[:, :, 1:], 0.01, 0.99)
        p[:, :, 0] = np.maximum(1 - (p * possible)[:, :, 1:].sum(2), 0.01)
        p = p * possible
        out.append(p / p.sum(2, keepdims=True))
    return out


def fit(patterns: DataFrame, model: str = "UN", n_classes: int = 2, n_starts: int = 10, tol: float = 1e-6, seed: int = 1, max_iter: int | None = None, also: list[Fit] | None = None, item_order: tuple[int, ...] | None = None, constraints: Constraints | None = None, starts: str = "spread") -> Fit:
    """The best of ``n_starts`` EM runs on a table (x, freq).

    Runs on up to PATTERNS_PER_TASK patterns are a task each; on more, all runs share each pass over the patterns.
    Both take the same steps.

    UN: free classes; MON: nondecreasing over classes; IIO: items in one order in every class; DM: both; LCR: Rasch or
    partial-credit items over free classes; RM: the same over a normal distribution (one start).  On graded answers
    MON orders every P(answer >= x) over classes and IIO the mean answers of items; their M step is the constrained maximum.  A run ends when the loglik changes by less than ``tol`` of its size, after 3 steps at least.
    Latent class fits in ``also`` with the same number of classes are further starts.  ``item_order`` (easy to hard) takes the
    place of the order of mean answers; ``constraints`` put any orders on free classes.  ``starts`` says where runs of free and
    ordered classes begin: "spread" around the overall shares, or at groups of persons by "quantiles" of totals or "kmeans".
    """
    with kept(patterns) as patterns:
        return _fit(patterns, model, n_classes, n_starts, tol, seed, max_iter, also, item_order, constraints, starts)


def _fit(patterns: DataFrame, model: str, n_classes: int, n_starts: int, tol: float, seed: int, max_iter: int | None, also: list[Fit] | None, item_order: tuple[int, ...] | None, constraints: Constraints | None, starts: str) -> Fit:
    if model not in MODELS:
        raise ValueError(f"no model named {model}")
    if starts not in STARTS:
        raise ValueError(f"no starts named {starts}")
    if starts != "spread" and model in ("LCR", "RM"):
        raise ValueError("groups of persons are starts of classes without abilities")
    overall = patterns.select("freq", F.posexplode("x").alias("item", "v")).groupBy("item", "v").agg(F.sum("freq").alias("n")).collect()
    n_patterns, n_obs = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("freq"), F.lit(0))).first()
    answered = [r for r in overall if r["v"] is not None]
    if not answered:
        raise ValueError("no answers to fit")
    counts = np.zeros((1 + max(r["item"] for r in overall), max(2, 1 + max(r["v"] for r in answered))))
    for r in answered:
        counts[r["item"], r["v"]] += r["n"]
    given = None if starts == "spread" else grouped_starts(patterns, starts, *_shares(counts), n_classes, n_starts, seed)
    shape, tables, climb, finish = _problem(counts, model, n_classes, n_starts, tol, seed, max_iter, also, item_order, constraints, given)
    return finish(climbed(patterns, n_patterns, len(tables), shape, climb), n_obs)


def climbed(patterns: DataFrame, n_patterns: int, n_starts: int, shape: tuple[int, ...], climb: Callable) -> list[tuple]:
    """Results of ``n_starts`` EM runs, each with its last parameters, over a table of any size."""
    if n_patterns <= PATTERNS_PER_TASK:
        return _climbed_apart(patterns, n_starts, shape, climb)
    with kept(patterns.repartition(1 + min(n_patterns // PATTERNS_PER_TASK, MOST_TASKS - 1))) as spread:
        runs = [climb(s) for s in range(n_starts)]
        return [(*r, last()) for r, (_, last) in zip(_climbed_together(spread, [run for run, _ in runs]), runs)]


def fit_here(x: np.ndarray, freq: np.ndarray, n_cat: int, model: str = "UN", n_classes: int = 2, n_starts: int = 10, tol: float = 1e-6, seed: int = 1, max_iter: int | None = None, also: list[Fit] | None = None, item_order: tuple[int, ...] | None = None, constraints: Constraints | None = None) -> Fit:
    """``fit`` of patterns that a task holds: ``x`` is patterns x items, -1 where an answer is missing."""
    seen = (x[:, :, None] == np.arange(n_cat)).reshape(len(x), -1).astype(float)
    shape, starts, climb, finish = _problem((freq @ seen).reshape(x.shape[1], n_cat), model, n_classes, n_starts, tol, seed, max_iter, also, item_order, constraints)
    results = []
    for s in range(len(starts)):
        run, last = climb(s)
        asked = next(run)
        while True:
            try:
                asked = run.send(_parted(_sums(seen, freq, [asked]), shape)[0])
            except StopIteration as end:
                results.append((*end.value, last()))
                break
    return finish(results, int(freq.sum()))


def _shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of categories per item, each category that occurs counted half a time more, highest categories)."""
    tops = np.maximum(1, np.array([np.nonzero(c)[0].max(initial=0) for c in counts]))
    raised = counts + 0.5 * (np.arange(counts.shape[1]) <= tops[:, None])
    return raised / raised.sum(1, keepdims=True), tops


def _problem(counts: np.ndarray, model: str, n_classes: int, n_starts: int, tol: float, seed: int, max_iter: int | None, also: list[Fit] | None, item_order: tuple[int, ...] | None = None, constraints: Constraints | None = None, given: list[np.ndarray] | None = None) -> tuple:
    """(shape of the probabilities, starts, ``climb(s)`` of one EM run, ``finish`` of all results) for answer counts per item and category."""
    n_items, n_cat = counts.shape
    shares, tops = _shares(counts)
    order = np.argsort(-(shares @ np.arange(n_cat)), kind="stable") if item_order is None else np.array(item_order)
    if constraints is not None and model != "UN":
        raise ValueError("constraints are for free classes")

    ability, pars = None, None
    if model == "RM":
        z, node_weights = normal_nodes()
        ability, n_classes, n_starts = z[:, None], len(z), 1
    elif model == "LCR":
        ability = np.eye(n_classes)
    probs = given or _starts(model, shares, tops, n_classes, n_starts, seed)
    weights = [node_weights if model == "RM" else np.full(n_classes, 1 / n_classes) for _ in probs]
    if ability is None:
        for f in also or []:
            if f.probs.shape == probs[0].shape:
                weights.append(f.weights)
                probs.append(f.probs)
    if ability is not None:
        easy = [np.log(shares[j, :-1][: tops[j]] / shares[j, 1:][: tops[j]]) for j in range(n_items)]
        lead = [np.ones(1) if model == "RM" else np.sort(np.random.default_rng(seed + s).uniform(-4, 4, n_classes)) if s else np.linspace(-1.5, 1.5, n_classes) for s in range(n_starts)]
        pars = [np.concatenate([a, *easy]) for a in lead]
        probs = [step_table(ability @ v[: ability.shape[1]], _split(v, ability.shape[1], tops), n_cat) for v in pars]

    ordered = OrderedStep(probs[0].shape, tops, constraints or ordering(model, order)) if ability is None and (constraints or model != "UN") else None

    def updater(par: list) -> Callable[[np.ndarray], np.ndarray]:
        """The M step of one run, whose abilities and steps are in ``par``."""
        last: list[np.ndarray] = []

        def likeliest(e: np.ndarray) -> np.ndarray:
            p = ordered(e)
            # What was found before keeps the orders too; the search's last digits mustn't cost likelihood.
            if last and expected_loglik(e, last[0]) > expected_loglik(e, p):
                return last[0]
            last[:] = [p]
            return p

        def update(e: np.ndarray) -> np.ndarray:
            if ability is not None:
                k = ability.shape[1]
                par[0] = _newton(e, par[0], ability, tops)
                if model == "RM":
                    par[0][0] = np.clip(abs(par[0][0]), 0.02, 20)
                return step_table(ability @ par[0][:k], _split(par[0], k, tops), n_cat)
            if constraints is not None or (model != "UN" and n_cat > 2):
                return likeliest(e)
            p = _free(e, tops)
            if model == "UN":
                return p
            # Of two categories the weighted projection is the maximum.
            project: dict[str, Callable] = {"MON": lambda q: monotone(q, e.sum(2)), "IIO": lambda q: item_ordered(q, order, e.sum(2)), "DM": lambda q: doubly_monotone(q, e.sum(2), order)}
            right = np.clip(project[model](p[:, :, 1]), CLIP, 1 - CLIP)
            return np.stack([1 - right, right], 2)

        return update

    def climb(s: int):
        par = [np.zeros(0) if pars is None else pars[s].copy()]
        return _climb(weights[s], probs[s], updater(par), model == "RM", tol, max_iter or (1000 if model == "UN" else 500)), lambda: np.asarray(par[0], float)

    def finish(results: list[tuple], n_obs: int) -> Fit:
        weights, probs, loglik, steps, done, fall, pars = (list(column) for column in zip(*results))
        best = int(np.argmax(loglik))
        w, p = weights[best], probs[best]
        k = ability.shape[1] if ability is not None else 0
        theta, items, sigma = None, [], None
        if ability is not None:
            theta, items = ability @ pars[best][:k], _split(pars[best], k, tops)
            sigma = float(pars[best][0]) if model == "RM" else None
            if model == "LCR":  # the steps sum to zero
                shift = np.concatenate(items).mean()
                theta, items = theta - shift, [d - shift for d in items]
        level = theta if theta is not None else (p @ np.arange(n_cat)).sum(1)
        # Classes that constraints name keep their numbers.
        rank = np.arange(len(w)) if constraints is not None else np.argsort(-w if model == "UN" else level, kind="stable")
        n_par = {"RM": 1 + int(tops.sum()), "LCR": 2 * n_classes - 1 + int(tops.sum()) - 1}.get(model, n_classes - 1 + n_classes * int(tops.sum()))
        return Fit(model, w[rank], p[rank], float(loglik[best]), n_par, n_obs, steps[best], done[best], None if theta is None else theta[rank], items, sigma, float(fall[best]))

    return probs[0].shape, probs, climb, finish


def _split(v: np.ndarray, k: int, tops: np.ndarray) -> list[np.ndarray]:
    return np.split(v[k:], np.cumsum(tops)[:-1])


def class_table(spark, f: Fit) -> DataFrame:
    """(class_id, weight, item_id, category, p) of a fit."""
    rows = [(c, float(f.weights[c]), j, x, float(f.probs[c, j, x])) for c, j, x in np.ndindex(f.probs.shape)]
    return spark.createDataFrame(rows, "class_id int, weight double, item_id int, category int, p double")


def step_rows(spark, f: Fit) -> DataFrame:
    """(item_id, step, delta) of a Rasch or partial-credit fit."""
    return spark.createDataFrame([(j, k + 1, float(d)) for j, item in enumerate(f.steps) for k, d in enumerate(item)], "item_id int, step int, delta double")


def fit_measures(patterns: DataFrame, f: Fit) -> DataFrame:
    """One row: model, loglik, n_par, aic, bic, g2, x2, df.  G2 and X2 are over the patterns without missing answers.

    Patterns that nobody gave add their expected number to X2, which is what the seen ones leave of the total.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                _, loglik = _posterior(_one_hot(b["x"], f.probs.shape[1], f.probs.shape[2]), f.weights, f.probs)
                yield pd.DataFrame({"freq": b["freq"], "p": np.exp(loglik)})

    whole = patterns.where(~F.exists("x", lambda v: v.isNull()))
    cells = whole.mapInPandas(run, "freq long, p double")
    n = F.sum("freq")
    cells = cells.groupBy().agg(n.alias("n"), F.sum("p").alias("p_seen"), F.sum(F.col("freq") * F.log(F.col("freq") / F.col("p"))).alias("flp"), F.sum(F.col("freq") * F.col("freq") / F.col("p")).alias("ffp"))
    n, tops = F.col("n"), (f.probs.sum(0) > CLIP).sum(1)
    x2 = F.col("ffp") / n - 2 * n + n * F.col("p_seen") + n * F.greatest(F.lit(0.0), 1 - F.col("p_seen"))
    return cells.select(
        F.lit(f.model).alias("model"), F.lit(f.loglik).alias("loglik"), F.lit(f.n_par).alias("n_par"),
        F.lit(2 * f.n_par - 2 * f.loglik).alias("aic"), F.lit(f.n_par * float(np.log(max(f.n_obs, 1))) - 2 * f.loglik).alias("bic"),
        (2 * (F.col("flp") - n * F.log(n))).alias("g2"), x2.alias("x2"), F.lit(float(np.prod(tops.astype(float))) - 1 - f.n_par).alias("df"),
    )


def person_scores(packed: DataFrame, f: Fit) -> DataFrame:
    """(person_id, eap, sd, modal) of a fit with abilities: posterior mean and deviation, and the first likeliest ability."""
    if f.theta is None:
        raise ValueError(f"{f.model} has no abilities")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                post, _ = _posterior(_one_hot(b["x"], f.probs.shape[1], f.probs.shape[2]), f.weights, f.probs)
                mean = post @ f.theta
                yield pd.DataFrame({"person_id": b["person_id"], "eap": mean, "sd": np.sqrt(np.maximum(post @ f.theta**2 - mean**2, 0)), "modal": f.theta[post.argmax(1)]})

    return packed.select("person_id", "x").mapInPandas(run, "person_id long, eap double, sd double, modal double")


def score_abilities(f: Fit, kind: str = "ML") -> list[tuple[int, float | None, float | None]]:
    """(total, theta, se) for every total of all items of a Rasch or partial-credit fit.

    ML is infinite without and with all steps, where WLE (the same with a correction for its bias) is null.  So is
    an ability beyond 10.
    """
    if kind not in ("ML", "WLE"):
        raise ValueError(f"no score named {kind}")
    if f.theta is None:
        raise ValueError(f"{f.model} has no abilities")
    at, top = np.arange(f.probs.shape[2]), sum(map(len, f.steps))

    def moments(theta: float) -> tuple[float, float, float]:
        p = step_table(np.array([theta]), f.steps, len(at))[0]
        mean = p @ at
        away = at[None] - mean[:, None]
        return mean.sum(), (p * away**2).sum(), (p * away**3).sum()

    def excess(theta: float, total: int) -> float:
        mean, var, skew = moments(theta)
        return mean - total - (skew / (2 * var) if kind == "WLE" else 0.0)

    out: list[tuple[int, float | None, float | None]] = []
    for total in range(top + 1):
        if total in (0, top):
            out.append((total, None if kind == "WLE" else float("inf") if total else float("-inf"), None))
            continue
        low, high = -10.0, 10.0
        if excess(low, total) > 0 or excess(high, total) < 0:
            out.append((total, None, None))
            continue
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if excess(mid, total) > 0 else (mid, high)
        out.append((total, mid, 1 / float(np.sqrt(moments(mid)[1]))))
    return out


def total_scores(packed: DataFrame, f: Fit, kind: str = "ML") -> DataFrame:
    """(person_id, theta, se) by total score, which the model makes sufficient; persons with missing answers get null.

    There is one ability per total, so those are broadcast.
    """
    scale = F.broadcast(packed.sparkSession.createDataFrame(score_abilities(f, kind), "total int, theta double, se double"))
    person = packed.select("person_id", F.when(~F.exists("x", lambda v: v.isNull()), F.aggregate("x", F.lit(0), lambda s, v: s + v)).alias("total"))
    return person.join(scale, "total", "left").select("person_id", "theta", "se")


def rasch_residuals(r: DataFrame, people: DataFrame, f: Fit) -> DataFrame:
    """(person_id, item_id, x, e, v): answers with their expectation and variance at the person's eap."""
    n_cat = f.probs.shape[2]
    steps = F.broadcast(r.sparkSession.createDataFrame([(j, [float(t) for t in np.cumsum(d)]) for j, d in enumerate(f.steps)], "item_id int, cum array<double>"))
    joined = r.where("x is not null").join(steps, "item_id").join(people.select("person_id", "eap"), "person_id")
    joined = joined.withColumn("g", F.expr(f"transform(slice(concat(array(0D), cum), 1, {n_cat}), (d, k) -> exp(k * eap - d))"))
    moment = lambda k: F.expr(f"aggregate(transform(g, (w, k) -> w * power(k, {k})), 0D, (s, v) -> s + v) / aggregate(g, 0D, (s, v) -> s + v)")
    return joined.withColumns({"e": moment(1), "m2": moment(2)}).select("person_id", "item_id", "x", "e", (F.col("m2") - F.col("e") * F.col("e")).alias("v"))


def item_information(spark, f: Fit, low: float = -4, high: float = 4, points: int = 81) -> DataFrame:
    """(theta, item_id, information): the variance of the answer over a grid of abilities."""
    table = step_table(np.linspace(low, high, points), f.steps, f.probs.shape[2])
    at = np.arange(f.probs.shape[2])
    info = table @ at**2 - (table @ at) ** 2
    return spark.createDataFrame([(float(t), j, float(info[i, j])) for i, t in enumerate(np.linspace(low, high, points)) for j in range(len(f.steps))], "theta double, item_id int, information double")


def total_information(spark, f: Fit, low: float = -4, high: float = 4, points: int = 81) -> DataFrame:
    """(theta, information) of all items together."""
    return item_information(spark, f, low, high, points).groupBy("theta").agg(F.sum("information").alias("information"))


def fit_responses(packed: DataFrame, model: str, **options) -> tuple[Fit, DataFrame]:
    """A fit of a packed table, and the pattern table it was made on."""
    patterns = pattern_frequencies(packed)
    return fit(patterns, model, **options), patterns
