"""A Rasch model whose abilities follow no given law, and replicates with abilities drawn anew.

The distribution of abilities is a histogram on fixed nodes, whose weights are estimated together with the steps.
Replicates draw everyone's ability afresh, so who left out what can't stay with the person: masks go by rank instead.
The person whose observed mean has rank r gets the answers of the simulated person whose total has rank r.  As simulated
persons are alike but for their totals, and answers given a total don't depend on the ability, it's enough to know how
many simulated persons have each total; the answers are then drawn given the total of the rank.  So no persons are
matched by a join, and what all tasks share is a count per replicate and total.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixtures as M
from .counts import mask_ranks, pattern_frequencies
from .fanout import kept
from .mixtures import Fit
from .nulls import REPLICATES, Draw, Refit, _matrix, _numbers, _replicated, _step_weights, given_totals, is_large, refit_table

#: Nodes of the histogram and how many standard deviations it reaches to either side.
NODES, REACH = 41, 4.0


def free_latent(patterns: DataFrame, rasch: Fit, nodes: int = NODES, rounds: int = 200, tol: float = 1e-7) -> Fit:
    """The Rasch or partial-credit fit ``rasch`` with a free histogram of abilities on equally spaced nodes.

    Weights and steps are estimated together by EM from equal weights, so the histogram isn't drawn towards the normal
    distribution as a single pass of posteriors would be.
    """
    if rasch.theta is None or rasch.sigma is None:
        raise ValueError("a free distribution of abilities needs a Rasch fit")
    z = np.linspace(-REACH, REACH, nodes) * rasch.sigma
    n_cat, tops = rasch.probs.shape[2], np.array([len(d) for d in rasch.steps])
    start = np.concatenate(rasch.steps)
    table = lambda v: M.step_table(z, M._split(v, 0, tops), n_cat)

    def climb(_: int):
        par = [start.copy()]

        def update(e: np.ndarray) -> np.ndarray:
            par[0] = M._newton(e, par[0], np.zeros((nodes, 0)), tops, fixed=z)
            return table(par[0])

        return M._climb(np.full(nodes, 1 / nodes), table(start), update, False, tol, rounds), lambda: np.asarray(par[0], float)

    with kept(patterns) as patterns:
        n = patterns.count()
        weights, probs, loglik, steps, done, fall, par = M.climbed(patterns, n, 1, table(start).shape, climb)[0]
    return replace(rasch, weights=np.maximum(weights, 1e-10) / np.maximum(weights, 1e-10).sum(), probs=probs, loglik=float(loglik), n_par=int(tops.sum()) + nodes - 1, iterations=steps, converged=done, theta=z, steps=M._split(par, 0, tops), sigma=None, fall=float(fall))


def latent_moments(f: Fit) -> tuple[float, float]:
    """(mean, variance) of the abilities of a fit."""
    mean = float(f.weights @ f.theta)
    return mean, float(f.weights @ (f.theta - mean) ** 2)


def histogram(spark, f: Fit) -> DataFrame:
    """(ability, weight) of a fit with abilities."""
    return spark.createDataFrame([(float(t), float(w)) for t, w in zip(f.theta, f.weights)], "ability double, weight double")


def drawn_abilities(f: Fit, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Abilities by two uniform numbers each: normal with a fit's sigma, else a node by weight, spread evenly over its bin."""
    if f.sigma is not None:
        return f.sigma * np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)
    half = np.diff(f.theta) / 2
    edges = np.concatenate([[f.theta[0] - half[0]], f.theta[:-1] + half, [f.theta[-1] + half[-1]]])
    k = np.minimum(np.searchsorted(np.cumsum(f.weights) / f.weights.sum(), u, "right"), len(f.theta) - 1)
    return edges[k] + v * (edges[k + 1] - edges[k])


#: Steps of the replicates that don't have those of the fit.
Steps = dict[int, list[np.ndarray]]


def _all_answers(ids: np.ndarray, rep: int, f: Fit, seed: int, steps: Steps) -> np.ndarray:
    """Simulated answers of persons to all items."""
    number = _numbers(ids, rep, seed)
    theta = drawn_abilities(f, number(0), number(1))
    upto = np.cumsum(M.step_table(theta, steps.get(rep, f.steps), f.probs.shape[2]), axis=2)
    tops = np.array([len(d) for d in f.steps])
    return np.stack([np.minimum((number(j + 2)[:, None] >= upto[:, j]).sum(1), tops[j]) for j in range(len(tops))], 1)


def simulated_totals(packed: DataFrame, f: Fit, replicates: int, seed: int, steps: Steps) -> np.ndarray:
    """Replicates x totals: how many simulated persons have each total; a row per batch and replicate is added up by Spark."""
    top = sum(len(d) for d in f.steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for rep in range(replicates):
                n = np.bincount(_all_answers(ids, rep, f, seed, steps).sum(1), minlength=top + 1)
                yield pa.RecordBatch.from_pydict({"rep": pa.array([rep] * (top + 1), pa.int32()), "total": pa.array(np.arange(top + 1), pa.int32()), "n": pa.array(n, pa.int64())})

    counts = packed.where("person_id is not null").select("person_id").mapInArrow(run, "rep int, total int, n long").groupBy("rep", "total").agg(F.sum("n").alias("n"))
    out = np.zeros((replicates, top + 1), np.int64)
    for r in counts.collect():
        out[r["rep"], r["total"]] = r["n"]
    return out


#: What the seed of a provisional replicate has on top of the seed of the final one.
_PROVISIONAL = 1_000_003


def redrawn_steps(packed: DataFrame, f: Fit, replicates: int = REPLICATES, seed: int = 1) -> Steps:
    """Steps of every replicate with their sampling error: those of a Rasch fit to answers drawn under ``f``.

    The refits are a task each and take abilities of mean zero, so the mean of those of ``f`` is added to their steps.  A
    replicate that can't be fitted, or in which the highest answer of an item is absent, keeps the steps of ``f``.
    """
    drawn = marginal_replicates(packed, f, replicates, seed + _PROVISIONAL)
    fits = refit_table(drawn, replicates, f.probs.shape[2], Refit("RM"), is_large(pattern_frequencies(packed)), 1, seed)
    tops, mean = np.array([len(d) for d in f.steps]), 0.0 if f.sigma is not None else latent_moments(f)[0]
    rows = fits.select("rep", "steps").collect()  # a row per replicate
    return {r["rep"]: M._split(np.array(r["steps"]) + mean, 0, tops) for r in rows if len(r["steps"]) == tops.sum()}


def marginal_replicates(packed: DataFrame, f: Fit, replicates: int = REPLICATES, seed: int = 1, item_errors: bool = False) -> DataFrame:
    """(rep, x, freq): abilities drawn from the distribution of ``f``, answers under its steps, observed masks by rank.

    Persons without any answer come last in rank.  With ``item_errors`` every replicate has steps of its own, see
    ``redrawn_steps``, so that what is made of replicates varies with the steps' errors too.
    """
    people = packed.where("person_id is not null").select("person_id", "x")
    steps = redrawn_steps(people, f, replicates, seed) if item_errors else {}
    if not people.where(F.exists("x", lambda v: v.isNull())).limit(1).count():
        return _replicated(people, range(replicates), lambda ids, answers: lambda rep: _all_answers(ids, rep, f, seed, steps))
    upto = np.cumsum(simulated_totals(people, f, replicates, seed, steps), axis=1)
    ranks = mask_ranks(people.select("person_id", F.posexplode("x").alias("item_id", "x")), len(f.steps)).select("person_id", "rank")

    def prepare(ids: np.ndarray, answers: np.ndarray, rank: np.ndarray) -> Draw:
        def draw(rep: int) -> np.ndarray:
            number = _numbers(ids, rep, seed)
            totals = np.minimum(np.searchsorted(upto[rep], rank, "left"), upto.shape[1] - 1)
            drawn = given_totals(totals, _step_weights(steps.get(rep, f.steps)), lambda place: number(place + 2 + len(f.steps)))
            return np.where(answers < 0, -1, drawn)

        return draw

    return _replicated(people.join(ranks, "person_id"), range(replicates), prepare, "rank")
