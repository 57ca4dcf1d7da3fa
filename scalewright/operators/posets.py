"""Partial orders of classes and of items: which pairs can be shown to be ordered, and what they add up to.

How far x is from lying above y is the mean, over the other side, of what y exceeds x by.  It is taken in the fit of free
classes and in refits of replicates under it, with their classes matched.  Bounds hold for all directed pairs of a side
at once: each pair's own spread is scaled by one quantile of the largest deviation.  x lies above y if the bound from above of
its shortfall is within a tolerance, while the bound from below of the reverse one is beyond it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nulls as N
from .errors import matched
from .mixtures import Fit, fit

SHORTFALLS = "rep int, side string, x int, y int, v double"
#: Replicates at least, of which half and LEAST_FITTED must be fitted, and the tolerance at 1,500 persons.
REPLICATES, LEAST_FITTED, SLIGHT = 99, 20, 0.01


def profiles(f: Fit) -> np.ndarray:
    """Classes x items: mean answers as shares of the highest one."""
    tops = np.maximum(1, ((f.probs > 1e-9).any(0) * np.arange(f.probs.shape[2])).max(1))
    return (f.probs @ np.arange(f.probs.shape[2])) / tops


def shortfalls(p: np.ndarray, sides: tuple[str, ...]) -> list[tuple[str, int, int, float]]:
    """(side, x, y, mean excess of y over x) of all directed pairs of classes and of items."""
    out = []
    for side in sides:
        rows = p if side == "class" else p.T
        gap = np.maximum(rows[None, :, :] - rows[:, None, :], 0).mean(2)
        out += [(side, x, y, float(gap[x, y])) for x in range(len(rows)) for y in range(len(rows)) if x != y]
    return out


def demonstrated(observed: DataFrame, replicated: DataFrame, tolerance: float, alpha: float = 0.05) -> DataFrame:
    """(side, dominant, dominated) of the pairs that are shown to be ordered.

    ``observed`` is (side, x, y, v), ``replicated`` the same per replicate (rep).
    """
    key = ["side", "x", "y"]
    scale = replicated.groupBy(*key).agg(F.greatest(F.stddev_samp("v"), F.lit(1e-6)).alias("s"))
    seen = observed.select(*key, F.col("v").alias("v0")).join(scale, key)
    away = replicated.join(F.broadcast(seen), key).withColumn("d", (F.col("v") - F.col("v0")) / F.col("s"))
    most = away.groupBy("rep", "side").agg(F.max("d").alias("up"), F.max(-F.col("d")).alias("down"))
    at = F.lit(1 - alpha / 2)
    factor = most.groupBy("side").agg(F.percentile("up", at).alias("u"), F.percentile("down", at).alias("l"))
    bounds = seen.join(factor, "side").select(*key, (F.col("v0") + F.col("u") * F.col("s")).alias("high"), (F.col("v0") - F.col("l") * F.col("s")).alias("low"))
    reverse = bounds.select("side", F.col("x").alias("y"), F.col("y").alias("x"), F.col("high").alias("high_back"), F.col("low").alias("low_back"))
    both = bounds.join(reverse, key)
    above = (F.col("high") <= tolerance) & (F.col("low_back") > tolerance)
    below = (F.col("high_back") <= tolerance) & (F.col("low") > tolerance)
    return both.where(above & ~below).select("side", F.col("x").alias("dominant"), F.col("y").alias("dominated"))


def added_by_closure(pairs: DataFrame) -> DataFrame:
    """(side, dominant, dominated) of pairs two steps apart that aren't pairs themselves.

    Without any, the relation is its own transitive closure, and as no pair is in it both ways, it has no cycle either.
    """
    step = pairs.select("side", F.col("dominant").alias("dominated"), F.col("dominated").alias("end"))
    two = pairs.join(step, ["side", "dominated"]).select("side", "dominant", F.col("end").alias("dominated")).distinct()
    return two.join(pairs, ["side", "dominant", "dominated"], "left_anti")


def shapes(pairs: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(side, comparable, total, shape, kind) per side of ``sizes``: antichain, partial, chain, or a relation that isn't an order.

    ``kind`` names partial orders of three: a single pair, V (one above both others) or Lambda (two above one).
    """
    spark = pairs.sparkSession
    sides = spark.createDataFrame([(side, n * (n - 1) // 2, n) for side, n in sizes.items()], "side string, total int, members int")
    n = pairs.groupBy("side").agg(F.count(F.lit(1)).alias("comparable"))
    broken = added_by_closure(pairs).groupBy("side").agg(F.count(F.lit(1)).alias("added"))
    above = pairs.groupBy("side", "dominant").agg(F.count(F.lit(1)).alias("n")).groupBy("side").agg(F.max("n").alias("above"))
    below = pairs.groupBy("side", "dominated").agg(F.count(F.lit(1)).alias("n")).groupBy("side").agg(F.max("n").alias("below"))
    out = sides
    for part in (n, broken, above, below):
        out = out.join(F.broadcast(part), "side", "left")
    count = F.coalesce("comparable", F.lit(0)).cast("long")
    shape = F.when(count == 0, "antichain").when(F.coalesce("added", F.lit(0)) > 0, "nontransitive").when(count == F.col("total"), "chain").otherwise("partial")
    kind = F.when((F.col("members") != 3) | (shape != "partial"), None).when(count == 1, "single").when(F.col("above") == 2, "V").when(F.col("below") == 2, "Lambda")
    return out.select("side", count.alias("comparable"), "total", shape.alias("shape"), kind.alias("kind"))


def refine(packed: DataFrame, patterns: DataFrame, n_classes: int = 3, replicates: int = REPLICATES, tolerance: float | None = None, alpha: float = 0.05, n_starts: int = 5, sides: tuple[str, ...] = ("class", "item"), seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(``demonstrated`` pairs, their ``shapes``) of the free classes of a table of answers.

    ``tolerance`` is SLIGHT at 1,500 persons by default, more for fewer.  Two classes have nothing between an antichain and a
    chain, so their side is left out.  Too few refits are an error.
    """
    sides = tuple(s for s in sides if s != "class" or n_classes > 2)
    if not sides:
        raise ValueError("two classes have no partial order")
    replicates = max(replicates, REPLICATES)
    free = fit(patterns, "UN", n_classes=n_classes, n_starts=n_starts, seed=seed)
    here, shape = profiles(free), free.probs.shape
    tolerance = SLIGHT * math.sqrt(1500 / max(free.n_obs, 1)) if tolerance is None else tolerance

    def compared(fits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for rep, weights, probs in zip(fits["rep"], fits["weights"], fits["probs"]):
            if len(probs) == math.prod(shape):
                p = profiles(Fit("UN", np.asarray(weights), np.asarray(probs).reshape(shape), 0.0, 0, 0, 0, True))
                rows += [(rep, *one) for one in shortfalls(p[matched(p, here)], sides)]
        return pd.DataFrame(rows, columns=["rep", "side", "x", "y", "v"])

    drawn = N.model_replicates(packed, free, replicates, seed)
    refits = N.refit_table(drawn, replicates, shape[2], N.Refit("UN", n_classes), N.is_large(patterns), n_starts, seed, compared, SHORTFALLS)
    spark = patterns.sparkSession
    # Replicates x pairs of classes and items; held, since the bounds use them twice.
    rows = refits.persist()
    fitted = rows.select("rep").distinct().count()
    if fitted < max(LEAST_FITTED, replicates // 2):
        raise ValueError(f"only {fitted} of {replicates} replicates could be fitted")
    observed = spark.createDataFrame(shortfalls(here, sides), "side string, x int, y int, v double")
    pairs = demonstrated(observed, rows, tolerance, alpha)
    found = [tuple(r) for r in pairs.collect()]  # at most as many as there are pairs of classes and of items
    rows.unpersist()
    pairs = spark.createDataFrame(found, pairs.schema)
    return pairs, shapes(pairs, {s: n_classes if s == "class" else shape[1] for s in sides})
