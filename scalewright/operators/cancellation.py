"""Cancellation checks of a table of success counts (row, col, n_total, n_right), rows and columns in order.

Sub-matrices are numbered, and tasks find theirs by number, so none lists them all.  Each is sampled under the order that an additive structure demands, many
side by side in a task, and a cell counts as violated if its observed rate lies outside the sampled range.  What
the checks say about each cell is summed up by DataFrame aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fanout import kept

#: Sub-matrices that are sampled side by side; the group's number is part of the seed.
GROUP = 512
#: Sampling steps, those left out at the start, and every how many-th one is kept.
STEPS, BURN, EVERY = 3000, 1000, 4
#: Draws of a sub-matrix until one can be checked, and the most tasks that groups go to.
TRIES, MOST_TASKS = 1000, 4096

# The 14 coherent triple cancellation tests of a 4 x 4 table (Kyngdon and Richards 2006).  Each has three
# premises and a conclusion, given as pairs of columns; their rows are always 1 and 0, 2 and 1, 3 and 2, and 3 and 0.
TRIPLE = [
    [(0, 1), (1, 2), (2, 3), (0, 3)],
    [(0, 1), (1, 2), (1, 2), (0, 2)],
    [(0, 1), (0, 1), (2, 3), (0, 3)],
    [(0, 1), (0, 1), (1, 2), (0, 2)],
    [(0, 2), (2, 3), (1, 2), (0, 3)],
    [(0, 2), (2, 3), (0, 1), (1, 3)],
    [(0, 2), (1, 2), (2, 3), (0, 3)],
    [(0, 2), (1, 2), (0, 1), (1, 3)],
    [(0, 2), (0, 1), (2, 3), (0, 3)],
    [(1, 2), (2, 3), (0, 1), (0, 3)],
    [(1, 2), (0, 1), (2, 3), (0, 3)],
    [(1, 2), (0, 1), (1, 2), (0, 3)],
    [(0, 1), (2, 3), (1, 2), (0, 3)],
    [(0, 1), (1, 3), (2, 3), (0, 3)],
]

Cell = tuple[int, int]
#: Premises (smaller, larger) and the conclusion (smaller, larger).  If no premise holds, the conclusion is reversed.
Rule = tuple[list[tuple[Cell, Cell]], tuple[Cell, Cell]]


def double_rules(size: int) -> list[Rule]:
    """Double cancellation in every 3 x 3 table inside one of ``size``."""
    triples = list(combinations(range(size), 3))
    return [([((r[1], c[0]), (r[0], c[1])), ((r[2], c[1]), (r[1], c[2]))], ((r[2], c[0]), (r[0], c[2]))) for r in triples for c in triples]


def triple_rules() -> list[Rule]:
    out = []
    for *pairs, end in TRIPLE:
        premises = [((k + 1, x), (k, y)) for k, (x, y) in enumerate(pairs)]
        out.append((premises, ((3, end[0]), (0, end[1]))))
    return out


#: check: (size, orders of rows and columns that bind a cell, rules)
CHECKS = {
    "single": (3, "RC", []),
    "single_rows": (3, "R", []),
    "single_columns": (3, "C", []),
    "double": (3, "RC", double_rules(3)),
    "double_only": (3, "", double_rules(3)),
    "triple": (4, "RC", double_rules(4) + triple_rules()),
    "triple_only": (4, "", triple_rules()),
}


def first_values(rates: np.ndarray) -> np.ndarray:
    """The rates of each table, sorted and laid out along its anti-diagonals."""
    m, size, _ = rates.shape
    at = sorted(((i + j, j, i) for i in range(size) for j in range(size)))
    out = np.empty_like(rates)
    ordered = np.sort(rates.reshape(m, -1), axis=1)
    for k, (_, j, i) in enumerate(at):
        out[:, i, j] = ordered[:, k]
    return out


def sampled_ranges(total: np.ndarray, right: np.ndarray, check: str, rng: np.random.Generator, low: float = 0.025, high: float = 0.975, steps: int = STEPS, burn: int = BURN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, mean) of the draws for every cell; ``total`` and ``right`` are tables x size x size.

    A step proposes for one cell after the other a uniform value between its bounds, upper ones below the lower
    one giving way to 1, and takes it by the ratio of binomial likelihoods.  A value at 0 or 1 is always left.
    """
    size = CHECKS[check][0]
    m = len(right)
    flat = lambda tables: np.ascontiguousarray(tables.reshape(m, -1).T)
    old, hits = flat(first_values(right / total)), flat(right)
    misses = flat(total) - hits
    at_ends = bool(((old == 0) | (old == 1)).any())
    plan, zero, one, kept = _plan(check), np.zeros(m), np.ones(m), []
    with np.errstate(divide="ignore", invalid="ignore"):
        held = hits * np.log(old) + misses * np.log1p(-old)
        for step in range(2, steps + 1):
            random = rng.random((len(plan), 2, m))
            for c, (below, above, a, b, premises, smaller, runs, others) in enumerate(plan):
                lower = zero if not below else old[below[0]] if len(below) == 1 else np.maximum(old[below[0]], old[below[1]])
                upper = one if not above else old[above[0]] if len(above) == 1 else np.minimum(old[above[0]], old[above[1]])
                if len(others):
                    holds = (old.take(a, 0) < old.take(b, 0)).take(premises, 0)
                    every, none = holds.all(0), ~holds.any(0)
                    under, over = (np.array([(x if k < smaller else y)[k:end].any(0) for k, end in runs]) for x, y in ((every, none), (none, every)))
                    value = old[others]
                    cross = np.maximum(value, ~under).min(0)  # all lie between 0 and 1: what doesn't bind gives way to these
                    lower = np.maximum(lower, np.minimum(value, over).max(0))
                    upper = np.where(cross > lower, np.minimum(upper, cross), upper)
                if (turned := upper < lower).any():
                    upper = np.where(turned, 1.0, upper)
                draw = lower + (upper - lower) * random[c, 0]
                new = hits[c] * np.log(draw) + misses[c] * np.log1p(-draw)
                ratio = np.exp(np.minimum(new - held[c], 1.0))
                if at_ends:
                    ratio = np.where((old[c] == 0) | (old[c] == 1), 2.0, ratio)
                take = ratio > random[c, 1]
                np.copyto(old[c], draw, where=take)
                np.copyto(held[c], new, where=take)
            if step > burn and step % EVERY == 0:
                kept.append(old.copy())
    if not kept:
        raise ValueError("no draws are left after the first ones")
    tables = lambda v: np.array(v).T.reshape(m, size, size)
    lows, highs, means = [], [], []
    for c in range(size * size):  # the draws are held once, and sorted a cell at a time
        draws = np.array([k[c] for k in kept])
        for out, v in zip((lows, highs, means), (*np.quantile(draws, [low, high], axis=0), draws.mean(0))):
            out.append(v)
    return tables(lows), tables(highs), tables(means)


def _plan(check: str) -> list[tuple]:
    """Per cell, numbered row by row: cells that bound it from below and from above, pairs to compare, and its rules.

    Rules are given by the places of their premises among the pairs (a column per rule, the first one repeated where there are
    fewer), how many have the cell as the smaller one of the conclusion, which come first, and by the other cell of the
    conclusion: rules stand together by that, and each such run is given by its start and end, and by that cell.
    """
    size, orders, rules = CHECKS[check]
    number = lambda cell: cell[0] * size + cell[1]
    out = []
    for i in range(size):
        for j in range(size):
            below = [number((i, j - 1))] * ("R" in orders and j > 0) + [number((i - 1, j))] * ("C" in orders and i > 0)
            above = [number((i, j + 1))] * ("R" in orders and j < size - 1) + [number((i + 1, j))] * ("C" in orders and i < size - 1)
            other = lambda r: number(r[1][1] if r[1][0] == (i, j) else r[1][0])  # noqa: B023, E731
            mine = sorted((r for r in rules if (i, j) in r[1]), key=lambda r: (r[1][0] != (i, j), other(r)))
            pairs = sorted({(number(a), number(b)) for premises, _ in mine for a, b in premises})
            most = max((len(premises) for premises, _ in mine), default=0)
            places = [[pairs.index((number(a), number(b))) for a, b in [*premises, *premises[:1] * (most - len(premises))]] for premises, _ in mine]
            smaller = sum(end[0] == (i, j) for _, end in mine)
            kinds = [(k >= smaller, other(r)) for k, r in enumerate(mine)]
            starts = [k for k, kind in enumerate(kinds) if k == 0 or kind != kinds[k - 1]]
            out.append((below, above, [a for a, _ in pairs], [b for _, b in pairs], np.array(places, int).T, smaller, list(zip(starts, [*starts[1:], len(mine)])), [kinds[k][1] for k in starts]))
    return out


def combination(rank: int, n: int, size: int) -> list[int]:
    """The combination of ``size`` out of 0 to n - 1 with the given number, in lexicographic order."""
    out, at = [], 0
    for left in range(size, 0, -1):
        while (behind := comb(n - at - 1, left - 1)) <= rank:
            rank -= behind
            at += 1
        out.append(at)
        at += 1
    return out


def _places(number: int, shape: tuple[int, int], size: int, adjacent: bool) -> tuple[list[int], list[int]]:
    """Rows and columns of the sub-matrix with the given number."""
    if adjacent:
        i, j = divmod(number, shape[1] - size + 1)
        return list(range(i, i + size)), list(range(j, j + size))
    i, j = divmod(number, comb(shape[1], size))
    return combination(i, shape[0], size), combination(j, shape[1], size)


def _number_of(shape: tuple[int, int], size: int, adjacent: bool) -> int:
    return (shape[0] - size + 1) * (shape[1] - size + 1) if adjacent else comb(shape[0], size) * comb(shape[1], size)


def chosen_places(numbers: range, shape: tuple[int, int], size: int, which: str | int, sound: Callable[[list[int], list[int]], bool], seed: tuple[int, ...]) -> list[tuple[int, list[int], list[int]]]:
    """(number, rows, columns) of sub-matrices: those with these numbers, or as many drawn ones.

    A draw that can't be checked is repeated, up to TRIES times; then its last try stands.  As many draws as there are
    sub-matrices, or more, take each of them once.
    """
    total = _number_of(shape, size, which == "adjacent")
    if isinstance(which, str) or which >= total:
        return [(k, *_places(k, shape, size, which == "adjacent")) for k in numbers]
    out = []
    for k in numbers:
        rng = np.random.default_rng([*seed, k])
        for _ in range(TRIES):
            rows, cols = (sorted(rng.choice(n, size, replace=False).tolist()) for n in shape)
            if sound(rows, cols):
                break
        out.append((k, rows, cols))
    return out


@dataclass(frozen=True)
class Table:
    """A table of counts that every task gets: a row per score group, a column per item."""

    rows: list[int]
    cols: list[int]
    total: np.ndarray
    right: np.ndarray

    def sound(self, rows: list[int], cols: list[int]) -> bool:
        n, k = self.total[np.ix_(rows, cols)], self.right[np.ix_(rows, cols)]
        return bool(((k > 0) & (k < n)).all())


def table_of(cells: DataFrame, adjust_extremes: bool = False) -> Table:
    """The table as arrays; a cell that is absent has no answers.  It has a row per score group, so it is small."""
    found = cells.select("row", "col", "n_total", "n_right").collect()
    rows, cols = (sorted({r[k] for r in found}) for k in ("row", "col"))
    at_row, at_col = ({v: k for k, v in enumerate(side)} for side in (rows, cols))
    total, right = np.zeros((2, len(rows), len(cols)))
    for r in found:
        at = at_row[r["row"]], at_col[r["col"]]
        total[at], right[at] = float(r["n_total"]), float(r["n_right"])
    if adjust_extremes:
        right = np.where((right == 0) & (total > 0), 0.001 * total, np.where(right == total, 0.999 * total, right))
    return Table(rows, cols, total, right)


def _over_groups(spark: SparkSession, table: Table, size: int, which: str | int, seed: int, then: Callable[[int, list[tuple[int, list[int], list[int]]]], pd.DataFrame], schema: str) -> DataFrame:
    """``then(group, sub-matrices)`` of groups of GROUP sub-matrices, which tasks number and draw by themselves."""
    shape = table.total.shape
    if min(shape) < size:
        raise ValueError(f"the table must have {size} rows and columns at least")
    total = _number_of(shape, size, which == "adjacent")
    wanted = min(which, total) if isinstance(which, int) else total
    groups = -(-wanted // GROUP)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g in b["id"].tolist():
                yield then(g, chosen_places(range(g * GROUP, min(wanted, (g + 1) * GROUP)), shape, size, which, table.sound, (seed,)))

    return spark.range(0, groups, 1, min(groups, MOST_TASKS)).mapInPandas(run, schema)


def sub_matrices(cells: DataFrame, size: int, which: str | int = "adjacent", seed: int = 1) -> DataFrame:
    """(sub_id, rows, cols): adjacent ones, "all", or a number of them that are drawn, each drawn again while it can't be checked."""
    table = table_of(cells)

    def listed(_: int, found: list[tuple[int, list[int], list[int]]]) -> pd.DataFrame:
        return pd.DataFrame([(k, [table.rows[i] for i in rows], [table.cols[j] for j in cols]) for k, rows, cols in found], columns=["sub_id", "rows", "cols"])

    return _over_groups(cells.sparkSession, table, size, which, seed, listed, "sub_id long, rows array<int>, cols array<int>")


def conjoint_checks(cells: DataFrame, check: str = "double", which: str | int = "adjacent", adjust_extremes: bool = False, seed: int = 1, low: float = 0.025, high: float = 0.975, steps: int = STEPS, burn: int = BURN) -> DataFrame:
    """(sub_id, row, col, n_total, rate, low, high, mean, violated) of every cell of every sub-matrix that is checked.

    A sub-matrix with a rate of 0 or 1 isn't checked, unless those are moved to 0.001 and 0.999.  A rate on the
    border of its range is a violation.  GROUP sub-matrices are sampled side by side, groups go to tasks of their own.
    """
    size = CHECKS[check][0]
    table = table_of(cells, adjust_extremes)
    names = ["sub_id", "row", "col", "n_total", "n_right", "low", "high", "mean"]

    def sampled(group: int, found: list[tuple[int, list[int], list[int]]]) -> pd.DataFrame:
        found = [f for f in found if table.sound(*f[1:])]
        if not found:
            return pd.DataFrame([], columns=names)
        total, right = (np.array([m[np.ix_(rows, cols)] for _, rows, cols in found]) for m in (table.total, table.right))
        lo, hi, mean = sampled_ranges(total, right, check, np.random.default_rng([seed, group]), low, high, steps, burn)
        sides = [(k, table.rows[i], table.cols[j]) for k, rows, cols in found for i in rows for j in cols]
        return pd.DataFrame(sides, columns=names[:3]).assign(n_total=total.ravel(), n_right=right.ravel(), low=lo.ravel(), high=hi.ravel(), mean=mean.ravel())

    checked = _over_groups(cells.sparkSession, table, size, which, seed, sampled, "sub_id long, row int, col int, n_total double, n_right double, low double, high double, mean double")
    rate = F.col("n_right") / F.col("n_total")
    return checked.select("sub_id", "row", "col", "n_total", rate.alias("rate"), "low", "high", "mean", (~((rate > F.col("low")) & (rate < F.col("high")))).alias("violated"))


def checked_cells(checks: DataFrame) -> DataFrame:
    """(row, col, n_total, n_checks, n_violated, rate) of the cells that were checked."""
    per = checks.groupBy("row", "col").agg(F.first("n_total").alias("n_total"), F.count(F.lit(1)).alias("n_checks"), F.sum(F.col("violated").cast("long")).alias("n_violated"))
    return per.withColumn("rate", F.col("n_violated") / F.col("n_checks"))


def violation_means(table: DataFrame) -> DataFrame:
    """(unweighted, weighted, n_cells): mean violation rate of the checked cells, and weighted by their answers."""
    return table.agg(F.avg("rate").alias("unweighted"), (F.sum(F.col("rate") * F.col("n_total")) / F.sum("n_total")).alias("weighted"), F.count(F.lit(1)).alias("n_cells"))


def column_means(table: DataFrame) -> DataFrame:
    return table.groupBy("col").agg(F.avg("rate").alias("rate"))


def hierarchy(cells: DataFrame, which: str | int = "adjacent", seed: int = 1, **options) -> DataFrame:
    """(sub_id, status) of 4 x 4 sub-matrices: the first of single, double and triple cancellation that fails.

    A cell passes on the border of its range here.  A sub-matrix with a rate of 0 or 1 is SKIPPED.
    """
    levels = []
    with kept(cells.select("row", "col", "n_total", "n_right")) as cells:  # a row per score group and item, read by every level
        everyone = sub_matrices(cells, 4, which, seed).select("sub_id")
        for level, check in (("SINGLE", "single4"), ("DOUBLE", "double4"), ("TRIPLE", "triple")):
            bad = ((F.col("rate") < F.col("low")) | (F.col("rate") > F.col("high"))).cast("int")
            found = conjoint_checks(cells, check, which, seed=seed, **options)
            levels.append((level, found.groupBy("sub_id").agg(F.max(bad).alias(level))))
    for _, found in levels:
        everyone = everyone.join(found, "sub_id", "left")
    status = F.when(F.col("SINGLE").isNull(), "SKIPPED")
    for level, _ in levels:
        status = status.when(F.col(level) == 1, f"FAILED_{level}")
    return everyone.select("sub_id", status.otherwise("PASSED_ALL").alias("status"))


CHECKS |= {"single4": (4, "RC", []), "double4": (4, "RC", double_rules(4))}


def dense_core(cells: DataFrame, least: int = 5) -> DataFrame:
    """``cells`` without the rows and columns that keep it from having ``least`` answers everywhere.

    While a cell is thin, the row with the most thin cells goes if it has as many as the worst column, else that
    column; the first of equal ones goes.  Fewer than three of either is an error.  The table has a row per
    score group and step, so its counts are weighed on the driver.
    """
    found = cells.collect()  # counted once: what stays is cut from the same rows
    n = {(r["row"], r["col"]): r["n_total"] for r in found}
    rows, cols = (sorted({k[i] for k in n}) for i in (0, 1))
    table = np.array([[n.get((r, c), 0) for c in cols] for r in rows]).reshape(len(rows), len(cols))
    stay = dense_sides(table, least)
    rows, cols = {rows[i] for i in stay[0]}, {cols[j] for j in stay[1]}
    return cells.sparkSession.createDataFrame([r for r in found if r["row"] in rows and r["col"] in cols], cells.schema)


def dense_sides(total: np.ndarray, least: int = 5) -> tuple[list[int], list[int]]:
    """Rows and columns that ``dense_core`` keeps of a table of counts."""
    rows, cols = (list(range(n)) for n in total.shape)
    while (thin := total[np.ix_(rows, cols)] < least).any():
        by_row, by_col = thin.sum(1), thin.sum(0)
        if by_row.max() >= by_col.max():
            del rows[int(by_row.argmax())]
        else:
            del cols[int(by_col.argmax())]
        if min(len(rows), len(cols)) < 3:
            raise ValueError("fewer than three rows or columns are left")
    return rows, cols
