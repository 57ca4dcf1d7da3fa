"""Null distributions: data drawn under a model, refitted or counted again.

Replicates are drawn person by person with numbers that depend on the person, the replicate and the item alone, so a task
that runs again draws the same.  Batches fold their draws into patterns before the shuffle, and what follows works
on a pattern table per replicate: (rep, x, freq).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cancellation as K
from . import mixtures as M
from .fanout import MOST_TASKS, kept, per_key
from .mixtures import PATTERNS_PER_TASK, Fit, fit, fit_here

#: Replicates of a test, and distinct (answered items, total) rows that the driver weighs itself; tasks weigh more of them.
REPLICATES, GROUPS_ON_DRIVER = 99, 2_000
#: Most coefficients of generating functions that are held side by side.
CELLS_AT_ONCE = 1 << 20
#: Persons whose replicates a task draws at once, and the most counts of patterns that it holds.
PERSONS_HELD, COUNTS_HELD = 1 << 15, 1 << 23
#: Numbers of sub-matrices in a part of a replicate, and the most sub-matrices that are sampled side by side.
NUMBERS_A_PART, SIDE_BY_SIDE = 1 << 13, 1 << 11
REPLICATE_ROWS = "rep int, x array<int>, freq long"


def _mixed(z: np.ndarray, part: int) -> np.ndarray:
    z = z + np.uint64(int(part) * 0xD1B54A32D192ED03 % 2**64)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _numbers(persons: np.ndarray, rep: int, seed: int) -> Callable[[int], np.ndarray]:
    """``_uniform`` of persons in a replicate, by what it is for; the bits that all of them share are mixed once."""
    z = _mixed(persons.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), rep + 1)
    return lambda what: (_mixed(_mixed(z, what + 1), seed + 1) >> np.uint64(11)).astype(float) * 2.0**-53


def _uniform(persons: np.ndarray, rep: int, what: int, seed: int) -> np.ndarray:
    """One number in [0, 1) per person, by mixing the bits of all four arguments."""
    return _numbers(persons, rep, seed)(what)


def _answers(x: pd.Series) -> np.ndarray:
    """Patterns x items, -1 where an answer is missing."""
    return np.nan_to_num(np.array([np.asarray(v, float) for v in x]), nan=-1).astype(int)


def _matrix(x: pa.Array) -> np.ndarray:
    """The same of an Arrow column of lists of one length."""
    return x.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(int).reshape(len(x), -1)


def _lists(answers: np.ndarray) -> pa.Array:
    """Patterns as an Arrow column, null where an answer is missing."""
    flat = answers.astype(np.int32).ravel()
    offsets = np.arange(len(answers) + 1, dtype=np.int32) * answers.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=flat < 0))


def _codes(answers: np.ndarray, base: int) -> np.ndarray:
    """Rows as numbers, in the order of the rows."""
    code = np.zeros(len(answers), np.int64)
    for column in answers.T:
        code *= base
        code += column
        code += 1
    return code


def _decoded(codes: np.ndarray, base: int, n_items: int) -> np.ndarray:
    return codes[:, None] // base ** np.arange(n_items, dtype=np.int64)[::-1] % base - 1


def _counted(answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and how often each occurs; rows that fit into one number are compared as such."""
    base = int(answers.max(initial=0)) + 2
    if base ** answers.shape[1] >= 2**62:
        return np.unique(answers, axis=0, return_counts=True)
    codes, freq = np.unique(_codes(answers, base), return_counts=True)
    return _decoded(codes, base, answers.shape[1]), freq


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to PERSONS_HELD rows or some more."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        waiting.append(b)
        if sum(w.num_rows for w in waiting) >= PERSONS_HELD:
            yield pa.concat_batches(waiting)
            waiting = []
    if sum(w.num_rows for w in waiting):
        yield pa.concat_batches(waiting)


#: What draws a replicate of some persons: a row of answers for each of them.
Draw = Callable[[int], np.ndarray]


def _replicated(people: DataFrame, replicates: range, prepare: Callable[..., Draw], *more: str) -> DataFrame:
    """(rep, x, freq) of ``prepare(person_ids, answers, columns named in more)(rep)`` for every replicate.

    Patterns of which there can be only few are counted over the whole task, others over the persons that are held together.
    """

    def rows(rep: int, patterns: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(patterns), rep, np.int32)), _lists(patterns), pa.array(freq.astype(np.int64))], ["rep", "x", "freq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in _held(batches):
            ids, answers = b.column(0).to_numpy(), _matrix(b.column(1))
            draw = prepare(ids, answers, *[b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(more))])
            for place, rep in enumerate(replicates):
                drawn = draw(rep)
                base, n_items = int(drawn.max(initial=0)) + 2, drawn.shape[1]
                if base**n_items * len(replicates) > COUNTS_HELD:
                    yield rows(rep, *_counted(drawn))
                    continue
                if (base, n_items) not in sums:
                    sums[base, n_items] = np.zeros((len(replicates), base**n_items), np.int32)
                sums[base, n_items][place] += np.bincount(_codes(drawn, base), minlength=base**n_items).astype(np.int32)
        for (base, n_items), counts in sums.items():
            for rep, one in zip(replicates, counts):
                codes = np.flatnonzero(one)
                yield rows(rep, _decoded(codes, base, n_items), one[codes])

    drawn = people.where("person_id is not null").select("person_id", "x", *more).mapInArrow(run, REPLICATE_ROWS)
    return drawn.groupBy("rep", "x").agg(F.sum("freq").alias("freq"))


def model_replicates(packed: DataFrame, f: Fit, replicates: int = REPLICATES, seed: int = 1, first: int = 0) -> DataFrame:
    """(rep, x, freq): everyone draws a class and answers under ``f``; what somebody left out stays out.

    Replicates are numbered from ``first`` on; each is the same whichever others are drawn.
    """
    weights, tables = np.cumsum(f.weights), np.ascontiguousarray(np.cumsum(f.probs, axis=2).transpose(1, 2, 0))

    def prepare(ids: np.ndarray, answers: np.ndarray) -> Draw:
        left_out = answers < 0

        def draw(rep: int) -> np.ndarray:
            number = _numbers(ids, rep, seed)
            k = np.minimum(np.searchsorted(weights, number(0), "right"), len(weights) - 1)
            new = np.zeros(answers.shape[::-1], np.int64).T
            for j, table in enumerate(tables):
                u = number(j + 1)
                for upto in table[:-1]:
                    new[:, j] += u >= upto[k]
            new[left_out] = -1
            return new

        return draw

    return _replicated(packed, range(first, first + replicates), prepare)


def _products(weights: list[np.ndarray]) -> list[np.ndarray]:
    """For every place the product of the polynomials from there on, each scaled to a largest coefficient of 1."""
    out = [np.ones(1)]
    for w in reversed(weights):
        p = np.convolve(out[-1], w)
        out.append(p / p.max())
    return out[::-1]


def _step_weights(steps: list[np.ndarray]) -> list[np.ndarray]:
    return [np.exp(-np.concatenate([[0.0], np.cumsum(d)])) for d in steps]


def mask_totals(patterns: DataFrame) -> DataFrame:
    """(mask, total, n): persons by the items that they answered, a string of 0 and 1, and their total."""
    mask = F.array_join(F.transform("x", lambda v: F.when(v.isNull(), "0").otherwise("1")), "")
    total = F.aggregate("x", F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return patterns.groupBy(mask.alias("mask"), total.alias("total")).agg(F.sum("freq").alias("n"))


def _times(left: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Products of the polynomials in the rows of ``left`` and of ``weights``, cut to the length of ``left``."""
    out = left * weights[:, :1]
    for k in range(1, weights.shape[1]):
        out[:, k:] += left[:, :-k] * weights[:, k : k + 1]
    return out


def _conditional_loss(groups: list[tuple[str, int, int]], steps: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Sum of n log gamma over the groups, and minus its slope by the steps: the expected numbers that reach each.

    An item's rest is the product of those before and behind it.  All sets of answered items go side by side, as many as CELLS_AT_ONCE allows.
    """
    value, reached = 0.0, np.zeros(sum(map(len, steps)))
    masks = sorted({mask for mask, _, _ in groups})
    at_once = max(1, CELLS_AT_ONCE // ((len(steps) + 1) * (len(reached) + 1)))
    place = {mask: k for k, mask in enumerate(masks)}
    of, total, n = (np.array(v) for v in zip(*[(place[mask], total, n) for mask, total, n in groups])) if groups else np.zeros((3, 0), int)
    for start in range(0, len(masks), at_once):
        here = (of >= start) & (of < start + at_once)
        more = _loss_of_masks(masks[start : start + at_once], of[here] - start, total[here], n[here], steps)
        value, reached = value + more[0], reached + more[1]
    return value, reached


def _loss_of_masks(masks: list[str], of: np.ndarray, total: np.ndarray, n: np.ndarray, steps: list[np.ndarray]) -> tuple[float, np.ndarray]:
    seen = np.array([[m == "1" for m in mask] for mask in masks])
    # An item that wasn't answered is the polynomial 1.
    weights = [np.where(seen[:, j, None], w, np.arange(len(w)) == 0) for j, w in enumerate(_step_weights(steps))]
    ends, scale = [], np.zeros(len(masks))
    for side in (weights, weights[::-1]):
        products = [np.zeros((len(masks), 1 + sum(map(len, steps))))]
        products[0][:, 0] = 1
        for w in side:
            p = _times(products[-1], w)
            largest = p.max(1, keepdims=True)
            products.append(p / largest)
            scale += np.log(largest[:, 0]) * (side is weights)
        ends.append(products)
    before, behind = ends[0], ends[1][::-1]
    value = float(n @ (np.log(before[-1][of, total]) + scale[of]))
    reached = []
    for j, w in enumerate(weights):
        # The rest is wanted at the groups' totals alone, less each answer to the item.
        left, right = before[j][of], behind[j + 1][of]
        p = np.zeros((len(of), w.shape[1]))
        for k in range(w.shape[1]):
            upto = total - k
            for s in range(int(upto.max(initial=-1)) + 1):
                p[:, k] += np.where(upto >= s, left[:, s] * right[np.arange(len(of)), np.maximum(upto - s, 0)], 0)
        p *= w[of]
        p /= p.sum(1, keepdims=True)
        reached.append((n * seen[of, j]) @ np.cumsum(p[:, ::-1], axis=1)[:, ::-1][:, 1:])
    return value, np.concatenate(reached)


def _loss_in_tasks(groups: DataFrame, steps: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """``_conditional_loss`` of a table (mask, total, n): a task per part of it, one vector of sums from each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(1 + sum(map(len, steps)))
        for b in batches:
            value, reached = _conditional_loss(list(zip(b["mask"], b["total"].tolist(), b["n"].tolist())), steps)
            sums += np.concatenate([[value], reached])
        yield pd.DataFrame({"sums": [sums.tobytes()]})

    sums = sum((np.frombuffer(r["sums"]) for r in groups.mapInPandas(run, "sums binary").collect()), np.zeros(1 + sum(map(len, steps))))
    return float(sums[0]), sums[1:]


def fit_conditional(patterns: DataFrame, rounds: int = 500, tol: float = 1e-10) -> list[np.ndarray]:
    """Steps of every item, summing to zero, by conditional maximum likelihood given who answered what and their totals.

    Persons with none or all of their steps say nothing, nor do those with one answer.  An iteration costs as much as there
    are sets of answered items and totals; more than GROUPS_ON_DRIVER of them are weighed by tasks.  A step beyond 25 and
    a search that doesn't end are errors.
    """
    with kept(patterns) as patterns:
        return _fit_conditional(patterns, rounds, tol)


def _fit_conditional(patterns: DataFrame, rounds: int, tol: float) -> list[np.ndarray]:
    tops = [max(1, r["top"] or 1) for r in patterns.select(F.posexplode("x").alias("item", "v")).groupBy("item").agg(F.max("v").alias("top")).orderBy("item").collect()]
    first = np.concatenate([[0], np.cumsum(tops)]).astype(int)
    most = F.aggregate(F.zip_with("x", F.array(*map(F.lit, tops)), lambda v, m: F.when(v.isNotNull(), m).otherwise(0)), F.lit(0), lambda s, v: s + v)
    total = F.aggregate("x", F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    telling = patterns.where((total > 0) & (total < most) & (F.aggregate("x", F.lit(0), lambda s, v: s + v.isNotNull().cast("int")) > 1))
    masks = mask_totals(telling)
    few = masks.limit(GROUPS_ON_DRIVER + 1).collect()
    if not few:
        raise ValueError("nobody has some but not all of the steps")
    if len(few) > GROUPS_ON_DRIVER:
        # Groups of one set of items share its generating function, so they stay together.
        n_groups, persons = masks.agg(F.count(F.lit(1)), F.sum("n")).first()
        masks = masks.repartition(min(MOST_TASKS, 1 + n_groups // GROUPS_ON_DRIVER), "mask").persist()
        loss_of = lambda d: _loss_in_tasks(masks, d)
    else:
        groups = [(r["mask"], r["total"], r["n"]) for r in few]
        persons = sum(n for _, _, n in groups)
        loss_of = lambda d: _conditional_loss(groups, d)
    margin = np.zeros(first[-1])
    counts = telling.select("freq", F.posexplode("x").alias("item", "v")).where("v > 0").groupBy("item", "v").agg(F.sum("freq").alias("n")).collect()
    for r in counts:
        margin[first[r["item"]] : first[r["item"]] + r["v"]] += r["n"]

    def loss(d: np.ndarray) -> tuple[float, np.ndarray]:
        value, reached = loss_of(np.split(d, first[1:-1]))
        return (value + margin @ d) / persons, (margin - reached) / persons

    # The search starts where each item by itself lies, with the curvature that it has by itself.
    spread = np.zeros((first[-1], first[-1]))
    at = np.zeros(first[-1])
    for low, high in zip(first[:-1], first[1:]):
        share = (margin[low:high] + 0.5) / (persons + 1)
        spread[low:high, low:high] = np.minimum.outer(share, share) - np.outer(share, share)
        given = np.maximum(np.concatenate([[persons], margin[low:high]]) - np.append(margin[low:high], 0), 0) + 0.5
        at[low:high] = np.log(given[:-1] / given[1:])
    begin = np.linalg.inv(spread + 1e-9 * np.eye(len(at)))
    at -= at.mean()
    value, slope = loss(at)
    inverse = begin
    for _ in range(rounds):
        if np.abs(slope).max() < tol:
            break
        move, scale = -inverse @ slope, 1.0
        move -= move.mean()
        if move @ slope >= 0:
            inverse = begin
            move = -inverse @ (slope - slope.mean())
            move -= move.mean()
        while True:  # halve until the loss falls enough
            new = at + scale * move
            new_value, new_slope = loss(new)
            # Within rounding of the loss the slope decides, so a search at the end of the digits doesn't go on.
            near = abs(new_value - value) <= 1e-12 * (1 + abs(value))
            if (np.abs(new_slope).max() <= 0.9 * np.abs(slope).max()) if near else new_value <= value + 1e-4 * scale * (move @ slope):
                break
            scale = scale / 2 if not near else 0.0
            if scale < 1e-10:
                break
        if scale < 1e-10:
            break
        s, y = new - at, new_slope - slope
        at, value, slope = new, new_value, new_slope
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            rho = 1 / (s @ y)
            left = np.eye(len(at)) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        if np.abs(at).max() > 25:
            raise ValueError("a step has no finite estimate")
    if np.abs(slope).max() > 1e-5:
        raise ValueError("the conditional likelihood didn't converge")
    return np.split(at - at.mean(), first[1:-1])


def given_totals(totals: np.ndarray, weights: list[np.ndarray], uniform: Callable[[int], np.ndarray]) -> np.ndarray:
    """Answers to all of the items with these step weights, one row per total; ``uniform(place)`` gives an item's random numbers."""
    out, left = np.empty((len(totals), len(weights)), int), totals
    rests = _products(weights)
    for place, weight in enumerate(weights):
        rest, k = rests[place + 1], np.arange(len(weight))
        after = left[:, None] - k
        p = np.where((after >= 0) & (after < len(rest)), weight * rest[np.clip(after, 0, len(rest) - 1)], 0)
        upto = np.cumsum(p, axis=1)
        x = (uniform(place)[:, None] * upto[:, -1:] >= upto).sum(1)
        out[:, place] = np.minimum(x, (p > 0) @ np.ones(len(k), int) - 1 + (p > 0).argmax(1))
        left = left - out[:, place]
    return out


class _GivenTotals:
    """``given_totals`` of persons with different items, all at once: what an item's answer depends on is laid out by set of items and rest of the total."""

    def __init__(self, masks: np.ndarray, weights: list[np.ndarray]):
        self.width = 1 + sum(len(w) - 1 for w in weights)
        rests = np.zeros((len(weights), len(masks), self.width + 1))  # the last place is for rests that can't be
        for m, mask in enumerate(masks):
            items = np.flatnonzero(mask)
            for j, rest in zip(items, _products([weights[j] for j in items])[1:]):
                rests[j, m, : len(rest)] = rest
        self.bounds, self.scale, self.most = [], [], []
        for j, w in enumerate(weights):
            after = np.arange(self.width)[:, None] - np.arange(len(w))
            p = w * rests[j][:, np.where(after >= 0, after, self.width)]
            upto, able = np.cumsum(p, axis=2), p > 0
            # Who didn't answer takes nothing from the total.
            upto[~masks[:, j], :, :-1] = np.inf
            self.bounds.append([np.ascontiguousarray(upto[..., k]).ravel() for k in range(len(w) - 1)])
            self.scale.append(np.ascontiguousarray(upto[..., -1]).ravel())
            self.most.append(np.where(masks[:, j, None], able.sum(2) - 1 + able.argmax(2), 0).ravel())

    def __call__(self, kind: np.ndarray, totals: np.ndarray, number: Callable[[int], np.ndarray]) -> np.ndarray:
        at = kind * self.width + totals
        out = np.zeros((len(self.scale), len(at)), np.int64).T
        for j, bounds in enumerate(self.bounds):
            u, x = number(j) * self.scale[j][at], out[:, j]
            for upto in bounds:
                x += u >= upto[at]
            np.minimum(x, self.most[j][at], out=x)
            at = at - x
        return out


def conditional_replicates(packed: DataFrame, steps: list[np.ndarray], replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(rep, x, freq) drawn given everyone's answered items and total, both of which stay exactly as they are."""
    weights = _step_weights(steps)
    cells = len(weights) * (1 + sum(map(len, steps))) * max(map(len, weights))

    def prepare(ids: np.ndarray, answers: np.ndarray) -> Draw:
        left_out, totals = answers < 0, np.maximum(answers, 0).sum(1)
        masks, kind = np.unique(~left_out, axis=0, return_inverse=True)
        kind, at_once = kind.ravel(), max(1, CELLS_AT_ONCE // cells)
        parts = [(start, np.flatnonzero((kind >= start) & (kind < start + at_once))) for start in range(0, len(masks), at_once)]
        ready = _GivenTotals(masks, weights) if len(parts) == 1 else None

        def draw(rep: int) -> np.ndarray:
            out = np.empty(answers.shape[::-1], np.int64).T
            for start, rows in parts:
                # Tables of more sets of items than are held at once are made again.
                given = ready or _GivenTotals(masks[start : start + at_once], weights)
                out[rows] = given(kind[rows] - start, totals[rows], _numbers(ids[rows], rep, seed))
            out[left_out] = -1
            return out

        return draw

    return _replicated(packed, range(replicates), prepare)


def resampled(packed: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """(rep, x, freq) of persons drawn with replacement: everyone counts Poisson(1) times, by their own numbers."""

    table = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def prepare(ids: np.ndarray, answers: np.ndarray) -> Draw:
        return lambda rep: np.repeat(answers, np.searchsorted(table, _uniform(ids, rep, 0, seed), "right"), axis=0)

    return _replicated(packed, range(replicates), prepare)


def per_replicate(replicates: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], float], n: int = REPLICATES) -> DataFrame:
    """(rep, statistic, failed): ``statistic(patterns, freq)`` of each of ``n`` replicates, a task each, which holds its pattern table.

    A replicate that raises ValueError has no statistic, and is marked.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, freq = _sorted_patterns(group)
        try:
            value: float | None = float(statistic(x, freq))
        except (ValueError, np.linalg.LinAlgError):
            value = None
        return pd.DataFrame({"rep": [int(group["rep"].iloc[0])], "statistic": [value], "failed": [value is None]}).astype({"statistic": "float64"})

    out = per_key(replicates, "rep", n, run, "rep int, statistic double, failed boolean")
    return out.withColumn("statistic", F.when(~F.col("failed"), F.col("statistic")))


def _sorted_patterns(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, freq) in an order that doesn't depend on how rows came in."""
    x, freq = _answers(group["x"]), group["freq"].to_numpy(float)
    order = np.lexsort(x.T[::-1])
    return x[order], freq[order]


def _categories(fits: list[Fit]) -> int:
    return max(f.probs.shape[2] for f in fits)


def is_large(patterns: DataFrame) -> bool:
    """Whether a pattern table, and so its replicates, is more than a task should hold."""
    return patterns.limit(PATTERNS_PER_TASK + 1).count() > PATTERNS_PER_TASK


@dataclass(frozen=True)
class Refit:
    """A fit to be made of every replicate; ``also`` names others that it starts from too."""

    model: str
    n_classes: int = 2
    also: tuple[str, ...] = ()


def _expected_each(replicates: DataFrame, asked: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> dict[tuple[int, int], tuple]:
    """Expected counts of every run, a (replicate, start), at its parameters; a row per replicate and task reaches the driver."""
    of: dict[int, list[int]] = {}
    for rep, s in asked:
        of.setdefault(rep, []).append(s)
    shape = next(iter(asked.values()))[1].shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for rep, group in b.groupby("rep"):
                if rep in of:
                    sums[rep] = sums.get(rep, 0) + M._sums(M._one_hot(group["x"], shape[1], shape[2]), group["freq"].to_numpy(float), [asked[rep, s] for s in of[rep]])
        yield pd.DataFrame({"rep": list(sums), "sums": [v.tobytes() for v in sums.values()]})

    total: dict[int, np.ndarray] = {}
    for r in replicates.mapInPandas(run, "rep int, sums binary").collect():
        total[r["rep"]] = total.get(r["rep"], 0) + np.frombuffer(r["sums"]).reshape(len(of[r["rep"]]), -1)
    return {(rep, s): one for rep, starts in of.items() if rep in total for s, one in zip(starts, M._parted(total[rep], shape))}


@contextmanager
def _spread(replicates: DataFrame, n: int) -> Iterator[DataFrame]:
    """Replicates held in tasks of about PATTERNS_PER_TASK patterns, each of one replicate or a few."""
    with kept(replicates) as replicates:
        parts = 1 + replicates.count() // (PATTERNS_PER_TASK * max(n, 1))
        with kept(replicates.repartition(min(n * parts, MOST_TASKS), "rep", F.pmod(F.xxhash64("x"), F.lit(parts)))) as spread:
            yield spread


def fit_each(replicates: DataFrame, n_cat: int, model: str, n_classes: int, n_starts: int, seed: int, also: dict[int, list[Fit]] | None = None) -> dict[int, Fit]:
    """The fit of every replicate of a table that no task holds whole; one pass serves a step of all runs.

    A replicate that can't be fitted is absent.
    """
    found = replicates.select("rep", "freq", F.posexplode("x").alias("item", "v")).where("v is not null").groupBy("rep", "item", "v").agg(F.sum("freq").alias("n")).collect()
    persons = {r["rep"]: r["n"] for r in replicates.groupBy("rep").agg(F.sum("freq").alias("n")).collect()}
    n_items = 1 + max((r["item"] for r in found), default=0)
    counts = {rep: np.zeros((n_items, n_cat)) for rep in persons}
    for r in found:
        counts[r["rep"]][r["item"], r["v"]] += r["n"]
    problems = {rep: M._problem(c, model, n_classes, n_starts, 1e-6, seed, None, (also or {}).get(rep)) for rep, c in counts.items() if c.any()}
    runs = {(rep, s): climb(s) for rep, (_, starts, climb, _) in problems.items() for s in range(len(starts))}
    asked, ended = {k: next(run) for k, (run, _) in runs.items()}, {}
    while asked:
        for k, one in _expected_each(replicates, asked).items():
            try:
                asked[k] = runs[k][0].send(one)
            except StopIteration as end:
                ended[k] = (*end.value, runs[k][1]())
                del asked[k]
    return {rep: finish([ended[rep, s] for s in range(len(starts))], int(persons[rep])) for rep, (_, starts, _, finish) in problems.items()}


def refitted(replicates: DataFrame, n: int, n_cat: int, recipe: dict[str, Refit], statistic: Callable[[Callable[[str], Fit]], float], large: bool = False, n_starts: int = 3, seed: int = 1) -> DataFrame:
    """(rep, statistic, failed): ``statistic(get)`` of every replicate, where ``get`` gives its fits by name.

    Small tables are a task each, which makes the fits that are asked for.  Of large ones all fits are made, a replicate's
    patterns being spread over tasks.
    """
    if not large:

        def here(x: np.ndarray, freq: np.ndarray) -> float:
            done: dict[str, Fit] = {}

            def get(name: str) -> Fit:
                if name not in done:
                    r = recipe[name]
                    done[name] = fit_here(x, freq, n_cat, r.model, n_classes=r.n_classes, n_starts=n_starts, seed=seed, also=[get(a) for a in r.also])
                return done[name]

            return statistic(get)

        return per_replicate(replicates, here, n)
    with _spread(replicates, n) as spread:
        fits: dict[str, dict[int, Fit]] = {}
        for name, r in recipe.items():  # in order, so that what a fit starts from is there
            also = {rep: [fits[a][rep] for a in r.also] for rep in (fits[r.also[0]] if r.also else {})}
            fits[name] = fit_each(spread, n_cat, r.model, r.n_classes, n_starts, seed, also)
    rows = []
    for rep in sorted(set().union(*fits.values())):
        try:
            rows.append((rep, float(statistic(lambda name: fits[name][rep])), False))  # noqa: B023
        except (KeyError, ValueError):
            rows.append((rep, None, True))
    return replicates.sparkSession.createDataFrame(rows, "rep int, statistic double, failed boolean")


FITS = "rep int, weights array<double>, probs array<double>, theta array<double>, steps array<double>, sigma double"


def refit_table(replicates: DataFrame, n: int, n_cat: int, refit: Refit, large: bool = False, n_starts: int = 3, seed: int = 1, then: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str = FITS) -> DataFrame:
    """``FITS``: the parameters of one fit of every replicate; those that can't be fitted are absent.

    ``then`` makes rows of ``schema`` of them in the task of the fit, so that no second Python process waits beside it.
    """

    def row(rep: int, f: Fit) -> tuple:
        flat = [float(d) for item in f.steps for d in item]
        return rep, f.weights.tolist(), f.probs.ravel().tolist(), None if f.theta is None else f.theta.tolist(), flat, f.sigma

    if large:
        with _spread(replicates, n) as spread:
            fits = fit_each(spread, n_cat, refit.model, refit.n_classes, n_starts, seed)
        table = replicates.sparkSession.createDataFrame([row(rep, f) for rep, f in fits.items()], FITS)
        return table if then is None else table.mapInPandas(lambda batches: map(then, batches), schema)
    names = [c.split()[0] for c in FITS.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            f = fit_here(*_sorted_patterns(group), n_cat, refit.model, n_classes=refit.n_classes, n_starts=n_starts, seed=seed)
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])
        found = pd.DataFrame([row(int(group["rep"].iloc[0]), f)], columns=names)
        return found if then is None else then(found)

    return per_key(replicates, "rep", n, run, schema)


def _ratio(low: Fit, high: Fit) -> float:
    return max(0.0, 2 * (high.loglik - low.loglik))


def _ratio_recipe(restricted: str, general: str, n_classes: int, reselect: tuple[int, ...], selection: str) -> tuple[dict[str, Refit], Callable[[Callable[[str], Fit]], float]]:
    """Refits and the likelihood ratio of a replicate.

    With ``reselect`` every replicate first takes the number of classes, two at least, at which the model ``selection`` has the
    least BIC, as was done with the data.
    """
    sizes = tuple(sorted(set(reselect))) if len(set(reselect)) > 1 else (n_classes,)
    recipe: dict[str, Refit] = {}
    for c in sizes:
        recipe |= {f"selection {c}": Refit(selection, c), f"low {c}": Refit(restricted, c), f"high {c}": Refit(general, c, (f"low {c}",))}
    if len(sizes) == 1:
        del recipe[f"selection {n_classes}"]

    def statistic(get: Callable[[str], Fit]) -> float:
        c = n_classes
        if len(sizes) > 1:
            bic = {k: _bic(get(f"selection {k}")) for k in sizes if k >= 2}
            c = min(bic, key=lambda k: (bic[k], k)) if bic else n_classes
        return _ratio(get(f"low {c}"), get(f"high {c}"))

    return recipe, statistic


def likelihood_ratio_test(packed: DataFrame, patterns: DataFrame, restricted: Fit, general: Fit, replicates: int = REPLICATES, n_starts: int = 3, seed: int = 1, reselect: tuple[int, ...] = (), selection: str | None = None) -> tuple[float, DataFrame]:
    """The likelihood ratio of two nested latent class fits, and (rep, statistic, failed) under the restricted one.

    The general model also starts from the restricted solution, so the ratio doesn't fall below zero by a bad optimum.
    ``reselect`` repeats the choice of the number of classes among those sizes in every replicate, by the BIC of ``selection``
    (the general model's by default).
    """
    classes = len(general.weights)
    if restricted.loglik > general.loglik:
        general = fit(patterns, general.model, n_classes=classes, n_starts=n_starts, seed=seed, also=[restricted])
    recipe, statistic = _ratio_recipe(restricted.model, general.model, classes, reselect, selection or general.model)
    drawn = model_replicates(packed, restricted, replicates, seed)
    return _ratio(restricted, general), refitted(drawn, replicates, _categories([restricted, general]), recipe, statistic, is_large(patterns), n_starts, seed)


def _held_rows(small: DataFrame) -> DataFrame:
    """A table of a row per replicate whose rows are made now, once."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def severity(packed: DataFrame, patterns: DataFrame, restricted: Fit, general: Fit, null: DataFrame, replicates: int = REPLICATES, n_starts: int = 3, seed: int = 1, alpha: float = 0.05, reselect: tuple[int, ...] = (), selection: str | None = None) -> DataFrame:
    """(cutoff, power, effect, observed_rank, separated, replicates): how far the likelihood ratio moves if the general fit is true.

    ``power`` is the share of ratios under the general fit above the null's cutoff, ``effect`` the chance that one of them
    exceeds one of the null (ties half), ``observed_rank`` the share of them below the observed ratio; they are ``separated`` if
    their median is above the cutoff.
    """
    recipe, statistic = _ratio_recipe(restricted.model, general.model, len(general.weights), reselect, selection or general.model)
    drawn = model_replicates(packed, general, replicates, seed + 1)
    shifted = refitted(drawn, replicates, _categories([restricted, general]), recipe, statistic, is_large(patterns), n_starts, seed).where("not failed")
    # Both sides are a row per replicate, and seconds of fitting: they are made once, not again for every use and every pair.
    shifted, null = (_held_rows(t.where(F.col("statistic").isNotNull()).select("statistic")) for t in (shifted, null))
    cutoff = null.agg(F.percentile("statistic", F.lit(1 - alpha)).alias("cutoff"))
    pairs = shifted.select(F.col("statistic").alias("s")).join(F.broadcast(null.select(F.col("statistic").alias("t"))), F.lit(True))
    effect = pairs.agg(F.avg(F.when(F.col("s") > F.col("t"), 1.0).when(F.col("s") == F.col("t"), 0.5).otherwise(0.0)).alias("effect"))
    rank = shifted.join(cutoff, F.lit(True)).agg(F.first("cutoff").alias("cutoff"), F.avg((F.col("statistic") > F.col("cutoff")).cast("double")).alias("power"), F.avg((F.col("statistic") < _ratio(restricted, general)).cast("double")).alias("observed_rank"), (F.percentile("statistic", F.lit(0.5)) > F.first("cutoff")).alias("separated"), F.count(F.lit(1)).alias("replicates"))
    return rank.join(effect, F.lit(True)).select("cutoff", "power", "effect", "observed_rank", "separated", "replicates")


def _bic(f: Fit) -> float:
    return f.n_par * float(np.log(f.n_obs)) - 2 * f.loglik


def rasch_against_classes(packed: DataFrame, patterns: DataFrame, rasch: Fit, grain: tuple[int, ...] = (2, 3, 4), replicates: int = REPLICATES, n_starts: int = 3, seed: int = 1) -> tuple[float, DataFrame]:
    """The least BIC of latent-class Rasch fits minus that of the Rasch fit, and the same under the Rasch fit.

    Small values speak for classes, so the p-value is the lower tail's.
    """
    observed = min(_bic(fit(patterns, "LCR", n_classes=c, n_starts=n_starts, seed=seed)) for c in grain) - _bic(rasch)
    recipe = {f"{c} classes": Refit("LCR", c) for c in grain} | {"RM": Refit("RM")}

    def gap(get: Callable[[str], Fit]) -> float:
        return min(_bic(get(f"{c} classes")) for c in grain) - _bic(get("RM"))

    drawn = model_replicates(packed, rasch, replicates, seed)
    return observed, refitted(drawn, replicates, rasch.probs.shape[2], recipe, gap, is_large(patterns), n_starts, seed)


def counts_of_patterns(x: np.ndarray, freq: np.ndarray, least: int = 10, thin: int = 5, with_scores: bool = False) -> tuple[np.ndarray, ...]:
    """(n_total, n_right), score groups x items, the hardest item first, of complete patterns; and the scores if asked for.

    Graded answers have a column per step: of those who gave one of its two neighbouring answers, how many gave the
    upper one.  Rows and columns go until every cell has ``thin`` answers.  Fewer than three of either is an error.
    """
    whole = (x >= 0).all(1)
    x, freq = x[whole], freq[whole]
    score = x.sum(1)
    values = np.unique(score)
    groups = [s for s in values if freq[score == s].sum() >= least]
    graded = x.max(initial=0) > 1
    if len(groups) < 3:
        raise ValueError("fewer than three score groups")
    rows = list(range(len(groups)))
    if not graded:
        right = np.array([freq[score == s] @ x[score == s] for s in groups])
        total = np.repeat([[freq[score == s].sum()] for s in groups], x.shape[1], axis=1)
    else:
        steps = [(j, k) for j in range(x.shape[1]) for k in range(1, x[:, j].max() + 1)]
        upper = np.stack([x[:, j] == k for j, k in steps], 1).astype(float)
        either = upper + np.stack([x[:, j] == k - 1 for j, k in steps], 1)
        right, total = (np.array([freq[score == s] @ m[score == s] for s in groups]) for m in (upper, either))
        rows, cols = K.dense_sides(total, thin)
        right, total = right[np.ix_(rows, cols)], total[np.ix_(rows, cols)]
    order = np.argsort(right.sum(0) / np.maximum(total.sum(0), 1), kind="stable")
    return (total[:, order], right[:, order], *([np.array(groups)[rows]] if with_scores else []))


def _count_tables(replicates: DataFrame, size: int, least: int, which: str | int, n: int) -> DataFrame:
    """(rep, width, n_total, n_right, turn, turns): every replicate's table of counts, score groups x items row by row, for every part of
    at most NUMBERS_A_PART of its sub-matrices; none if the table is too small for one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        try:
            total, right = counts_of_patterns(*_sorted_patterns(group), least)
            if min(total.shape) >= size:
                turns = 1 if which == "adjacent" else max(1, -(-_wanted(total.shape, size, which) // NUMBERS_A_PART))
                found = [(int(group["rep"].iloc[0]), total.shape[1], total.ravel().tolist(), right.ravel().tolist(), turns)]
        except ValueError:
            pass
        return pd.DataFrame(found, columns=["rep", "width", "n_total", "n_right", "turns"])

    tables = per_key(replicates, "rep", n, run, "rep int, width int, n_total array<double>, n_right array<double>, turns long")
    return tables.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))


def _wanted(shape: tuple[int, int], size: int, which: str | int) -> int:
    number = K._number_of(shape, size, which == "adjacent")
    return min(which, number) if isinstance(which, int) else number


def violation_rates(replicates: DataFrame, check: str = "double", least: int = 10, seed: int = 1, which: str | int = "adjacent", n: int = REPLICATES) -> DataFrame:
    """(rep, statistic): mean violation rate of the sub-matrices of every replicate, weighted by answers.

    ``which`` is "adjacent", "all", or a number that every replicate draws.  A replicate without a sub-matrix that can be
    checked has no row.  A task finds the sub-matrices of its part by number, checks up to SIDE_BY_SIDE at once and returns sums
    per cell; replicates share a part of adjacent ones, which are few.
    """
    size, adjacent = K.CHECKS[check][0], which == "adjacent"
    cell = ["rep", "row", "col"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rng, found, sums = np.random.default_rng([seed, int(group["part"].iloc[0])]), [], []
        for t in group.sort_values("rep").itertuples():
            total, right = (np.array(v).reshape(-1, t.width) for v in (t.n_total, t.n_right))
            table = K.Table(list(range(total.shape[0])), list(range(t.width)), total, right)
            # Parts take turns, as numbers that stand together are often alike in whether they can be checked.
            numbers = range(t.turn, _wanted(total.shape, size, which), t.turns)
            for _, rows, cols in K.chosen_places(numbers, total.shape, size, which, table.sound, (seed, t.rep + 1)):
                if table.sound(rows, cols):
                    found.append((t.rep, rows, cols, total[np.ix_(rows, cols)], right[np.ix_(rows, cols)]))
        batches = 1 if adjacent else -(-len(found) // SIDE_BY_SIDE)
        for k in range(batches if found else 0):
            reps, rows, cols, total, right = (np.array(v) for v in zip(*found[k::batches]))
            low, high, _ = K.sampled_ranges(total, right, check, rng)
            bad = ~((right / total > low) & (right / total < high))
            sums.append(pd.DataFrame({"rep": np.repeat(reps, size * size), "row": np.repeat(rows, size, axis=1).ravel(), "col": np.tile(cols, size).ravel(), "n_total": total.ravel(), "violated": bad.ravel()}))
        if not sums:
            return pd.DataFrame([], columns=[*cell, "n_total", "n_checks", "n_violated"])
        return pd.concat(sums).groupby(cell, as_index=False).agg(n_total=("n_total", "first"), n_checks=("violated", "size"), n_violated=("violated", "sum"))

    rep, shared = F.col("rep").cast("long") + 1, max(1, K.GROUP // 64)
    part = F.floor(rep / shared) if adjacent else F.shiftleft(rep, 32) + F.col("turn")
    keys, number = (-(-(n + 1) // shared), None) if adjacent else (max(64, 4 * (n + 1)), rep + F.col("turn") * (n + 1))
    parts = _count_tables(replicates, size, least, which, n).withColumn("part", part)
    cells = per_key(parts, "part", keys, run, "rep int, row int, col int, n_total double, n_checks long, n_violated long", number)
    rate = cells.groupBy(*cell).agg(F.first("n_total").alias("n"), (F.sum("n_violated") / F.sum("n_checks")).alias("rate"))
    return rate.groupBy("rep").agg((F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("statistic"))


def cancellation_null(packed: DataFrame, patterns: DataFrame, check: str = "double", replicates: int = REPLICATES, least: int = 10, seed: int = 1, which: str | int = "adjacent", drawn: DataFrame | None = None) -> tuple[float, DataFrame]:
    """The weighted violation rate of a table, and (rep, statistic) of its replicates.

    Those are drawn given everyone's total, or given as ``drawn``.  Graded answers are recoded to steps in each of them.
    """
    if drawn is None:
        drawn = conditional_replicates(packed, fit_conditional(patterns), replicates, seed)
    every = drawn.unionByName(patterns.select(F.lit(-1).cast("int").alias("rep"), "x", "freq"))
    rates = {r["rep"]: r["statistic"] for r in violation_rates(every, check, least, seed, which, replicates).collect()}
    if -1 not in rates:
        raise ValueError("the table has too few score groups or no sub-matrix that can be checked")
    observed = rates.pop(-1)
    return observed, patterns.sparkSession.createDataFrame(sorted(rates.items()), "rep int, statistic double")


def ordering_statistic(x: np.ndarray, freq: np.ndarray, least: int = 20) -> float:
    """Positive crossings of rest-score curves, weighted by group size and divided by persons, of a pattern table."""
    seen = x >= 0
    mean = np.array([(freq * seen[:, j]) @ x[:, j] / max((freq * seen[:, j]).sum(), 1) for j in range(x.shape[1])])
    order, total, out = np.argsort(-mean, kind="stable"), np.maximum(x, 0).sum(1), 0.0
    for place, a in enumerate(order):
        for h in order[place + 1 :]:
            both = seen[:, a] & seen[:, h]
            rest = (total - x[:, a] - x[:, h])[both]
            n = np.bincount(rest, freq[both])
            gap = np.bincount(rest, (freq * (x[:, h] - x[:, a]))[both])
            out += np.maximum(gap, 0)[n >= least].sum()
    return out / freq.sum()


def ordering_null(packed: DataFrame, patterns: DataFrame, ordered: Fit, replicates: int = REPLICATES, least: int = 20, seed: int = 1, first: int = 0) -> tuple[float, DataFrame]:
    """The statistic of item ordering, and (rep, statistic, failed) under a fit that keeps items in one order."""
    statistic = lambda x, n: ordering_statistic(x, n, least)
    observed = per_replicate(patterns.select(F.lit(-1).alias("rep"), "x", "freq"), statistic, 1).first()["statistic"]
    return observed, per_replicate(model_replicates(packed, ordered, replicates, seed, first), statistic, replicates)


def in_stages(stage: Callable[[int, int], DataFrame], observed: float, replicates: int, most: int = 999, alpha: float = 0.05) -> tuple[DataFrame, bool]:
    """(null, whether it was extended): ``replicates`` draws, and as many more as make ``most`` where their p-value can't decide.

    ``stage(first, n)`` gives the draws from number ``first`` on; draws of the first stage stay.  A p-value decides if it is as small
    as it can be, or above ``alpha`` by more than three of its standard errors.
    """
    null = stage(0, replicates)
    rows = [tuple(r) for r in null.collect()]
    spark, schema = null.sparkSession, null.schema
    at = null.columns.index("statistic")
    values = [r[at] for r in rows if r[at] is not None]
    p = (1 + sum(v >= observed for v in values)) / (len(values) + 1)
    low, high = 1.5 / (replicates + 1), alpha + 3 * float(np.sqrt(alpha * (1 - alpha) / replicates))
    extended = most > replicates and low <= p <= high
    if extended:
        rows += [tuple(r) for r in stage(replicates, most - replicates).collect()]
    return spark.createDataFrame(rows, schema), extended
