"""Order constraints on tables classes x items x categories, and the likeliest tables that obey them.

A constraint says that the mean answer, or the chance of an answer of at least some step, of one cell isn't above that of
another.  All of them are linear in the probabilities, so a set of them is a matrix, orders are put together by
stacking, and the weighted multinomial likelihood is concave under them: one interior-point search finds its maximum,
for many tables that don't touch each other side by side.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Newton steps of a search, and where the search ends: largest residual and mean product of slacks and multipliers.
ROUNDS, TOLERANCE = 80, 1e-11


@dataclass(frozen=True)
class Cell:
    """The mean answer of an item in a class, or with ``step`` the chance of an answer of at least that step."""

    class_id: int
    item_id: int
    step: int | None = None


@dataclass(frozen=True)
class Constraints:
    """Orders of classes and of items, and further pairs (lower, higher) of cells.

    ``item_order`` lists items from easy to hard.  Ordered classes rise in every step of every item; ordered items fall
    in their mean answers in every class.
    """

    monotone_classes: bool = False
    item_order: tuple[int, ...] | None = None
    pairs: tuple[tuple[Cell, Cell], ...] = field(default=())

    def __and__(self, other: Constraints) -> Constraints:
        if self.item_order and other.item_order and self.item_order != other.item_order:
            raise ValueError("two different orders of items")
        return Constraints(self.monotone_classes or other.monotone_classes, self.item_order or other.item_order, self.pairs + other.pairs)

    def edges(self, tops: Iterable[int], n_classes: int) -> list[tuple[Cell, Cell]]:
        """All pairs (lower, higher).  An item that the table doesn't have, or that occurs twice in an order, is an error."""
        tops = [int(t) for t in tops]
        out: list[tuple[Cell, Cell]] = []
        if self.monotone_classes:
            out += [(Cell(c, j, x), Cell(c + 1, j, x)) for j, top in enumerate(tops) for x in range(1, top + 1) for c in range(n_classes - 1)]
        if self.item_order is not None:
            if len(set(self.item_order)) < len(self.item_order) or not set(self.item_order) <= set(range(len(tops))):
                raise ValueError("an order of items names each item once")
            out += [(Cell(c, hard), Cell(c, easy)) for c in range(n_classes) for easy, hard in zip(self.item_order, self.item_order[1:])]
        return out + list(self.pairs)


def ordering(model: str, item_order: Iterable[int]) -> Constraints:
    """The constraints of a named model: MON, IIO, DM for both, none for UN."""
    return Constraints(model in ("MON", "DM"), tuple(int(j) for j in item_order) if model in ("IIO", "DM") else None)


def values(p: np.ndarray, cell: Cell) -> float:
    row = p[cell.class_id, cell.item_id]
    return float(row @ np.arange(len(row))) if cell.step is None else float(row[cell.step :].sum())


def violations(p: np.ndarray, constraints: Constraints, tops: Iterable[int] | None = None, tolerance: float = 1e-6) -> list[tuple[Cell, Cell, float]]:
    """(lower, higher, how much above) of the pairs that a table classes x items x categories breaks."""
    tops = [p.shape[2] - 1] * p.shape[1] if tops is None else tops
    gaps = [(a, b, values(p, a) - values(p, b)) for a, b in constraints.edges(tops, len(p))]
    return [g for g in gaps if g[2] > tolerance]


def is_acyclic(constraints: Constraints, tops: Iterable[int], n_classes: int) -> bool:
    """Whether the pairs are a partial order, so that no two cells are forced to be equal."""
    after: dict[Cell, set[Cell]] = {}
    waits: dict[Cell, int] = {}
    for a, b in set(constraints.edges(tops, n_classes)):
        after.setdefault(a, set()).add(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    free = [c for c, n in waits.items() if not n]
    seen = 0
    while free:
        cell = free.pop()
        seen += 1
        for b in after.get(cell, ()):
            waits[b] -= 1
            if not waits[b]:
                free.append(b)
    return seen == len(waits)


def maximised(weight: np.ndarray, equal: np.ndarray, below: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The p >= 0 with equal @ p = 1 and below @ p <= 0 that maximises sum(weight * log p), for every row of ``weight``.

    A primal-dual interior-point search: slacks and multipliers of the inequalities stay positive, and their products
    are driven to zero together.  All rows share each step's linear algebra.
    """
    n_rows, n = weight.shape
    inner = np.vstack([below.reshape(-1, n), -np.eye(n)])
    w = weight / np.maximum(weight.sum(1, keepdims=True), 1e-300)
    p = np.tile(1 / (equal.T @ (equal @ np.ones(n))), (n_rows, 1))
    slack = np.maximum(-(p @ inner.T), 0.05)
    dual = 0.1 / slack / len(inner)
    price = np.zeros((n_rows, len(equal)))
    best, held = np.full(n_rows, np.inf), p.copy()
    for _ in range(rounds):
        gap = (slack * dual).mean(1)
        slope = -w / p + price @ equal + dual @ inner
        off_equal, off_below = p @ equal.T - 1, p @ inner.T + slack
        worst = np.maximum.reduce([np.abs(slope).max(1) * p.min(1).clip(1e-12, 1), np.abs(off_equal).max(1), np.abs(off_below).max(1), gap])
        better = worst < best
        best[better], held[better] = worst[better], p[better]
        if (best < tolerance).all():
            break
        target = 0.1 * gap[:, None]
        ratio = dual / slack
        curve = (ratio[:, None, :] * inner.T) @ inner
        curve[:, np.arange(n), np.arange(n)] += w / p**2 + 1e-14
        side = -(slope + ((ratio * off_below) - dual + target / slack) @ inner)
        system = np.zeros((n_rows, n + len(equal), n + len(equal)))
        system[:, :n, :n], system[:, :n, n:], system[:, n:, :n] = curve, equal.T, equal
        system[:, np.arange(n, n + len(equal)), np.arange(n, n + len(equal))] = -1e-14
        try:
            move = np.linalg.solve(system, np.concatenate([side, -off_equal], 1)[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            break
        d_p, d_price = move[:, :n], move[:, n:]
        d_slack = -off_below - d_p @ inner.T
        d_dual = -dual + target / slack - ratio * d_slack
        if not np.isfinite(move).all():
            break

        def longest(v: np.ndarray, d: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.minimum(1.0, 0.99 * np.where(d < 0, -v / d, np.inf).min(1))[:, None]

        primal = np.minimum(longest(slack, d_slack), longest(p, d_p))
        other = longest(dual, d_dual)
        p, slack = p + primal * d_p, slack + primal * d_slack
        dual, price = dual + other * d_dual, price + other * d_price
    return held


def _layout(shape: tuple[int, int, int], tops: np.ndarray) -> np.ndarray:
    """Where the cells classes x items x categories lie in a vector of those that can occur; -1 for others."""
    out = np.full(shape, -1)
    can = np.arange(shape[2])[None, None, :] <= np.asarray(tops)[None, :, None]
    can = np.broadcast_to(can, shape)
    out[can] = np.arange(can.sum())
    return out


def _matrices(at: np.ndarray, edges: list[tuple[Cell, Cell]]) -> tuple[np.ndarray, np.ndarray]:
    """(sums that are 1, differences that are at most 0) over the vector of cells."""
    n = int(at.max()) + 1
    rows = at.reshape(-1, at.shape[2])
    equal = np.zeros((len(rows), n))
    for k, cells in enumerate(rows):
        equal[k, cells[cells >= 0]] = 1
    below = np.zeros((len(edges), n))
    for k, pair in enumerate(edges):
        for cell, sign in zip(pair, (1.0, -1.0)):
            cells = at[cell.class_id, cell.item_id]
            factor = np.arange(len(cells)) if cell.step is None else (np.arange(len(cells)) >= cell.step).astype(float)
            below[k, cells[cells >= 0]] += sign * factor[cells >= 0]
    return equal, below


def _blocks(shape: tuple[int, int, int], edges: list[tuple[Cell, Cell]]) -> list[list[tuple[int, int]]]:
    """Distributions (class, item) that constraints tie together, directly or through others."""
    parent = {(c, j): (c, j) for c in range(shape[0]) for j in range(shape[1])}

    def root(k: tuple[int, int]) -> tuple[int, int]:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in edges:
        parent[root((a.class_id, a.item_id))] = root((b.class_id, b.item_id))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in parent:
        out.setdefault(root(k), []).append(k)
    return list(out.values())


class OrderedStep:
    """The M step under constraints: the likeliest table given expected counts classes x items x categories.

    Distributions that no constraint ties together are separate problems; those of one form are solved side by side.
    Where the free shares, or for two orders those under the order of classes alone, keep all constraints, they are
    the answer.
    """

    def __init__(self, shape: tuple[int, int, int], tops: np.ndarray, constraints: Constraints):
        self.shape, self.tops, self.constraints = shape, np.asarray(tops), constraints
        self.edges = constraints.edges(self.tops, shape[0])
        self.can = np.broadcast_to(np.arange(shape[2])[None, None, :] <= self.tops[None, :, None], shape)
        self.relaxed = OrderedStep(shape, tops, Constraints(True)) if constraints.monotone_classes and (constraints.item_order or constraints.pairs) else None
        self.groups: dict[tuple, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        if self.relaxed is not None or not self.edges:
            self._prepare([[(c, j) for c in range(shape[0]) for j in range(shape[1])]] if self.edges else [])
        else:
            self._prepare(_blocks(shape, self.edges))

    def _prepare(self, blocks: list[list[tuple[int, int]]]) -> None:
        at = _layout(self.shape, self.tops)
        equal, below = _matrices(at, self.edges)
        for block in blocks:
            cells = np.concatenate([at[k][at[k] >= 0] for k in block])
            mine = equal[:, cells].any(1)
            bound = below[:, cells].any(1)
            e, b = equal[np.ix_(mine, cells)], below[np.ix_(bound, cells)]
            self.groups.setdefault((e.tobytes(), b.tobytes(), e.shape), []).append((cells, e, b))

    def free(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum(2, keepdims=True)
        return np.where(total > 0, counts / np.where(total > 0, total, 1), self.can / self.can.sum(2, keepdims=True))

    def holds(self, p: np.ndarray, tolerance: float = 1e-9) -> bool:
        return not violations(p, self.constraints, self.tops, tolerance)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        p = self.relaxed(counts) if self.relaxed is not None else self.free(counts)
        if self.holds(p):
            return p
        flat = np.where(self.can, counts, 0)[self.can].astype(float)
        # Empty cells get the least weight that keeps the maximum unique.
        flat = np.maximum(flat, 1e-9 * max(flat.sum(), 1e-9))
        out = p[self.can].copy()
        for members in self.groups.values():
            found = maximised(np.array([flat[cells] for cells, _, _ in members]), members[0][1], members[0][2])
            for (cells, _, _), one in zip(members, found):
                out[cells] = one
        table = np.zeros(self.shape)
        table[self.can] = np.maximum(out, 0)
        return table / table.sum(2, keepdims=True)


def expected_loglik(counts: np.ndarray, p: np.ndarray) -> float:
    return float((counts * np.log(np.maximum(p, 1e-300)))[counts > 0].sum())


def projected(values_: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, int]], cycles: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """The values nearest to given ones, in weighted least squares, with value a <= value b for all ``pairs`` (a, b).

    Each pair is pooled in turn, with its last correction taken back first; the sweep repeats until nothing moves.
    """
    x = np.asarray(values_, float).copy()
    w = np.maximum(np.asarray(weight, float), 1e-12)
    pulled = np.zeros(len(pairs))
    for _ in range(cycles):
        before = x.copy()
        for k, (a, b) in enumerate(pairs):
            # The correction of a pair moves a down and b up, by amounts inverse to their weights.
            x[a] += pulled[k] / w[a]
            x[b] -= pulled[k] / w[b]
            pulled[k] = max(0.0, (x[a] - x[b]) / (1 / w[a] + 1 / w[b]))
            x[a] -= pulled[k] / w[a]
            x[b] += pulled[k] / w[b]
        if np.abs(x - before).max() < tolerance:
            break
    return x
