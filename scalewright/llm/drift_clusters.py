"""Centroid clustering with bounds that geometry keeps tight.

Vectors are whole numbers, centroids too (floors of means), so distances are exact.  Every vector carries its cluster, an
upper bound of the distance to its centroid and a lower bound of that to any other.  When centroids move, the upper
bound grows by the way its centroid went.  The lower bound needn't fall by the longest way of another centroid: the
vectors of a cluster lie in a sphere around its old centroid, and how much nearer a centroid that moves from a to b can
come to a point of that sphere is settled in the plane through a, b and the sphere's centre.  Seen from the midpoint of a
and b, points within an angle t of the direction of the move come nearer by at most |b - a| cos t, and no point of the
sphere is seen at less than the angle of its centre minus that of its tangent.

A vector stays where it is if its upper bound is below its lower bound or half the way to the next centroid; else its own
distance is computed, and if that doesn't settle it, it is compared with all centroids.

Vectors and bounds are a written table per round.  Sums of clusters are added up in the tasks; the driver gets at
most PARTS rows per cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .store import saved

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Up to this magnitude distances and sums of components are exact in doubles; beyond it, Python's integers take over.
EXACT = 1 << 22
#: Slack of the bounds, far above the rounding of a square root or a sum of a few of them.
SLACK = 1e-9
#: Rows that are compared with all centroids at once, and parts into which the sums of a cluster are added up.
ROWS, PARTS = 4096, 32
MOST_LONG = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, size: int = SIZE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of exactly ``size`` components, none null or non-finite, in the table's own precision.

    ``v`` is floor(256 x) / 256, which any precision holds, and which takes few different values that Parquet stores in few bits.
    """
    kind = vectors.schema[embedding].dataType
    own = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    e = F.col(f"`{embedding}`").cast("array<double>")
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * float(SCALE)) == float("inf")))
    kept = vectors.where(F.col(f"`{embedding}`").isNotNull() & (F.size(e) == size) & sound)
    return kept.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(e, _floored).cast("array<float>" if own else "array<double>").alias("v"))


def _floored(x: Column) -> Column:
    """floor(256 x) / 256, in doubles all the way, since a long may not hold it."""
    y = x * float(SCALE)
    near = F.rint(y)
    return F.when(near > y, near - 1).otherwise(near) / float(SCALE)


def first_centroids(v: DataFrame, clusters: int = CLUSTERS, salt: str = "2") -> list[list[int]]:
    """The vectors of least SHA-256 of ``salt:vec_id``; ties are ordered by the vector, null ids come last."""
    hashed = v.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [[math.floor(SCALE * x) for x in r["v"]] for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()]


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(256 x) of every component, as doubles without fractions."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def _whole(a: np.ndarray) -> np.ndarray:
    """Doubles without fractions as Python integers."""
    return np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape)


class Centroids:
    """Centroids of whole numbers, and exact squared distances to them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.large = any(abs(x) > EXACT for row in rows for x in row)
        self.near = np.array([[float(x) for x in row] for row in rows]).reshape(len(rows), -1)

    def _apart(self, x: np.ndarray) -> bool:
        return self.large or bool(len(x) and np.abs(x).max() > EXACT)

    def squared(self, x: np.ndarray) -> np.ndarray:
        """Rows x centroids, exact: doubles, or Python's integers where those don't suffice."""
        if not self._apart(x):
            return (x * x).sum(1)[:, None] - 2 * (x @ self.near.T) + (self.near * self.near).sum(1)
        exact, c = _whole(x), np.array(self.rows, dtype=object).reshape(len(self.rows), -1)
        return np.array([[((row - one) ** 2).sum() for one in c] for row in exact], dtype=object).reshape(len(x), len(c))

    def squared_to(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The squared distance of every row to one centroid each."""
        if not self._apart(x):
            return ((x - self.near[which]) ** 2).sum(1)
        exact = _whole(x)
        return np.array([((row - np.array(self.rows[k], dtype=object)) ** 2).sum() for row, k in zip(exact, which)], dtype=object)

    def gaps(self) -> np.ndarray:
        """Distances between centroids, infinite to themselves."""
        d = np.sqrt(((self.near[:, None] - self.near) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        return d


def tightened_drift(centre: np.ndarray, radius: float, a: np.ndarray, b: np.ndarray) -> float:
    """At most how much nearer a centroid that moves from ``a`` to ``b`` comes to any point of a sphere."""
    move = float(np.linalg.norm(b - a))
    if move == 0:
        return 0.0
    out = centre - (a + b) / 2
    away = float(np.linalg.norm(out))
    if radius >= away:
        return move
    angle = np.arccos(np.clip(out @ (b - a) / (away * move), -1, 1)) - np.arcsin(radius / away)
    return move * float(np.cos(max(angle, 0.0))) if angle < np.pi / 2 else 0.0


def drifts(old: Centroids, new: Centroids, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cluster (growth of its upper bounds, fall of its lower bounds).  Without bounds where doubles can't tell centroids apart."""
    k = len(old.rows)
    if old.large or new.large:
        return np.full(k, np.inf), np.full(k, np.inf)
    moved = np.sqrt(((new.near - old.near) ** 2).sum(1))
    fall = [max((tightened_drift(old.near[c], radius[c], old.near[j], new.near[j]) for j in range(k) if j != c and moved[j]), default=0.0) for c in range(k)]
    return moved, np.array(fall)


def _nearest(c: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, the first of equal ones; distance; distance to the next) by comparison with all."""
    best, upper, lower = np.empty(len(x), np.int32), np.empty(len(x)), np.full(len(x), np.inf)
    for at in range(0, len(x), ROWS):
        here = slice(at, at + ROWS)
        d = c.squared(x[here])
        rows = np.arange(len(d))
        best[here] = np.argmin(d, axis=1)
        upper[here] = np.sqrt(d[rows, best[here]].astype(float))
        if d.shape[1] > 1:
            others = d.astype(float)
            others[rows, best[here]] = np.inf
            lower[here] = np.sqrt(others.min(1))
    return best, upper, lower


def reassigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids, growth: np.ndarray, fall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, rows compared with all centroids) after centroids moved."""
    half = np.zeros(len(c.rows)) if c.large else c.gaps().min(1) / 2
    cluster, upper, lower = cluster.copy(), upper + growth[cluster], lower - fall[cluster]
    settled = lambda rows: upper[rows] * (1 + SLACK) + SLACK < np.maximum(lower[rows], half[cluster[rows]]) * (1 - SLACK)
    open_rows = np.flatnonzero(~settled(np.arange(len(x))))
    upper[open_rows] = np.sqrt(c.squared_to(x[open_rows], cluster[open_rows]).astype(float))
    open_rows = open_rows[~settled(open_rows)]
    cluster[open_rows], upper[open_rows], lower[open_rows] = _nearest(c, x[open_rows])
    return cluster, upper, lower, len(open_rows)


def _state_schema(v: DataFrame) -> str:
    return f"vec_id long, v {v.schema['v'].dataType.simpleString()}, cluster int, upper double, lower double"


def _state(batch: pa.RecordBatch, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])


def cluster_sums(state: DataFrame) -> list[tuple[int, int, float, str]]:
    """(cluster, n, radius, sums) of every cluster with vectors; sums are decimal texts, as they may pass 64 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n: dict[int, int] = {}
        radius: dict[int, float] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            x, of, upper = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(of).tolist():
                rows = x[of == k]
                one = rows.sum(0) if np.abs(rows).max() <= EXACT else _whole(rows).sum(0)
                sums[k] = [a + int(b) for a, b in zip(sums.get(k, [0] * x.shape[1]), one)]
                n[k] = n.get(k, 0) + len(rows)
                radius[k] = max(radius.get(k, 0.0), float(upper[of == k].max()))
        if n:
            part = TaskContext.get().partitionId() % PARTS
            keys = list(n)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(keys), pa.int32()), "cluster": pa.array(keys, pa.int32()), "n": [n[k] for k in keys], "radius": [radius[k] for k in keys], "sums": [",".join(map(str, sums[k])) for k in keys]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = [sum(column) for column in zip(*(map(int, s.split(",")) for s in group["sums"]))]
        return pd.DataFrame({"cluster": group["cluster"].iloc[:1], "n": [group["n"].sum()], "radius": [group["radius"].max()], "sums": [",".join(map(str, total))]})

    parts = state.select("v", "cluster", "upper").mapInArrow(add, "part int, cluster int, n long, radius double, sums string")
    # PARTS x clusters rows at most.
    found = parts.groupBy("part", "cluster").applyInPandas(merge, "cluster int, n long, radius double, sums string").toPandas()
    return [tuple(merge(group).itertuples(index=False, name=None))[0] for _, group in found.groupby("cluster")]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that is kept.

    Vectors with another number of components, or with null or non-finite ones, are left out.  With fewer vectors than
    ``clusters`` each starts a cluster; equal starts tie, and the smaller number takes the vectors.  Rows repeated under
    an id are vectors of their own; a null id stays null.  A distance or a sum beyond 64 bits is null.  An empty
    table gives an empty table.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = kept_vectors(vectors, size, vec_id, embedding)
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    first = first_centroids(v, clusters)
    if not first:
        return spark.createDataFrame([], out_schema)
    now = Centroids(first)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _state(batch, *_nearest(now, _matrix(batch.column(1))))

    state = saved(v.mapInArrow(begin, _state_schema(v)), "drift-state")
    for _ in range(rounds):
        found = cluster_sums(state)
        radius, rows = np.zeros(len(now.rows)), [list(r) for r in now.rows]
        for k, n, r, sums in found:
            radius[k], rows[k] = r, [int(s) // int(n) for s in sums.split(",")]
        old, now = now, Centroids(rows)
        state = saved(state.mapInArrow(_mover(now, *drifts(old, now, radius * (1 + SLACK) + SLACK)), _state_schema(v)), "drift-state")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = now.squared_to(_matrix(batch.column(1)), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([int(x) if x <= MOST_LONG else None for x in d], pa.int64())], ["vec_id", "cluster", "distance"])

    measured = state.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long")
    total = {r["cluster"]: r["s"] for r in measured.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    fits = lambda s: None if s is None or s > MOST_LONG else int(s)
    inertia = None if None in total.values() else sum(total.values())
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.rows]
    per = spark.createDataFrame([(k, fits(s), fits(inertia), digest[k]) for k, s in total.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _mover(c: Centroids, growth: np.ndarray, fall: np.ndarray):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            yield _state(batch, *reassigned(x, *(batch.column(k).to_numpy() for k in (2, 3, 4)), c, growth, fall)[:3])

    return move


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same rows in SQL, with every round spelt out and every vector compared with all centroids."""
    assign = """a{r} AS MATERIALIZED (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
            SELECT v.rid, c.k, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY rid)"""
    move = """m{r} AS MATERIALIZED (SELECT k, list(floor_mean ORDER BY j) AS c FROM (
            SELECT k, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean FROM (
                SELECT a.k, j, sum(v.v[j]) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid), range(1, {size} + 1) t(j) GROUP BY a.k, j)) GROUP BY k),
        c{next} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (k))"""
    steps = [assign.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, next=r + 1, size=size), assign.format(r=r + 1)]
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM v WHERE true QUALIFY k < {clusters}),
        {", ".join(steps)}
        SELECT v.vec_id, a.k::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM v JOIN a{rounds} a USING (rid) JOIN c{rounds} c USING (k)"""
