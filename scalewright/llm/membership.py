"""Taking rows out of a wide table by key, without moving the rows that stay.

The keys to find are laid out as a bitmap of hash positions.  It has a bounded size and is broadcast, so every
task sees at once which of its rows can't be among the keys; those stay where they are.  Only the others, the
rows of the keys and a few that share a position, are shuffled and compared with the keys themselves.  The
result is exact at every size: a bitmap at its bound only sends more rows through the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Positions per key, and the least and most positions of a bitmap (the most are 32 MB).
POSITIONS_PER_KEY, LEAST_POSITIONS, MOST_POSITIONS = 16, 1 << 15, 1 << 28

#: A task of the few rows that move is kept for so many rows of the table at least.
WIDE_ROWS = 1 << 13


def _position(keys: list[Column], positions: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(positions)) + 1


def split_by_keys(rows: DataFrame, of: dict[str, Column], keys: DataFrame, more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that are in none of ``keys``, rows that may be), each as ``row`` with the columns of ``of`` and ``more``.

    ``of`` says how a row's key is made, under the column names of ``keys``.  ``keys`` should be a written
    table, since it is read twice.  Null keys are keys like others.
    """
    names, more = list(of), more or {}
    positions = LEAST_POSITIONS
    while positions < min(MOST_POSITIONS, POSITIONS_PER_KEY * keys.count()):
        positions *= 2
    at = keys.select(_position([F.col(n) for n in names], positions).alias("at"))
    # At most MOST_POSITIONS / 32,768 rows of 4 KB.
    bitmap = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    df = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[c.alias(n) for n, c in {**of, **more}.items()])
    df = df.withColumn("at", _position([F.col(n) for n in names], positions)).withColumn("in_bucket", F.bitmap_bucket_number("at"))
    df = df.join(F.broadcast(bitmap), F.col("in_bucket") == F.col("bucket"), "left")
    byte = "cast(conv(hex(substring(bits, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)), 16, 10) as int)"
    maybe = F.expr(f"coalesce((shiftright({byte}, cast(bitmap_bit_position(at) % 8 as int)) & 1) = 1, false)")
    df = df.withColumn("maybe", maybe)
    return df.where("not maybe").select("row", *names, *more), df.where("maybe").select("row", *names, *more)


def _renamed(keys: DataFrame, names: list[str]) -> DataFrame:
    return keys.select(*[F.col(n).alias(f"key_{n}") for n in names])


def _same(columns: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"key_{n}")) for n, c in columns.items()))


def rows_in(rows: DataFrame, of: dict[str, Column], keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys``, columns as in ``rows``."""
    return split_by_keys(rows, of, keys)[1].join(_renamed(keys, list(of)), _same({n: n for n in of}), "left_semi").select("row.*")


def rows_not_in(rows: DataFrame, of: dict[str, Column], keys: DataFrame, n_rows: int) -> DataFrame:
    """The rows whose key isn't in ``keys``, columns as in ``rows``, which has ``n_rows``."""
    rest, maybe = split_by_keys(rows, of, keys)
    return rest.select("row.*").unionByName(maybe.join(_renamed(keys, list(of)), _same({n: n for n in of}), "left_anti").select("row.*").coalesce(1 + n_rows // WIDE_ROWS))


def rows_but(rows: DataFrame, of: dict[str, Column], dropped: DataFrame, same: Column, longest: Column) -> DataFrame:
    """The rows whose key isn't in ``dropped``; of rows with one id and equal ``same``, the one with the most ``longest``.

    The first column of ``of`` is the row's id.  Only rows move whose id is dropped or repeated.
    """
    names = list(of)
    repeated = rows.groupBy(of[names[0]].alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    ids = saved(dropped.select(F.col(names[0]).alias("id")).unionByName(repeated).distinct(), "dropped-ids", n_rows := rows.count())
    rest, maybe = split_by_keys(rows, {"id": of[names[0]]}, ids, {f"of_{n}": c for n, c in of.items()} | {"same": same, "longest": longest})
    stay = maybe.join(_renamed(dropped, names), _same({n: f"of_{n}" for n in names}), "left_anti")
    one = stay.groupBy("id", "same").agg(F.max_by("row", "longest").alias("row"))
    return rest.select("row.*").unionByName(one.select("row.*").coalesce(1 + n_rows // WIDE_ROWS))
