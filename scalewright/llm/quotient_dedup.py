"""Exact dedup through counting quotient filters.

1. Every document gets a 64-bit fingerprint of its normalised text (all white space deleted).
2. Each task builds counting quotient filters of the fingerprints it holds: the upper half of a
   fingerprint is the quotient, the lower half the remainder, and remainders are kept sorted within
   the run of their quotient, each with a count.  Nothing is cut off, so the filters are lossless.
3. Filters of the same quotient range are merged by their sorted remainders, counts added.
4. Only documents whose fingerprint has a count above one are routed to verification, where they are
   grouped by the bytes of the normalised text itself.  The grouping pre-aggregates in the map tasks,
   so a group of copies with a third of all rows arrives as one row per task.

A filter is flushed once it holds ``FILTER_CAPACITY`` fingerprints, so memory stays bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .membership import rows_but, rows_in
from .store import saved
from .text import without_spaces

#: Fingerprints a task gathers before it hands its filters on.
FILTER_CAPACITY = 1 << 20
#: Fingerprints that one merged quotient range holds on average.
RANGE_SIZE = 1 << 16
BLOCK_SCHEMA = "quotient_range int, quotients binary, runs binary, remainders binary, counts binary"


def filter_of(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(quotients, run lengths, remainders, counts), sorted, of fingerprints that may repeat."""
    values, at = np.unique(fingerprints, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(values)).astype(np.uint64)
    quotients, runs = np.unique((values >> np.uint64(32)).astype(np.uint32), return_counts=True)
    return quotients, runs.astype(np.uint32), values.astype(np.uint32), total


def fingerprints_of(quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray) -> np.ndarray:
    return (np.repeat(quotients, runs).astype(np.uint64) << np.uint64(32)) | remainders


def _blocks(values: np.ndarray, counts: np.ndarray, range_bits: int) -> pa.RecordBatch:
    quotients, runs, remainders, total = filter_of(values, counts)
    ranges = (quotients >> np.uint32(32 - range_bits)) if range_bits else np.zeros_like(quotients)
    ends = np.cumsum(runs, dtype=np.int64)
    rows = []
    for r in np.unique(ranges):
        lo, hi = np.searchsorted(ranges, [r, r + 1])
        a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
        rows.append((int(r), quotients[lo:hi].tobytes(), runs[lo:hi].tobytes(), remainders[a:b].tobytes(), total[a:b].tobytes()))
    names = ["quotient_range", "quotients", "runs", "remainders", "counts"]
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def partition_filters(fingerprints: DataFrame, range_bits: int) -> DataFrame:
    """Counting quotient filters of a long column ``fp``, one row per task and quotient range."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, n = [], [], 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values, times = np.unique(fps, return_counts=True)
            held.append(values)
            counts.append(times)
            n += len(values)
            if n >= FILTER_CAPACITY:
                yield _blocks(np.concatenate(held), np.concatenate(counts), range_bits)
                held, counts, n = [], [], 0
        if n:
            yield _blocks(np.concatenate(held), np.concatenate(counts), range_bits)

    return fingerprints.select("fp").mapInArrow(build, BLOCK_SCHEMA)


def merged_repeats(filters: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that all filters together count more than once."""

    def merge(blocks: pd.DataFrame) -> pd.DataFrame:
        values = [fingerprints_of(np.frombuffer(q, np.uint32), np.frombuffer(r, np.uint32), np.frombuffer(m, np.uint32)) for q, r, m in zip(blocks.quotients, blocks.runs, blocks.remainders)]
        counts = [np.frombuffer(c, np.uint64) for c in blocks.counts]
        quotients, runs, remainders, total = filter_of(np.concatenate(values), np.concatenate(counts))
        more = total > 1
        return pd.DataFrame({"fp": fingerprints_of(quotients, runs, remainders)[more].view(np.int64), "n": total[more].astype(np.int64)})

    return filters.groupBy("quotient_range").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; null counts as empty, so null, empty and
    blank texts are one group.  Of a group the row with the most code points stays, then the smallest
    id.  Rows repeated under one id tie: each is marked kept, and ``drop_copies`` leaves one of them.
    A null id loses against any other.  Very long texts are compared whole.  Other columns are ignored.
    """
    lean = saved(_lean(docs, doc_id, text), "exact-lean")
    n = lean.count()
    range_bits = min(20, max(4, math.ceil(math.log2(max(2, n) / RANGE_SIZE))))
    repeats = saved(merged_repeats(partition_filters(lean, range_bits)), "exact-repeats")
    suspects = saved(lean.join(repeats, "fp", "left_semi").select("doc_id").distinct(), "exact-suspects", n)

    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    routed = rows_in(texts, {"doc_id": F.col("doc_id")}, suspects)
    # The larger text wins, then the smaller id: one number, so that the aggregate can hash and update in place.
    # Rows without an id are counted, but neither maximum sees them; a group of only such rows has the null id.
    step = F.lit(str(2 * 10**19)).cast("decimal(38,0)")
    classes = (
        routed.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"), without_spaces(F.col("text")).alias("norm"))
        .groupBy("norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n_cp"))).alias("n_cp"), F.max(F.col("n_cp") * step - F.col("doc_id")).alias("rank"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "group_size", (F.col("n_cp") * step - F.col("rank")).cast("long").alias("keep_id"))
    )
    known = F.col("group_size").isNotNull()
    return lean.join(classes, "text_sha256", "left").select(
        "doc_id",
        F.when(known, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~known | F.expr("doc_id <=> keep_id")).alias("kept"),
        "text_sha256",
    )


def _lean(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    norm = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), without_spaces(F.col(f"`{text}`")).alias("norm"))
    return norm.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Of rows repeated under the id that stays, the one with the most code points is left.  Rows that stay are
    never shuffled, but for those whose id is dropped or repeated elsewhere.
    """
    key = ["doc_id", "text_sha256"]
    dropped = saved(exact_groups(docs, doc_id, text).where("not kept").select(*key).distinct(), "exact-dropped", docs.count())
    body = F.col(f"`{text}`")
    of = {"doc_id": F.col(f"`{doc_id}`"), "text_sha256": F.sha2(without_spaces(body), 256)}
    return rows_but(docs, of, dropped, of["text_sha256"], F.struct(F.char_length(body), body))
