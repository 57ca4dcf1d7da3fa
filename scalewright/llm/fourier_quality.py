"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Every text gives a row of statistics.  Random Fourier features of the standardised statistics approximate a
Gaussian kernel.  Each task sums the normal equations of its labelled rows; the sums are added per matrix
row, and the driver solves systems of fixed size.  Scores are calibrated by isotonic regression over ``BINS``
bins of raw scores, each of them the score of a row by a fit to the other folds.  Labels of rows whose crc32 of the id leaves 1 modulo 3 are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Random features, width of the kernel in standard deviations, weight of the ridge, bins, seed.
FEATURES, WIDTH, RIDGE, BINS, SEED = 160, 6.0, 1.0, 400, 20240
#: Labelled rows are calibrated by the fit to the folds they aren't in; rows of equal statistics share a fold.
FOLDS = 4
#: Standardised statistics are cut at this, so that one odd text can't leave the kernel's range.
LARGEST = 6.0
NAMES = ("log_words", "word_length", "symbols", "upper", "digits", "stops", "commas", "exclaims", "bars", "distinct", "distinct_pairs", "top_word", "line_length", "repeated_lines", "ends", "short_words", "odd")
_LETTERS = re.compile(r"[^\W\d_]")


def statistics(text: str) -> list[float]:
    """Statistics of one whole text; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    share = lambda chars: sum(map(text.count, chars)) / size
    lower = text.lower()
    upper = sum(map(str.__ne__, lower, text)) / size if len(lower) == size and lower != text else 0.0
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(1 for x in lines if x.rstrip()[-1] in ".!?")
    return [
        np.log1p(n), (size - n) / n, share("#*$%&<>|"), upper, share("0123456789"), share(".?"), share(",;:"), share("!"), share("|"),
        len(kinds) / n, len(set(zip(words, words[1:]))) / n, max(kinds.values()) / n, np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        ends / max(1, len(lines)), sum(c for w, c in kinds.items() if len(w) <= 3) / n, share("_=/\\{}[]@~^"),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py() or "") for t in batch.column("text")], np.float64).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(rows[:, i]) for i in range(len(NAMES))]], ["doc_id", *NAMES])


class Kernel:
    """Standardisation and random features; a few thousand numbers, whatever the input."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.waves = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -LARGEST, LARGEST)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.waves + self.phases)
        return np.hstack((z, np.ones((len(rows), 1))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES])


def fold() -> Column:
    return F.pmod(F.xxhash64(*NAMES), F.lit(FOLDS)).cast("int")


def normal_equations(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """[Z'Z | Z'y] of every fold of ``rows`` (NAMES, label, fold): each task sums its own, then the sums are added row by row."""
    side = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, side, side + 1))
        for batch in batches:
            z, folds = kernel(_matrix(batch)), batch.column("fold").to_numpy(zero_copy_only=False)
            zy = np.column_stack((z, batch.column("label").to_numpy(zero_copy_only=False)))
            for k in range(FOLDS):
                total[k] += z[folds == k].T @ zy[folds == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS * side), pa.int32()), pa.array([r.tobytes() for r in total.reshape(FOLDS * side, -1)], pa.binary())], ["i", "sums"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(b, np.float64) for b in group.sums)
        return pd.DataFrame({"i": group.i[:1], "sums": [sums.tobytes()]})

    found = rows.select(*NAMES, "label", "fold").mapInArrow(partial, "i int, sums binary").groupBy("i").applyInPandas(added, "i int, sums binary").collect()
    out = np.zeros((FOLDS * side, side + 1))
    for r in found:
        out[r["i"]] = np.frombuffer(r["sums"], np.float64)
    return out.reshape(FOLDS, side, side + 1)


def ridge(sums: np.ndarray) -> np.ndarray:
    return np.linalg.solve(sums[:, :-1] + RIDGE * np.eye(len(sums)), sums[:, -1])


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Nondecreasing fit of means with weights, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, k2 = blocks.pop()
            w1, m1, k1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.repeat([b[1] for b in blocks], [b[2] for b in blocks])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Null texts count as empty and get the score that their statistics give.  Without labels, or with labels
    of one kind, every score is the (smoothed) share of label 1.  A document with several labels counts by
    their mean.  Labels of ids that ``docs`` doesn't have are ignored.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    measured = saved(texts.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES)), "quality-statistics")
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
    known = known.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("label").alias("label"))
    rows = saved(measured.join(known, "doc_id").withColumn("fold", fold()), "quality-labelled")
    ends = rows.agg(F.count("label").alias("n"), F.avg("label").alias("share"), *[f(c).alias(f"{k}_{c}") for c in NAMES for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    if not ends["n"] or not 0 < ends["share"] < 1:
        score = (1 + ends["n"] * (ends["share"] or 0.0)) / (2 + ends["n"])
        return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(float(score)).alias("score"), F.lit(int(score >= 0.5)).alias("predicted"))

    kernel = Kernel(np.array([ends[f"mean_{c}"] for c in NAMES]), np.array([max(ends[f"sd_{c}"], 1e-9) for c in NAMES]))
    sums = normal_equations(rows, kernel)
    total = sums.sum(axis=0)
    weights, others = ridge(total), np.column_stack([ridge(total - own) for own in sums])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            at = _bin((kernel(_matrix(batch)) @ others)[np.arange(len(folds)), folds])
            n += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=batch.column("label").to_numpy(zero_copy_only=False), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(n), pa.array(ones)], ["bin", "n", "ones"])

    counted = rows.select(*NAMES, "label", "fold").mapInArrow(bins, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").toPandas()
    used = counted[counted.n > 0]
    levels = isotonic(used.n.to_numpy(), used.ones.to_numpy() / used.n.to_numpy())
    centres = (used.bin.to_numpy() + 0.5) * 2 / BINS - 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_matrix(batch)) @ weights
            # A thousandth of the raw score orders texts within a level.
            fit = 0.999 * np.interp(raw, centres, levels) + 0.001 * np.clip((raw + 1) / 3, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fit)], ["doc_id", "score"])

    out = measured.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
