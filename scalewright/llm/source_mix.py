"""Mixing sources to target weights.

Tokens are aggregated per source, each source gets a target and from it a repetition rate, and every
document is emitted floor(rate) times plus one more time with a probability equal to the fraction.

The extra copy is a Bernoulli draw by a hash of seed and id, so a rerun takes the same documents.  Few long
documents hold much of a source, and independent draws would miss its target by tens of percent.  So the
draws are balanced: documents of a source are put in classes of like size, and in each class the hash has to
be below a threshold at which the count drawn is the fraction of the class, what rounding leaves being
carried from longer to shorter classes.  Thresholds come from counts per (source, class, hash slot), so no
task or driver ever sees the documents of a source together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .text import words

#: Weights that the sources take in turn, in code point order of their names, null last.
WEIGHTS = (5, 2, 1)
#: What all sources share, in hundredths of the corpus, and the most that one takes, in times its size.
SHARE_PERCENT, MOST_TIMES = 150, 2
SEED = "mix-1"
#: Size classes for each doubling of the size, and hash slots in which documents of a class are counted.
CLASSES_PER_DOUBLING, SLOTS = 4, 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, size).

    A source is full at ``most_times`` its size; what it can't take is shared again by weight.  The
    windows run over one row per source, never over documents.  Sources of size 0 have target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long")).withColumn("cap", F.col("source_size") * most_times)
    # In the order in which rising shares fill them up, a source is full if its equal share of the rest reaches its cap.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = (
        per.withColumn("before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.col("cap") * F.col("open_weight") * 100 <= F.col("weight") * (F.col("total") * share_percent - F.col("before") * 100))
        .withColumn("taken", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("shared", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    )
    share = F.col("weight") * (F.col("total") * share_percent - F.col("taken") * 100) / (F.col("shared") * 100)
    return per.select("source", "source_size", "weight", F.round(F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share), 6).alias("target"))


def hash_unit(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**12))


def _size_class(size: Column) -> Column:
    return F.floor(F.log2(size + 1) * CLASSES_PER_DOUBLING).cast("int")


def _slot(doc_id: Column, seed: str) -> Column:
    return F.floor(hash_unit(doc_id, seed) * SLOTS).cast("int")


def _lean(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"))
    return sized.withColumn("size_class", _size_class(F.col("size"))).withColumn("slot", _slot(F.col("doc_id"), seed))


def draw_thresholds(lean: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, class, whole, below, source_size, target): a row takes ``whole`` copies, and one more if its slot is less than ``below``."""
    counts = saved(lean.groupBy("source", "size_class", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-slots", lean.count())
    classes = counts.groupBy("source", "size_class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    per_source = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("size_class"), F.col("n"), F.col("words"))), asc=False).alias("classes"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = per_source.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate"))
    # At most CLASSES_PER_DOUBLING x 63 elements: what a class leaves over or takes too much is carried on.
    fold = """aggregate(classes, cast((0D, array()) as struct<carry: double, drawn: array<struct<size_class: int, quota: bigint>>>), (s, c) ->
        transform(array(struct(s, c, case when c.words = 0 then cast(round(fraction * c.n) as bigint)
            else least(c.n, greatest(0L, cast(round((fraction * c.words + s.carry) * c.n / c.words) as bigint))) end as quota)),
            x -> cast((x.s.carry + fraction * x.c.words - x.quota * x.c.words / x.c.n, concat(x.s.drawn, array(struct(x.c.size_class as size_class, x.quota as quota))))
                as struct<carry: double, drawn: array<struct<size_class: int, quota: bigint>>>))[0]).drawn"""
    quotas = per_source.withColumn("d", F.explode(F.expr(fold))).select("name", F.col("d.size_class").alias("class"), F.col("d.quota").alias("quota"), F.floor("rate").cast("int").alias("whole"), "source_size", "target")
    running = F.sum("n").over(Window.partitionBy("source", "size_class").orderBy("slot"))
    reached = counts.withColumn("running", running).join(quotas, F.col("source").eqNullSafe(F.col("name")) & (F.col("size_class") == F.col("class")))
    return reached.groupBy("name", "class", "whole", "source_size", "target").agg(F.coalesce(F.min(F.when(F.col("running") > F.col("quota"), F.col("slot"))), F.lit(SLOTS)).alias("below"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Size is the number of words (null: 0).  A null source is a source of its own.  Rows repeated under
    one id and size are decided alike.  A document in a source without words is taken 0 times.
    """
    lean = saved(_lean(docs, doc_id, text, source, seed), "mix-sizes")
    draws = saved(draw_thresholds(lean, source_targets(lean)), "mix-draws", lean.count())
    here = F.col("source").eqNullSafe(F.col("name")) & (F.col("size_class") == F.col("class"))
    copies = F.col("whole") + (F.col("slot") < F.col("below")).cast("int")
    return lean.join(draws, here).withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` with every row repeated as often as ``mixed`` takes it, all columns kept."""
    lean = saved(_lean(docs, doc_id, text, source, seed), "mix-sizes")
    draws = saved(draw_thresholds(lean, source_targets(lean)), "mix-draws", lean.count())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("size_class", _size_class(F.size(words(F.col("row").getField(text))))).withColumn("slot", _slot(F.col("row").getField(doc_id), seed))
    joined = row.join(draws, F.col("row").getField(source).eqNullSafe(F.col("name")) & (F.col("size_class") == F.col("class")))
    copies = F.col("whole") + (F.col("slot") < F.col("below")).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
