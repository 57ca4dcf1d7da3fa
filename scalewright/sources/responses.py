"""Response tables: (person_id LONG, item_id INT, x INT), a missing answer being NULL or an absent row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most items whose answers are aggregated side by side, a column each.
ITEMS_AT_ONCE = 32


def from_wide(df: DataFrame, person: str, items: list[str]) -> DataFrame:
    """A column per item to one row per answer; ``item_id`` is the position in ``items``."""
    long = df.select(F.col(f"`{person}`").cast("long").alias("person_id"), *[F.col(f"`{c}`").cast("int").alias(str(i)) for i, c in enumerate(items)])
    out = long.unpivot("person_id", [F.col(f"`{i}`") for i in range(len(items))], "item", "x")
    return out.select("person_id", F.col("item").cast("int").alias("item_id"), "x")


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses derived from orders: customers answer eight items, harder ones less often right.

    ``x`` is binary, ``xp`` counts up to 3.  A pair of customer and item that never occurs is missing.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    item = F.col("l_partkey") % 8
    right = F.when(F.col("l_quantity") > 20 + 4 * item, 1).otherwise(0)
    # Lines go to the join as item and answer, which take a fraction of the room of part and quantity.
    answers = lines.select("l_orderkey", item.cast("int").alias("item_id"), right.alias("right"))
    # Orders are a hash table per partition, so neither side is sorted; the sorts spilled where lines are many.
    return (
        answers.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("person_id"), "item_id")
        .agg(F.max("right").cast("int").alias("x"), F.least(F.lit(3), F.sum("right")).cast("int").alias("xp"))
    )


def packed(responses: DataFrame, n_items: int, value: str = "x") -> DataFrame:
    """(person_id, x ARRAY<INT>): one element per item in order, NULL where the answer is missing.

    Of rows repeated under one person and item the largest answer counts.  One shuffle serves both groupings.
    """
    if n_items <= ITEMS_AT_ONCE:
        answers = [F.max(F.when(F.col("item_id") == i, F.col(value))) for i in range(n_items)]
        return responses.where(F.col(value).isNotNull()).groupBy("person_id").agg(F.array(*answers).alias("x"))
    by_person = responses.where(F.col(value).isNotNull()).select("person_id", "item_id", value).repartition("person_id")
    once = by_person.groupBy("person_id", "item_id").agg(F.max(value).alias(value))
    lists = once.groupBy("person_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", value))).alias("m"))
    return lists.select("person_id", F.transform(F.sequence(F.lit(0), F.lit(n_items - 1)), lambda i: F.col("m")[i]).alias("x"))
