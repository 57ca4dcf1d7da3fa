"""Dealing small tables with costly keys over tasks.

A replicate or a block of sub-matrices is a few rows and seconds of work.  By its size alone such a table would be
merged into one task, and a hash of few keys would leave tasks empty.  Here a key's number says in which task it goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Most tasks of a fan-out; further keys share them in turn.
MOST_TASKS = 512
#: Lets adaptive execution merge the partitions of a table that is held.
MERGES = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def per_key(df: DataFrame, key: str, n_keys: int, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, number: Column | None = None) -> DataFrame:
    """``run`` of the rows of every key, as ``applyInPandas`` does, each of up to MOST_TASKS keys in a task of its own.

    ``number`` counts the keys from 0 on; it defaults to the key.  ``n_keys`` only sets how many tasks there are.
    """
    tasks = max(1, min(n_keys, MOST_TASKS))
    slot = F.pmod(F.col(key) if number is None else number, F.lit(tasks)).cast("int")
    return df.withColumn("_slot", slot).repartitionById(tasks, F.col("_slot")).groupBy("_slot", key).applyInPandas(lambda group: run(group.drop(columns="_slot")), schema)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df``, held while its rows are used several times; one that is held already stays so.

    It may be held in as few partitions as its size asks for: otherwise a small table stays in as many as a shuffle has, and
    every step that reads it pays for a task, and mostly a Python call, per handful of rows.
    """
    if df.storageLevel != StorageLevel.NONE:
        yield df
        return
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(MERGES)
    conf.set(MERGES, "true")
    try:
        df = df.persist()
    finally:
        conf.set(MERGES, before)
    try:
        yield df
    finally:
        df.unpersist()
