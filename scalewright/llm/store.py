"""Intermediate tables in the folder that driver and executors share.

Writing a table cuts the lineage: an executor that is lost later costs a re-read of a file,
not a recomputation of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
#: Narrow rows that a file of a small table should hold at least.
ROWS_PER_FILE = 1 << 16
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster's executors wouldn't share one, so
    there it is an error.
    """
    folder = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SHARED_DIR} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="scalewright-")
        spark.conf.set(SHARED_DIR, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``rows``, a bound on the rows of a table that is cheap to make, keeps it from being written as many tiny
    files.  The tables stay, since what an operator returns reads them; whoever owns the folder clears it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks of the actions inside get at most ``rows`` rows at once, which bounds memory where rows are wide."""
    before = spark.conf.get(BATCH_ROWS, None)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_ROWS)
        else:
            spark.conf.set(BATCH_ROWS, before)
