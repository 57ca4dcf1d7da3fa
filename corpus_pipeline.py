"""The corpus pipeline: quality rules, exact dedup, near-dedup, source mix, tokens.

Every stage gets the table that the stage before it wrote, works on all of its rows, and returns the columns
of ``documents``; the last one returns a row of token digests per document of the mix.  Other columns are carried
along under any name, and a stage over an empty table returns an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scalewright.llm import byte_bpe, divergence_rules, order_minhash, quotient_dedup, registry, source_mix
from scalewright.llm.store import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Null, empty and blank texts go; repeated rows are judged alike."""
    return divergence_rules.kept_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: most code points, then smallest id.

    Null and empty texts are one group.  A row without an id loses; of rows repeated under one id, one stays.
    """
    return quotient_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each class of near copies.

    Texts without words and rows without an id are classes of their own; of rows repeated under one id and
    text, one stays.
    """
    return order_minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.  A null source is a source; one without words is taken 0 times."""
    return source_mix.mixture(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token digests per row; null and empty texts have no ids, repeated rows are encoded each."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(registry.RANK_FILE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]

#: Near-dedup, the balanced draws and the merges have no SQL form; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
