"""A training-data pipeline over ``documents``: each stage applies one operator to all that the last one kept.

Stages return the columns of ``documents``; the last returns packed pieces. Rejected documents and
near copies go; repeated passages and secrets are taken out of the texts (``n_chars`` follows).
Null texts count as empty and fail the quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import stored
from starweave.llm.minhash import keep_one_of_each
from starweave.llm.packing import pack
from starweave.llm.quality import quality_filter
from starweave.llm.secret_scan import redact
from starweave.llm.suffix_dedup import remove_repeats

NEAR_PERCENT = 80  # similarity of near copies; 85 is the contract of the query op3 alone


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return keep_one_of_each(docs, min_percent=NEAR_PERCENT)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 100-byte strings that also start earlier."""
    return _counted(remove_repeats(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every reported secret masked."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its sequence and place."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("suffix_array", suffix_array),
          ("secret_scans", secret_scans), ("packing", packing)]
ORACLE_SQL = None  # suffix-array removal and packing are not SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the kept rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
