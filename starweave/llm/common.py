"""Helpers shared by the operators: fresh column names, scratch tables, unique row order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.session import scratch_path

#: Bytes that separate words: space and 0x09 to 0x0D. ``bytes.split()`` splits on exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def quoted(name: str) -> str:
    """A column name as a SQL identifier (dots and backticks allowed)."""
    return "`" + name.replace("`", "``") + "`"


def col(df: DataFrame, name: str):
    return df[quoted(name)]


def fresh(taken: Iterable[str], label: str) -> str:
    """A column name that is not taken (Spark compares names without case)."""
    used = {t.lower() for t in taken}
    name, n = f"__{label}", 0
    while name.lower() in used:
        n += 1
        name = f"__{label}{n}"
    return name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    It cuts lineage: a lost executor costs one stage over this table, not the steps before it. The
    shuffle files of the write go as soon as the table is there, since nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, under fixed names, so that extra columns cannot clash."""
    cols = [col(df, id_col).cast("long").alias("doc_id"), col(df, text_col).cast("string").alias("text")]
    return df.select(*cols, *(col(df, c).alias(c) for c in more))


def fold(docs: DataFrame, modulus: int, remainder: int) -> F.Column:
    """crc32(doc_id as text) mod ``modulus`` equals ``remainder``; a null id is in no fold."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % modulus == remainder, F.lit(False))
