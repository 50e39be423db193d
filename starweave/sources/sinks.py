"""Event-log sinks: Parquet, optionally partitioned, and a log laid out by case with a manifest."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import quote


def write_log(df: DataFrame, path: str, partition_by: list[str] | tuple[str, ...] | None = None,
              mode: str = "errorifexists", max_records_per_file: int | None = None) -> None:
    """Write ``df`` to ``path`` as Parquet.

    The write is one distributed job; each task writes its own files, and the commit protocol
    makes a retried or lost task invisible. ``partition_by`` lays the output out by low-
    cardinality columns (for example an activity or a date) so later reads prune folders.
    ``max_records_per_file`` bounds file size when one partition value holds most rows.
    """
    writer = df.write.mode(mode)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_clustered_log(df: DataFrame, path: str, case: str, order: Sequence[str], buckets: int) -> None:
    """Write ``df`` laid out by case, for ``read_clustered_log``: one shuffle now, none for what follows.

    ``path/data`` holds ``buckets`` files: a case is in one of them, by the hash that Spark itself deals
    by, and its events lie together in ``order``. ``path/layout`` says how, and ``path/manifest`` has a row per file: its name, smallest
    and largest case, cases and events. A case that holds most events makes one large file; results that
    reduce it stay cheap, ``event_order`` cuts it by rank.
    """
    if "`" in case or not order:
        raise ValueError("a clustered log needs a case column without backticks and an order")
    spark = df.sparkSession
    keys = [case, *[c for c in order if c != case]]
    name = f"sw_clustered_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, F.col(quote(case)))
    try:
        dealt.write.format("parquet").option("path", f"{path}/data").bucketBy(buckets, case).sortBy(*keys).saveAsTable(name)
        layout = json.dumps({"case": case, "keys": keys, "buckets": buckets, "schema": df.schema.json()})
        column = F.col(quote(case))
        files = spark.read.table(name).groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(column).cast("string").alias("first_case"), F.max(column).cast("string").alias("last_case"),
            (F.count_distinct(column) + F.max(column.isNull().cast("int"))).alias("n_cases"), F.count(F.lit(1)).alias("n_events"))
        files.write.parquet(f"{path}/manifest")
        spark.createDataFrame([(layout,)], "layout string").write.parquet(f"{path}/layout")
    finally:
        spark.sql(f"drop table if exists {name}")  # the files stay: the table only described them


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a clustered log: file, first_case, last_case, n_cases, n_events."""
    return spark.read.schema("file string, first_case string, last_case string, n_cases bigint, n_events bigint") \
        .parquet(f"{path}/manifest")


def read_clustered_log(spark: SparkSession, path: str) -> DataFrame:
    """The log at ``path``; grouping, ordering or joining it by case moves no events.

    The layout is declared as a bucketed table of the session's catalog, under a name that follows from
    the path.
    """
    found = spark.read.parquet(f"{path}/layout").first().layout
    layout = json.loads(found)
    name = "sw_log_" + hashlib.sha256(f"{path} {found}".encode()).hexdigest()[:32]
    fields = ", ".join(f"{quote(f['name'])} {_sql_type(f['type'])}" for f in json.loads(layout["schema"])["fields"])
    keys = ", ".join(map(quote, layout["keys"]))
    spark.sql(f"create table if not exists {name} ({fields}) using parquet clustered by ({quote(layout['case'])}) "
              f"sorted by ({keys}) into {layout['buckets']} buckets location '{path}/data'")
    return spark.read.table(name)


def _sql_type(kind) -> str:
    from pyspark.sql.types import StructType

    field = {"type": "struct", "fields": [{"name": "c", "type": kind, "nullable": True, "metadata": {}}]}
    return StructType.fromJson(field).fields[0].dataType.simpleString()
