"""Role-driven measures: durations, event order, activity and resource summaries (M1–M4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import quote
from ..session import scratch_path


def durations(log: DataFrame, case: str, start: str, end: str | None = None) -> DataFrame:
    """Per case: ``n_events``, ``first_start`` (min start), ``last_end`` (max end) and
    ``seconds`` between them (negative when the end comes first; kept as is)."""
    end = end or start
    agg = log.groupBy(F.col(quote(case))).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(F.col(quote(start))).alias("first_start"),
        F.max(F.col(quote(end))).alias("last_end"),
    )
    return add_seconds(agg, "first_start", "last_end")


def add_seconds(df: DataFrame, start: str, end: str, name: str = "seconds") -> DataFrame:
    """``df`` with the whole seconds from ``start`` to ``end`` (negative when end comes first)."""
    return df.withColumn(name, F.timestamp_diff("SECOND", F.col(quote(start)), F.col(quote(end))))


def event_durations(log: DataFrame, start: str, end: str) -> DataFrame:
    """Each event with ``seconds`` from its start to its end."""
    return log.withColumn("seconds", F.timestamp_diff("SECOND", F.col(quote(start)), F.col(quote(end))))


def summarize(log: DataFrame, key: str, case: str, name: str | None = None) -> DataFrame:
    """Per activity (or resource): ``n_events`` and ``n_cases`` (distinct non-null cases)."""
    return log.groupBy(F.col(quote(key)).alias(name or key)).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct(F.col(quote(case))).alias("n_cases"),
    )


def event_order(log: DataFrame, case: str, order: Sequence[str], name: str = "n",
                rows_per_slice: int = 100_000) -> DataFrame:
    """Position of each event inside its case, 1-based, in DEC-3 order (M2).

    ``row_number() over (partition by case order by ...)`` hands a whole case to one task. That is what
    happens to cases of up to ``rows_per_slice`` events. Longer ones are found first, by a count over
    narrow rows (an action when the order is built), and cut by rank: their events are dealt by range of
    (case, order columns), whose boundaries Spark takes from a sample of the rows themselves. So slices
    are even whatever the values are: an outlier moves no boundary, and events that share a leading
    value are cut on the next order columns. Each slice is sorted and numbered, and written once in the
    shared scratch folder, which fixes slices and numbers for all that follows; a slice's events start
    after the case's events in earlier slices, known from one row per (slice, case).

    Columns of any type that can be sorted can lead the order, nulls first. The order must be total
    within a case (give tiebreak columns); with ties the numbering of tied rows is arbitrary, as with
    ``row_number``, and only rows that tie in all of it stay in one slice.
    """
    if not order:
        raise ValueError("event_order needs order columns")
    by = [F.col(quote(c)) for c in order]
    columns = [F.col(quote(c)) for c in log.columns]
    rows = log.select(*columns, F.col(quote(case)).alias("__case"))  # events without a case are one case
    position = F.row_number().over(Window.partitionBy("__case").orderBy(*by)).cast("bigint")
    spark = log.sparkSession
    sizes = rows.groupBy("__case").agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > rows_per_slice)
    total = sizes.agg(F.sum("__size")).first()[0]
    if total is None:
        return rows.select(*columns, position.alias(name))
    path = scratch_path(spark, "long-cases")
    sizes.write.parquet(path)
    # Cases of more than ``rows_per_slice`` events: as many rows as the log has slices, at most.
    long_cases = spark.read.schema(sizes.schema).parquet(path).select(F.col("__case").alias("__long"))
    is_long = F.col("__case").eqNullSafe(F.col("__long"))
    slices = slice_rows(rows.join(long_cases, is_long, "left_semi"), by, int(total), rows_per_slice)
    # The number in the file order is the slice in the upper bits and the place in it in the lower ones.
    firsts = slices.groupBy("__slice", "__case").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy("__case").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.select(F.col("__slice").alias("__s"), F.col("__case").alias("__c"),
                           (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    here = (F.col("__slice") == F.col("__s")) & F.col("__case").eqNullSafe(F.col("__c"))
    numbered = slices.join(starts, here).select(*columns, (F.col("__place") + F.col("__shift")).alias(name))
    short = rows.join(long_cases, is_long, "left_anti").select(*columns, position.alias(name))
    return short.unionByName(numbered)


def slice_rows(rows: DataFrame, by: Sequence[Column], total: int, rows_per_slice: int) -> DataFrame:
    """The rows of long cases with ``__slice`` and ``__place``: ranges of (case, order), sorted, written once.

    Ranges come from a sample, so they are cut for three quarters of ``rows_per_slice``.
    """
    spark = rows.sparkSession
    count = max(2, -(-4 * total // (3 * rows_per_slice)))
    placed = rows.repartitionByRange(count, "__case", *by).sortWithinPartitions("__case", *by) \
        .select("*", F.monotonically_increasing_id().alias("__id"))
    out = placed.select(*[c for c in placed.columns if c != "__id"], F.shiftright("__id", 33).cast("int").alias("__slice"),
                        F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    path = scratch_path(spark, "slices")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
