"""The star join over a stream of events (stream-static left joins).

Every dimension stays a static DataFrame; only the events dataset is a stream. A left join
with the stream on the left keeps no state, so the query runs with constant memory however
long it lives. The key check of the static sides runs once, as its own batch job, before the
stream starts.

Case-level results need all events of a case, which no micro-batch has. ``start_group_partials``
writes, per micro-batch, each key's *partial* results (counts, minima, maxima, First/Last packs,
sums) to Parquet, one folder per epoch, overwritten if the epoch is replayed; the stream holds
no per-case state. ``group_from_partials`` merges all epochs per key and finishes the
reduction in batch, exactly as ``plans.eventlog.group_aggregate`` does over the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.project import apply_attributes
from ..operators.star import check_unique_keys, far_parts, split_parts, star_join
from ..plans import eventlog
from ..plans.spec import ImportSpec, SpecError
from ..session import scratch_path


def stream_event_log(spec: ImportSpec, events_stream: DataFrame, static_sources: Mapping[str, DataFrame],
                     check_keys: bool | None = None,
                     columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """A streaming event log: the star join plus attribute types and defaults."""
    if not events_stream.isStreaming:
        raise SpecError("events_stream must be a streaming DataFrame (spark.readStream...)")
    streaming_statics = [n for n, df in static_sources.items() if df.isStreaming]
    if streaming_statics:
        raise SpecError(f"only the events dataset may be a stream, not {streaming_statics}")
    sources = {**static_sources, spec.events.name: events_stream}
    star = star_join(spec, sources, check_keys, columns)
    present = set(star.columns)
    attrs = [a for a in spec.attributes if a.name in present and not a.is_excluded]
    out = apply_attributes(star, attrs, drop_excluded=False)
    excluded = [a.name for a in spec.attributes if a.is_excluded and a.name in present]
    return out.drop(*excluded)


def start_log_stream(log: DataFrame, path: str, checkpoint: str | None = None,
                     partition_by: list[str] | None = None, available_now: bool = False,
                     processing_time: str | None = None) -> StreamingQuery:
    """Append the streaming log to Parquet at ``path``.

    The checkpoint defaults to a fresh folder under the session's shared checkpoint dir, so a
    restarted driver or lost executor resumes from the last committed micro-batch.
    """
    spark = log.sparkSession
    writer = log.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def start_group_partials(spec: ImportSpec, events_stream: DataFrame, static_sources: Mapping[str, DataFrame],
                         path: str, group: str | None = None, *, check_keys: bool | None = None,
                         checkpoint: str | None = None, available_now: bool = False,
                         processing_time: str | None = None, **measures) -> StreamingQuery:
    """Stream the per-key partial results of ``group_aggregate`` into ``path``.

    ``group`` defaults to the Case attribute; ``measures`` are ``group_aggregate``'s ``rules``,
    ``mins``, ``maxs``, ``sums``, ``count`` and ``order``. Each micro-batch is reduced per key
    of the edge that supplies the group (or per group value when the events hold it) and
    written under ``__epoch=<id>`` with dynamic partition overwrite, so a replayed epoch
    replaces its own output and nothing is counted twice.
    """
    if not events_stream.isStreaming:
        raise SpecError("events_stream must be a streaming DataFrame (spark.readStream...)")
    plan = eventlog.group_plan(spec, group or spec.roles().case, **measures)
    ev_name = spec.events.name
    if spec.check_keys if check_keys is None else check_keys:
        check_unique_keys(spec, static_sources)  # once, before the stream starts

    def write_batch(batch: DataFrame, epoch: int) -> None:
        sources = {**static_sources, ev_name: batch}
        if plan.edge is None:
            near = eventlog.attributed(spec, sources, check_keys=False, columns=plan.needed)
            per_key = eventlog.key_partials(spec, plan, near, plan.group)
        else:
            parts = split_parts(spec, sources, plan.needed, plan.edge, check_keys=False)
            per_key = eventlog.key_partials(spec, plan, parts.near, parts.near_key, parts.far_columns)
        (per_key.withColumn("__epoch", F.lit(int(epoch)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("__epoch").parquet(path))

    spark = events_stream.sparkSession
    writer = events_stream.writeStream.foreachBatch(write_batch).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "partials-ckpt"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def group_from_partials(spec: ImportSpec, static_sources: Mapping[str, DataFrame], path: str,
                        group: str | None = None, *, check_keys: bool | None = None,
                        spark: SparkSession | None = None, **measures) -> DataFrame:
    """Finish ``group_aggregate`` from the partials that ``start_group_partials`` wrote."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise SpecError("no active Spark session; pass spark=")
    plan = eventlog.group_plan(spec, group or spec.roles().case, **measures)
    per_key = eventlog.merge_partials(spark.read.parquet(path))
    if plan.edge is None:
        return eventlog.finish_group(spec, plan, per_key)
    far, far_key, far_columns = far_parts(spec, static_sources, plan.needed, plan.edge, check_keys)
    return eventlog.finish_group(spec, plan, per_key, far, far_key, far_columns)


def start_case_table_partials(spec: ImportSpec, events_stream: DataFrame, static_sources: Mapping[str, DataFrame],
                              path: str, **options) -> StreamingQuery:
    """``start_group_partials`` with the case table's reductions."""
    return start_group_partials(spec, events_stream, static_sources, path, **options,
                                **eventlog.case_table_measures(spec))


def case_table_from_partials(spec: ImportSpec, static_sources: Mapping[str, DataFrame], path: str,
                             check_keys: bool | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The case table (as ``plans.eventlog.case_table``) from streamed partials."""
    out = group_from_partials(spec, static_sources, path, check_keys=check_keys, spark=spark,
                              **eventlog.case_table_measures(spec))
    return eventlog.drop_excluded_case_columns(spec, out)
