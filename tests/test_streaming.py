"""The star join with events read as a stream: same rows as the batch star join."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from starweave.plans import eventlog, stars
from starweave.plans.spec import SpecError
from starweave.session import scratch_path
from starweave.streaming.events import start_log_stream, stream_event_log


def test_stream_matches_batch(spark):
    spec = stars.clicks_spec()
    static = stars.clicks_sources(spark, SF01)
    events_path = f"{SF01}/events.parquet"
    schema = spark.read.parquet(events_path).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "events.parquet").parquet(SF01))
    log = stream_event_log(spec, stream, {k: v for k, v in static.items() if k != "events"})
    out = scratch_path(spark, "stream-out")
    q = start_log_stream(log, out, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out)
    want = eventlog.event_log(spec, static)
    cols = ["event_id", "event_type", "c_custkey", "n_name", "c_mktsegment"]
    assert got.count() == want.count()
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0


def test_stream_rejects_duplicate_static_keys(spark):
    spec = stars.clicks_spec()
    static = stars.clicks_sources(spark, SF01)
    nation = static["nation"]
    dup = nation.union(nation.filter(F.col("n_nationkey") == 3))
    schema = static["events"].schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF01)
    with pytest.raises(Exception, match="duplicate key in nation.n_nationkey: 3"):
        stream_event_log(spec, stream, {"customer": static["customer"], "nation": dup})


def test_stream_requires_streaming_events(spark):
    static = stars.clicks_sources(spark, SF01)
    with pytest.raises(SpecError):
        stream_event_log(stars.clicks_spec(), static["events"], static)


def _split_events(spark, parts=4):
    """The events table rewritten as several files, so a stream sees several micro-batches."""
    path = scratch_path(spark, "events-files")
    spark.read.parquet(f"{SF01}/events.parquet").repartition(parts).write.parquet(path)
    return path


@pytest.mark.parametrize("star", ["clicks", "clicks_flat"])
def test_streamed_case_table_matches_batch(spark, star):
    from starweave.streaming.events import case_table_from_partials, start_case_table_partials

    spec = stars.clicks_spec() if star == "clicks" else stars.clicks_flat_spec()
    static = stars.clicks_sources(spark, SF01)
    static.pop("events")
    if star == "clicks_flat":
        static = {}
    src_dir = _split_events(spark)
    schema = spark.read.parquet(src_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src_dir)
    out = scratch_path(spark, "partials")
    q = start_case_table_partials(spec, stream, static, out, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    epochs = {r[0] for r in spark.read.parquet(out).select("__epoch").distinct().collect()}
    assert len(epochs) >= 2
    sources = {**static, "events": spark.read.parquet(f"{SF01}/events.parquet")}
    got = case_table_from_partials(spec, static, out, spark=spark)
    want = eventlog.case_table(spec, sources)
    assert got.columns == want.columns
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
