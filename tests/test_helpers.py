"""Helpers not covered by the oracle queries."""

from pyspark.sql import functions as F

import golden
from conftest import SF01
from starweave.functions.types import fill_defaults
from starweave.operators.audit import profile_columns
from starweave.operators.measures import event_durations, summarize
from starweave.operators.project import display_attributes, role_projection
from starweave.plans import eventlog


def test_fill_defaults_typed_and_empty(spark):
    df = spark.sql("select cast(null as bigint) a, cast(null as string) b, cast(null as double) c, 5L d")
    out = fill_defaults(df, {"a": ("-1", "Integer"), "b": ("none", "String"), "c": ("", "Float"),
                             "d": ("9", "Integer")}).first()
    assert out["a"] == -1 and out["b"] == "none" and out["c"] is None and out["d"] == 5


def test_profile_columns_approximate_is_close(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    exact = {r["column_name"]: r for r in profile_columns(orders, exact=True).collect()}
    approx = {r["column_name"]: r for r in profile_columns(orders, exact=False, rsd=0.01).collect()}
    assert set(exact) == set(approx) == set(orders.columns)
    for name, r in exact.items():
        assert approx[name]["n_rows"] == r["n_rows"] and approx[name]["n_nulls"] == r["n_nulls"]
        assert abs(approx[name]["n_distinct"] - r["n_distinct"]) <= 0.03 * r["n_distinct"] + 1  # 3 x rsd
    assert exact["o_orderstatus"]["family"] == "string" and exact["o_orderdate"]["family"] == "timestamp"


def test_role_projection_with_end_and_durations(spark):
    spec = golden.spec()
    log = eventlog.event_log(spec, golden.frames(spark))
    roles = role_projection(log, spec.roles(), keep=["EventCost"])
    assert roles.columns == ["case_id", "activity", "start_ts", "end_ts", "resource", "EventCost"]
    secs = {r["EventCost"]: r["seconds"] for r in event_durations(log, "StartTimestamp", "EndTimestamp").collect()}
    assert secs == {5.0: 1800, 2.5: 900, 1.0: 300, 4.0: 600}


def test_summarize_counts_distinct_cases(spark):
    spec = golden.spec()
    log = eventlog.event_log(spec, golden.frames(spark))
    got = {r["activity"]: (r["n_events"], r["n_cases"]) for r in summarize(log, "Activity", "CaseID", "activity").collect()}
    assert got == {"Create": (2, 2), "Approve": (1, 1), None: (1, 0)}


def test_display_attributes_without_flags_is_empty(spark):
    log = eventlog.event_log(golden.spec(), golden.frames(spark))
    assert display_attributes(log).count() == 0
    flagged = log.withColumn("Region", F.col("Region").alias("Region", metadata={"display": True}))
    assert [tuple(r) for r in display_attributes(flagged).collect()] == [("Region", 2)]


def test_event_log_metadata_carries_roles_and_flags(spark):
    log = eventlog.event_log(golden.spec(), golden.frames(spark))
    meta = {f.name: f.metadata for f in log.schema.fields}
    assert meta["CaseID"]["import_type"] == "Case" and meta["CaseID"]["level"] == "Case"
    assert meta["EventCost"]["finance"] == "PerEvent"
    assert meta["Activity"]["case_handling"] == "First" and meta["Activity"]["display"] is False


def test_summary_fallback_paths_match_log_grouping(spark):
    from starweave.operators.measures import summarize
    from starweave.plans import stars

    spec, src = stars.clicks_spec(), stars.clicks_sources(spark, SF01)
    got = eventlog.summary(spec, src, "c_mktsegment", "segment")      # key on the cases side
    want = summarize(eventlog.event_log(spec, src), "c_mktsegment", "c_custkey", "segment")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    flat = stars.clicks_flat_spec()
    ev = {"events": src["events"]}
    got = eventlog.summary(flat, ev, "event_type")                     # no cases dataset
    want = summarize(eventlog.event_log(flat, ev), "event_type", "user_id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 5
