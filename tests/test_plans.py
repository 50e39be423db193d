"""Plan shapes the scale design depends on, read from the physical plan."""

import re

from conftest import SF01
from pyspark.sql import functions as F
from starweave.operators.measures import event_order
from starweave.plans.registry import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schema(text: str, table: str) -> set[str]:
    m = re.search(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}\.parquet", text)
    assert m, f"no scan of {table}"
    return {c.split("#")[0] for c in m.group(1).split(",")}


def test_star_join_prunes_columns_and_has_no_window(spark):
    text = plan(QUERIES["star_join"](spark, SF01))
    assert read_schema(text, "lineitem") == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                             "l_extendedprice", "l_shipdate"}
    assert "Window" not in text
    assert "BroadcastExchange" in text or "SortMergeJoin" in text


def test_case_first_aggregates_before_the_cases_join(spark):
    text = plan(QUERIES["case_first"](spark, SF01))
    # The events are reduced per link key (partial aggregate under the first exchange) and the
    # orders join sits above that aggregate, not below it.
    lines = text.splitlines()
    scan = next(i for i, l in enumerate(lines) if "lineitem.parquet" in l)
    partial = max(i for i, l in enumerate(lines[:scan]) if "partial_min" in l)
    join = max(i for i, l in enumerate(lines[:partial]) if "Join" in l)
    assert join < partial < scan
    assert "Window" not in text


def test_event_order_shuffles_events_once(spark):
    text = plan(QUERIES["event_order"](spark, SF01))
    # No case of that table is long: one window over the case, one shuffle of the events.
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_long_cases_are_numbered_without_a_window_over_them(spark):
    log = spark.range(3000).select((F.col("id") % 3 == 0).alias("c"), F.col("id").alias("t"))
    text = plan(event_order(log, "c", ["t"], rows_per_slice=500))
    # Only cases that are not long go through a window over the case; the others were written in slices.
    assert "ReadSchema: struct<__case:boolean,__slice:int,__place:bigint>" in text and "LeftAnti" in text
    numbering = [w for w in re.findall(r"Window \[[^\n]*", text) if "row_number" in w]
    assert len(numbering) == 1


def test_audits_preaggregate_keys_before_anti_join(spark):
    text = plan(QUERIES["fk_orphans"](spark, SF01))
    lines = text.splitlines()
    anti = next(i for i, l in enumerate(lines) if "LeftAnti" in l)
    if "BroadcastHashJoin" in lines[anti]:
        # Catalyst pushes an anti join below the aggregate only when it can broadcast the
        # target: non-orphans are then dropped map-side, before any shuffle.
        assert any("partial_count" in l for l in lines[:anti])
    else:
        assert any("partial_count" in l for l in lines[anti:])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = plan(QUERIES["fk_orphans"](spark, SF01)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    anti = next(i for i, l in enumerate(big) if "LeftAnti" in l)
    assert "SortMergeJoin" in big[anti] and any("partial_count" in l for l in big[anti:])


def test_key_check_leaves_the_plan_alone(spark):
    text = plan(QUERIES["join_events_cases"](spark, SF01))
    assert "Union" not in text and "raise_error" not in text and "Window" not in text


def test_summary_reduces_pairs_before_the_cases_join(spark):
    lines = plan(QUERIES["activity_summary"](spark, SF01)).splitlines()
    scan = next(i for i, l in enumerate(lines) if "lineitem.parquet" in l)
    pairs = max(i for i, l in enumerate(lines[:scan]) if "partial_count(1)" in l)
    join = max(i for i, l in enumerate(lines[:pairs]) if "Join" in l and "LeftOuter" in l)
    assert join < pairs < scan
    assert "SortAggregate" not in "\n".join(lines[:scan])


def test_case_values_on_events_shuffles_events_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(QUERIES["case_attributes_on_events"](spark, SF01)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The event rows (event_id plus the link key) go straight from their scan into the join
    # shuffle: no join with the cases table on the event side.
    scan = next(i for i, l in enumerate(lines) if "FileScan parquet [event_id" in l and "ts" not in l.split("]")[0])
    exchange = max(i for i, l in enumerate(lines[:scan]) if "Exchange" in l)
    assert "hashpartitioning(coalesce(" in lines[exchange]
    assert not any("Join" in l for l in lines[exchange:scan])
    assert "Window" not in "\n".join(lines)


def test_counts_of_distinct_values_do_not_expand_rows(spark):
    for name in ("profile_columns", "display_attributes"):
        text = plan(QUERIES[name](spark, SF01))
        assert "Expand" not in text and "partial_count" in text


def test_display_counts_join_keys_not_events(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(QUERIES["display_attributes"](spark, SF01)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Between a join and an events scan below it, the events are reduced to their distinct keys.
    for scan in (i for i, l in enumerate(lines) if "events.parquet" in l):
        depth = lines[scan].index("FileScan")
        above = [l for l in lines[:scan] if len(l) - len(l.lstrip(" :+-")) < depth]
        last_join = max((i for i, l in enumerate(above) if "Join" in l), default=None)
        if last_join is not None and "user_id" in lines[scan]:
            assert any("HashAggregate(keys=" in l for l in above[last_join:])


def test_case_values_on_events_read_the_events_twice(spark, monkeypatch):
    from starweave.plans import eventlog

    written, real = [], eventlog.written
    monkeypatch.setattr(eventlog, "written", lambda df, label: written.append(plan(df)) or real(df, label))
    text = plan(QUERIES["case_attributes_on_events"](spark, SF01))
    assert len(written) == 1 and written[0].count("events.parquet") == 1 and text.count("events.parquet") == 1
