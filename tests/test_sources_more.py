"""Clustered logs, folders of several schemas, rejected CSV lines, cast losses."""

import golden
import pytest
from conftest import SF001
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starweave.functions.types import cast_losses
from starweave.operators import cases, measures
from starweave.plans import eventlog, stars
from starweave.session import scratch_path
from starweave.sources.folders import folder_files, read_csv_checked, united_schema, wider
from starweave.sources.readers import read_dataset
from starweave.sources.sinks import read_clustered_log, read_manifest, write_clustered_log


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clustered(spark):
    ev = stars.table(spark, SF001, "events").withColumn("user_id", F.when(F.col("event_id") % 9 > 0, F.col("user_id")))
    path = scratch_path(spark, "clustered")
    write_clustered_log(ev, path, "user_id", ["ts", "event_id"], 6)
    return ev, path


def test_clustered_log_moves_no_events(spark, clustered):
    ev, path = clustered
    log = read_clustered_log(spark, path)
    assert log.schema == ev.schema and log.exceptAll(ev).count() == 0 and log.count() == ev.count()
    rules = {"first": ("event_type", "First"), "last": ("event_type", "Last")}
    order = ["ts", "event_id"]
    table = cases.case_table(log, "user_id", order, rules, start="ts")
    numbered = measures.event_order(log, "user_id", order)
    for df in (cases.case_values(log, "user_id", order, rules), table, numbered):
        assert "Exchange" not in plan(df)
    assert table.exceptAll(cases.case_table(ev, "user_id", order, rules, start="ts")).count() == 0
    want = ev.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("bigint"))
    assert numbered.exceptAll(want).count() == 0


def test_manifest_has_every_file(spark, clustered):
    ev, path = clustered
    rows = read_manifest(spark, path).collect()
    assert sum(r.n_events for r in rows) == ev.count() and len(rows) <= 6
    assert sum(r.n_cases for r in rows) == ev.select("user_id").distinct().count()
    known = [int(c) for r in rows for c in (r.first_case, r.last_case) if c is not None]
    assert min(known) == ev.agg(F.min("user_id")).first()[0] and max(known) == ev.agg(F.max("user_id")).first()[0]


def test_clustered_log_of_no_events(spark):
    path = scratch_path(spark, "clustered-empty")
    write_clustered_log(golden.frames(spark)["events"].limit(0), path, "CaseID", ["StartTimestamp"], 3)
    assert read_clustered_log(spark, path).count() == 0


def test_wider_types():
    i, l, f, d, s = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType()
    assert wider(i, l) == wider(l, i) == l and wider(f, i) == d and wider(f, d) == d and wider(i, s) == s
    assert wider(T.DecimalType(10, 2), i) == T.DecimalType(12, 2) and wider(T.DecimalType(38, 2), T.DecimalType(38, 10)) == d
    assert wider(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType() and wider(T.NullType(), i) == i
    assert wider(T.BooleanType(), i) == s and wider(T.ArrayType(i), i) == s
    both = united_schema([T.StructType().add("A", i).add("b", s), T.StructType().add("a", l).add("c", d)])
    assert [(x.name, x.dataType) for x in both.fields] == [("A", l), ("b", s), ("c", d)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_folder_of_several_schemas(spark, fmt):
    root = scratch_path(spark, "mixed")
    save = lambda df, p: df.coalesce(1).write.format(fmt).option("header", "true").save(f"{root}/{p}")
    save(spark.range(3).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("name")), "a")
    save(spark.range(3, 6).select(F.lit(2.5).alias("price"), (F.col("id") + 5_000_000_000).alias("id")), "b/c")
    save(spark.range(6, 8).select(F.col("id").cast("int").alias("id"), F.lit("y").alias("name")), "d")
    save(spark.range(9).withColumn("name", F.lit("no")), "_hidden")
    df = read_dataset(spark, root, fmt, recursive=True)
    rows = {(r.id, r.name, r.price) for r in df.collect()}
    assert rows == {(0, "x", None), (1, "x", None), (2, "x", None), (6, "y", None), (7, "y", None),
                    *((5_000_000_000 + i, None, 2.5) for i in (3, 4, 5))}
    assert df.count() == 8 and len(folder_files(spark, root, fmt)) == 3


def test_partition_folders_of_several_schemas(spark):
    root = scratch_path(spark, "mixed-parts")
    spark.range(2).select(F.col("id").cast("int").alias("id")).write.parquet(f"{root}/day=1")
    spark.range(2).select(F.col("id")).write.parquet(f"{root}/day=2")
    df = read_dataset(spark, root, "parquet", recursive=True)
    assert sorted((r.id, r.day) for r in df.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_rejected_lines(spark):
    root = scratch_path(spark, "bad-csv")
    spark.createDataFrame([("id,name,price",), ("1,a,2.5",), ("x,b,1",), ("2,c",), ("3,d,4,5",), ('4,"e, f",1',), ("5,,",), ("6,g,cheap",)],
                          "value string").coalesce(1).write.text(root)
    good, bad = read_csv_checked(spark, root, "id int, name string, price double")
    assert sorted((r.id, r.name, r.price) for r in good.collect()) == [(1, "a", 2.5), (4, "e, f", 1.0), (5, None, None)]
    assert sorted(r.line for r in bad.collect()) == ["2,c", "3,d,4,5", "6,g,cheap", "x,b,1"]
    assert good.count() + bad.count() == 7 and bad.groupBy("file").count().count() == 1
    free, wrong = read_csv_checked(spark, root)
    assert free.count() + wrong.count() == 7 and sorted(r.line for r in wrong.collect()) == ["2,c", "3,d,4,5"]


def test_cast_losses_are_counted_in_passing(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "x"), ("1.5", "soon", None), ("no", None, "y"), (None, "2024-02-30", "z")],
                               "a string, b string, c string")
    seen = Observation()
    typed = cast_losses(df, {"a": "Integer", "b": "Date"}, seen)
    assert typed.columns == ["a", "b", "c"]
    assert [r.a for r in typed.collect()] == [1, None, None, None]
    assert seen.get == {"a": 2, "b": 2}


def test_event_log_reports_losses(spark):
    from dataclasses import replace

    spec, src = golden.spec(), golden.frames(spark)
    spec = spec.with_attributes(*[replace(a, source_data_type="Integer", default_value="0") if a.name == "Activity" else a
                                  for a in spec.attributes])
    seen = Observation()
    log = eventlog.event_log(spec, src, losses=seen)
    assert {r.Activity for r in log.collect()} == {0}
    assert seen.get["Activity"] == 3 and sum(seen.get.values()) == 3
    again = eventlog.event_log(spec, src, losses=Observation())
    assert plan(again).count("Scan") == plan(eventlog.event_log(spec, src)).count("Scan")
