"""Exact counts of distinct values by pairs, and display counts on keys."""

import golden
from conftest import SF001
from pyspark.sql import functions as F

from starweave.operators.audit import count_values, profile_columns
from starweave.operators.project import display_attributes
from starweave.plans import eventlog, stars
from starweave.plans.spec import Attribute


def test_counts_equal_count_distinct_for_every_type(spark):
    df = spark.range(200).select(
        (F.col("id") % 7).alias("a.b"), (F.col("id") % 5).cast("int").alias("i"),
        F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, -0.0).otherwise(0.0).alias("d"),
        F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("s"), F.lit(None).alias("nothing"),
        (F.col("id") % 2 == 0).alias("flag"), F.expr("timestamp_seconds(id % 9)").alias("t"), F.expr("cast(id % 6 as decimal(20,3))").alias("m"),
        F.array(F.col("id") % 3, F.lit(None)).alias("arr"), F.struct((F.col("id") % 2).alias("x")).alias("st"),
        F.expr("binary(cast(id % 8 as string))").alias("bin"), F.expr("date_add(date'2020-01-01', cast(id % 11 as int))").alias("day"))
    got = {r.column_name: (r.n_rows, r.n_nulls, r.n_distinct) for r in count_values(df, df.columns).collect()}
    for c in df.columns:
        col = F.col(f"`{c}`")
        want = df.agg(F.count(F.lit(1)), F.count(F.lit(1)) - F.count(col), F.count_distinct(col)).first()
        assert got[c] == tuple(want), c
    maps = df.select(F.create_map(F.lit("a"), F.col("i"), F.lit("b"), F.lit(1)).alias("m"))
    assert count_values(maps, ["m"]).first().n_distinct == 5


def test_columns_of_an_empty_table_have_a_row(spark):
    df = spark.createDataFrame([], "a int, b string, c int")
    assert sorted(tuple(r) for r in profile_columns(df).collect()) == [("a", "int", 0, 0, 0), ("b", "string", 0, 0, 0), ("c", "int", 0, 0, 0)]


def test_approximate_profile_is_asked_for(spark):
    df = stars.table(spark, SF001, "orders")
    exact = {r.column_name: r for r in profile_columns(df).collect()}
    near = {r.column_name: r for r in profile_columns(df, exact=False).collect()}
    assert all(near[c].n_rows == exact[c].n_rows and near[c].family == exact[c].family for c in exact)
    assert all(abs(near[c].n_distinct - exact[c].n_distinct) <= 0.2 * exact[c].n_distinct + 1 for c in exact)


def test_display_counts_equal_those_of_the_log(spark):
    from dataclasses import replace

    spec = golden.spec()
    spec = spec.with_attributes(*[replace(a, is_display=True) for a in spec.attributes])
    spec = spec.with_attributes(*[replace(a, default_value="none") if a.name == "Activity" else a for a in spec.attributes])
    src = golden.frames(spark)
    want = sorted(map(tuple, display_attributes(eventlog.event_log(spec, src)).collect()))
    assert sorted(map(tuple, eventlog.display_summary(spec, src).collect())) == want
    assert dict(want)["Activity"] == 3 and len(want) == len(spec.attributes)
    assert eventlog.display_summary(golden.spec(), src).count() == 0
    assert isinstance(spec.attributes[0], Attribute)
