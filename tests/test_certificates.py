"""One key check per source set, and a new one when a source changes."""

import uuid

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from starweave.operators import certificates
from starweave.operators.star import DuplicateKeyError, star_join
from starweave.plans import eventlog, stars
from starweave.plans.spec import ImportSpec, edge, events, lookup
from starweave.session import scratch_path
from starweave.sources.readers import load_sources


def jobs(spark, run) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "test")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture()
def forget():
    certificates._BY_SNAPSHOT.clear()
    certificates._BY_FRAME.clear()


def test_one_check_for_all_outputs(spark, forget, monkeypatch):
    checks, real = [], certificates.first_repeated
    monkeypatch.setattr(certificates, "first_repeated", lambda tagged: checks.append(len(tagged)) or real(tagged))
    spec, sources = stars.sales_spec(), stars.sales_sources(spark, SF001)
    eventlog.event_log(spec, sources)
    eventlog.case_table(spec, sources)
    eventlog.finance(spec, sources, "s_acctbal")
    eventlog.event_log(spec, stars.sales_sources(spark, SF001))  # the same unchanged files, loaded again
    assert checks == [4]


def test_building_again_runs_no_job(spark, forget):
    spec, sources = stars.clicks_spec(), stars.clicks_sources(spark, SF001)
    assert jobs(spark, lambda: eventlog.event_log(spec, sources)) > 0
    assert jobs(spark, lambda: eventlog.event_log(spec, sources)) == 0


def _spec() -> ImportSpec:
    return ImportSpec((events("e", ["v"], edge("k", "l", "id")), lookup("l", ["name"])))


def test_changed_files_are_checked_again(spark, forget):
    path = scratch_path(spark, "lookup")
    ev = spark.range(10).select(F.col("id").alias("v"), (F.col("id") % 5).alias("k"))

    def build():
        return star_join(_spec(), {"e": ev, "l": load_sources(spark, _lookup_spec(), {"l": path, "e": ev})["l"]})

    def _lookup_spec():
        return _spec()

    spark.range(5).select("id", F.lit("a").alias("name")).write.parquet(path)
    assert build().count() == 10
    spark.range(1).select("id", F.lit("b").alias("name")).write.mode("append").parquet(path)
    with pytest.raises(DuplicateKeyError):
        build()
    with pytest.raises(DuplicateKeyError):  # a failed check proves nothing
        build()


def test_plans_over_one_file_are_told_apart(spark, forget):
    src = stars.sales_sources(spark, SF001)
    spec = ImportSpec((events("lineitem", ["l_linenumber"], edge("l_orderkey", "orders", "o_orderkey")), lookup("orders", ["o_orderstatus"])))
    star_join(spec, src)
    doubled = {**src, "orders": src["orders"].unionByName(src["orders"])}
    with pytest.raises(DuplicateKeyError):
        star_join(spec, doubled)
    shifted = {**src, "orders": src["orders"].withColumn("o_orderkey", F.lit(1).cast("bigint"))}
    with pytest.raises(DuplicateKeyError):
        star_join(spec, shifted)


def test_rows_without_files_hang_on_their_frame(spark, forget):
    ev = spark.createDataFrame([(1, 1), (2, 1)], "v int, k int")
    one, two = (spark.createDataFrame(rows, "id int, name string") for rows in ([(1, "a")], [(1, "a"), (1, "b")]))
    assert certificates.snapshot(one) is None
    assert star_join(_spec(), {"e": ev, "l": one}).count() == 2
    assert jobs(spark, lambda: star_join(_spec(), {"e": ev, "l": one})) == 0
    with pytest.raises(DuplicateKeyError):
        star_join(_spec(), {"e": ev, "l": two})


def test_random_plans_have_no_snapshot(spark, forget):
    df = stars.table(spark, SF001, "orders")
    assert certificates.snapshot(df) is not None
    assert certificates.snapshot(df.filter(F.rand() < 2)) is None
