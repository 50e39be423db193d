"""AQE splits a hot key's partition in the star join and in the case-attribute join back.

Broadcast is switched off and the skew thresholds lowered so that sf0.01 data behaves like a
skewed large input: one order holds a third of all line items.
"""

import contextlib

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from starweave.operators import cases
from starweave.operators.star import star_join
from starweave.plans import stars

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot_sources(spark):
    src = stars.sales_sources(spark, SF01)
    # Eight input tasks: AQE splits a skewed partition along map outputs, and the sf0.01 file
    # is a single split.
    li = src["lineitem"].repartition(8).withColumn(
        "l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey")))
    return {**src, "lineitem": li}


def test_star_join_hot_case_is_split(spark, hot_sources):
    with conf(spark, SKEW_CONF):
        df = star_join(stars.sales_spec(), hot_sources).select("o_orderkey", "l_extendedprice", "p_type")
        plan = final_plan(df)
        assert "SortMergeJoin" in plan and "isSkewJoin=true" in plan.replace("skew=true", "isSkewJoin=true")
        assert df.count() == hot_sources["lineitem"].count()


def test_case_attributes_join_back_is_split(spark, hot_sources):
    with conf(spark, SKEW_CONF):
        log = hot_sources["lineitem"]
        order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
        df = cases.attach_case_attributes(log, "l_orderkey", order, {"f": ("l_returnflag", "First")})
        plan = final_plan(df)
        assert "isSkewJoin=true" in plan.replace("skew=true", "isSkewJoin=true")
        assert df.count() == log.count()
