"""Hot keys: one case holding a third of all events, checked against brute-force windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from starweave.operators import cases, measures


@pytest.fixture(scope="module")
def hot(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    # Every third event moves to user -1 (not a customer); a few more get no user at all (a null case group).
    return ev.withColumn(
        "user_id",
        F.when(F.col("event_id") % 3 == 0, F.lit(-1))
        .when(F.col("event_id") % 97 == 1, F.lit(None))
        .otherwise(F.col("user_id")),
    )


@pytest.mark.parametrize("rows_per_slice", [50, 1_000, 100_000])
@pytest.mark.parametrize("partitions", [16, 64])
def test_event_order_matches_row_number_on_all_columns(spark, hot, rows_per_slice, partitions):
    order = ["ts", "event_id"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = measures.event_order(hot, "user_id", order, rows_per_slice=rows_per_slice)
        assert got.columns == [*hot.columns, "n"]
        want = hot.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
        assert got.exceptAll(want).count() == 0 and got.count() == hot.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("kind", ["double", "int", "date", "timestamp", "string", "decimal(20,4)"])
def test_event_order_by_any_type(spark, kind):
    data = [(i % 3, None if i % 11 == 0 else str(20000000 + (i * 7919) % 1000), i) for i in range(600)]
    df = spark.createDataFrame(data, "c int, x string, id int")
    cast = {"date": "date_add(date'2020-01-01', cast(x as int) - 20000000)",
            "timestamp": "timestamp_seconds(cast(x as int))"}.get(kind, f"cast(x as {kind})")
    df = df.selectExpr("c", f"{cast} as x", "id")
    if kind == "double":
        df = df.withColumn("x", F.when(F.col("id") % 13 == 0, float("nan")).when(F.col("id") % 17 == 0, float("-inf"))
                           .when(F.col("id") % 19 == 0, float("inf")).otherwise(F.col("x")))
    got = measures.event_order(df, "c", ["x", "id"], rows_per_slice=20)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("x", "id")))
    pairs = lambda d: {(r.id, r.n) for r in d.select("id", "n").collect()}
    assert pairs(got) == pairs(want)


def test_first_last_on_hot_case_match_window(spark, hot):
    order = ["ts", "event_id"]
    rules = {"first_type": ("event_type", "First"), "last_type": ("event_type", "Last")}
    got = cases.case_values(hot, "user_id", order, rules)
    w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                  Window.unboundedFollowing)
    want = hot.select("user_id", F.first("event_type").over(w).alias("first_type"),
                      F.last("event_type").over(w).alias("last_type")).distinct()
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_attach_case_attributes_keeps_every_event_and_null_group(spark, hot):
    order = ["ts", "event_id"]
    rules = {"first_type": ("event_type", "First")}
    got = cases.attach_case_attributes(hot, "user_id", order, rules)
    assert got.count() == hot.count()
    w = Window.partitionBy("user_id").orderBy(*order)
    want = hot.withColumn("first_type", F.first("event_type").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    assert got.select("event_id", "first_type").exceptAll(want.select("event_id", "first_type")).count() == 0
    assert got.filter(F.col("user_id").isNull() & F.col("first_type").isNull()).count() == 0


def test_fk_orphans_preaggregates_hot_key(spark, hot):
    from starweave.operators.audit import fk_orphans

    customers = spark.read.parquet(f"{SF01}/customer.parquet")
    rows = {r["user_id"]: r["n"] for r in fk_orphans(hot, customers, "user_id", "c_custkey").collect()}
    assert rows == {-1: hot.filter(F.col("user_id") == -1).count()}


def test_case_aggregate_split_matches_log_grouping(spark):
    """Aggregating events per link key before the cases join gives the same case table as
    grouping the full event log, including the null-case group of orphan keys (DEC-14)."""
    from starweave.operators.cases import case_table as log_case_table
    from starweave.plans import eventlog, stars

    spec = stars.sales_spec()
    src = stars.sales_sources(spark, SF01)
    li = src["lineitem"].withColumn(
        "l_orderkey",
        F.when(F.col("l_partkey") % 3 == 0, F.lit(7))           # one hot order
        .when(F.col("l_partkey") % 11 == 1, -F.col("l_orderkey") - 1)  # keys with no order
        .otherwise(F.col("l_orderkey")))
    src = {**src, "lineitem": li}
    split = eventlog.case_table(spec, src)
    r = spec.roles()
    log = eventlog.event_log(spec, src)
    brute = log_case_table(log, r.case, r.order(), eventlog.case_rules(spec), start=r.start, end=r.end)
    brute = brute.select(*split.columns)
    assert split.count() == brute.count()
    assert split.exceptAll(brute).count() == 0 and brute.exceptAll(split).count() == 0
    orphans = li.filter(F.col("l_orderkey") < 0).count()
    assert split.filter(F.col("o_orderkey").isNull()).first()["n_events"] == orphans


def test_group_aggregate_by_lookup_column_matches_log_grouping(spark):
    """Grouping by a lookup column (resource) after a per-key reduction equals grouping the
    whole event log, with names shared by two supplier keys and a hot supplier."""
    from starweave.plans import eventlog, stars

    spec = stars.sales_spec()
    src = stars.sales_sources(spark, SF01)
    sup = src["supplier"].withColumn("s_name", F.concat(F.lit("S"), (F.col("s_suppkey") % 50).cast("string")))
    li = src["lineitem"].withColumn(
        "l_suppkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(5)).otherwise(F.col("l_suppkey")))
    src = {**src, "supplier": sup, "lineitem": li}
    order = ["l_shipdate", "l_linenumber", "l_partkey", "o_orderkey"]
    got = eventlog.group_aggregate(
        spec, src, "s_name", order=order,
        rules={"bal": ("s_acctbal", "First"), "rf": ("l_returnflag", "Last")},
        mins={"first_ship": "l_shipdate"}, sums={"tot": "l_extendedprice", "bal_sum": "s_acctbal"})
    log = eventlog.event_log(spec, src)
    key = [F.col(c) for c in order]
    want = log.groupBy("s_name").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("l_shipdate").alias("first_ship"),
        F.min(F.struct(*key, F.col("s_acctbal"))).alias("f"),
        F.max(F.struct(*key, F.col("l_returnflag"))).alias("l"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("tot"),
        F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("bal_sum"),
    ).select("s_name", "n_events", "first_ship", F.col("f.s_acctbal").alias("bal"),
             F.col("l.l_returnflag").alias("rf"), "tot", "bal_sum")
    assert got.columns == want.columns
    assert got.count() == want.count() == 50
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_group_aggregate_by_case_lookup_uses_full_order(spark):
    """Grouping by a case-lookup column: several cases share a group, and the Start column
    comes from the cases table; First/Last must compare it across cases."""
    from pyspark.sql import Window as W

    from starweave.plans import eventlog, stars

    spec = stars.sales_spec()
    src = stars.sales_sources(spark, SF01)
    order = ["o_orderdate", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
    got = eventlog.group_aggregate(
        spec, src, "c_mktsegment", order=order,
        rules={"first_flag": ("l_returnflag", "First"), "first_status": ("o_orderstatus", "First"),
               "last_prio": ("o_orderpriority", "Last")},
        mins={"first_order": "o_orderdate"}, maxs={"last_ship": "l_shipdate"})
    log = eventlog.event_log(spec, src)
    w = W.partitionBy("c_mktsegment").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    want = log.select(
        "c_mktsegment",
        F.count(F.lit(1)).over(w).alias("n_events"),
        F.min("o_orderdate").over(w).alias("first_order"),
        F.max("l_shipdate").over(w).alias("last_ship"),
        F.first("l_returnflag").over(w).alias("first_flag"),
        F.first("o_orderstatus").over(w).alias("first_status"),
        F.last("o_orderpriority").over(w).alias("last_prio"),
    ).distinct()
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_group_aggregate_by_shared_lookup_column(spark):
    """Group by the events-side use of a lookup that the cases side also uses (prefixed)."""
    from starweave.plans import eventlog
    from starweave.plans.spec import ImportSpec, attr, cases, edge, events, lookup

    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn("ev_nationkey", F.col("user_id") % 25)
    src = {"events": ev, "customer": spark.read.parquet(f"{SF01}/customer.parquet"),
           "nation": spark.read.parquet(f"{SF01}/nation.parquet")}
    spec = ImportSpec((
        events("events", ["event_id", "ts", "event_type", "value", "user_id", "ev_nationkey"],
               edge("user_id", "customer", "c_custkey"),
               edge("ev_nationkey", "nation", "n_nationkey", prefix="ev_")),
        cases("customer", ["c_custkey", "c_nationkey"], edge("c_nationkey", "nation", "n_nationkey", prefix="cs_")),
        lookup("nation", ["n_name"]),
    ), (attr("event_id", "Integer"), attr("ts", "Date", "Start"), attr("event_type", "String", "Activity"),
        attr("value", "Float"), attr("c_custkey", "Integer", "Case", "Case"),
        attr("ev_n_name", "String"), attr("cs_n_name", "String", level="Case")),
        tiebreak=("event_id",)).validate()
    got = eventlog.group_aggregate(spec, src, "ev_n_name", rules={"home": ("cs_n_name", "First")},
                                   sums={"v": "value"})
    log = eventlog.event_log(spec, src)
    order = [F.col("ts"), F.col("event_id")]
    want = log.groupBy("ev_n_name").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(F.struct(*order, F.col("cs_n_name"))).alias("f"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"),
    ).select("ev_n_name", "n_events", F.col("f.cs_n_name").alias("home"), "v")
    assert got.count() == want.count() == 25
    assert got.exceptAll(want).count() == 0


def test_group_aggregate_fan_out_without_key_check(spark):
    """With the key check off, duplicate target keys fan events out the same way in the
    per-key reduction as in the joined event log."""
    from starweave.plans import eventlog, stars

    spec = stars.sales_spec()
    src = stars.sales_sources(spark, SF01)
    orders = src["orders"]
    dup = orders.unionByName(orders.filter(F.col("o_orderkey") % 7 == 0)
                             .withColumn("o_orderstatus", F.lit("X")))
    src = {**src, "orders": dup}
    got = eventlog.group_aggregate(spec, src, "o_orderstatus", rules={"f": ("l_returnflag", "First")},
                                   mins={"m": "l_shipdate"}, sums={"t": "l_extendedprice", "p": "o_totalprice"},
                                   check_keys=False)
    log = eventlog.event_log(spec, src, check_keys=False)
    order = [F.col(c) for c in spec.roles().order()]
    want = log.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("l_shipdate").alias("m"),
        F.min(F.struct(*order, F.col("l_returnflag"))).alias("ff"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("t"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("p"),
    ).select("o_orderstatus", "n_events", "m", F.col("ff.l_returnflag").alias("f"), "t", "p")
    assert got.count() == want.count() == 4
    assert got.exceptAll(want).count() == 0


def test_summary_pairs_match_log_grouping(spark):
    """Per-activity counts from (activity, link key) pairs equal grouping the whole log, with
    a hot order and orphan keys."""
    from starweave.operators.measures import summarize
    from starweave.plans import eventlog, stars

    spec = stars.sales_spec()
    src = stars.sales_sources(spark, SF01)
    li = src["lineitem"].withColumn(
        "l_orderkey",
        F.when(F.col("l_partkey") % 3 == 0, F.lit(7))
        .when(F.col("l_partkey") % 11 == 1, -F.col("l_orderkey") - 1)
        .otherwise(F.col("l_orderkey")))
    src = {**src, "lineitem": li}
    for key, name in (("p_type", "activity"), ("s_name", "resource"), ("l_returnflag", "flag")):
        got = eventlog.summary(spec, src, key, name)
        want = summarize(eventlog.event_log(spec, src), key, "o_orderkey", name)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0


def test_case_values_on_events_keyed_by_link(spark):
    """G3 keyed by the events' link key equals full-frame windows over the joined log, with a
    hot customer, orphan keys and null keys (the null-case group, DEC-14)."""
    from pyspark.sql import Window as W

    from starweave.plans import eventlog, stars

    spec = stars.clicks_spec()
    src = stars.clicks_sources(spark, SF01)
    ev = src["events"].withColumn(
        "user_id",
        F.when(F.col("event_id") % 3 == 0, F.lit(7))
        .when(F.col("event_id") % 13 == 1, -F.col("user_id") - 1)
        .when(F.col("event_id") % 29 == 2, F.lit(None))
        .otherwise(F.col("user_id")))
    src = {**src, "events": ev}
    rules = {"first_type": ("event_type", "First"), "last_type": ("event_type", "Last"),
             "seg": ("c_mktsegment", "First")}
    got = eventlog.case_values_on_events(spec, src, rules, ["event_id", "c_custkey"])
    log = eventlog.event_log(spec, src)
    w = W.partitionBy("c_custkey").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding,
                                                                         W.unboundedFollowing)
    want = log.select("event_id", "c_custkey", F.first("event_type").over(w).alias("first_type"),
                      F.last("event_type").over(w).alias("last_type"),
                      F.first("c_mktsegment").over(w).alias("seg"))
    assert got.columns == want.columns
    assert got.count() == want.count() == ev.count()
    assert got.exceptAll(want).count() == 0


def _slices(spark, rows, monkeypatch, rows_per_slice):
    """Numbers of each row by ``event_order`` and the sizes of the slices that it cut."""
    from starweave.operators import measures

    seen, real = [], measures.slice_rows
    monkeypatch.setattr(measures, "slice_rows", lambda *a: seen.append(real(*a)) or seen[-1])
    got = measures.event_order(rows, "c", ["t", "id"], rows_per_slice=rows_per_slice).cache()
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("t", "id")))
    assert got.count() == want.count() and got.exceptAll(want.withColumn("n", F.col("n").cast("bigint"))).count() == 0
    got.unpersist()
    return [r["count"] for r in seen[0].groupBy("__slice").count().collect()]


@pytest.mark.parametrize("shape", ["outlier", "one value", "two thirds one value", "null", "text", "exponential", "small cases too"])
def test_slices_of_a_long_case_are_even(spark, monkeypatch, shape):
    n, per = 60_000, 5_000
    base = spark.range(n).select("id", F.lit(1).alias("c"))
    t = {"outlier": F.when(F.col("id") == 7, 0).otherwise(1_700_000_000_000_000 + F.col("id") * 37 % 1000),
         "one value": F.lit(5), "null": F.lit(None).cast("int"), "two thirds one value": F.when(F.col("id") % 3 > 0, 9).otherwise(F.col("id")),
         "text": F.concat(F.lit("same start of a long text "), (F.col("id") * 7919 % n).cast("string")),
         "exponential": F.exp(F.col("id") % 700), "small cases too": F.col("id")}[shape]
    rows = base.withColumn("t", t)
    if shape == "small cases too":
        rows = rows.unionByName(spark.range(5_000).select("id", (F.col("id") % 50 + 2).cast("int").alias("c"), F.col("id").alias("t")))
    sizes = _slices(spark, rows, monkeypatch, per)
    assert sum(sizes) == n and max(sizes) <= 2 * per and len(sizes) >= n // (2 * per)


def test_long_null_case_and_hot_order(spark, monkeypatch):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 2 == 0, 3).alias("c"), (F.col("id") % 3).alias("t"))
    assert max(_slices(spark, rows, monkeypatch, 2_000)) <= 4_000
