"""Key checks that no later step can remove, exact money, folders, overrides and odd names."""

import datetime as dt

import pytest
from conftest import SF001
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starweave import ImportSpec, load_sources, write_log
from starweave.functions.types import ATTRIBUTE_SPARK_TYPE, ATTRIBUTE_TYPES, to_attribute_type, type_family
from starweave.operators import audit, cases
from starweave.operators.star import DuplicateKeyError, star_join
from starweave.plans import eventlog, stars
from starweave.session import scratch_path
from starweave.sources.readers import read_dataset


@pytest.fixture(scope="module")
def doubled(spark):
    src = stars.sales_sources(spark, SF001)
    return {**src, "orders": src["orders"].union(src["orders"])}


@pytest.mark.parametrize("build", [
    lambda s, d: eventlog.event_log(s, d).filter("o_orderstatus = 'O'"),
    lambda s, d: eventlog.event_log(s, d, columns=["l_extendedprice"]),  # the duplicated table is not even joined
    lambda s, d: star_join(s, d).join(d["part"].limit(1), F.lit(True), "inner"),
    lambda s, d: eventlog.case_table(s, d).filter("o_orderstatus = 'O'"),
    lambda s, d: eventlog.finance(s, d, "l_extendedprice").filter("o_orderkey >= 0"),
    lambda s, d: eventlog.summary(s, d, s.roles().activity).filter("n_events > 1"),
    lambda s, d: eventlog.case_values_on_events(s, d, {"v": ("l_returnflag", "First")}, ["l_linenumber"]).filter("v = 'R'"),
])
def test_duplicate_keys_raise_whatever_follows(doubled, build):
    with pytest.raises(DuplicateKeyError, match="duplicate key in orders.o_orderkey"):
        build(stars.sales_spec(), doubled).count()


def test_money_is_added_exactly(spark):
    log = spark.createDataFrame([(1, 0.004)] * 5 + [(2, 1e17), (2, 0.5), (3, float("nan")), (3, 2.0), (4, None)], "c int, v double")
    got = dict(cases.finance_totals(log, "v", "PerEvent", ["c"]).collect())
    assert got == {1: 0.02, 2: 1e17 + 0.5, 3: 2.0, 4: None}


def test_folder_keeps_every_file_and_partition_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string")
    root = scratch_path(spark, "mixed")
    df.coalesce(1).write.option("header", True).csv(f"{root}/deep/x")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    part = next(f.getPath() for f in fs.listStatus(path(f"{root}/deep/x")) if f.getPath().getName().startswith("part-"))
    out = fs.create(path(f"{root}/UPPER.CSV"))
    out.write(bytearray(b"id,kind\n3,c\n"))
    out.close()
    assert part and {r.id for r in read_dataset(spark, root, "csv", recursive=True).collect()} == {1, 2, 3}
    logs = scratch_path(spark, "parts")
    write_log(df, logs, partition_by=["kind"])
    back = read_dataset(spark, logs, "parquet", recursive=True)
    assert {(r.id, r.kind) for r in back.collect()} == {(1, "a"), (2, "b")}
    given = read_dataset(spark, root, "csv", recursive=True, schema="id long, kind string")
    assert given.schema["id"].dataType == T.LongType()


VALUES = {
    "tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 1.5, "double": 2.5, "decimal(10,2)": 3, "string": "x",
    "boolean": True, "date": dt.date(2020, 1, 2), "timestamp": dt.datetime(2020, 1, 2, 3), "timestamp_ntz": dt.datetime(2020, 1, 2, 3),
    "binary": b"a", "array<int>": [1], "map<string,int>": {"k": 1}, "struct<x:int>": (1,), "interval day": dt.timedelta(days=1),
}


def test_overrides_never_fail(spark):
    picks, want = [], {}
    for i, (kind, value) in enumerate(VALUES.items()):
        lit = F.lit(None).cast(kind) if isinstance(value, (list, dict, tuple)) else F.lit(value).cast(kind)
        for target in ATTRIBUTE_TYPES:
            name = f"{i}_{target}"
            dtype = spark.range(1).select(lit.alias("c")).schema["c"].dataType
            picks.append(to_attribute_type(lit, dtype, target).alias(name))
            want[name] = ATTRIBUTE_SPARK_TYPE[target]
    df = spark.range(1).select(*picks)
    assert {f.name: f.dataType for f in df.schema.fields} == want
    row = df.first().asDict()
    at = list(VALUES).index
    assert row[f"{at('binary')}_Integer"] is None and row[f"{at('binary')}_String"] == "61"
    assert row[f"{at('bigint')}_Date"] is None and row[f"{at('timestamp')}_Boolean"] is None
    seconds = int(dt.datetime(2020, 1, 2, 3, tzinfo=dt.timezone.utc).timestamp())
    assert row[f"{at('timestamp')}_Integer"] == row[f"{at('timestamp_ntz')}_Integer"] == seconds
    assert type_family(T.DecimalType(5, 1)) == "double" and type_family("varchar(20)") == "string"


def test_names_with_dots_and_a_key_called_n(spark):
    src = spark.createDataFrame([(1,), (9,)], "n int")
    tgt = spark.createDataFrame([(1, "x")], "id int, `Act.id` string")
    assert [tuple(r) for r in audit.fk_orphans(src, tgt, "n", "id").collect()] == [(9, 1)]
    dotted = src.withColumnRenamed("n", "Act.id")
    assert [tuple(r) for r in audit.fk_orphans(dotted, tgt, "Act.id", "id").collect()] == [(9, 1)]


def test_ill_typed_default_is_rejected():
    from dataclasses import replace

    from golden import spec
    from starweave.plans.spec import SpecError

    s = spec()
    a = next(a for a in s.attributes if a.source_data_type == "Float")
    bad = tuple(replace(x, default_value="abc") if x is a else x for x in s.attributes)
    with pytest.raises(SpecError, match="default"):
        replace(s, attributes=bad).validate(require_roles=False)
    assert isinstance(s, ImportSpec) and load_sources
