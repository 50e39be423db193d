"""Sources and sink: catalog table, CSV, Parquet, folders; the event-log sink; entry smoke."""

import os


from conftest import SF001, SF01
from starweave.plans.spec import SpecError
from starweave.session import scratch_path, strip_scheme
from starweave.sources.readers import columns_of, load_sources, read_dataset
from starweave.sources.sinks import write_log


def test_folder_scan_skips_hidden_and_other_formats(spark):
    root = scratch_path(spark, "folder")
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "event_type")
    ev.write.parquet(f"{root}/a")
    ev.limit(5).write.parquet(f"{root}/_staging")      # hidden folder: skipped
    ev.limit(5).write.parquet(f"{root}/b/.tmp")        # hidden folder: skipped
    ev.limit(5).write.csv(f"{root}/c")                 # other format: skipped
    got = read_dataset(spark, root, "parquet", recursive=True)
    assert got.count() == ev.count()


def test_csv_with_schema_skips_inference(spark):
    path = scratch_path(spark, "csv")
    orders = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_totalprice")
    orders.write.option("header", "true").csv(path)
    got = read_dataset(spark, path, "csv", schema="o_orderkey bigint, o_totalprice double")
    assert dict(got.dtypes) == {"o_orderkey": "bigint", "o_totalprice": "double"}
    assert got.exceptAll(orders).count() == 0


def test_partitioned_catalog_table_columns_once(spark):
    path = scratch_path(spark, "tbl")
    name = "sw_part_" + os.path.basename(path).rsplit("-", 1)[-1]
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "event_type", "value")
    ev.write.partitionBy("event_type").option("path", path).format("parquet").saveAsTable(name)
    df = read_dataset(spark, name, "table")
    names = [n for n, _ in columns_of(df)]
    assert sorted(names) == ["event_id", "event_type", "value"]
    assert df.count() == ev.count()


def test_load_sources_by_path_and_frame(spark):
    from starweave.plans import stars

    spec = stars.docs_spec()
    srcs = load_sources(spark, spec, {"documents": f"{SF001}/documents.parquet",
                                      "labels": spark.read.parquet(f"{SF001}/labels.parquet")})
    assert set(srcs) == {"documents", "labels"}
    try:
        load_sources(spark, spec, {"documents": f"{SF001}/documents.parquet"})
        raise AssertionError("expected SpecError")
    except SpecError:
        pass


def test_write_log_partitioned_round_trip(spark):
    path = scratch_path(spark, "sink")
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "event_type", "value")
    write_log(ev, path, partition_by=["event_type"], max_records_per_file=100)
    back = spark.read.parquet(path).select("event_id", "event_type", "value")
    assert back.exceptAll(ev).count() == 0 and back.count() == ev.count()
    folders = sorted(d for d in os.listdir(strip_scheme(path)) if d.startswith("event_type="))
    assert len(folders) == ev.select("event_type").distinct().count()


def test_entry_smoke(spark):
    import __spark_entry__ as entry_mod

    df = entry_mod.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    from starweave.plans.registry import ORACLE, QUERIES

    assert set(QUERIES) == set(ORACLE) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
