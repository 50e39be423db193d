"""An import config document with paths runs end to end and matches the registered star."""

import json
import os

from conftest import SF01
from starweave.__main__ import main
from starweave.plans import eventlog, stars
from starweave.plans.spec import ImportSpec
from starweave.session import scratch_path, strip_scheme
from starweave.sources.readers import load_sources


def _clicks_config() -> dict:
    doc = stars.clicks_spec().to_config()
    for d in doc["inputDataBinding"]["dataSource"]["datasets"]:
        d["Path"] = f"{SF01}/{d['Name']}.parquet"
    return doc


def test_config_with_paths_builds_the_same_log(spark):
    spec = ImportSpec.from_config(json.dumps(_clicks_config()), tiebreak=("event_id",))
    log = eventlog.event_log(spec, load_sources(spark, spec))
    want = eventlog.event_log(stars.clicks_spec(), stars.clicks_sources(spark, SF01))
    assert log.columns == want.columns
    assert log.exceptAll(want).count() == 0 and log.count() == want.count()


def test_command_line_writes_log_and_case_table(spark):
    out = scratch_path(spark, "cli")
    cfg = os.path.join(strip_scheme(scratch_path(spark, "cfg")) + ".json")
    os.makedirs(os.path.dirname(cfg), exist_ok=True)
    with open(cfg, "w", encoding="utf-8") as fh:
        json.dump(_clicks_config(), fh)
    assert main([cfg, "--out", out, "--tiebreak", "event_id", "--case-table", "--partition-by", "event_type"]) == 0
    log = spark.read.parquet(f"{out}/event_log")
    cases = spark.read.parquet(f"{out}/case_table")
    assert log.count() == spark.read.parquet(f"{SF01}/events.parquet").count()
    assert cases.count() == log.select("c_custkey").distinct().count()
    assert {"c_custkey", "n_events", "start_ts", "end_ts", "c_mktsegment", "n_name"} <= set(cases.columns)


def test_example_config_parses():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(os.path.join(here, "examples", "golden_import.json"), encoding="utf-8") as fh:
        spec = ImportSpec.from_config(json.load(fh))
    assert [d.name for d in spec.datasets] == ["events", "cases", "activity", "resource"]
    assert spec.roles().case == "CaseID" and spec.roles().end == "EndTimestamp"


def test_config_file_type_picks_the_reader(spark):
    """dataSourceFileType 0 reads each dataset as a folder of CSV files."""
    from starweave.functions.types import normalize_types

    doc = _clicks_config()
    root = scratch_path(spark, "csv-star")
    for d in doc["inputDataBinding"]["dataSource"]["datasets"]:
        df = spark.read.parquet(d["Path"])
        df.write.option("header", "true").csv(f"{root}/{d['Name']}/part")
        d["Path"] = f"{root}/{d['Name']}"
    doc["inputDataBinding"]["dataSource"]["dataSourceFileType"] = 0
    spec = ImportSpec.from_config(doc, tiebreak=("event_id",))
    assert spec.source_format == "csv" and ImportSpec.from_config(spec.to_config()).source_format == "csv"
    sources = {k: normalize_types(v) for k, v in load_sources(spark, spec).items()}
    log = eventlog.event_log(spec, sources).select("event_id", "event_type", "c_custkey", "n_name")
    want = eventlog.event_log(stars.clicks_spec(), stars.clicks_sources(spark, SF01)) \
        .select("event_id", "event_type", "c_custkey", "n_name")
    assert log.count() == want.count() and log.exceptAll(want).count() == 0


def test_command_line_explain_writes_nothing(spark, capsys):
    out = scratch_path(spark, "cli-explain")
    cfg = strip_scheme(scratch_path(spark, "cfg")) + ".json"
    os.makedirs(os.path.dirname(cfg), exist_ok=True)
    with open(cfg, "w", encoding="utf-8") as fh:
        json.dump(_clicks_config(), fh)
    assert main([cfg, "--out", out, "--tiebreak", "event_id", "--case-table", "--explain"]) == 0
    assert not os.path.exists(strip_scheme(out))
