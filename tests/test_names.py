"""Output names per use of a dataset, and what a config document keeps."""

import json

import golden
import pytest
from conftest import SF001

from starweave.__main__ import main
from starweave.operators.star import star_join
from starweave.plans import eventlog, stars
from starweave.plans.names import output_columns, with_names
from starweave.plans.spec import ImportSpec, SpecError, attr, cases, edge, events, lookup
from starweave.session import scratch_path, strip_scheme


def _shared(naming="qualify", **kw) -> ImportSpec:
    return ImportSpec((
        events("events", ["EventCost", "Region"], edge("CaseID", "cases", "CaseID", **kw), edge("Activity_id", "activity", "Activity_id")),
        cases("cases", ["CaseID", "Region"], edge("First_id", "activity", "Activity_id")),
        lookup("activity", ["Activity"])), naming=naming)


def test_later_uses_are_qualified():
    assert [c.name for c in output_columns(_shared())] == [
        "EventCost", "Region", "CaseID", "cases_Region", "Activity", "First_id_Activity"]
    with pytest.raises(SpecError, match="Activity.*Region"):
        output_columns(_shared("strict"))


def test_prefix_and_alias_of_the_cases_link():
    assert [c.name for c in output_columns(_shared(prefix="cs_"))][2:4] == ["cs_CaseID", "cs_Region"]
    named = with_names(_shared("strict", aliases={"Region": "home"}), {("cases", "First_id"): "f_"}, {("events", "", "EventCost"): "cost"})
    assert [c.name for c in output_columns(named)] == ["cost", "Region", "CaseID", "home", "Activity", "f_Activity"]
    with pytest.raises(SpecError, match="no such edge"):
        with_names(_shared(), {("cases", "nothing"): "x"})


def test_names_differ_without_case_and_numbers_close_the_rest():
    spec = ImportSpec((
        events("e", ["A", "e_x"], edge("k1", "l", "id"), edge("k2", "l", "id"), edge("k3", "l", "id", export_name="a")),
        lookup("l", ["a", "k2_a"])), naming="qualify")
    names = [c.name for c in output_columns(spec)]
    assert len({n.casefold() for n in names}) == len(names) == 9


def test_values_reach_their_use(spark):
    from pyspark.sql import functions as F

    src = golden.frames(spark)
    src["events"] = src["events"].withColumn("Region", F.lit("here"))
    src["cases"] = src["cases"].withColumn("First_id", F.lit(11))
    rows = star_join(_shared(), src).orderBy("EventCost").collect()
    assert [(r.Region, r.cases_Region, r.Activity, r.First_id_Activity) for r in rows] == [
        ("here", "South", "Create", "Approve"), ("here", "North", "Approve", "Approve"), ("here", None, None, None),
        ("here", "North", "Create", "Approve")]


def test_two_edges_from_one_key_differ_by_prefix(spark):
    spec = ImportSpec((events("events", ["EventCost"], edge("Activity_id", "activity", "Activity_id", prefix="a_"),
                              edge("Activity_id", "activity", "Activity_id", prefix="b_")), lookup("activity", ["Activity"])))
    got = star_join(spec, golden.frames(spark))
    assert got.columns == ["EventCost", "a_Activity", "b_Activity"]
    assert all(r.a_Activity == r.b_Activity for r in got.collect())


def _config() -> dict:
    spec = _shared().with_attributes(
        attr("EventCost", "Float", finance="PerEvent"), attr("Region", "String", level="Event"),
        attr("CaseID", "Integer", "Case", "Case"), attr("Activity", "String", "Activity"))
    doc = spec.to_config()
    del doc["inputDataBinding"]["importOptions"]
    doc["inputDataBinding"]["miningMetadata"]["ImportConfiguration"]["Attributes"].append(
        {"Name": "First_id_Activity_x", "ImportType": "Start", "SourceDataType": "Date"})
    return doc


def test_document_with_one_lookup_used_twice():
    spec = ImportSpec.from_config(json.dumps(_config()))
    assert spec.attribute("cases_Region").level == "Case" and spec.attribute("cases_Region").import_type == "Other"
    assert spec.attribute("First_id_Activity").import_type == "Other"
    assert spec.attribute("Activity").import_type == "Activity"
    with pytest.raises(SpecError, match="clash"):
        output_columns(ImportSpec.from_config(json.dumps(_config()), naming="strict"))


@pytest.mark.parametrize("spec", [
    stars.sales_spec(), stars.clicks_spec(), stars.docs_spec(), _shared(prefix="p_", aliases={"Region": "r"}),
    ImportSpec(stars.clicks_spec().datasets, stars.clicks_spec().attributes, ("event_id", "value"), False, "csv", "strict"),
    with_names(stars.docs_spec(), aliases={("documents", "", "lang"): "language"})])
def test_round_trip_keeps_all(spec):
    back = ImportSpec.from_config(json.loads(json.dumps(spec.to_config())))
    assert back == spec


def test_command_line_names(spark):
    import os

    doc = stars.clicks_spec().to_config()
    for d in doc["inputDataBinding"]["dataSource"]["datasets"]:
        d["Path"] = f"{SF001}/{d['Name']}.parquet"
    cfg = strip_scheme(scratch_path(spark, "cfg")) + ".json"
    os.makedirs(os.path.dirname(cfg), exist_ok=True)
    with open(cfg, "w", encoding="utf-8") as fh:
        json.dump(doc, fh)
    out = scratch_path(spark, "cli-names")
    assert main([cfg, "--out", out, "--prefix", "customer.c_nationkey=case_", "--alias", "events.value=amount",
                 "--alias", "events.user_id.c_mktsegment=segment"]) == 0
    log = spark.read.parquet(f"{out}/event_log")
    assert {"case_n_name", "amount", "segment"} <= set(log.columns)
    want = eventlog.event_log(stars.clicks_spec(), stars.clicks_sources(spark, SF001))
    assert log.select("event_id", "amount", "segment", "case_n_name").exceptAll(
        want.select("event_id", "value", "c_mktsegment", "n_name")).count() == 0
