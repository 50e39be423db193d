"""The golden star with its expected results (FIXTURES.md §2)."""

import pytest

import golden
from starweave.operators import audit, cases
from starweave.operators.star import star_join
from starweave.plans import eventlog
from starweave.plans.spec import ImportSpec


@pytest.fixture(scope="module")
def src(spark):
    return golden.frames(spark)


def test_event_columns_and_order(spark, src):
    star = star_join(golden.spec(), src)
    assert star.columns == [
        "StartTimestamp", "EndTimestamp", "EventCost", "CaseID", "CustomerName", "CustomerSegment",
        "InvoiceTotalAmountWithoutVAT", "Region", "Activity", "Resource", "ResourceKey",
    ]


def test_event_log_rows(spark, src):
    log = eventlog.event_log(golden.spec(), src)
    rows = {r["EventCost"]: r for r in log.collect()}
    assert len(rows) == 4
    unmatched = rows[4.0]
    assert unmatched["Activity"] is None and unmatched["CaseID"] is None  # DEC-14
    assert rows[1.0]["Resource"] is None and rows[1.0]["ResourceKey"] is None
    assert rows[5.0]["Activity"] == "Create" and rows[2.5]["Resource"] == "R8"
    assert dict(log.dtypes)["CaseID"] == "bigint"
    assert dict(log.dtypes)["StartTimestamp"] == "timestamp_ntz"


def test_config_document_gives_same_spec(spark, src):
    from_doc = ImportSpec.from_config(golden.CONFIG)
    assert from_doc.datasets == golden.spec().datasets
    assert from_doc.attributes == golden.spec().attributes
    again = ImportSpec.from_config(from_doc.to_config())
    assert again == from_doc


def test_fk_orphans(spark, src):
    ev, cs = src["events"], src["cases"]
    act = audit.fk_orphans(ev, src["activity"], "Activity_id", "Activity_id").collect()
    assert [tuple(r) for r in act] == [(99, 1)]
    assert audit.fk_orphans(ev, src["resource"], "Resource_id", "Resource_id").count() == 0
    assert [tuple(r) for r in audit.fk_orphans(ev, cs, "CaseID", "CaseID").collect()] == [(3, 1)]


def test_cases_without_events(spark, src):
    rows = audit.cases_without_events(src["events"], src["cases"], "CaseID", "CaseID").collect()
    assert [r["CaseID"] for r in rows] == [4]


def test_finance_per_event_by_case(spark, src):
    out = eventlog.finance(golden.spec(), src, "EventCost")
    assert {r["CaseID"]: r["total"] for r in out.collect()} == {1: 7.5, 2: 1.0, None: 4.0}


def test_finance_per_case_by_segment(spark, src):
    out = eventlog.finance(golden.spec(), src, "InvoiceTotalAmountWithoutVAT", by=["CustomerSegment"])
    assert {r["CustomerSegment"]: r["total"] for r in out.collect()} == {"A": 100.0, "B": 50.0, None: None}


def test_activity_first_last(spark, src):
    spec = golden.spec()
    log = eventlog.event_log(spec, src)
    r = spec.roles()
    rules = {"first": ("Activity", "First"), "last": ("Activity", "Last")}
    got = {row["CaseID"]: (row["first"], row["last"]) for row in cases.case_values(log, r.case, r.order(), rules).collect()}
    assert got[1] == ("Create", "Approve")
    assert got[2] == ("Create", "Create")


def test_case_table(spark, src):
    out = eventlog.case_table(golden.spec(), src)
    rows = {r["CaseID"]: r for r in out.collect()}
    assert set(rows) == {1, 2, None}  # case 4 has no events (DEC-12)
    assert rows[1]["n_events"] == 2 and rows[1]["CustomerName"] == "Ann"
    assert str(rows[1]["end_ts"]) == "2024-01-01 10:15:00"


def test_case_attributes_on_events(spark, src):
    log = eventlog.event_log(golden.spec(), src, case_attributes_on_events=True)
    assert log.count() == 4
    by_cost = {r["EventCost"]: r for r in log.collect()}
    assert by_cost[2.5]["CustomerName"] == "Ann"
