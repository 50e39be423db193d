"""Inputs that must be rejected (FIXTURES.md §4) and the one-row-per-event invariant."""

from dataclasses import replace

import pytest

import golden
from starweave.operators.star import star_join
from starweave.plans.spec import ImportSpec, SpecError, attr, cases, edge, events, lookup


def _spec(*datasets, attributes=()):
    return ImportSpec(tuple(datasets), tuple(attributes))


def test_missing_events_dataset():
    with pytest.raises(SpecError, match="events"):
        _spec(lookup("a", ["x"])).validate(require_roles=False)


def test_cases_without_link():
    with pytest.raises(SpecError, match="link"):
        _spec(events("e", ["x"]), cases("c", ["y"])).validate(require_roles=False)


def test_two_datasets_with_one_name():
    with pytest.raises(SpecError, match="share a name"):
        _spec(events("e", ["x"], edge("k", "a", "k")), lookup("a", ["x"]), lookup("a", ["y"])).validate(
            require_roles=False)


def test_edge_to_unknown_dataset():
    with pytest.raises(SpecError, match="not in the spec"):
        _spec(events("e", ["x"], edge("k", "nowhere", "k"))).validate(require_roles=False)


def test_join_declared_on_lookup():
    bad = replace(lookup("a", ["x"]), joins=(edge("x", "b", "x"),))
    with pytest.raises(SpecError, match="cannot declare joins"):
        _spec(events("e", ["x"], edge("k", "a", "k")), bad, lookup("b", ["y"])).validate(require_roles=False)


def test_case_and_activity_roles_required():
    base = golden.spec()
    no_case = base.with_attributes(*[a for a in base.attributes if a.import_type != "Case"])
    with pytest.raises(SpecError, match="Case role"):
        no_case.validate()
    two_cases = base.with_attributes(*base.attributes, attr("Region2", "String", "Case"))
    with pytest.raises(SpecError, match="Case role"):
        two_cases.validate()
    no_activity = base.with_attributes(*[a for a in base.attributes if a.import_type != "Activity"])
    with pytest.raises(SpecError, match="Activity role"):
        no_activity.validate()


def test_clashing_output_names(spark):
    src = golden.frames(spark)
    spec = _spec(
        events("events", ["EventCost"], edge("Activity_id", "activity", "Activity_id"),
               edge("Resource_id", "resource", "Resource_id", export_name="EventCost")),
        lookup("activity", ["Activity"]), lookup("resource", ["Resource"]))
    with pytest.raises(SpecError, match="clash"):
        star_join(spec, src)


def test_shared_lookup_needs_prefix(spark):
    src = golden.frames(spark)
    spec = _spec(
        events("events", ["EventCost"], edge("Activity_id", "activity", "Activity_id"),
               edge("Resource_id", "activity", "Activity_id")),
        lookup("activity", ["Activity"]))
    with pytest.raises(SpecError, match="clash"):
        star_join(spec, src)
    ok = _spec(
        events("events", ["EventCost"], edge("Activity_id", "activity", "Activity_id", prefix="a_"),
               edge("Resource_id", "activity", "Activity_id", prefix="r_")),
        lookup("activity", ["Activity"]))
    shared = star_join(ok, src)
    assert shared.columns == ["EventCost", "a_Activity", "r_Activity"]
    assert shared.count() == 4  # one key check for the shared lookup, not one per edge


def test_duplicate_target_key_raises_with_check(spark):
    src = golden.frames(spark)
    dup = src["activity"].union(spark.createDataFrame([(10, "Again")], "Activity_id int, Activity string"))
    spec = golden.spec()
    with pytest.raises(Exception, match="duplicate key in activity.Activity_id: 10"):
        star_join(spec, {**src, "activity": dup}).collect()
    # Check off: the duplicate fans the two events of activity 10 out into four rows.
    assert star_join(spec, {**src, "activity": dup}, check_keys=False).count() == 6


def test_one_row_per_event_when_keys_unique(spark):
    src = golden.frames(spark)
    assert star_join(golden.spec(), src).count() == src["events"].count()


def test_floating_key_with_integer_join_type(spark):
    src = golden.frames(spark)
    ev = src["events"].withColumn("Activity_id", src["events"]["Activity_id"].cast("double"))
    with pytest.raises(TypeError, match="cannot be an Integer join key"):
        star_join(golden.spec(), {**src, "events": ev})


def test_string_key_matches_integer_key(spark):
    src = golden.frames(spark)
    ev = src["events"].withColumn("Activity_id", src["events"]["Activity_id"].cast("string"))
    rows = star_join(golden.spec(), {**src, "events": ev}).select("EventCost", "Activity").collect()
    assert {r["EventCost"]: r["Activity"] for r in rows} == {5.0: "Create", 2.5: "Approve", 1.0: "Create", 4.0: None}


def test_unknown_attribute_type():
    with pytest.raises(SpecError, match="SourceDataType"):
        golden.spec().with_attributes(attr("x", "Money")).validate(require_roles=False)


def test_config_without_datasets():
    with pytest.raises(SpecError, match="datasets"):
        ImportSpec.from_config({"inputDataBinding": {"dataSource": {}}})
