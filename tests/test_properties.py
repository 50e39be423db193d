"""Property tests: config round trip of generated specs; type-family normalization."""

from hypothesis import given, settings
from hypothesis import strategies as st

from starweave.functions.types import (
    BOOLEAN_NAMES, FLOAT_NAMES, INT_NAMES, OTHER_AS_STRING_NAMES, STRING_NAMES, TIMESTAMP_NAMES, type_family,
)
from starweave.plans.spec import ImportSpec, attr, cases, edge, events, lookup

NAMES = st.text(alphabet="abcdefghijklmnopqrstuvwxyz_", min_size=1, max_size=8)
KNOWN = INT_NAMES + FLOAT_NAMES + STRING_NAMES + BOOLEAN_NAMES + TIMESTAMP_NAMES + OTHER_AS_STRING_NAMES


@st.composite
def specs(draw):
    cols = draw(st.lists(NAMES, min_size=2, max_size=5, unique=True))
    n_lookups = draw(st.integers(0, 3))
    lookups = [lookup(f"lk{i}", draw(st.lists(NAMES, max_size=3, unique=True))) for i in range(n_lookups)]
    edges = [edge(f"fk{i}", f"lk{i}", "id", key_type=draw(st.sampled_from(["Integer", "String"])),
                  export_name=draw(st.one_of(st.none(), st.just(f"x{i}"))), prefix=draw(st.sampled_from(["", "p_"])))
             for i in range(n_lookups)]
    with_cases = draw(st.booleans())
    datasets = [events("ev", cols + [f"fk{i}" for i in range(n_lookups)], *edges,
                       *([edge("cfk", "cs", "cid")] if with_cases else []))]
    if with_cases:
        datasets.append(cases("cs", ["cid", "cattr"]))
    datasets += lookups
    attrs = (attr(cols[0], "Integer", "Case", "Case"), attr(cols[1], "String", "Activity"),
             attr("start", "Date", "Start"))
    code = draw(st.sampled_from([None, "csv", "parquet", "table"]))
    return ImportSpec(tuple(datasets), attrs, source_format=code)


@settings(max_examples=60, deadline=None)
@given(specs())
def test_config_round_trip(spec):
    again = ImportSpec.from_config(spec.to_config())
    assert again.datasets == spec.datasets
    assert again.attributes == spec.attributes
    assert again.source_format == spec.source_format


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(KNOWN), st.sampled_from(["", " ", "  "]), st.sampled_from(["", " "]), st.booleans())
def test_type_family_ignores_case_and_padding(name, left, right, upper):
    padded = left + (name.upper() if upper else name) + right
    assert type_family(padded) == type_family(name)
    assert type_family(name) in ("int", "double", "string", "boolean", "timestamp")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz<>,:_0123456789", min_size=1, max_size=20))
def test_unknown_names_pass_through(name):
    family = type_family(name)
    if name not in KNOWN and not name.startswith(("decimal", "varchar", "char", "nvarchar")):
        assert family == name
