"""Attribute projections on an assembled star: types, defaults, flags, roles (P4–P9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.types import ATTRIBUTE_SPARK_TYPE, default_literal, observed_losses, quote, to_attribute_type
from ..plans.spec import Attribute, Roles, SpecError
from .audit import count_values

# Canonical role column names of an event log.
ROLE_COLUMNS = (("case", "case_id"), ("activity", "activity"), ("start", "start_ts"),
                ("end", "end_ts"), ("resource", "resource"))


def _metadata(a: Attribute) -> dict:
    return {
        "import_type": a.import_type,
        "level": a.level,
        "finance": a.finance,
        "case_handling": a.handling,
        "display": bool(a.is_display),
        "excluded": bool(a.is_excluded),
    }


def apply_attributes(star: DataFrame, attributes: Sequence[Attribute], drop_excluded: bool = True,
                     metadata: bool = True, losses: Observation | None = None) -> DataFrame:
    """Type, default and flag each attribute column of the star, in one projection.

    SourceDataType casts with ``try_cast`` (P5); a non-empty DefaultValue fills nulls (P6,
    DEC-7); the attribute's role, level, rules and display flag ride along as column metadata
    (P8); ``IsExcluded`` columns are dropped last (P7, DEC-8). Columns without an attribute pass
    through unchanged. With ``metadata=False`` (internal uses) the projection is skipped when it
    would change nothing. ``losses`` counts, per attribute, the values that its type turns into null,
    before defaults fill them (``functions.types.cast_losses``).
    """
    fields = {f.name: f.dataType for f in star.schema.fields}
    by_name = {a.name: a for a in attributes}
    unknown = [n for n in by_name if n not in fields]
    if unknown:
        raise SpecError(f"attributes with no column in the star: {unknown}")
    if not metadata and not any(
            (drop_excluded and a.is_excluded) or a.default_value != ""
            or fields[a.name] != ATTRIBUTE_SPARK_TYPE[a.source_data_type] for a in by_name.values()):
        return star
    typed: dict[str, str] = {}
    if losses is not None:
        typed = {n: f"__typed{i}" for i, n in enumerate(by_name)}
        star = observed_losses(star.select("*", *[
            to_attribute_type(F.col(quote(n)), fields[n], by_name[n].source_data_type).alias(t) for n, t in typed.items()]), typed, losses)
    out: list[Column] = []
    for name, dtype in fields.items():
        col = F.col(quote(name))
        a = by_name.get(name)
        if a is None:
            out.append(col)
            continue
        if drop_excluded and a.is_excluded:
            continue
        col = F.col(typed[name]) if typed else to_attribute_type(col, dtype, a.source_data_type)
        if a.default_value != "":
            fallback = default_literal(a.default_value, a.source_data_type)
            col = F.coalesce(col, fallback.cast(ATTRIBUTE_SPARK_TYPE[a.source_data_type]))
        out.append(col.alias(name, metadata=_metadata(a)))
    return star.select(*out)


def excluded_columns(attributes: Sequence[Attribute]) -> list[str]:
    return [a.name for a in attributes if a.is_excluded]


def display_columns(log: DataFrame) -> list[str]:
    """Columns flagged ``IsDisplayAttribute``, from the log's column metadata."""
    return [f.name for f in log.schema.fields if f.metadata.get("display")]


def display_attributes(log: DataFrame) -> DataFrame:
    """One row per display attribute with its number of distinct values, exact.

    Columns: ``attribute``, ``distinct_values``. ``eventlog.display_summary`` gives the same from a spec
    without joining the events.
    """
    names = display_columns(log)
    if not names:
        return log.sparkSession.createDataFrame([], "attribute string, distinct_values bigint")
    return count_values(log, names).select(F.col("column_name").alias("attribute"), F.col("n_distinct").alias("distinct_values"))


def role_projection(log: DataFrame, roles: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """The role columns under canonical names (``case_id, activity, start_ts, end_ts,
    resource``; absent roles are left out), followed by ``keep`` columns unchanged (P9)."""
    cols: list[Column] = []
    for role, canonical in ROLE_COLUMNS:
        source = getattr(roles, role)
        if source:
            cols.append(F.col(quote(source)).alias(canonical))
    cols += [F.col(quote(c)) for c in keep]
    return log.select(*cols)
