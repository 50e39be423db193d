"""Star assembly: one row per event, with its case and lookup attributes (J1–J6, P1–P3).

Plan shape (DEC-1: every join is a left join from the events side):

    cases  ──left──> case lookups          (snowflake arm, joined on the cases side first)
    events ──left──> cases_wide ──left──> event lookups

The snowflake arm is joined before the events meet the cases, so the wide events rows are
shuffled once on the case key instead of once more on a case-lookup key. Broadcast versus
shuffle is left to Catalyst and AQE: a lookup is broadcast only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks with runtime sizes), otherwise
it is a sort-merge join on the typed key. A hot foreign key (one key holding a third of the
events, or many null keys) lands in one shuffle partition of the events side; AQE's skew-join
rule splits that partition, which it supports for left outer joins with the skew on the left.

Key check (DEC-2): with ``check_keys`` on, building the star first runs one job over the typed key
columns of every join target of the spec that has no certificate yet, whatever ``columns`` asks for
(``operators.certificates``); a repeated key raises. The check is an action of its own, so no filter, join or pruning of the result can remove
it, and the joins stay exactly as without it, directly on their shuffles, which AQE's skew-join
rule needs.

Split builds (``split_parts``, ``far_parts``): the same pieces, cut at one events edge and not
joined there, for callers that reduce the events per key of that edge before the join
(``plans.eventlog.group_aggregate``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import quote, typed_key
from ..plans.names import OutputColumn, edge_label, edge_owners, hidden_keys, output_columns
from ..plans.spec import KIND_CASES, Dataset, ImportSpec, JoinEdge, SpecError
from .certificates import DuplicateKeyError, check_targets  # noqa: F401


def project(df: DataFrame, columns: list[str] | tuple[str, ...], hide: set[str] | None = None) -> DataFrame:
    """Keep the included columns, minus hidden ones, in the given order (P1, P2)."""
    hide = hide or set()
    known = set(df.columns)
    missing = [c for c in columns if c not in known]
    if missing:
        raise SpecError(f"columns not in the source: {missing}")
    return df.select(*[F.col(quote(c)) for c in columns if c not in hide])


def _check_columns(d: Dataset, schema: dict) -> None:
    missing = [c for c in d.columns if c not in schema]
    if missing:
        raise SpecError(f"{d.name}: columns not in the source: {missing}")


def check_unique_keys(spec: ImportSpec, sources: Mapping[str, DataFrame]) -> None:
    """Raise on a repeated (typed, non-null) key of any join target of ``spec``.

    Targets that hold a certificate are not read again; one job checks all the others
    (``operators.certificates``).
    """
    targets: dict[tuple[str, str, str], Column] = {}
    for owner in edge_owners(spec):
        for j in owner.joins:
            what = (j.target_dataset, j.target_column, j.key_type)
            if what in targets or j.target_dataset not in sources:
                continue
            schema = {f.name: f.dataType for f in sources[j.target_dataset].schema.fields}
            if j.target_column not in schema:
                raise SpecError(f"{j.target_dataset} has no column {j.target_column!r}")
            targets[what] = typed_key(F.col(quote(j.target_column)), schema[j.target_column], j.key_type,
                                      where=f"{j.target_dataset}.{j.target_column}")
    check_targets(sources, targets)


class _Namer:
    def __init__(self) -> None:
        self.i = 0

    def next(self) -> tuple[str, str]:
        self.i += 1
        return f"__s{self.i}", f"__t{self.i}"


def _lookup_side(src: DataFrame, target: Dataset, edge: JoinEdge, key_name: str,
                 cols: list[OutputColumn]) -> DataFrame:
    schema = {f.name: f.dataType for f in src.schema.fields}
    if edge.target_column not in schema:
        raise SpecError(f"{target.name} has no column {edge.target_column!r}")
    key = typed_key(F.col(quote(edge.target_column)), schema[edge.target_column], edge.key_type,
                    where=f"{target.name}.{edge.target_column}")
    side = src.select(key.alias(key_name), *[F.col(quote(c.source)).alias(c.name) for c in cols])
    return side.filter(F.col(key_name).isNotNull())


def _source_key(df_schema: dict, owner: Dataset, edge: JoinEdge) -> Column:
    if edge.source_column not in df_schema:
        raise SpecError(f"{owner.name} has no column {edge.source_column!r}")
    return typed_key(F.col(quote(edge.source_column)), df_schema[edge.source_column], edge.key_type,
                     where=f"{owner.name}.{edge.source_column}")


def _attach_lookups(base: DataFrame, owner: Dataset, spec: ImportSpec, sources: Mapping[str, DataFrame],
                    keys: dict[JoinEdge, str], out_cols: list[OutputColumn], namer: _Namer,
                    checked: bool) -> DataFrame:
    """Left-join every lookup edge of ``owner`` onto ``base`` (which carries typed keys)."""
    for j in owner.joins:
        target = spec.dataset(j.target_dataset)
        if target.kind == KIND_CASES:
            continue
        cols = [c for c in out_cols if c.via == edge_label(owner, j)]
        if not cols and checked:
            # Keys checked unique: a left join that adds no column cannot change the rows. Catalyst
            # cannot prove the keys unique, so it would keep the join; the builder drops it.
            continue
        _, tname = namer.next()
        side = _lookup_side(sources[target.name], target, j, tname, cols)
        base = base.join(side, base[keys[j]] == side[tname], "left")
    return base


def is_case_side(spec: ImportSpec, c: OutputColumn) -> bool:
    """True for columns of the cases dataset, its lookups and its export names."""
    cs = spec.cases
    return cs is not None and (c.dataset == cs.name and not c.via or c.via.startswith(cs.name + "."))


@dataclass(frozen=True)
class SplitParts:
    """A star split at one edge: the near side and the edge's target, not yet joined.

    ``near``: events with every other join needed for ``columns``, plus ``near_key`` (the typed
    key of the split edge). ``far``: the edge's target (for the cases link, the cases table
    with its lookups), with ``far_key``. ``far_columns``: output columns on the far side.
    """

    near: DataFrame
    near_key: str
    far: DataFrame
    far_key: str
    far_columns: tuple[str, ...]


def split_edge_of(spec: ImportSpec, column: str) -> JoinEdge | None:
    """The events edge whose far side supplies ``column``: the cases link for cases-side
    columns, the lookup edge for an events-lookup column; None for an events column."""
    c = next((o for o in output_columns(spec) if o.name == column), None)
    if c is None:
        raise SpecError(f"{column!r} is not a star output column")
    if is_case_side(spec, c):
        return spec.case_edge()
    for j in spec.events.joins:
        if c.via == edge_label(spec.events, j):
            return j
    return None


def split_parts(spec: ImportSpec, sources: Mapping[str, DataFrame], columns: list[str] | tuple[str, ...],
                edge: JoinEdge, check_keys: bool | None = None) -> SplitParts:
    """Build both sides of the star split at the events ``edge`` for the named output columns.

    Callers that reduce events per group of a far-side column aggregate ``near`` by
    ``near_key`` first and join the result to ``far``: events are then shuffled only as
    partial aggregates, and the join runs over one row per key.
    """
    spec.validate(require_roles=False)
    if edge not in spec.events.joins:
        raise SpecError("split_parts splits at an edge of the events dataset")
    check = _checked(spec, sources, check_keys)
    out_cols = _wanted(output_columns(spec), columns)
    namer = _Namer()
    target = spec.dataset(edge.target_dataset)
    on_cases = target.kind == KIND_CASES
    if on_cases:
        far_cols = [c for c in out_cols if is_case_side(spec, c)]
    else:
        far_cols = [c for c in out_cols if c.via == edge_label(spec.events, edge)]
    near_cols = [c for c in out_cols if c not in far_cols]
    base, ev_keys = _events_select(spec, sources, near_cols, namer)
    if not on_cases and any(is_case_side(spec, c) for c in near_cols):
        cases_wide, case_key = _cases_wide(spec, sources, near_cols, namer, check)
        base = base.join(cases_wide, base[ev_keys[spec.case_edge()]] == cases_wide[case_key], "left")
    others = replace(spec.events, joins=tuple(j for j in spec.events.joins if j != edge))
    base = _attach_lookups(base, others, spec, sources, ev_keys, near_cols, namer, check)
    near = base.select(*[_final_column(spec, c, ev_keys) for c in near_cols], F.col(ev_keys[edge]))
    far, far_key = _far_side(spec, sources, edge, far_cols, namer, check)
    return SplitParts(near, ev_keys[edge], far, far_key, tuple(c.name for c in far_cols))


def far_parts(spec: ImportSpec, sources: Mapping[str, DataFrame], columns: list[str] | tuple[str, ...],
              edge: JoinEdge, check_keys: bool | None = None) -> tuple[DataFrame, str, tuple[str, ...]]:
    """Only the far side of ``split_parts``: ``(far, far_key, far_columns)``.

    The events dataset is not read; callers that kept per-key partial results (for example
    per micro-batch of a stream) join them to this side.
    """
    spec.validate(require_roles=False)
    check = _checked(spec, sources, check_keys)
    out_cols = _wanted(output_columns(spec), columns)
    if spec.dataset(edge.target_dataset).kind == KIND_CASES:
        far_cols = [c for c in out_cols if is_case_side(spec, c)]
    else:
        far_cols = [c for c in out_cols if c.via == edge_label(spec.events, edge)]
    far, far_key = _far_side(spec, sources, edge, far_cols, _Namer(), check)
    return far, far_key, tuple(c.name for c in far_cols)


def _checked(spec: ImportSpec, sources: Mapping[str, DataFrame], check_keys: bool | None) -> bool:
    """Run the key check unless it is off; True if keys are known to be unique."""
    check = spec.check_keys if check_keys is None else check_keys
    if check:
        check_unique_keys(spec, sources)
    return check


def _far_side(spec: ImportSpec, sources: Mapping[str, DataFrame], edge: JoinEdge, far_cols: list[OutputColumn],
              namer: _Namer, check: bool) -> tuple[DataFrame, str]:
    target = spec.dataset(edge.target_dataset)
    if target.kind == KIND_CASES:
        far, far_key = _cases_wide(spec, sources, far_cols, namer, check)
    else:
        _, far_key = namer.next()
        far = _lookup_side(sources[target.name], target, edge, far_key, far_cols)
    return far.select(*[F.col(quote(c.name)) for c in far_cols], F.col(far_key)), far_key


def _wanted(out_cols: list[OutputColumn], columns: list[str] | tuple[str, ...] | None) -> list[OutputColumn]:
    if columns is None:
        return out_cols
    known = {c.name for c in out_cols}
    unknown = [c for c in columns if c not in known]
    if unknown:
        raise SpecError(f"not star output columns: {unknown}")
    wanted = set(columns)
    return [c for c in out_cols if c.name in wanted]


def _events_select(spec: ImportSpec, sources: Mapping[str, DataFrame], out_cols: list[OutputColumn],
                   namer: _Namer) -> tuple[DataFrame, dict[JoinEdge, str]]:
    """The events dataset narrowed to its output columns plus one typed key per edge."""
    ev = spec.events
    for d in spec.datasets:
        if d.name not in sources:
            raise SpecError(f"no source for dataset {d.name!r}")
    ev_src = sources[ev.name]
    ev_schema = {f.name: f.dataType for f in ev_src.schema.fields}
    _check_columns(ev, ev_schema)
    ev_keys: dict[JoinEdge, str] = {}
    sel: list[Column] = [F.col(quote(c.source)).alias(c.name) for c in out_cols
                         if c.dataset == ev.name and not c.via and not c.export]
    for j in ev.joins:
        sname, _ = namer.next()
        ev_keys[j] = sname
        sel.append(_source_key(ev_schema, ev, j).alias(sname))
    return ev_src.select(*sel), ev_keys


def _cases_wide(spec: ImportSpec, sources: Mapping[str, DataFrame], out_cols: list[OutputColumn],
                namer: _Namer, check: bool) -> tuple[DataFrame, str]:
    """The cases dataset with its lookups joined, keyed by the typed link target."""
    cs = spec.cases
    link = spec.case_edge()
    cs_src = sources[cs.name]
    cs_schema = {f.name: f.dataType for f in cs_src.schema.fields}
    _check_columns(cs, cs_schema)
    if link.target_column not in cs_schema:
        raise SpecError(f"{cs.name} has no column {link.target_column!r}")
    _, case_key = namer.next()
    cs_keys: dict[JoinEdge, str] = {}
    sel: list[Column] = [
        typed_key(F.col(quote(link.target_column)), cs_schema[link.target_column], link.key_type,
                  where=f"{cs.name}.{link.target_column}").alias(case_key)
    ]
    sel += [F.col(quote(c.source)).alias(c.name) for c in out_cols
            if c.dataset == cs.name and not c.via and not c.export]
    for j in cs.joins:
        sname, _ = namer.next()
        cs_keys[j] = sname
        sel.append(_source_key(cs_schema, cs, j).alias(sname))
    wanted_exports = {c.name for c in out_cols if c.export and c.dataset == cs.name}
    sel += [_source_key(cs_schema, cs, j).alias(j.export_name) for j in cs.joins
            if j.export_name in wanted_exports]
    cases_wide = cs_src.select(*sel).filter(F.col(case_key).isNotNull())
    cases_wide = _attach_lookups(cases_wide, cs, spec, sources, cs_keys, out_cols, namer, check)
    return cases_wide, case_key


def _final_column(spec: ImportSpec, c: OutputColumn, ev_keys: dict[JoinEdge, str]) -> Column:
    if c.export and c.dataset == spec.events.name:
        edge = next(j for j in spec.events.joins if j.source_column == c.source and j.export_name == c.name)
        return F.col(ev_keys[edge]).alias(c.name)
    return F.col(quote(c.name))


def star_join(spec: ImportSpec, sources: Mapping[str, DataFrame], check_keys: bool | None = None,
              columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """Assemble the star: one row per event (exactly one when target keys are unique).

    ``columns`` limits the output to those names. With the key check on, a lookup (or the
    cases table) that contributes none of them is not joined at all.
    """
    spec.validate(require_roles=False)
    check = _checked(spec, sources, check_keys)
    out_cols = _wanted(output_columns(spec), columns)
    namer = _Namer()
    cs = spec.cases

    # Events side: included columns, typed foreign keys, export names.
    base, ev_keys = _events_select(spec, sources, out_cols, namer)

    # Cases side with its own lookups, then the events -> cases link.
    needs_cases = cs is not None and (not check or any(is_case_side(spec, c) for c in out_cols))
    if needs_cases:
        cases_wide, case_key = _cases_wide(spec, sources, out_cols, namer, check)
        link = spec.case_edge()
        base = base.join(cases_wide, base[ev_keys[link]] == cases_wide[case_key], "left")

    base = _attach_lookups(base, spec.events, spec, sources, ev_keys, out_cols, namer, check)
    return base.select(*[_final_column(spec, c, ev_keys) for c in out_cols])
