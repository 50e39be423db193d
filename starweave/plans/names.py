"""Output names: one for each use of a column, whichever dataset and edge it is reached through (DEC-6).

A column is used once by its own dataset (events, cases) and once per edge that leads to a lookup. Its name
is the edge's alias for it, else the edge's prefix and the dataset's alias or the column's own name; the
prefix and aliases of the events' link apply to the columns of the cases. Spark compares names without
case, and so does this module.

Two uses may ask for one name. Under ``naming="strict"`` that is an error. Under ``"qualify"``, which is
how config documents are read, because they name a dataset once however often it is used, the first use
keeps the bare name, which is the one that the document's attributes mean; a later use of a cases column
gets ``<cases>_<column>``, of a lookup column ``<key column>_<column>``, of an export name
``<dataset>_<name>``, and a number if that is taken too. Names given by alias or prefix are never changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from .spec import KIND_CASES, Attribute, Dataset, ImportSpec, JoinEdge, SpecError


@dataclass(frozen=True)
class OutputColumn:
    name: str          # name in the star output
    dataset: str       # dataset it comes from
    source: str        # column in that dataset
    via: str = ""      # edge label for lookup columns; "" for events/cases columns
    export: bool = False


@dataclass(frozen=True)
class _Use:
    asked: str        # name that spec or document asks for
    fixed: bool       # given by alias or prefix
    qualified: str    # name of a later use of the same column name
    column: OutputColumn


def hidden_keys(d: Dataset) -> set[str]:
    """Columns of ``d`` used as a join source: hidden from its output (P2)."""
    return {j.source_column for j in d.joins}


def edge_owners(spec: ImportSpec) -> list[Dataset]:
    return [spec.events] + ([spec.cases] if spec.cases is not None else [])


def edge_label(owner: Dataset, edge: JoinEdge) -> str:
    """What tells one use of a target from another."""
    own = [edge.prefix, *(f"{c}={n}" for c, n in edge.aliases), edge.export_name or ""]
    marks = f" {own}" if any(own) else ""
    return f"{owner.name}.{edge.source_column}->{edge.target_dataset}.{edge.target_column}{marks}"


def _use(d: Dataset, column: str, edge: JoinEdge | None, qualifier: str, via: str) -> _Use:
    own = dict(d.aliases).get(column)
    alias = dict(edge.aliases).get(column) if edge is not None else None
    prefix = edge.prefix if edge is not None else ""
    asked = alias or prefix + (own or column)
    return _Use(asked, bool(alias or prefix or own), f"{qualifier}_{column}", OutputColumn(asked, d.name, column, via))


def _uses(spec: ImportSpec) -> list[_Use]:
    """Every use, in output order: events, cases, lookups per edge, export names."""
    ev, cs = spec.events, spec.cases
    out = [_use(ev, c, None, ev.name, "") for c in ev.columns if c not in hidden_keys(ev)]
    if cs is not None:
        out += [_use(cs, c, spec.case_edge(), cs.name, "") for c in cs.columns if c not in hidden_keys(cs)]
    for owner in edge_owners(spec):
        for j in owner.joins:
            target = spec.dataset(j.target_dataset)
            if target.kind != KIND_CASES:
                out += [_use(target, c, j, j.source_column, edge_label(owner, j)) for c in target.columns]
    for owner in edge_owners(spec):
        for j in owner.joins:
            if j.export_name:
                column = OutputColumn(j.export_name, owner.name, j.source_column, via="", export=True)
                out.append(_Use(j.export_name, False, f"{owner.name}_{j.export_name}", column))
    return out


def output_columns(spec: ImportSpec) -> list[OutputColumn]:
    """The star's output columns, in order, each under its own name."""
    uses = _uses(spec)
    asked = [u.asked.casefold() for u in uses]
    fixed = [u.asked.casefold() for u in uses if u.fixed]
    clash = sorted({u.asked for u in uses if asked.count(u.asked.casefold()) > 1}) if spec.naming == "strict" else \
        sorted({u.asked for u in uses if u.fixed and fixed.count(u.asked.casefold()) > 1})
    if clash:
        raise SpecError(f"output names clash: {clash}; give the edge a prefix or an alias, or the key an export name (DEC-6)")
    taken, out = set(fixed), []
    for u in uses:
        name = u.asked
        if not u.fixed and name.casefold() in taken:
            name, n = u.qualified, 1
            while name.casefold() in taken:
                n += 1
                name = f"{u.qualified}_{n}"
        taken.add(name.casefold())
        out.append(replace(u.column, name=name))
    return out


def with_derived_attributes(spec: ImportSpec) -> ImportSpec:
    """``spec`` with an attribute for each further use of a column whose bare name has one.

    It has the type, rules and flags of that attribute, but no role and no finance type, which are the
    first use's alone; a column of the cases is of Case level.
    """
    by_name = {a.name: a for a in spec.attributes}
    cases = spec.cases.name if spec.cases is not None else None
    more: list[Attribute] = []
    for u, c in zip(_uses(spec), output_columns(spec)):
        bare = by_name.get(c.source if not c.export else u.asked)
        if c.name in by_name or bare is None or c.name == bare.name:
            continue
        level = "Case" if c.dataset == cases and not c.export else bare.level
        more.append(replace(bare, name=c.name, import_type="Other", finance="None", level=level))
    return replace(spec, attributes=(*spec.attributes, *more)) if more else spec


def with_names(spec: ImportSpec, prefixes: dict[tuple[str, str], str] | None = None,
               aliases: dict[tuple[str, str, str], str] | None = None) -> ImportSpec:
    """``spec`` with prefixes by (dataset, key column) of an edge, and aliases by (dataset, key column, column).

    An alias with an empty key column names a column of the dataset itself.
    """
    prefixes, aliases = dict(prefixes or {}), dict(aliases or {})
    used: set[tuple] = set()

    def edge(d: Dataset, j: JoinEdge) -> JoinEdge:
        own = {c: n for (name, key, c), n in aliases.items() if (name, key) == (d.name, j.source_column)}
        target = {*spec.dataset(j.target_dataset).columns}
        used.update((d.name, j.source_column, c) for c in own if c in target)
        used.add((d.name, j.source_column))
        return replace(j, prefix=prefixes.get((d.name, j.source_column), j.prefix),
                       aliases=tuple({**dict(j.aliases), **own}.items()))

    datasets = []
    for d in spec.datasets:
        own = {c: n for (name, key, c), n in aliases.items() if name == d.name and not key}
        used.update((d.name, "", c) for c in own if c in d.columns)
        datasets.append(replace(d, joins=tuple(edge(d, j) for j in d.joins), aliases=tuple({**dict(d.aliases), **own}.items())))
    lost = [k for k in (*prefixes, *aliases) if k not in used]
    if lost:
        raise SpecError(f"no such edge or column: {lost}")
    return replace(spec, datasets=tuple(datasets))
