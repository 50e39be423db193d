"""Run an import spec: event log, case table and measures as lazy DataFrames.

    spec ─validate─> sources ─star_join─> attributes ─> event_log
                                            └─> case_table / finance / measures

Everything after validation is DataFrame composition; Catalyst sees one plan per output and
prunes unused columns and joins' inputs down to the scans.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.types import MONEY, quote, type_family
from ..operators.amounts import wide_totals
from ..operators.audit import count_values
from ..operators.cases import attach_case_values, finance_totals
from ..operators.project import apply_attributes, excluded_columns
from ..operators.star import output_columns, split_edge_of, split_parts, star_join
from ..session import scratch_path
from .spec import ImportSpec, JoinEdge, SpecError


def attributed(spec: ImportSpec, sources: Mapping[str, DataFrame], check_keys: bool | None,
                columns: list[str] | tuple[str, ...] | None = None, losses: Observation | None = None) -> DataFrame:
    """The star with typed attributes and defaults, excluded attributes still in place."""
    star = star_join(spec, sources, check_keys, columns=columns)
    present = set(star.columns)
    attrs = [a for a in spec.attributes if a.name in present]
    return apply_attributes(star, attrs, drop_excluded=False, losses=losses)


def event_log(spec: ImportSpec, sources: Mapping[str, DataFrame], check_keys: bool | None = None,
              require_roles: bool = True, case_attributes_on_events: bool = False,
              columns: list[str] | tuple[str, ...] | None = None, losses: Observation | None = None) -> DataFrame:
    """One row per event with typed attribute columns (DEC-10).

    With ``case_attributes_on_events`` every Case-level attribute carries its case's First or
    Last value on each event (G3) instead of the event's own value. ``columns`` limits the log
    to those names (plus, for G3, the role and order columns) and skips joins they do not need.
    ``losses`` has, after the first action on the log, the values per attribute that its type turned
    into null (P4, P5).
    """
    spec.validate(require_roles=require_roles)
    if columns is not None and case_attributes_on_events:
        roles = spec.roles()
        columns = list(dict.fromkeys([*columns, roles.case, *roles.order(), *case_rules(spec)]))
    log = attributed(spec, sources, check_keys, columns, losses)
    if case_attributes_on_events:
        roles = spec.roles()
        rules = {k: v for k, v in case_rules(spec).items() if k in log.columns}
        if rules:
            renamed = {f"__cl_{k}": v for k, v in rules.items()}
            values = case_aggregate(spec, sources, rules=renamed, count=None, check_keys=False)
            log = attach_case_values(log, roles.case, values)
            log = log.select(*[(F.col(quote(f"__cl_{c}")) if c in rules else F.col(quote(c))).alias(c)
                               for c in log.columns if not c.startswith("__cl_")])
    gone = set(excluded_columns(spec.attributes))
    return log.select(*[F.col(quote(c)) for c in (log.columns if columns is None else columns) if c not in gone])


def case_rules(spec: ImportSpec) -> dict[str, tuple[str, str]]:
    """``{name: (name, First|Last)}`` for every Case-level attribute except the Case role."""
    return {a.name: (a.name, a.handling) for a in spec.attributes
            if a.level == "Case" and a.import_type != "Case"}


def case_table(spec: ImportSpec, sources: Mapping[str, DataFrame], check_keys: bool | None = None) -> DataFrame:
    """One row per case that has events (DEC-12), built from the events (G1, G2, G4).

    Columns: the case column, ``n_events``, ``start_ts`` (min Start), ``end_ts`` (max End, or
    max Start without an End role, DEC-9), then every Case-level attribute's First or Last.
    """
    out = case_aggregate(spec, sources, check_keys=check_keys, **case_table_measures(spec))
    return drop_excluded_case_columns(spec, out)


def case_table_measures(spec: ImportSpec) -> dict:
    """The reductions of the case table, as keyword arguments of ``group_aggregate``."""
    spec.validate()
    roles = spec.roles()
    return {"rules": case_rules(spec), "mins": {"start_ts": roles.start or roles.end},
            "maxs": {"end_ts": roles.end or roles.start}, "count": "n_events"}


def drop_excluded_case_columns(spec: ImportSpec, table: DataFrame) -> DataFrame:
    case = spec.roles().case
    return table.drop(*[c for c in excluded_columns(spec.attributes) if c != case])


def case_aggregate(spec: ImportSpec, sources: Mapping[str, DataFrame], *,
                   rules: Mapping[str, tuple[str, str]] | None = None,
                   mins: Mapping[str, str] | None = None, maxs: Mapping[str, str] | None = None,
                   sums: Mapping[str, str] | None = None, count: str | None = "n_events",
                   check_keys: bool | None = None) -> DataFrame:
    """Reduce the events of each case: one row per case that has events (see ``group_aggregate``)."""
    spec.validate()
    return group_aggregate(spec, sources, spec.roles().case, rules=rules, mins=mins, maxs=maxs, sums=sums,
                           count=count, check_keys=check_keys)


@dataclass(frozen=True)
class GroupPlan:
    """What ``group_aggregate`` computes, resolved against the spec (no data touched)."""

    group: str
    rules: dict
    mins: dict
    maxs: dict
    sums: dict
    count: str | None
    order: list
    needed: list
    edge: JoinEdge | None

    def names(self) -> list[str]:
        return ([self.count] if self.count else []) + [*self.mins, *self.maxs, *self.rules, *self.sums]


def group_plan(spec: ImportSpec, group: str, *, rules: Mapping[str, tuple[str, str]] | None = None,
               mins: Mapping[str, str] | None = None, maxs: Mapping[str, str] | None = None,
               sums: Mapping[str, str] | None = None, count: str | None = "n_events",
               order: list[str] | None = None) -> GroupPlan:
    spec.validate()
    roles = spec.roles()
    rules, mins, maxs, sums = dict(rules or {}), dict(mins or {}), dict(maxs or {}), dict(sums or {})
    order = list(roles.order() if order is None else order)
    cols = {c.name for c in output_columns(spec)}
    referenced = [group, *order, *[c for c, _ in rules.values()], *mins.values(), *maxs.values(),
                  *sums.values()]
    missing = [c for c in referenced if c not in cols]
    if missing:
        raise SpecError(f"not columns of the event log: {sorted(set(missing))}")
    return GroupPlan(group, rules, mins, maxs, sums, count, order, list(dict.fromkeys(referenced)),
                     split_edge_of(spec, group))


def group_aggregate(spec: ImportSpec, sources: Mapping[str, DataFrame], group: str, *,
                    rules: Mapping[str, tuple[str, str]] | None = None,
                    mins: Mapping[str, str] | None = None, maxs: Mapping[str, str] | None = None,
                    sums: Mapping[str, str] | None = None, count: str | None = "n_events",
                    order: list[str] | None = None, check_keys: bool | None = None) -> DataFrame:
    """Reduce the events of each value of ``group``: one row per value that has events.

    Output: ``group``, then ``count`` (if named), ``mins``, ``maxs``, ``rules`` (First or Last
    in ``order``, by default the DEC-3 order) and ``sums`` (added exactly as ``MONEY``, returned
    as double), each a mapping from output name to attribute.

    When ``group`` comes from the far side of an events edge (the cases table, or a lookup such
    as the resource's), the events are reduced *before* they meet that side: grouped by the
    edge's typed key (partial aggregation in every map task, so a hot key never lands whole in
    one task), joined one row per key to the far side, then merged per group. Events are never
    shuffled whole for that join, only as partial aggregates. Far-side values are constant per
    key: Min/Max/Sum use them once per key (Sum weighs by the key's event count) and First/Last
    pair them with the key's first/last event before the merge. Keys with no match have a null
    group and merge into the single null group (DEC-14). Otherwise the event log is grouped
    directly.
    """
    plan = group_plan(spec, group, rules=rules, mins=mins, maxs=maxs, sums=sums, count=count, order=order)
    if plan.edge is None:
        per_key = key_partials(spec, plan, attributed(spec, sources, check_keys, plan.needed), plan.group)
        return finish_group(spec, plan, per_key)
    parts = split_parts(spec, sources, plan.needed, plan.edge, check_keys)
    per_key = key_partials(spec, plan, parts.near, parts.near_key, parts.far_columns)
    return finish_group(spec, plan, per_key, parts.far, parts.far_key, parts.far_columns)


def key_partials(spec: ImportSpec, plan: GroupPlan, near: DataFrame, key: str,
                 far_columns: tuple[str, ...] = ()) -> DataFrame:
    """Per-key partial results: ``__key`` plus one column per decomposable aggregate.

    Partial results of several inputs (say, the micro-batches of a stream) merge with
    ``merge_partials`` before ``finish_group``.
    """
    far = set(far_columns)
    near = _typed(spec, near)
    near_order = [c for c in plan.order if c not in far]
    partials, _ = _reductions(near_order, plan.rules, plan.mins, plan.maxs, plan.sums, plan.count, far)
    return near.groupBy(F.col(quote(key)).alias("__key")).agg(*[e.alias(n) for n, e in partials])


def merge_partials(partials: DataFrame) -> DataFrame:
    """Combine partial results that share a key (from separate inputs) into one row per key."""
    names = [c for c in partials.columns if c.startswith("__") and c != "__key" and c != "__epoch"]
    return partials.groupBy("__key").agg(*[_merge(n) for n in names])


def finish_group(spec: ImportSpec, plan: GroupPlan, per_key: DataFrame, far_df: DataFrame | None = None,
                 far_key: str | None = None, far_columns: tuple[str, ...] = ()) -> DataFrame:
    """From per-key partials to one row per group (see ``group_aggregate``)."""
    far = set(far_columns)
    near_order = [c for c in plan.order if c not in far]
    partials, post = _reductions(near_order, plan.rules, plan.mins, plan.maxs, plan.sums, plan.count, far)
    if far_df is None:
        exprs = dict(post)
        return per_key.select(F.col("__key").alias(plan.group), *[exprs[n].alias(n) for n in plan.names()])
    far_df = _typed(spec, far_df)
    joined = per_key.join(far_df, per_key["__key"] == far_df[far_key], "left")
    # One row per key now: far-side values are constant per key. Pair them with the key's
    # partials, then merge the keys of each group; keys without a match all have a null group.
    steps, far_post = _far_steps(partials, plan.rules, plan.mins, plan.maxs, plan.sums, far, plan.order, near_order)
    merged = joined.groupBy(F.col(quote(plan.group))).agg(*[fn(e).alias(n) for n, fn, e in steps])
    exprs = dict(post + far_post)
    return merged.select(F.col(quote(plan.group)), *[exprs[n].alias(n) for n in plan.names()])


def case_values_on_events(spec: ImportSpec, sources: Mapping[str, DataFrame],
                          rules: Mapping[str, tuple[str, str]], columns: list[str],
                          check_keys: bool | None = None) -> DataFrame:
    """Event rows (``columns``) with their case's First/Last values (G3).

    When the case comes from the cases dataset, the values are keyed by the events' own link
    key: each key gets its case's merged values (a key with no case gets the null-case group's,
    DEC-14), and the events join them on that key. The events are read twice: reduced to one row per
    key, which is written once (an action when this is built), and as rows. They are shuffled once, for
    the join, and never joined to the cases table themselves; a hot case is one hot key there,
    which AQE's skew-join rule splits. Without a cases dataset the values are joined back on
    the case column.
    """
    case = spec.roles().case
    plan = group_plan(spec, case, rules=rules, count=None)
    if plan.edge is None:
        log = attributed(spec, sources, check_keys, list(dict.fromkeys([*columns, case])))
        values = finish_group(spec, plan, key_partials(spec, plan, log, case))
        return attach_case_values(log, case, values).select(*[F.col(quote(c)) for c in [*columns, *rules]])
    parts = split_parts(spec, sources, plan.needed, plan.edge, check_keys)
    far = set(parts.far_columns)
    per_key = key_partials(spec, plan, parts.near, parts.near_key, parts.far_columns)
    # First reading of the events, reduced to one row per link key, kept for the two uses below.
    joined = written(per_key.join(_typed(spec, parts.far), per_key["__key"] == F.col(parts.far_key), "left").drop(parts.far_key),
                     "case-values")
    near_order = [c for c in plan.order if c not in far]
    partials, post = _reductions(near_order, plan.rules, plan.mins, plan.maxs, plan.sums, None, far)
    steps, far_post = _far_steps(partials, plan.rules, plan.mins, plan.maxs, plan.sums, far, plan.order, near_order)
    exprs = dict(post + far_post)
    merges = [fn(e).alias(n) for n, fn, e in steps]
    picked = [exprs[n].alias(n) for n in rules]
    names = [F.col(quote(r)) for r in rules]
    own = F.col(quote(case))
    if _keys_are_cases(spec, sources, case, check_keys):
        # Each matched key is a case of its own; only the keys without a case form one group.
        single = joined.filter(own.isNotNull()).select("__key", own.alias("__c"), *[e.alias(n) for n, _, e in steps]) \
            .select("__key", "__c", *picked)
        nobody = joined.filter(own.isNull())
        group = nobody.agg(*merges).select(F.lit(1).alias("__one"), *picked)
        nobody = nobody.select("__key", own.alias("__c"), F.lit(1).alias("__one")).join(group, "__one")
        by_key = single.unionByName(nobody.drop("__one"))
    else:
        values = joined.groupBy(own.alias("__case")).agg(*merges).select("__case", *picked)
        key_map = joined.select("__key", own.alias("__c"))
        by_key = key_map.join(values, key_map["__c"].eqNullSafe(values["__case"]), "left").select("__key", "__c", *names)
    event_cols = [c for c in columns if c != case]
    side = split_parts(spec, sources, event_cols + [case], plan.edge, check_keys=False)
    link = side.near_key
    events = _typed(spec, side.near.select(*[F.col(quote(c)) for c in event_cols], link))
    out = events.join(by_key, events[link].eqNullSafe(by_key["__key"]), "left")
    picks = [F.col("__c").alias(case) if c == case else F.col(quote(c)) for c in columns]
    return out.select(*picks, *names)


def _keys_are_cases(spec: ImportSpec, sources: Mapping[str, DataFrame], case: str, check_keys: bool | None) -> bool:
    """Whether the case column is the checked link key itself, in a type that keeps different keys apart."""
    link = spec.case_edge()
    column = next(c for c in output_columns(spec) if c.name == case)
    if not (spec.check_keys if check_keys is None else check_keys) or column.source != link.target_column or column.export:
        return False
    attribute = spec.attribute(case)
    kind = sources[column.dataset].schema[column.source].dataType
    family = type_family(kind)
    return family in ("int", "string") and (attribute is None or attribute.source_data_type in (
        ("Integer", "String") if family == "int" else ("String",))) and not (attribute is not None and attribute.default_value)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, whatever is built on it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def display_summary(spec: ImportSpec, sources: Mapping[str, DataFrame], check_keys: bool | None = None) -> DataFrame:
    """``attribute, distinct_values`` of every display attribute (P8), as over the event log but without joining it.

    The events' own attributes are counted where they are. Those that an edge of the events leads to are
    counted over the distinct keys of that edge, joined to its far side (the cases with their lookups, or
    one lookup): an event row never meets a join.
    """
    spec.validate(require_roles=False)
    known = {c.name for c in output_columns(spec)}
    flagged = [a.name for a in spec.attributes if a.is_display and a.name in known]
    by_edge: dict[JoinEdge | None, list[str]] = {}
    for name in flagged:
        by_edge.setdefault(split_edge_of(spec, name), []).append(name)
    out = []
    for edge, names in by_edge.items():
        if edge is None:
            out.append(count_values(attributed(spec, sources, check_keys, names), names))
            continue
        parts = split_parts(spec, sources, names, edge, check_keys)
        keys = parts.near.select(F.col(parts.near_key).alias("__key")).distinct()
        reached = keys.join(parts.far, keys["__key"] == parts.far[parts.far_key], "left")
        out.append(count_values(_typed(spec, reached.select(*[F.col(quote(n)) for n in names])), names))
    if not out:
        return next(iter(sources.values())).sparkSession.createDataFrame([], "attribute string, distinct_values bigint")
    every, *more = out
    for df in more:
        every = every.unionByName(df)
    return every.select(F.col("column_name").alias("attribute"), F.col("n_distinct").alias("distinct_values"))


def summary(spec: ImportSpec, sources: Mapping[str, DataFrame], key: str, name: str | None = None,
            check_keys: bool | None = None) -> DataFrame:
    """Per value of ``key`` (the activity or the resource): ``n_events`` and ``n_cases``
    (distinct non-null cases), as ``operators.measures.summarize`` over the event log (M3, M4).

    When the case comes from the cases dataset and ``key`` does not, the events are first
    reduced to distinct (key, link key) pairs with their counts; only those pairs meet the
    cases side, where each link key resolves to its case (null when it has none, DEC-14).
    """
    spec.validate()
    case = spec.roles().case
    out_name = name or key
    edge = split_edge_of(spec, case)
    far_of_key = edge is not None and split_edge_of(spec, key) == edge
    if edge is None or far_of_key or key == case:
        log = attributed(spec, sources, check_keys, [case, key])
        return log.groupBy(F.col(quote(key)).alias(out_name)).agg(
            F.count(F.lit(1)).alias("n_events"), F.count_distinct(F.col(quote(case))).alias("n_cases"))
    parts = split_parts(spec, sources, [key, case], edge, check_keys)
    near = _typed(spec, parts.near)
    far_df = _typed(spec, parts.far)
    pairs = near.groupBy(F.col(quote(key)).alias("__g"), F.col(parts.near_key).alias("__key")).agg(
        F.count(F.lit(1)).alias("__n"))
    joined = pairs.join(far_df, pairs["__key"] == far_df[parts.far_key], "left")
    return joined.groupBy(F.col("__g").alias(out_name)).agg(
        F.sum("__n").alias("n_events"), F.count_distinct(F.col(quote(case))).alias("n_cases"))


def _typed(spec: ImportSpec, df: DataFrame) -> DataFrame:
    present = set(df.columns)
    return apply_attributes(df, [a for a in spec.attributes if a.name in present], drop_excluded=False,
                            metadata=False)


def _pack(order: list[str], values: list[str]) -> Column:
    fields = [F.col(quote(c)).alias(f"o{i}") for i, c in enumerate(order)]
    fields += [F.col(quote(c)).alias(f"v{i}") for i, c in enumerate(values)]
    if not fields:
        fields = [F.lit(0).alias("o0")]
    return F.struct(*fields)


def _reductions(order: list[str], rules: dict, mins: dict, maxs: dict, sums: dict, count: str | None,
                far: set[str]) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """Decomposable aggregates ``(name, expression)`` over near-side columns, and the output
    expressions over them. Far-side columns are left to ``_far_steps``."""
    aggs: list[tuple[str, Column]] = [("__n", F.count(F.lit(1)))]
    post: list[tuple[str, Column]] = []
    if count:
        post.append((count, F.col("__n")))
    for label, spec_map, fn in (("__min", mins, F.min), ("__max", maxs, F.max)):
        for i, (out, col) in enumerate(spec_map.items()):
            if col not in far:
                aggs.append((f"{label}{i}", fn(F.col(quote(col)))))
                post.append((out, F.col(f"{label}{i}")))
    firsts = [(o, c) for o, (c, how) in rules.items() if how != "Last" and c not in far]
    lasts = [(o, c) for o, (c, how) in rules.items() if how == "Last" and c not in far]
    has_far_first = any(how != "Last" and c in far for c, how in rules.values())
    has_far_last = any(how == "Last" and c in far for c, how in rules.values())
    for label, group, fn, needed in (("__first", firsts, F.min, has_far_first),
                                     ("__last", lasts, F.max, has_far_last)):
        if group or needed:
            aggs.append((label, fn(_pack(order, [c for _, c in group]))))
    for out, (col, how) in rules.items():
        if col not in far:
            label, group = ("__last", lasts) if how == "Last" else ("__first", firsts)
            i = [o for o, _ in group].index(out)
            post.append((out, F.col(label)[f"v{i}"]))
    for i, (out, col) in enumerate(sums.items()):
        if col not in far:
            aggs.append((f"__sum{i}", F.sum(F.col(quote(col)).try_cast(MONEY))))
            post.append((out, F.col(f"__sum{i}").cast("double")))
    return aggs, post


def _far_steps(partials: list[tuple[str, Column]], rules: dict, mins: dict, maxs: dict, sums: dict,
                far: set[str], order: list[str], near_order: list[str]
                ) -> tuple[list[tuple], list[tuple[str, Column]]]:
    """Merge per-key partials per group, folding in far-side values (constant per key).

    First/Last: each key's first (last) event is repacked with the *full* order, far-side order
    columns included, followed by its near-side and far-side values; the merge takes the min
    (max) of those, so keys that share a group are compared in the complete order. Returns
    (name, aggregate, what it merges) and the output expressions of the far-side columns.
    """
    def values(last: bool, on_far: bool) -> list[str]:
        return [c for c, how in rules.values() if (c in far) == on_far and (how == "Last") == last]

    merges: list[tuple] = []
    post: list[tuple[str, Column]] = []
    for name, _ in partials:
        if name not in ("__first", "__last"):
            merges.append((name, _merge_of(name), F.col(name)))
            continue
        last = name == "__last"
        fields = [(F.col(quote(c)) if c in far else F.col(name)[f"o{near_order.index(c)}"]).alias(f"o{i}")
                  for i, c in enumerate(order)]
        fields += [F.col(name)[f"v{i}"].alias(f"v{i}") for i in range(len(values(last, False)))]
        fields += [F.col(quote(c)).alias(f"x{i}") for i, c in enumerate(values(last, True))]
        packed = F.struct(*(fields or [F.lit(0).alias("o0")]))
        merges.append((name, F.max if last else F.min, packed))
    for label, spec_map, fn in (("__fmin", mins, F.min), ("__fmax", maxs, F.max)):
        for i, (out, col) in enumerate(spec_map.items()):
            if col in far:
                merges.append((f"{label}{i}", fn, F.col(quote(col))))
                post.append((out, F.col(f"{label}{i}")))
    for out, (col, how) in rules.items():
        if col in far:
            last = how == "Last"
            post.append((out, F.col("__last" if last else "__first")[f"x{values(last, True).index(col)}"]))
    for i, (out, col) in enumerate(sums.items()):
        if col in far:
            weighted = F.col(quote(col)).try_cast(MONEY) * F.col("__n").cast("decimal(12,0)")
            merges.append((f"__fsum{i}", F.sum, weighted))
            post.append((out, F.col(f"__fsum{i}").cast("double")))
    return merges, post


def _merge_of(name: str):
    """How per-key partial results combine into one group."""
    if name == "__n" or name.startswith("__sum"):
        return F.sum
    return F.min if name.startswith(("__min", "__first")) else F.max


def _merge(name: str) -> Column:
    return _merge_of(name)(F.col(name)).alias(name)


def finance(spec: ImportSpec, sources: Mapping[str, DataFrame], attribute: str,
            by: list[str] | None = None, check_keys: bool | None = None, wide: bool = False) -> DataFrame:
    """Total of one finance attribute under its FinanceImportType (G5–G7, DEC-11).

    ``by`` defaults to the case column for PerEvent and PerCase, and to the resource column
    for PerResource. PerEvent by case, PerCase and PerResource reduce per case or resource first
    (``group_aggregate``); PerEvent by other columns sums over the event log.

    Amounts outside ``MONEY`` are left out unless ``wide``: then every finite amount is added, and the
    counts of ``wide_totals`` come with the total. PerEvent then sums over the event log.
    """
    spec.validate()
    a = spec.attribute(attribute)
    if a is None or a.finance == "None":
        raise SpecError(f"{attribute!r} is not a finance attribute")
    roles = spec.roles()
    by = list(by or [])
    if a.finance == "PerEvent" and wide:
        by = by or [roles.case]
        log = attributed(spec, sources, check_keys, list(dict.fromkeys([attribute, *by])))
        return wide_totals(log, attribute, by)
    if a.finance == "PerEvent" and by in ([], [roles.case]):
        return case_aggregate(spec, sources, sums={"total": attribute}, count=None, check_keys=check_keys)
    if a.finance == "PerCase":
        carried = {c: (c, "First") for c in dict.fromkeys([attribute, *by]) if c != roles.case}
        per_case = case_aggregate(spec, sources, rules=carried, count=None, check_keys=check_keys)
        if wide:
            return wide_totals(per_case, attribute, by or [roles.case])
        money = F.col(quote(attribute)).try_cast(MONEY)
        if by in ([], [roles.case]):  # each case is one row already
            return per_case.select(F.col(quote(roles.case)), money.cast("double").alias("total"))
        group = [F.col(quote(c)) for c in by]
        return per_case.groupBy(*group).agg(F.sum(money).cast("double").alias("total"))
    if a.finance == "PerResource":
        if not roles.resource:
            raise SpecError("PerResource needs a Resource role")
        # DEC-3 order within a resource; the case closes ties between cases.
        order = [c for c in roles.order() if c != roles.resource] + [roles.case]
        carried = {c: (c, "First") for c in dict.fromkeys([attribute, *by]) if c != roles.resource}
        per_resource = group_aggregate(spec, sources, roles.resource, rules=carried, count=None, order=order,
                                       check_keys=check_keys)
        if wide:
            return wide_totals(per_resource, attribute, by or [roles.resource])
        money = F.col(quote(attribute)).try_cast(MONEY)
        if by in ([], [roles.resource]):  # each resource is one row already
            return per_resource.select(F.col(quote(roles.resource)), money.cast("double").alias("total"))
        group = [F.col(quote(c)) for c in by]
        return per_resource.groupBy(*group).agg(F.sum(money).cast("double").alias("total"))
    log = attributed(spec, sources, check_keys, list(dict.fromkeys([attribute, *by])))
    return finance_totals(log, attribute, a.finance, by)
