"""Case-level rules and finance totals (G1–G7).

First and Last are ordered reductions: ``min``/``max`` of a struct that holds the order
columns (DEC-3) followed by the values. They are declarative aggregates with partial
aggregation, so a case that holds a third of all events is reduced map-side in every task
before the shuffle; no task ever holds a whole case. All First attributes share one ``min``
(and all Last ones one ``max``), so each event feeds one buffer per rule, not one per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import MONEY, quote


def _packed(order: Sequence[str], values: Sequence[str]) -> Column:
    """One struct: the DEC-3 order fields first, then the carried values.

    Struct comparison is field by field with nulls first, so ``min`` of it is the first row
    in that order and ``max`` the last; on a tie in the order the values decide, which keeps
    the result deterministic.
    """
    if not order:
        raise ValueError("an order is needed for First/Last; give start, end or tiebreak columns")
    return F.struct(*[F.col(quote(c)).alias(f"o{i}") for i, c in enumerate(order)],
                    *[F.col(quote(c)).alias(f"v{i}") for i, c in enumerate(values)])


def _rule_aggs(rules: Mapping[str, tuple[str, str]], order: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Aggregates and post-projection for ``{out_name: (column, "First"|"Last")}``."""
    firsts = [(out, col) for out, (col, how) in rules.items() if how != "Last"]
    lasts = [(out, col) for out, (col, how) in rules.items() if how == "Last"]
    aggs: list[Column] = []
    post: list[Column] = []
    for label, group, fn in (("__first", firsts, F.min), ("__last", lasts, F.max)):
        if not group:
            continue
        aggs.append(fn(_packed(order, [col for _, col in group])).alias(label))
        post += [F.col(label)[f"v{i}"].alias(out) for i, (out, _) in enumerate(group)]
    return aggs, post


def case_values(log: DataFrame, case: str, order: Sequence[str],
                rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per case with each rule's value: ``case`` column plus one column per rule."""
    aggs, post = _rule_aggs(rules, order)
    if not aggs:
        return log.select(F.col(quote(case))).distinct()
    return log.groupBy(F.col(quote(case))).agg(*aggs).select(F.col(quote(case)), *post)


def case_table(log: DataFrame, case: str, order: Sequence[str], rules: Mapping[str, tuple[str, str]],
               start: str | None = None, end: str | None = None) -> DataFrame:
    """The case table built from events alone (G4, DEC-10, DEC-12).

    Columns: the case column, ``n_events``, ``start_ts`` (min start), ``end_ts`` (max end; with
    no End role the Start column stands in, DEC-9), then one column per rule.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_events")]
    post: list[Column] = [F.col(quote(case)), F.col("n_events")]
    end = end or start
    if start:
        aggs.append(F.min(F.col(quote(start))).alias("start_ts"))
        post.append(F.col("start_ts"))
    if end:
        aggs.append(F.max(F.col(quote(end))).alias("end_ts"))
        post.append(F.col("end_ts"))
    rule_aggs, rule_post = _rule_aggs(rules, order)
    return log.groupBy(F.col(quote(case))).agg(*aggs, *rule_aggs).select(*post, *rule_post)


def attach_case_attributes(log: DataFrame, case: str, order: Sequence[str],
                           rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Every event row with its case's First/Last values (G3).

    Same answer as ``first_value``/``last_value`` over a full-frame window partitioned by case,
    but computed as a partial aggregate joined back: a window would put a whole case into one
    task, the aggregate never does.
    """
    return attach_case_values(log, case, case_values(log, case, order, rules))


def attach_case_values(log: DataFrame, case: str, values: DataFrame) -> DataFrame:
    """Join one row of values per case (keyed by ``case``) onto every event of that case.

    The join is null-safe, so events without a case get the values of the null-case group, as
    a window partition on a null key would. Its keys are expressions of the case column, so
    both sides are shuffled for the join itself and AQE can split a hot case's partition.
    """
    values = values.withColumnRenamed(case, "__case")
    joined = log.join(values, log[quote(case)].eqNullSafe(values["__case"]), "left")
    return joined.drop("__case")


def finance_totals(log: DataFrame, value: str, mode: str, by: Sequence[str], order: Sequence[str] = (),
                   case: str | None = None, resource: str | None = None) -> DataFrame:
    """Sum a finance attribute by ``by`` under its FinanceImportType (DEC-11).

    PerEvent sums every event's value. PerCase first takes one value per case (the First in
    DEC-3 order; ``by`` columns must be case-level and are taken the same way), then sums.
    PerResource does the same per resource. Money is summed exactly as ``MONEY`` so the total
    does not depend on the order of addition; it is returned as a double named ``total``.
    """
    by = list(by)
    if mode == "PerEvent":
        rows = log
    elif mode in ("PerCase", "PerResource"):
        unit = case if mode == "PerCase" else resource
        if not unit:
            raise ValueError(f"{mode} needs the {'case' if mode == 'PerCase' else 'resource'} column")
        carried = [c for c in dict.fromkeys([value] + by) if c != unit]
        rules = {c: (c, "First") for c in carried}
        rows = case_values(log, unit, order, rules)
    else:
        raise ValueError(f"finance mode must be PerEvent, PerCase or PerResource, not {mode!r}")
    money = F.col(quote(value)).try_cast(MONEY)
    return rows.groupBy(*[F.col(quote(c)) for c in by]).agg(F.sum(money).cast("double").alias("total"))
