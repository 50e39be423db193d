"""Key audits and column profiles (K1–K4).

Each audit is one lazy DataFrame. Foreign keys are aggregated before any join, so the anti
joins run over distinct keys, not over every event: a key that holds a third of the events
is one row after the map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import quote, type_family, typed_key


def _typed(df: DataFrame, column: str, key_type: str, where: str):
    dtype = df.schema[column].dataType
    return typed_key(F.col(quote(column)), dtype, key_type, where=where)


def fk_orphans(src: DataFrame, tgt: DataFrame, source_column: str, target_column: str,
               key_type: str = "Integer") -> DataFrame:
    """Foreign-key values of ``src`` with no matching key in ``tgt``, with their row counts.

    Columns: the raw foreign-key column (its own name) and ``n`` (``n_rows`` if that is the key's
    own name). A null foreign key is not an
    orphan; a value that does not convert to the key type is (it can never match).
    """
    fk = F.col(quote(source_column))
    counts = src.filter(fk.isNotNull()).groupBy(fk.alias("__fk")).agg(F.count(F.lit(1)).alias("__n"))
    probe = counts.withColumn("__k", _typed(counts, "__fk", key_type, f"source {source_column}"))
    keys = tgt.select(_typed(tgt, target_column, key_type, f"target {target_column}").alias("__t"))
    keys = keys.filter(F.col("__t").isNotNull())
    orphans = probe.join(keys, probe["__k"] == keys["__t"], "left_anti")
    count = "n" if source_column.lower() != "n" else "n_rows"
    return orphans.select(F.col("__fk").alias(source_column), F.col("__n").alias(count))


def pk_duplicates(tgt: DataFrame, key_column: str, key_type: str | None = None) -> DataFrame:
    """Key values that occur more than once in a join target (they would fan out events).

    Columns: ``key`` and ``n``. Null keys never match, so they are not reported.
    """
    key = F.col(quote(key_column))
    if key_type is not None:
        key = _typed(tgt, key_column, key_type, f"key {key_column}")
    return (
        tgt.select(key.alias("key"))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def cases_without_events(events: DataFrame, cases: DataFrame, source_column: str, target_column: str,
                         key_type: str = "Integer", columns: list[str] | None = None) -> DataFrame:
    """Rows of the cases table that no event links to (DEC-12).

    The event side is reduced to its distinct typed keys first (map-side), then anti-joined.
    """
    used = (
        events.select(_typed(events, source_column, key_type, f"events {source_column}").alias("__k"))
        .filter(F.col("__k").isNotNull())
        .distinct()
    )
    keep = columns or [target_column]
    probe = cases.select(*[F.col(quote(c)) for c in keep],
                         _typed(cases, target_column, key_type, f"cases {target_column}").alias("__t"))
    return probe.join(used, probe["__t"] == used["__k"], "left_anti").drop("__t")


def count_values(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per named column: ``column_name, n_rows, n_nulls, n_distinct``, exact.

    Rows become narrow (column number, value) pairs, values of one type in one slot. Pairs are counted
    in every task and merged by a shuffle of distinct pairs; the merged ones are counted per column in
    the same two steps. No task holds a column's values, and a value that most rows have is one pair.
    Values are equal as in ``count(distinct)``.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    values = {n: _groupable(F.col(quote(n)), fields[n]) for n in names}
    typed = df.select(*[values[n].alias(f"c{i}") for i, n in enumerate(names)]).schema
    kinds = {n: f.dataType.simpleString() for n, f in zip(names, typed.fields)}
    slots = list(dict.fromkeys(kinds.values()))

    def pair(i: int, n: str | None):
        return F.struct(F.lit(i).alias("i"), *[(values[n] if n and kinds[n] == k else F.lit(None).cast(k)).alias(f"s{j}")
                                               for j, k in enumerate(slots)])

    keys = ["i", *[f"s{j}" for j in range(len(slots))]]
    counted = df.select(F.inline(F.array(*[pair(i, n) for i, n in enumerate(names)]))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # A pair of each column that counts no row: columns of an empty table have a result, too.
    none = df.sparkSession.range(1).select(F.inline(F.array(*[pair(i, None) for i in range(len(names))])), F.lit(0).cast("bigint").alias("n"))
    held = F.coalesce(*[F.when(F.col(k).isNotNull(), True) for k in keys[1:]], F.lit(False))
    total = counted.unionByName(none).groupBy("i").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(held, 0).otherwise(F.col("n"))).alias("n_nulls"),
        F.count(F.when(held, 1)).alias("n_distinct"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return total.select(name.alias("column_name"), "n_rows", "n_nulls", "n_distinct")


def _groupable(c: Column, dtype: T.DataType) -> Column:
    """The column as something that Spark can group by, equal where its values are equal."""
    if isinstance(dtype, T.NullType):
        return c.cast("string")
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def profile_columns(df: DataFrame, exact: bool = True, columns: list[str] | None = None,
                    rsd: float = 0.05) -> DataFrame:
    """One row per column: ``column_name, family, n_rows, n_nulls, n_distinct``.

    Counts are exact (``count_values``: one scan, a shuffle of distinct values). ``exact=False`` uses
    HyperLogLog++ (``approx_count_distinct`` with relative standard deviation ``rsd``) instead: one
    partial/final aggregate whose one-row result is unpivoted with ``inline``.
    """
    names = columns or df.columns
    fields = {f.name: f for f in df.schema.fields}
    families = F.create_map(*[F.lit(x) for n in names for x in (n, type_family(fields[n].dataType))])
    if exact:
        return count_values(df, names).select("column_name", families[F.col("column_name")].alias("family"), "n_rows", "n_nulls",
                                              "n_distinct")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, name in enumerate(names):
        c = F.col(quote(name))
        aggs += [F.count(c).alias(f"__nn{i}"), F.approx_count_distinct(c, rsd).alias(f"__nd{i}")]
    rows = [F.struct(F.lit(name).alias("column_name"), F.lit(type_family(fields[name].dataType)).alias("family"),
                     F.col("__rows").alias("n_rows"), (F.col("__rows") - F.col(f"__nn{i}")).alias("n_nulls"),
                     F.col(f"__nd{i}").cast("bigint").alias("n_distinct")) for i, name in enumerate(names)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
