"""Every operator as a query over the driver tables, with its DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over whole tables. Column
names match the oracle's exactly (the comparison sorts columns by name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import cast_attributes as _cast_attributes, normalize_types as _normalize_types
from ..operators import audit, cases, measures
from ..operators.project import role_projection as _role_projection
from ..operators.star import hidden_keys, project, star_join as _star_join
from ..session import scratch_path
from ..sources.folders import read_csv_checked
from ..sources.readers import read_dataset
from ..sources.sinks import read_clustered_log, write_clustered_log, write_log
from . import eventlog
from .spec import ImportSpec, attr, cases as cases_ds, edge, events as events_ds, lookup
from .stars import (
    clicks_flat_spec, clicks_sources, clicks_spec, docs_sources, docs_spec, sales_sources, sales_spec, table,
    tables,
)

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- sources and sink
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scan_table")
    name = "sw_events_" + path.rsplit("-", 1)[-1]
    table(spark, sf_dir, "events").write.option("path", path).format("parquet").saveAsTable(name)
    return read_dataset(spark, name, "table").select("event_id", "event_type", "value")


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scan_csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice") \
        .write.option("header", "true").csv(path)
    return _normalize_types(read_dataset(spark, path, "csv"))


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_dataset(spark, f"{sf_dir.rstrip('/')}/part.parquet", "parquet").select("p_partkey", "p_name", "p_size")


def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "scan_folder")
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    # Every row lands in one of two nested folders: two event types shallow, the rest deeper.
    shallow = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    ev.filter(shallow).write.parquet(f"{root}/2024/a")
    ev.filter(~shallow).write.parquet(f"{root}/2024/b/c/d")
    return read_dataset(spark, root, "parquet", recursive=True)


def write_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = clicks_spec(with_attributes=False)
    star = _star_join(spec, clicks_sources(spark, sf_dir)).select("event_id", "event_type", "c_mktsegment")
    path = scratch_path(spark, "event_log")
    write_log(star, path, partition_by=["event_type"])
    return spark.read.parquet(path).select("event_id", "event_type", "c_mktsegment")


def clustered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last activity and position of every event, from a log that is laid out by case."""
    spec = clicks_flat_spec()
    r = spec.roles()
    path = scratch_path(spark, "clustered_log")
    write_clustered_log(eventlog.event_log(spec, tables(spark, sf_dir, "events")), path, r.case, r.order(), 16)
    log = read_clustered_log(spark, path)
    ordered = measures.event_order(log, r.case, r.order())
    rules = {"first_type": (r.activity, "First"), "last_type": (r.activity, "Last")}
    return cases.attach_case_attributes(ordered, r.case, r.order(), rules).select("event_id", "n", *rules)


def scan_mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose files differ in columns and integer width."""
    root = scratch_path(spark, "scan_mixed_folder")
    ev = table(spark, sf_dir, "events")
    click = F.coalesce(F.col("event_type") == "click", F.lit(False))
    ev.filter(click).select("event_id", F.col("user_id").cast("int").alias("user_id"), "event_type").write.parquet(f"{root}/a")
    ev.filter(~click).select("user_id", "event_id", "value").write.parquet(f"{root}/b/c")
    return read_dataset(spark, root, "parquet", recursive=True)


def scan_csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV source that do not parse, and the rest, counted."""
    path = scratch_path(spark, "scan_csv_rejected")
    orders = table(spark, sf_dir, "orders")
    # Prices of urgent orders are not numbers in this source.
    price = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise(F.col("o_totalprice").cast("string"))
    orders.select("o_orderkey", "o_orderstatus", price.alias("o_totalprice")).write.option("header", "true").csv(path)
    good, bad = read_csv_checked(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return good.groupBy(F.lit("accepted").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lowest")) \
        .unionByName(bad.groupBy(F.lit("rejected").alias("kind")).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.split("line", ",")[0].cast("bigint")).alias("lowest")))


# ---------------------------------------------------------------- projections and types
PROJECTED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "lineitem"), PROJECTED)


def hide_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ev = ImportSpec((events_ds("lineitem", li.columns,
                               edge("l_orderkey", "orders", "o_orderkey"),
                               edge("l_partkey", "part", "p_partkey"),
                               edge("l_suppkey", "supplier", "s_suppkey")),
                     cases_ds("orders", ["o_orderkey"]), lookup("part", []), lookup("supplier", []))).events
    return project(li, ev.columns, hide=hidden_keys(ev))


def export_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = docs_spec(export_name="doc_ref", label_columns=("quality",))
    return _star_join(spec, docs_sources(spark, sf_dir)).select("doc_ref", "lang", "quality")


def normalize_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalize_types(table(spark, sf_dir, "orders"))


def cast_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.col("value").alias("value_int"), F.col("user_id").alias("user_str"))
    return _cast_attributes(ev, {"value_int": "Integer", "user_str": "String"})


def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = docs_spec(label_columns=("quality",)).with_attributes(
        attr("doc_id", "Integer"), attr("quality", "Integer", default_value="-1"))
    log = eventlog.event_log(spec, docs_sources(spark, sf_dir), require_roles=False)
    return log.select("doc_id", "quality")


def exclude_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sales_spec()
    dropped = {"l_discount", "l_quantity", "o_orderpriority", "o_orderdate", "s_acctbal", "l_partkey", "l_suppkey"}
    spec = spec.with_attributes(*[
        attr(a.name, a.source_data_type, a.import_type, a.level, finance=a.finance,
             case_handling=a.case_handling, is_excluded=a.name in dropped)
        for a in spec.attributes
    ])
    return eventlog.event_log(spec, sales_sources(spark, sf_dir))


def display_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = clicks_spec()
    flagged = {"event_type", "c_mktsegment", "n_name"}
    spec = base.with_attributes(*[
        attr(a.name, a.source_data_type, a.import_type, a.level, finance=a.finance,
             is_display=a.name in flagged)
        for a in base.attributes
    ])
    return eventlog.display_summary(spec, clicks_sources(spark, sf_dir))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole typed event log of the sales star (every attribute, DEC-10)."""
    return eventlog.event_log(sales_spec(), sales_sources(spark, sf_dir))


def role_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sales_spec()
    log = eventlog.event_log(spec, sales_sources(spark, sf_dir))
    return _role_projection(log, spec.roles())


# ---------------------------------------------------------------- joins
def join_events_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ImportSpec((
        events_ds("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"],
                  edge("l_orderkey", "orders", "o_orderkey")),
        cases_ds("orders", ["o_orderkey", "o_orderstatus"]),
    ))
    return _star_join(spec, tables(spark, sf_dir, "lineitem", "orders"))


def join_event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star_join(docs_spec(), docs_sources(spark, sf_dir)).select("doc_id", "lang", "quality", "toxic")


def join_case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star_join(clicks_spec(with_attributes=False), clicks_sources(spark, sf_dir)) \
        .select("event_id", "c_custkey", "n_name")


def join_typed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", F.col("l_partkey").cast("string").alias("l_partkey_text"))
    spec = ImportSpec((
        events_ds("lineitem", ["l_linenumber", "l_partkey_text"],
                  edge("l_partkey_text", "part", "p_partkey", key_type="String", export_name="l_partkey_text")),
        lookup("part", ["p_type"]),
    ))
    return _star_join(spec, {"lineitem": li, "part": table(spark, sf_dir, "part")})


def shared_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ev_nationkey", F.col("user_id") % 25)
    spec = ImportSpec((
        events_ds("events", ["event_id", "user_id", "ev_nationkey"],
                  edge("user_id", "customer", "c_custkey"),
                  edge("ev_nationkey", "nation", "n_nationkey", prefix="ev_")),
        cases_ds("customer", ["c_custkey", "c_nationkey"],
                 edge("c_nationkey", "nation", "n_nationkey", prefix="cs_")),
        lookup("nation", ["n_name"]),
    ))
    sources = {"events": ev, **tables(spark, sf_dir, "customer", "nation")}
    return _star_join(spec, sources).select("event_id", "ev_n_name", "cs_n_name")


def emitted_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config document that uses one lookup twice and whose events and cases share a column name."""
    ev = table(spark, sf_dir, "events").withColumn("ev_nationkey", F.col("user_id") % 25)
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "value")
    nation = {"TargetColumnName": "n_nationkey", "TargetDatasetName": "nation", "JoinKeyType": "Integer"}
    link = {"SourceColumnName": "user_id", "TargetColumnName": "c_custkey", "TargetDatasetName": "customer",
            "JoinKeyType": "Integer"}
    datasets = [
        {"Kind": 0, "Name": "events", "Columns": [{"Name": c} for c in ("event_id", "ts", "event_type", "value")],
         "Join": [link, {**nation, "SourceColumnName": "ev_nationkey"}]},
        {"Kind": 1, "Name": "customer", "Columns": [{"Name": c} for c in ("c_custkey", "value")],
         "Join": [{**nation, "SourceColumnName": "c_nationkey"}]},
        {"Kind": 2, "Name": "nation", "Columns": [{"Name": "n_name"}], "Join": None},
    ]
    attributes = [{"Name": n, "SourceDataType": t, "ImportType": r, "Level": v} for n, t, r, v in (
        ("event_id", "Integer", "Other", "Event"), ("ts", "Date", "Start", "Event"), ("event_type", "String", "Activity", "Event"),
        ("value", "Float", "Other", "Case"), ("c_custkey", "Integer", "Case", "Case"), ("n_name", "String", "Other", "Event"))]
    spec = ImportSpec.from_config({"inputDataBinding": {
        "dataSource": {"datasets": datasets}, "miningMetadata": {"ImportConfiguration": {"Attributes": attributes}}}},
        tiebreak=("event_id",))
    return eventlog.event_log(spec, {"events": ev, "customer": customer, **tables(spark, sf_dir, "nation")})


STAR_COLUMNS = ["l_linenumber", "o_orderkey", "c_mktsegment", "p_type", "s_name", "l_shipdate", "l_extendedprice"]


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star_join(sales_spec(), sales_sources(spark, sf_dir), columns=STAR_COLUMNS)


# ---------------------------------------------------------------- key audits
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fk_orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pk_duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "Integer")


def cases_without_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cases_without_events(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"),
                                      "l_orderkey", "o_orderkey")


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile_columns(table(spark, sf_dir, "orders"), exact=True)


# ---------------------------------------------------------------- case level and finance
def case_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.case_aggregate(sales_spec(), sales_sources(spark, sf_dir),
                                   rules={"l_returnflag": ("l_returnflag", "First")}, count=None)


def case_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.case_aggregate(sales_spec(), sales_sources(spark, sf_dir),
                                   rules={"l_returnflag": ("l_returnflag", "Last")}, count=None)


def case_attributes_on_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"first_type": ("event_type", "First"), "last_type": ("event_type", "Last")}
    return eventlog.case_values_on_events(clicks_spec(), clicks_sources(spark, sf_dir), rules, ["event_id"])


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales case table from the spec: counts, span and every Case-level attribute."""
    return eventlog.case_table(sales_spec(), sales_sources(spark, sf_dir))


def case_table_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = clicks_flat_spec()
    log = eventlog.event_log(spec, tables(spark, sf_dir, "events"))
    r = spec.roles()
    return cases.case_table(log, r.case, r.order(), {"first_type": ("event_type", "First")},
                            start=r.start, end=r.end)


def finance_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.finance(sales_spec(), sales_sources(spark, sf_dir), "l_extendedprice")


def finance_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.finance(sales_spec(), sales_sources(spark, sf_dir), "o_totalprice", by=["o_orderstatus"])


def finance_per_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.finance(sales_spec(), sales_sources(spark, sf_dir), "s_acctbal")


def finance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of amounts of any size, with counts of the large ones and of those that are no finite number."""
    return eventlog.finance(sales_spec(), sales_sources(spark, sf_dir), "l_extendedprice", by=["l_returnflag"], wide=True)


# ---------------------------------------------------------------- measures
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_case = eventlog.case_aggregate(sales_spec(), sales_sources(spark, sf_dir),
                                       mins={"first_start": "o_orderdate"}, maxs={"last_end": "l_shipdate"})
    return measures.add_seconds(per_case, "first_start", "last_end")


def event_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = eventlog.event_log(sales_spec(), sales_sources(spark, sf_dir),
                             columns=["o_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate"])
    return measures.event_durations(log, "o_orderdate", "l_shipdate")


def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = clicks_flat_spec()
    log = eventlog.event_log(spec, tables(spark, sf_dir, "events"))
    r = spec.roles()
    return measures.event_order(log, r.case, r.order())


def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sales_spec()
    return eventlog.summary(spec, sales_sources(spark, sf_dir), spec.roles().activity, "activity")


def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sales_spec()
    return eventlog.summary(spec, sales_sources(spark, sf_dir), spec.roles().resource, "resource")


QUERIES: dict[str, Query] = {
    "scan_table": scan_table,
    "scan_csv": scan_csv,
    "scan_parquet": scan_parquet,
    "scan_folder": scan_folder,
    "write_event_log": write_event_log,
    "clustered_log": clustered_log,
    "scan_mixed_folder": scan_mixed_folder,
    "scan_csv_rejected": scan_csv_rejected,
    "project_columns": project_columns,
    "hide_foreign_keys": hide_foreign_keys,
    "export_foreign_key": export_foreign_key,
    "normalize_types": normalize_types,
    "cast_attributes": cast_attributes,
    "default_values": default_values,
    "exclude_attributes": exclude_attributes,
    "display_attributes": display_attributes,
    "event_log": event_log,
    "role_projection": role_projection,
    "join_events_cases": join_events_cases,
    "join_event_lookup": join_event_lookup,
    "join_case_lookup": join_case_lookup,
    "join_typed_key": join_typed_key,
    "shared_lookup": shared_lookup,
    "emitted_config": emitted_config,
    "star_join": star_join,
    "fk_orphans": fk_orphans,
    "pk_duplicates": pk_duplicates,
    "cases_without_events": cases_without_events,
    "profile_columns": profile_columns,
    "case_first": case_first,
    "case_last": case_last,
    "case_attributes_on_events": case_attributes_on_events,
    "case_table": case_table,
    "case_table_from_events": case_table_from_events,
    "finance_per_event": finance_per_event,
    "finance_per_case": finance_per_case,
    "finance_per_resource": finance_per_resource,
    "finance_wide": finance_wide,
    "durations": durations,
    "event_durations": event_durations,
    "event_order": event_order,
    "activity_summary": activity_summary,
    "resource_summary": resource_summary,
}

_SALES_FROM = """
    lineitem l
    left join orders o on l.l_orderkey = o.o_orderkey
    left join customer c on o.o_custkey = c.c_custkey
    left join part p on l.l_partkey = p.p_partkey
    left join supplier s on l.l_suppkey = s.s_suppkey
"""

_SALES_ORDER = "l.l_shipdate, l.l_linenumber, l.l_partkey, l.l_suppkey"

ORACLE: dict[str, str] = {
    "scan_table": "select event_id, event_type, value from events",
    "scan_csv": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "scan_parquet": "select p_partkey, p_name, p_size from part",
    "scan_folder": "select event_id, event_type from events",
    "write_event_log": """
        select e.event_id, e.event_type, c.c_mktsegment
        from events e left join customer c on e.user_id = c.c_custkey""",
    "clustered_log": """
        select event_id, row_number() over o as n, first_value(event_type) over w as first_type,
               last_value(event_type) over w as last_type
        from events
        window o as (partition by user_id order by ts, event_id),
               w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)""",
    "scan_mixed_folder": """
        select event_id, user_id, case when event_type = 'click' then event_type end as event_type,
               case when event_type = 'click' then null else value end as value
        from events""",
    "scan_csv_rejected": """
        select case when o_orderpriority = '1-URGENT' then 'rejected' else 'accepted' end as kind, count(*) as n,
               min(o_orderkey) as lowest
        from orders group by 1""",
    "project_columns": "select l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate from lineitem",
    "hide_foreign_keys": "select * exclude (l_orderkey, l_partkey, l_suppkey) from lineitem",
    "export_foreign_key": """
        select d.doc_id as doc_ref, d.lang, l.quality
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "normalize_types": """
        select cast(o_orderkey as bigint) as o_orderkey, cast(o_custkey as bigint) as o_custkey,
               cast(o_orderstatus as varchar) as o_orderstatus, cast(o_totalprice as double) as o_totalprice,
               cast(o_orderdate as timestamp) as o_orderdate, cast(o_orderpriority as varchar) as o_orderpriority
        from orders""",
    "cast_attributes": """
        select event_id, cast(trunc(value) as bigint) as value_int, cast(user_id as varchar) as user_str
        from events""",
    "default_values": """
        select d.doc_id, coalesce(cast(l.quality as bigint), -1) as quality
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "exclude_attributes": f"""
        select l.l_linenumber::bigint as l_linenumber, l.l_extendedprice, l.l_returnflag, l.l_shipdate,
               o.o_orderkey, o.o_orderstatus, o.o_totalprice, p.p_type, s.s_name, c.c_mktsegment
        from {_SALES_FROM}""",
    "display_attributes": """
        select 'event_type' as attribute, count(distinct e.event_type) as distinct_values from events e
        union all
        select 'c_mktsegment', count(distinct c.c_mktsegment)
        from events e left join customer c on e.user_id = c.c_custkey
        union all
        select 'n_name', count(distinct n.n_name)
        from events e left join customer c on e.user_id = c.c_custkey
                      left join nation n on c.c_nationkey = n.n_nationkey""",
    "event_log": f"""
        select l.l_linenumber::bigint as l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount,
               l.l_returnflag, l.l_shipdate, o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
               o.o_orderpriority, p.p_type, s.s_name, s.s_acctbal, c.c_mktsegment,
               l.l_partkey, l.l_suppkey
        from {_SALES_FROM}""",
    "role_projection": f"""
        select o.o_orderkey as case_id, p.p_type as activity, l.l_shipdate as start_ts, s.s_name as resource
        from {_SALES_FROM}""",
    "join_events_cases": """
        select l.l_linenumber, l.l_extendedprice, o.o_orderkey, o.o_orderstatus
        from lineitem l left join orders o on l.l_orderkey = o.o_orderkey""",
    "join_event_lookup": """
        select d.doc_id, d.lang, l.quality, l.toxic
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "join_case_lookup": """
        select e.event_id, c.c_custkey, n.n_name
        from events e left join customer c on e.user_id = c.c_custkey
                      left join nation n on c.c_nationkey = n.n_nationkey""",
    "join_typed_key": """
        select l.l_linenumber, cast(l.l_partkey as varchar) as l_partkey_text, p.p_type
        from lineitem l left join part p on l.l_partkey = p.p_partkey""",
    "shared_lookup": """
        select e.event_id, ne.n_name as ev_n_name, nc.n_name as cs_n_name
        from events e
        left join customer c on e.user_id = c.c_custkey
        left join nation nc on c.c_nationkey = nc.n_nationkey
        left join nation ne on e.user_id % 25 = ne.n_nationkey""",
    "emitted_config": """
        select e.event_id, e.ts, e.event_type, e.value, c.c_custkey, c.c_acctbal as customer_value, ne.n_name,
               nc.n_name as c_nationkey_n_name
        from events e
        left join customer c on e.user_id = c.c_custkey
        left join nation nc on c.c_nationkey = nc.n_nationkey
        left join nation ne on e.user_id % 25 = ne.n_nationkey""",
    "star_join": f"""
        select l.l_linenumber, o.o_orderkey, c.c_mktsegment, p.p_type, s.s_name, l.l_shipdate, l.l_extendedprice
        from {_SALES_FROM}""",
    "fk_orphans": """
        select d.doc_id, count(*) as n
        from documents d
        where d.doc_id is not null
          and not exists (select 1 from labels l where l.doc_id = d.doc_id)
        group by d.doc_id""",
    "pk_duplicates": """
        select l_orderkey as key, count(*) as n
        from lineitem where l_orderkey is not null
        group by l_orderkey having count(*) > 1""",
    "cases_without_events": """
        select o.o_orderkey from orders o
        where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)""",
    "profile_columns": """
        select 'o_orderkey' as column_name, 'int' as family, count(*) as n_rows,
               count(*) - count(o_orderkey) as n_nulls, count(distinct o_orderkey) as n_distinct from orders
        union all
        select 'o_custkey', 'int', count(*), count(*) - count(o_custkey), count(distinct o_custkey) from orders
        union all
        select 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus), count(distinct o_orderstatus)
        from orders
        union all
        select 'o_totalprice', 'double', count(*), count(*) - count(o_totalprice), count(distinct o_totalprice)
        from orders
        union all
        select 'o_orderdate', 'timestamp', count(*), count(*) - count(o_orderdate), count(distinct o_orderdate)
        from orders
        union all
        select 'o_orderpriority', 'string', count(*), count(*) - count(o_orderpriority),
               count(distinct o_orderpriority) from orders""",
    "case_first": f"""
        select o.o_orderkey, arg_min(l.l_returnflag, row({_SALES_ORDER})) as l_returnflag
        from {_SALES_FROM} group by o.o_orderkey""",
    "case_last": f"""
        select o.o_orderkey, arg_max(l.l_returnflag, row({_SALES_ORDER})) as l_returnflag
        from {_SALES_FROM} group by o.o_orderkey""",
    "case_attributes_on_events": """
        select e.event_id,
               first_value(e.event_type) over w as first_type,
               last_value(e.event_type) over w as last_type
        from events e left join customer c on e.user_id = c.c_custkey
        window w as (partition by c.c_custkey order by e.ts, e.event_id
                     rows between unbounded preceding and unbounded following)""",
    "case_table": f"""
        select o.o_orderkey, count(*) as n_events, min(l.l_shipdate) as start_ts, max(l.l_shipdate) as end_ts,
               arg_min(o.o_orderstatus, row({_SALES_ORDER})) as o_orderstatus,
               arg_min(o.o_totalprice, row({_SALES_ORDER})) as o_totalprice,
               arg_min(o.o_orderdate, row({_SALES_ORDER})) as o_orderdate,
               arg_min(o.o_orderpriority, row({_SALES_ORDER})) as o_orderpriority,
               arg_min(c.c_mktsegment, row({_SALES_ORDER})) as c_mktsegment
        from {_SALES_FROM} group by o.o_orderkey""",
    "case_table_from_events": """
        select user_id, count(*) as n_events, min(ts) as start_ts, max(ts) as end_ts,
               arg_min(event_type, row(ts, event_id)) as first_type
        from events group by user_id""",
    "finance_per_event": f"""
        select o.o_orderkey, cast(sum(cast(l.l_extendedprice as decimal(18,2))) as double) as total
        from {_SALES_FROM} group by o.o_orderkey""",
    "finance_per_case": f"""
        select o_orderstatus, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
        from (
            select o.o_orderkey,
                   arg_min(o.o_totalprice, row({_SALES_ORDER})) as o_totalprice,
                   arg_min(o.o_orderstatus, row({_SALES_ORDER})) as o_orderstatus
            from {_SALES_FROM} group by o.o_orderkey
        ) t
        group by o_orderstatus""",
    "finance_per_resource": f"""
        select s_name, cast(sum(cast(s_acctbal as decimal(18,2))) as double) as total
        from (
            select s.s_name, arg_min(s.s_acctbal, row({_SALES_ORDER}, o.o_orderkey)) as s_acctbal
            from {_SALES_FROM} group by s.s_name
        ) t group by s_name""",
    "finance_wide": f"""
        select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total,
               count(l_extendedprice) as n_values, count(*) filter (where abs(l_extendedprice) >= 1e18) as n_wide,
               count(*) filter (where not isfinite(l_extendedprice)) as n_left_out
        from {_SALES_FROM} group by l_returnflag""",
    "durations": f"""
        select o.o_orderkey, count(*) as n_events, min(o.o_orderdate) as first_start, max(l.l_shipdate) as last_end,
               date_diff('second', min(o.o_orderdate), max(l.l_shipdate)) as seconds
        from {_SALES_FROM} group by o.o_orderkey""",
    "event_durations": """
        select l.l_linenumber::bigint as l_linenumber, l.l_shipdate, o.o_orderkey, o.o_orderdate, l.l_partkey,
               date_diff('second', o.o_orderdate, l.l_shipdate) as seconds
        from lineitem l left join orders o on l.l_orderkey = o.o_orderkey""",
    "event_order": """
        select * exclude (props), row_number() over (partition by user_id order by ts, event_id) as n
        from events""",
    "activity_summary": f"""
        select p.p_type as activity, count(*) as n_events, count(distinct o.o_orderkey) as n_cases
        from {_SALES_FROM} group by p.p_type""",
    "resource_summary": f"""
        select s.s_name as resource, count(*) as n_events, count(distinct o.o_orderkey) as n_cases
        from {_SALES_FROM} group by s.s_name""",
}
