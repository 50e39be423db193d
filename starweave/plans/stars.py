"""Import specs over the driver's TPC-H-style tables, used by the entry points, tests and bench.

    sales        lineitem ─> orders (cases) ─> customer;  lineitem ─> part, supplier
    clicks       events ─> customer (cases) ─> nation
    clicks_flat  events alone
    docs         documents ─> labels
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spec import ImportSpec, attr, cases, edge, events, lookup

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Order within an order (case): l_shipdate alone has ties, and (l_orderkey, l_linenumber)
# repeats, so part and supplier keys complete it.
SALES_TIEBREAK = ("l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def sales_spec(with_attributes: bool = True) -> ImportSpec:
    """lineitem events; orders as cases; customer through orders; part and supplier lookups.

    Part and supplier keys are exported under their own names so they can order events.
    """
    spec = ImportSpec(
        datasets=(
            events("lineitem",
                   ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_returnflag", "l_shipdate"],
                   edge("l_orderkey", "orders", "o_orderkey"),
                   edge("l_partkey", "part", "p_partkey", export_name="l_partkey"),
                   edge("l_suppkey", "supplier", "s_suppkey", export_name="l_suppkey")),
            cases("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                             "o_orderpriority"],
                  edge("o_custkey", "customer", "c_custkey")),
            lookup("part", ["p_type"]),
            lookup("supplier", ["s_name", "s_acctbal"]),
            lookup("customer", ["c_mktsegment"]),
        ),
        tiebreak=SALES_TIEBREAK,
    )
    if not with_attributes:
        return spec
    return spec.with_attributes(
        attr("l_linenumber", "Integer"),
        attr("l_quantity", "Float"),
        attr("l_extendedprice", "Float", finance="PerEvent"),
        attr("l_discount", "Float"),
        attr("l_returnflag", "String"),
        attr("l_shipdate", "Date", "Start"),
        attr("o_orderkey", "Integer", "Case", "Case"),
        attr("o_orderstatus", "String", level="Case"),
        attr("o_totalprice", "Float", level="Case", finance="PerCase"),
        attr("o_orderdate", "Date", level="Case"),
        attr("o_orderpriority", "String", level="Case"),
        attr("p_type", "String", "Activity"),
        attr("s_name", "String", "Resource"),
        attr("s_acctbal", "Float", finance="PerResource"),
        attr("c_mktsegment", "String", level="Case"),
        attr("l_partkey", "Integer"),
        attr("l_suppkey", "Integer"),
    ).validate()


def sales_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return tables(spark, sf_dir, "lineitem", "orders", "part", "supplier", "customer")


def clicks_spec(with_attributes: bool = True) -> ImportSpec:
    spec = ImportSpec(
        datasets=(
            events("events", ["event_id", "ts", "user_id", "event_type", "value"],
                   edge("user_id", "customer", "c_custkey")),
            cases("customer", ["c_custkey", "c_nationkey", "c_mktsegment"],
                  edge("c_nationkey", "nation", "n_nationkey")),
            lookup("nation", ["n_name"]),
        ),
        tiebreak=("event_id",),
    )
    if not with_attributes:
        return spec
    return spec.with_attributes(
        attr("event_id", "Integer"),
        attr("ts", "Date", "Start"),
        attr("event_type", "String", "Activity"),
        attr("value", "Float", finance="PerEvent"),
        attr("c_custkey", "Integer", "Case", "Case"),
        attr("c_mktsegment", "String", level="Case"),
        attr("n_name", "String", level="Case"),
    ).validate()


def clicks_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return tables(spark, sf_dir, "events", "customer", "nation")


def clicks_flat_spec() -> ImportSpec:
    return ImportSpec(
        datasets=(events("events", ["event_id", "ts", "user_id", "event_type", "value"]),),
        attributes=(
            attr("event_id", "Integer"),
            attr("ts", "Date", "Start"),
            attr("user_id", "Integer", "Case", "Case"),
            attr("event_type", "String", "Activity"),
            attr("value", "Float"),
        ),
        tiebreak=("event_id",),
    ).validate()


def docs_spec(export_name: str = "doc_id", label_columns: tuple[str, ...] = ("quality", "toxic")) -> ImportSpec:
    """documents with their labels; the hidden key comes back under ``export_name``."""
    return ImportSpec(
        datasets=(
            events("documents", ["doc_id", "lang", "source"],
                   edge("doc_id", "labels", "doc_id", export_name=export_name)),
            lookup("labels", list(label_columns)),
        ),
    ).validate(require_roles=False)


def docs_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return tables(spark, sf_dir, "documents", "labels")
