"""Compare a Spark DataFrame with DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from starweave.plans.stars import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_tuple"):  # Decimal
        return round(float(v), 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(df, con, sql):
    spark_names = df.columns
    spark_rows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    duck_names = [d[0] for d in rel.description]
    duck_rows = rel.fetchall()
    assert sorted(spark_names) == sorted(duck_names), (spark_names, duck_names)
    a = rows_of(spark_names, spark_rows)
    b = rows_of(duck_names, duck_rows)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:5]
    return len(a)
