"""Totals of amounts of any size against exact fractions."""

import math
import random
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

import golden
from conftest import SF01
from oracle import compare, duck

from starweave.operators.amounts import wide_totals
from starweave.plans import eventlog
from starweave.plans.registry import ORACLE, QUERIES


def test_every_finite_amount_is_added(spark):
    rng = random.Random(5)
    rows = [("mixed", rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-3, 300)) for _ in range(300)]
    rows += [("cancel", v) for v in (1e300, 5.25, -1e300, 3e25, -3e25)]
    rows += [("edge", v) for v in (1e18, -1e18, 999999999999999872.0, 1.7976931348623157e308, -1.7976931348623157e308, 0.1)]
    rows += [("odd", v) for v in (math.nan, math.inf, -math.inf, None, 2.5)] + [("none", None), (None, 1e20), (None, 1.5)]
    rows += [("over", 1.7e308)] * 3 + [("hot", 1.1e18)] * 1000
    got = {r.g: r for r in wide_totals(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"]).collect()}
    assert set(got) == {g for g, _ in rows}
    for g in got:
        given = [v for k, v in rows if k == g and v is not None]
        finite = [v for v in given if math.isfinite(v)]
        # Amounts mean their decimal form; ten digits after the point, half up, inside the narrow range.
        exact = sum((Fraction(Decimal(repr(v)) if abs(v) >= 1e18 else round(Decimal(repr(v)), 10)) for v in finite), Fraction(0))
        if g == "over":
            assert got[g].total == math.inf
        else:
            assert got[g].total == (float(exact) if finite else None), g
        assert (got[g].n_values, got[g].n_left_out) == (len(finite), len(given) - len(finite))
        assert got[g].n_wide == sum(abs(v) >= 1e18 for v in finite)
    assert got["cancel"].total == 5.25


def test_whole_numbers_names_and_empty_tables(spark):
    df = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (-2**63,), (7,), (None,)], "`limb.x` long")
    assert tuple(wide_totals(df, "limb.x").first()) == (float(2**63 + 5), 4, 3, 0)
    assert tuple(wide_totals(df.filter("false"), "limb.x").first()) == (None, 0, 0, 0)
    assert wide_totals(df.withColumn("limb", F.lit(1)).filter("false"), "limb.x", ["limb"]).count() == 0
    plan = wide_totals(df, "limb.x")._jdf.queryExecution().toString()
    assert "partial_sum" in plan


def test_finance_of_wide_amounts(spark):
    compare(QUERIES["finance_wide"](spark, SF01), duck(SF01), ORACLE["finance_wide"])
    src = golden.frames(spark)
    for attribute, by in (("EventCost", None), ("InvoiceTotalAmountWithoutVAT", ["CustomerSegment"])):
        key = by[0] if by else "CaseID"
        narrow = eventlog.finance(golden.spec(), src, attribute, by=by).collect()
        wide = eventlog.finance(golden.spec(), src, attribute, by=by, wide=True).collect()
        assert {(r[key], r.total) for r in narrow} == {(r[key], r.total) for r in wide}
        assert not any(r.n_wide or r.n_left_out for r in wide)
