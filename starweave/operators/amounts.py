"""Totals of amounts of any size, exactly, and counts of what a total cannot hold.

Amounts inside ``MONEY`` are added as such. A larger one (1e18 or more, either sign) is taken as its
decimal form, digits times a power of ten, and added in limbs of eight decimal digits, so sums stay
exact integers whatever the order of rows. A group has at most 38 limbs; they meet in one row per
group and become the nearest double (an infinity if no double is that large).
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import MONEY, quote

_LIMB = 8  # decimal digits
_COEFFICIENT = "decimal(28,0)"  # 17 digits and a limb; ten digits more let 1e10 rows and many more be added


def _limbs(value: Column, integral: bool) -> tuple[Column, Column]:
    """(limb, coefficient) of an amount outside ``MONEY``: coefficient * 10 ** (8 * limb). Null for others."""
    if integral:
        wide = value.isNotNull() & value.try_cast(MONEY).isNull()
        return F.when(wide, F.lit(0)), F.when(wide, value.try_cast(_COEFFICIENT))
    v = value.try_cast("double")
    wide = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & value.try_cast(MONEY).isNull()
    text = F.when(wide, v.cast("string"))  # such as -1.25E18
    digits = F.substring_index(text, "E", 1)
    power = F.substring_index(text, "E", -1).try_cast("int") - F.length(F.substring_index(digits, ".", -1))
    scale = F.element_at(F.array(*[F.lit(10 ** i).cast("decimal(8,0)") for i in range(_LIMB)]), power % _LIMB + 1)
    whole = F.replace(digits, F.lit("."), F.lit("")).try_cast("decimal(18,0)")
    return F.floor(power / _LIMB).cast("int"), (whole * scale).cast(_COEFFICIENT)


def _nearest(narrow: object, limbs: Sequence[dict]) -> float:
    total = Fraction(narrow or 0) + sum(int(x["coefficient"]) * 10 ** (_LIMB * x["limb"]) for x in limbs)
    try:
        return float(total)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.pandas_udf(T.DoubleType())
def _total(narrow: pd.Series, limbs: pd.Series) -> pd.Series:
    return pd.Series([_nearest(n, x) for n, x in zip(narrow, limbs)], dtype="float64")


def wide_totals(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group ``by``: ``total`` of every finite amount, ``n_values`` added, ``n_wide`` of them outside
    ``MONEY``, and ``n_left_out``: values that are neither null nor a finite number.

    A group without values has a null total; without ``by`` there is one row. Rows are reduced to one
    per group and limb in the map tasks, so a hot group is never gathered.
    """
    keys = [F.col(quote(c)).alias(f"__g{i}") for i, c in enumerate(by)]
    names = [f"__g{i}" for i in range(len(keys))]
    amount = F.col(quote(value))
    limb, coefficient = _limbs(amount, isinstance(rows.schema[value].dataType, T.IntegralType))
    flat = rows.select(*keys, amount.isNotNull().alias("__given"), amount.try_cast(MONEY).alias("__narrow"),
                       limb.alias("limb"), coefficient.alias("__coefficient"))
    added = F.col("__narrow").isNotNull() | F.col("__coefficient").isNotNull()
    parts = flat.groupBy(*names, "limb").agg(
        F.sum("__narrow").alias("__narrow"), F.sum("__coefficient").alias("coefficient"),
        F.count_if(added).alias("__n"), F.count("__coefficient").alias("__wide"), F.count_if("__given").alias("__given"))
    # A null limb holds all amounts inside MONEY; collect_list leaves out its null entry.
    entry = F.when(F.col("limb").isNotNull(), F.struct("limb", "coefficient"))
    groups = parts.groupBy(*names).agg(
        F.sum("__narrow").alias("__narrow"), F.collect_list(entry).alias("__limbs"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum("__wide"), F.lit(0)).alias("n_wide"), F.coalesce(F.sum("__given"), F.lit(0)).alias("__given"))
    total = F.when(F.col("n_values") > 0, _total("__narrow", "__limbs")).alias("total")
    return groups.select(*[F.col(n).alias(c) for n, c in zip(names, by)], total, "n_values", "n_wide",
                         (F.col("__given") - F.col("n_values")).alias("n_left_out"))
