"""Exact quantiles without a sort of all rows or a buffer of a group's values.

A first pass takes a mergeable sketch of each group, whose rank error is bounded, and so an interval that must hold each
wanted place. A second pass counts the rows: those in an interval by value, all others by the gap they lie in. What is left
of a group is a small table, whose running counts give the values at the places.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is 1 / ACCURACY of the group's rows at most; intervals reach so many errors to both sides.
#: In a group of up to so many rows all values are counted: there the reach would be a few rows or less.
ACCURACY, REACH, SMALL = 20_000, 4, 50_000


def same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of keys of two aliased tables; null meets null."""
    on = [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]
    return functools.reduce(operator.and_, on)


def with_keys(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each combination of keys (one row if there are none)."""
    if not keys:
        return rows.join(F.broadcast(table))
    added = [F.col(f"_right.`{c}`") for c in table.columns if c not in keys]
    return rows.alias("_left").join(table.alias("_right"), same("_left", "_right", keys)).select("_left.*", *added)


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """One row for each group that has a value (without keys always one, null if there is none): keys and, for each name, the quantile at its share p: the value at place
    (n - 1) p of the ordered values, from 0, interpolated between neighbours. Nulls take no part; NaN is the largest value."""
    names = sorted(wanted, key=wanted.get)
    margin = REACH / ACCURACY
    shares = [min(1.0, max(0.0, wanted[n] + d * margin)) for n in names for d in (-1, 1)]
    x = value.cast("double")
    rows = df.where(x.isNotNull()).select(*(F.col(f"`{k}`") for k in keys), (x + 0.0).alias("_x"))
    bounds = rows.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.percentile_approx("_x", shares, ACCURACY).alias("_b"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), (F.count("*") <= SMALL).alias("_small"))
    if not keys:
        bounds = bounds.where("_least is not null")
    low = [F.when(F.col("_small") | F.lit(s <= margin), F.col("_least")).otherwise(F.get("_b", F.lit(2 * k))) for k, s in enumerate(shares[::2])]
    high = [F.when(F.col("_small") | F.lit(s >= 1 - margin), F.col("_most")).otherwise(F.get("_b", F.lit(2 * k + 1))) for k, s in enumerate(shares[1::2])]
    each = with_keys(rows, bounds.select(*(F.col(f"`{k}`") for k in keys), F.array(*low).alias("_low"), F.array(*high).alias("_high")), keys)
    at = [(F.get("_low", F.lit(k)), F.get("_high", F.lit(k))) for k in range(len(names))]
    inside = functools.reduce(operator.or_, (F.col("_x").between(a, b) for a, b in at))
    gap = F.greatest(F.lit(float("-inf")), *(F.when(F.col("_x") > b, b) for _, b in at))
    by = [F.col(f"`{k}`") for k in keys]
    counts = each.groupBy(*by, F.when(inside, F.col("_x")).otherwise(gap).alias("_v"), (~inside).alias("_out")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_v", "_out")
    upto = counts.withColumns({"_upto": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    out = []
    for name in names:
        place = (F.col("_all") - 1) * F.lit(wanted[name])
        found = [F.min(F.when(F.col("_upto") > at, F.struct("_v", "_out"))) for at in (F.floor(place), F.ceil(place))]
        share = F.first(place - F.floor(place))
        sure = F.when(found[0]["_out"] | found[1]["_out"], F.raise_error(F.lit("exact_quantiles: a place lies outside its interval")).cast("double"))
        a, b = found[0]["_v"], found[1]["_v"]
        out.append(F.coalesce(sure, F.when((share == 0) | (a == b), a).otherwise((1 - share) * a + share * b)).alias(name))
    return upto.groupBy(*by).agg(*out)
