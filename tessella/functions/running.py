"""Totals over a whole ordered table, without bringing it into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a whole-table order is split into: at least and at most, and values that a range should hold.
RANGES, MOST_RANGES, RANGE_VALUES = 64, 1024, 1_000_000


def range_of(x: Column, cuts: list[float]) -> Column:
    """How many of the rising cut points are below x, by a tree of comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x <= F.lit(cuts[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(cuts))


def quantile_grid(df: DataFrame, order: str) -> tuple[list[float], int]:
    """Values at the shares 1 / MOST_RANGES, 2 / MOST_RANGES, .. and the number of values, by one pass with a mergeable
    sketch; no values if there are none. The shares go as text: a column object for each would cost more than the pass."""
    shares = ", ".join(f"{k / MOST_RANGES!r}D" for k in range(1, MOST_RANGES))
    x = df.select(F.col(order).cast("double").alias("x"))
    found, n = x.selectExpr(f"percentile_approx(x, array({shares}), {4 * MOST_RANGES})", "count(x)").first()
    return found or [], n


def cut_points(df: DataFrame, order: str) -> list[float]:
    """Values that split the rows into ranges of like size."""
    found, n = quantile_grid(df, order)
    ranges = min(MOST_RANGES, max(RANGES, n // RANGE_VALUES))
    return sorted({found[k * MOST_RANGES // ranges - 1] for k in range(1, ranges)}) if found else []


def running_totals(
    df: DataFrame, order: str, sums: dict[str, Column], keys: list[str] | None = None, like: DataFrame | None = None
) -> DataFrame:
    """Adds, for each name of ``sums``, the sum over all rows of the key that are before in ``order``.

    ``df`` has one row for each key and value of ``order``, which is a number or null-free. Rows are dealt into ranges of values by cut
    points from a sketch; each range adds up by itself, and the ranges' totals, a table of one row for each key
    and range, give what stands before it. The cut points are fixed numbers, so the plan is deterministic. ``like`` has a
    column ``order`` with about the same values and is cheaper to read than ``df``: the cut points come from there."""
    keys = keys or []
    part = range_of(F.col(order).cast("double"), cut_points(df if like is None else like, order))
    dealt = df.withColumn("_range", part)
    by = [F.col(f"`{k}`") for k in keys]
    totals = dealt.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("_left._range") == F.col("_right._of")
    for k in keys:
        match &= F.col(f"_left.`{k}`").eqNullSafe(F.col(f"_right.`{k}`"))
    rows = dealt.alias("_left").join(offsets.alias("_right"), match).select("_left.*", *(f"_right._o_{n}" for n in sums))
    return rows.select(
        *(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items())
    )


def mid_ranks(df: DataFrame, field: str) -> DataFrame:
    """(value, count, rank): the mid-rank that each distinct value's rows share, from value counts."""
    values = df.where(F.col(field).isNotNull()).select((F.col(field).cast("double") + 0.0).alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("count"))
    return running_totals(counts, "value", {"before": F.col("count")}, like=values).select(
        "value", "count", (F.col("before") + (F.col("count") + 1) / 2).alias("rank")
    )
