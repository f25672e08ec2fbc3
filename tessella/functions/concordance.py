"""Concordant and discordant pairs of a large table, without bringing it into one task.

Both axes are dealt into ranges of values. Pairs whose ranges differ on both axes follow from the counts of the cells of
the two; pairs within a range of x, and pairs within a range of y whose ranges of x differ, are counted range by range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.running import MOST_RANGES, quantile_grid, range_of

#: Rows that a range should hold, and ranges at least and at most: their square bounds what the driver holds.
ROWS, LEAST, MOST = 250_000, 4, 1024


def _cuts(df: DataFrame, axis: str) -> list[float]:
    """Cut points; a value that holds several ranges' rows has a range of its own."""
    found, n = quantile_grid(df, axis)
    ranges = min(MOST, max(LEAST, n // ROWS))
    chosen = [found[k * MOST_RANGES // ranges - 1] for k in range(1, ranges)] if found else []
    heavy = {a for a, b in zip(chosen, chosen[1:]) if a == b}
    return sorted({*chosen, *(float(np.nextafter(v, -np.inf)) for v in heavy)})


def net_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weights of concordant less those of discordant pairs; pairs that tie on either axis count nothing.

    By the bits of x's dense rank: two values part at their highest differing bit, and at each bit the rows of both sides
    are compared by y in one sorted pass."""
    rank = np.unique(x, return_inverse=True)[1]
    by_y = np.argsort(y, kind="stable")
    rank, y, w = rank[by_y], np.unique(y[by_y], return_inverse=True)[1], w[by_y].astype(float)
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        block = rank >> (bit + 1)
        order = np.argsort(block, kind="stable")
        b, v, m = block[order], y[order], w[order]
        right = (rank[order] >> bit & 1).astype(bool)
        before = np.concatenate([[0.0], np.cumsum(np.where(right, 0.0, m))])  # weights of the lower side
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        tie = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (v[1:] != v[:-1])]))
        sizes, ties = np.diff(np.append(first, len(b))), np.diff(np.append(tie, len(b)))
        start, end = np.repeat(before[first], sizes), np.repeat(before[np.append(first[1:], len(b))], sizes)
        below, upto = np.repeat(before[tie], ties), np.repeat(before[np.append(tie[1:], len(b))], ties)
        total += float((m * ((below - start) - (end - upto)))[right].sum())
    return total


def net_concordance(counts: DataFrame) -> float:
    """Concordant less discordant pairs of a table of x, y and n (how many rows the two stand for)."""
    x, y = _cuts(counts, "x"), _cuts(counts, "y")
    dealt = counts.select(
        F.col("x").cast("double"), F.col("y").cast("double"), F.col("n").cast("double"),
        range_of(F.col("x").cast("double"), x).alias("i"), range_of(F.col("y").cast("double"), y).alias("j"),
    )
    cells = dealt.groupBy("i", "j").agg(F.sum("n").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).toPandas()
    if not len(cells):
        return 0.0
    grid = np.zeros((len(x) + 1, len(y) + 1))
    grid[cells["i"], cells["j"]] = cells["n"]
    lower = np.cumsum(grid, 0) - grid  # of the ranges of x below
    left = np.cumsum(lower, 1) - lower
    right = lower.sum(1, keepdims=True) - left - lower
    total = float((grid * (left - right)).sum())

    def within(axis: str, other: str) -> float:
        """A range with a single value on its axis has ties only."""
        low, high = ("a", "b") if axis == "i" else ("c", "d")
        ends = cells.groupby(axis).agg({low: "min", high: "max"})
        wide = [int(k) for k, r in ends.iterrows() if r[low] < r[high]]
        if not wide:
            return 0.0

        def run(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [net_pairs(part[other].to_numpy(), part["y"].to_numpy(), part["n"].to_numpy())]})

        rows = dealt if len(wide) == len(ends) else dealt.where(F.col(axis).isin(wide))
        return float(rows.groupBy(axis).applyInPandas(run, "s double").agg(F.sum("s")).first()[0] or 0.0)

    return total + within("i", "x") + within("j", "i")
