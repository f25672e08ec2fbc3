"""Groupers: the key of a row, with a column that gives the keys' own order. Rows with a null key are dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tessella.errors import RequestError
from tessella.operators.filters import date_ranges
from tessella.operators.slots import Registry, Slot, check, column, kind, local_time, number

GROUPERS = Registry("grouper")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


@dataclass
class Keyed:
    """A table with the columns ``name`` (the key) and ``order`` (what it sorts by)."""

    df: DataFrame
    name: str
    order: str


def _with(df: DataFrame, slot: Slot, key: Column, order: Column) -> Keyed:
    name = slot.label or slot.field
    if include := slot.get("include"):
        place = F.array_position(F.array(*(F.lit(str(v)) for v in include)), key.cast("string"))
        key, order = F.when(place > 0, key), place
    out = df.withColumns({"_key": key, "_by": order}).where(F.col("_key").isNotNull())
    if name in out.columns:
        out = out.drop(name)
    out = out.withColumnRenamed("_key", name).withColumnRenamed("_by", f"_ord_{name}")
    return Keyed(out, name, f"_ord_{name}")


@GROUPERS.add("GROUP_CATEGORY")
def category(df: DataFrame, slot: Slot) -> Keyed:
    """By value; numbers sort as numbers, listed ``levels`` in their order."""
    c = column(df, slot)
    of = kind(df, slot.field)
    if slot.get("levels"):
        return _with(df, slot, c.cast("string"), F.array_position(F.array(*map(F.lit, slot.get("levels"))), c.cast("string")))
    return _with(df, slot, c.cast("string"), c if isinstance(of, (NumericType, BooleanType)) else c.cast("string"))


def _interval(slot: Slot, default: float = 1.0) -> float:
    width = float(slot.get("interval", default))
    return width if width > 0 else 1.0


def _text(x: Column) -> Column:
    """A number without a trailing ".0"."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


@GROUPERS.add("GROUP_RANGE")
def value_range(df: DataFrame, slot: Slot) -> Keyed:
    x, w = number(df, slot), _interval(slot, 10.0)
    low = F.floor(x / w) * w
    return _with(df, slot, F.when(~F.isnan(x), F.concat(_text(low), F.lit("-"), _text(low + w))), low)


@GROUPERS.add("GROUP_ROUNDED")
def rounded(df: DataFrame, slot: Slot) -> Keyed:
    x, w = number(df, slot), _interval(slot)
    low = F.floor(x / w) * w
    return _with(df, slot, F.when(~F.isnan(x), _text(low)), low)


def _labelled(df: DataFrame, slot: Slot, tests: list[tuple[str, Column]], present: Column) -> Keyed:
    key, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (label, test) in reversed([*enumerate(tests)]):
        key, order = F.when(test, label).otherwise(key), F.when(test, k).otherwise(order)
    if (rest := slot.get("unmatched_label")) is not None:
        key = F.when(present, F.coalesce(key, F.lit(rest)))
        order = F.coalesce(order, F.lit(len(tests)))
    return _with(df, slot, key, order)


@GROUPERS.add("GROUP_NUMERIC_RANGES")
def numeric_ranges(df: DataFrame, slot: Slot) -> Keyed:
    """Labelled [start, end); a missing end is open. Overlaps are refused."""
    x = number(df, slot)
    spans = [(r["label"], r.get("start"), r.get("end")) for r in slot.need("ranges")]
    ordered = sorted(spans, key=lambda s: -np.inf if s[1] is None else s[1])
    for a, b in zip(ordered, ordered[1:]):
        if a[2] is None or b[1] is None or b[1] < a[2]:
            raise RequestError(f"GROUP_NUMERIC_RANGES: ranges {a[0]!r} and {b[0]!r} overlap")
    tests = [(n, (F.lit(True) if a is None else x >= a) & (F.lit(True) if b is None else x < b)) for n, a, b in spans]
    return _labelled(df, slot, tests, x.isNotNull())


@GROUPERS.add("GROUP_DATE_RANGES")
def by_date_ranges(df: DataFrame, slot: Slot) -> Keyed:
    column(df, slot, "date")
    day = local_time(df, slot.field, slot.get("zone")).cast("date")
    return _labelled(df, slot, [(n, day.between(F.lit(a), F.lit(b))) for n, a, b in date_ranges(slot)], day.isNotNull())


@GROUPERS.add("GROUP_DATE")
def by_date(df: DataFrame, slot: Slot) -> Keyed:
    """By ``component``: year, quarter, month, week (ISO), day, hour, or cyclic weekday, month_of_year, hour_of_day,
    quarter_of_year. ``fiscal_offset`` months shift years and quarters, ``week_start`` the first weekday."""
    check(kind(df, slot.field), "date", slot)
    d, part, shift = local_time(df, slot.field, slot.get("zone")), slot.get("component", "day"), int(slot.get("fiscal_offset", 0))
    moved = F.add_months(d.cast("date"), shift) if shift else d
    fiscal = "FY" if shift else ""
    first = WEEKDAYS.index(slot.get("week_start", "Monday"))
    weekday = F.pmod(F.weekday(d) - first, F.lit(7))
    names = F.array(*map(F.lit, WEEKDAYS[first:] + WEEKDAYS[:first]))
    year, quarter = F.year(moved), F.quarter(moved)
    week_year = F.extract(F.lit("YEAROFWEEK"), d)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    keys: dict[str, tuple[Column, Column]] = {
        "year": (F.concat(F.lit(fiscal), year), year),
        "quarter": (F.concat(F.lit(fiscal), year, F.lit("-Q"), quarter), year * 4 + quarter),
        "month": (F.date_format(d, "yyyy-MM"), F.trunc(d, "month")),
        "week": (F.concat(week_year, F.lit("-W"), pad(F.weekofyear(d), 2)), F.trunc(d, "week")),
        "day": (F.date_format(d, "yyyy-MM-dd"), F.to_date(d)),
        "hour": (F.date_format(d, "yyyy-MM-dd HH"), F.date_trunc("hour", d)),
        "weekday": (F.get(names, weekday), weekday),
        "month_of_year": (F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1), F.month(d)),
        "quarter_of_year": (F.concat(F.lit("Q"), quarter), quarter),
        "hour_of_day": (pad(F.hour(d), 2), F.hour(d)),
    }
    if part not in keys:
        raise RequestError(f"GROUP_DATE: no component {part!r}; one of {sorted(keys)}")
    key, order = keys[part]
    return _with(df, slot, F.when(d.isNotNull(), key), order)


@GROUPERS.add("GROUP_QUANTILE")
def quantile(df: DataFrame, slot: Slot) -> Keyed:
    """Equal-population buckets Q1.. (4), D1.. (10), P1.. (100) or B1..: a row's bucket is that of its place in order of
    value. Rows that tie on the value share the place of the first of them, so buckets don't hang on row order.

    Places come from counts by value, in ranges; no task sees the whole table."""
    from tessella.functions.running import running_totals

    x, n = number(df, slot), int(slot.get("interval", 4))
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    values = rows.select((x + 0.0).alias("_x"))
    counts = values.groupBy("_x").agg(F.count("*").alias("_n"))
    placed = running_totals(counts, "_x", {"_before": F.col("_n")}, like=values)
    total = values.agg(F.count("*").alias("_total"))
    bucket = F.floor(F.col("_before") * n / F.col("_total")).cast("int")
    by_value = placed.join(F.broadcast(total)).select("_x", bucket.alias("_bucket"))
    joined = rows.join(by_value, x == F.col("_x")).drop("_x")
    letter = {4: "Q", 10: "D", 100: "P"}.get(n, "B")
    out = _with(joined, slot, F.concat(F.lit(letter), F.col("_bucket") + 1), F.col("_bucket"))
    return Keyed(out.df.drop("_bucket"), out.name, out.order)


@GROUPERS.add("GROUP_SET_VALUE")
def set_value(df: DataFrame, slot: Slot) -> Keyed:
    key = F.when(column(df, slot, "set").isNotNull(), F.array_join(F.array_sort(F.array_distinct(column(df, slot, "set"))), "|"))
    return _with(df, slot, key, key)


@GROUPERS.add("GROUP_SET_PER_ELEMENT")
def set_element(df: DataFrame, slot: Slot) -> Keyed:
    """A row stands in the bucket of each of its labels; one without labels in none."""
    c = column(df, slot, "set")
    out = df.withColumn("_element", F.explode(F.array_distinct(c)))
    keyed = _with(out, slot, F.col("_element"), F.col("_element"))
    return Keyed(keyed.df.drop("_element"), keyed.name, keyed.order)


@GROUPERS.add("GROUP_KMEANS")
def kmeans(df: DataFrame, slot: Slot) -> Keyed:
    """Segments by Lloyd's algorithm over the numeric fields of ``members``; keys cluster_1.. by falling size, then by
    centroid. Each pass is one aggregate with k rows; starts are drawn by seed from the rows with the smallest hashes,
    so partitioning doesn't matter. The best of ``n_init`` starts, by within-cluster squares, stays."""
    members, k = list(slot.need("members")), int(slot.need("k"))
    for m in members:
        check(kind(df, m), "number", Slot(slot.type, m))
    cols = [F.col(f"`{m}`").cast("double") for m in members]
    whole = cols[0].isNotNull()
    for c in cols[1:]:
        whole = whole & c.isNotNull()
    rows = df.where(whole)
    if slot.get("standardize"):
        s = rows.agg(*(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
        cols = [(c - s[i]) / (s[len(cols) + i] or 1.0) for i, c in enumerate(cols)]
    point = F.array(*cols)
    seed = int(slot.get("seed", 0))
    pool = rows.select(point.alias("p")).distinct().orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(max(50 * k, 200))
    start = np.array([r[0] for r in pool.collect()])
    if len(start) < k:
        raise RequestError(f"GROUP_KMEANS: {len(start)} different points for {k} clusters")

    def nearest(centres: np.ndarray) -> Column:
        spans = [sum(((c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(cols, row)), F.lit(0.0)) for row in centres]
        best = F.least(*spans) if k > 1 else spans[0]
        at = F.lit(k - 1)
        for i in range(k - 2, -1, -1):
            at = F.when(spans[i] == best, i).otherwise(at)
        return F.struct(at.alias("at"), best.alias("d"))

    def spread(rng: np.random.Generator) -> np.ndarray:
        chosen = [start[rng.integers(len(start))]]
        while len(chosen) < k:
            d = np.min([((start - c) ** 2).sum(1) for c in chosen], axis=0)
            chosen.append(start[int(np.argmax(d))] if d.sum() == 0 else start[rng.choice(len(start), p=d / d.sum())])
        return np.array(chosen)

    best: tuple[float, np.ndarray, list[int]] | None = None
    for run in range(int(slot.get("n_init", 1))):
        centres = spread(np.random.default_rng(seed + run))
        for _ in range(int(slot.get("max_iter", 20))):
            got = rows.groupBy(nearest(centres)["at"].alias("at")).agg(F.count("*"), *(F.avg(c) for c in cols)).collect()
            new, sizes = centres.copy(), [0] * k
            for r in got:
                new[r[0]], sizes[r[0]] = r[2:], r[1]
            still = np.allclose(new, centres, rtol=0, atol=1e-9)
            centres = new
            if still:
                break
        cost = rows.agg(F.sum(nearest(centres)["d"])).first()[0]
        if best is None or cost < best[0] - 1e-9:
            best = (cost, centres, sizes)
    order = sorted(range(k), key=lambda i: (-best[2][i], *best[1][i]))
    names = {c: i for i, c in enumerate(order)}
    rank = F.get(F.array(*(F.lit(names[i]) for i in range(k))), nearest(best[1])["at"])
    return _with(rows, Slot(slot.type, members[0], slot.label or "cluster", {}), F.concat(F.lit("cluster_"), rank + 1), rank)


def apply_groupers(df: DataFrame, slots: list[Slot]) -> tuple[DataFrame, list[str], list[str]]:
    """The table with all keys, the names of the keys, and the columns they sort by."""
    names, orders = [], []
    for slot in slots:
        make: Callable[[DataFrame, Slot], Keyed] = GROUPERS.find(slot.type)
        keyed = make(df, slot)
        df = keyed.df
        names.append(keyed.name)
        orders.append(keyed.order)
    return df, names, orders
