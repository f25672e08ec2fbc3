"""Filters: predicates that chain in declared order, all of which must hold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tessella.errors import RequestError
from tessella.operators.slots import Registry, Slot, column, expression, kind, local_time

FILTERS = Registry("filter")


def _values(slot: Slot) -> list:
    return list(slot.need("values"))


@FILTERS.add("FILTER_INCLUDE")
def include(df: DataFrame, slot: Slot) -> Column:
    return column(df, slot).isin(*_values(slot))


@FILTERS.add("FILTER_EXCLUDE")
def exclude(df: DataFrame, slot: Slot) -> Column:
    """Null passes."""
    c = column(df, slot)
    return c.isNull() | ~c.isin(*_values(slot))


@FILTERS.add("FILTER_RANGE")
def in_range(df: DataFrame, slot: Slot) -> Column:
    """Both ends included; a null end is open."""
    low, high = _values(slot)
    c = column(df, slot, "ordered")
    if low is None or high is None:
        return c <= high if low is None else c >= low
    return c.between(low, high)


@FILTERS.add("FILTER_NULL")
def null_state(df: DataFrame, slot: Slot) -> Column:
    """``values`` says which rows stay: ["null"] or ["not_null"]. NaN and the empty set aren't null."""
    state = _values(slot)
    if state not in (["null"], ["not_null"]):
        raise RequestError("FILTER_NULL: values must be ['null'] or ['not_null']")
    c = column(df, slot)
    return c.isNull() if state == ["null"] else c.isNotNull()


@FILTERS.add("FILTER_EXPRESSION")
def by_expression(df: DataFrame, slot: Slot) -> Column:
    return expression(df, slot.need("expression"), slot.get("constants"), slot.get("lookups"), None, slot.get("models"))


def _truthy(df: DataFrame, slot: Slot) -> Column:
    """What counts as true: a true boolean, a number other than 0 and NaN, a non-empty text or set; null for null."""
    c, of = column(df, slot), kind(df, slot.field)
    if isinstance(of, BooleanType):
        return c
    if isinstance(of, NumericType):
        return (c != 0) & ~F.isnan(c.cast("double"))
    return F.size(c) > 0 if of.typeName() == "array" else F.length(c.cast("string")) > 0


def _strict(df: DataFrame, slot: Slot) -> bool:
    if slot.get("values") == ["truthy"]:
        return False
    if not isinstance(kind(df, slot.field), BooleanType):
        raise RequestError(f"{slot.type}: field {slot.field!r} isn't boolean; values ['truthy'] opts into truthiness")
    return True


@FILTERS.add("FILTER_TRUE")
def is_true(df: DataFrame, slot: Slot) -> Column:
    return column(df, slot) if _strict(df, slot) else _truthy(df, slot)


@FILTERS.add("FILTER_FALSE")
def is_false(df: DataFrame, slot: Slot) -> Column:
    """Strict: false only. Truthy: what is falsy, and null."""
    return ~column(df, slot) if _strict(df, slot) else ~F.coalesce(_truthy(df, slot), F.lit(False))


def _labels(slot: Slot) -> Column:
    values = _values(slot)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


@FILTERS.add("FILTER_SET_CONTAINS_ALL")
def contains_all(df: DataFrame, slot: Slot) -> Column:
    return F.size(F.array_except(_labels(slot), column(df, slot, "set"))) == 0


@FILTERS.add("FILTER_SET_CONTAINS_ANY")
def contains_any(df: DataFrame, slot: Slot) -> Column:
    return F.arrays_overlap(column(df, slot, "set"), _labels(slot))


@FILTERS.add("FILTER_SET_CONTAINS_NONE")
def contains_none(df: DataFrame, slot: Slot) -> Column:
    """Null passes."""
    c = column(df, slot, "set")
    return c.isNull() | ~F.arrays_overlap(c, _labels(slot))


@FILTERS.add("FILTER_SET_EQUALS")
def set_equals(df: DataFrame, slot: Slot) -> Column:
    return F.array_sort(F.array_distinct(column(df, slot, "set"))) == F.array_sort(F.array_distinct(_labels(slot)))


def date_ranges(slot: Slot) -> list[tuple[str, dt.date, dt.date]]:
    """Labelled (start, end) days, both included, in order; ranges that overlap or end before they start are refused."""
    out = []
    for r in slot.need("ranges"):
        start, end = dt.date.fromisoformat(str(r["start"])), dt.date.fromisoformat(str(r["end"]))
        if end < start:
            raise RequestError(f"{slot.type}: range {r['label']!r} ends before it starts")
        out.append((r["label"], start, end))
    ordered = sorted(out, key=lambda x: x[1])
    for a, b in zip(ordered, ordered[1:]):
        if b[1] <= a[2]:
            raise RequestError(f"{slot.type}: ranges {a[0]!r} and {b[0]!r} overlap")
    return out


@FILTERS.add("FILTER_DATE_RANGES")
def in_date_ranges(df: DataFrame, slot: Slot) -> Column:
    column(df, slot, "date")
    day = local_time(df, slot.field, slot.get("zone")).cast("date")
    out = F.lit(False)
    for _, start, end in date_ranges(slot):
        out = out | day.between(F.lit(start), F.lit(end))
    return out


def apply_filters(df: DataFrame, slots: list[Slot]) -> DataFrame:
    for slot in slots:
        df = df.where(FILTERS.find(slot.type)(df, slot))
    return df


def filter_counts(df: DataFrame, slots: list[Slot]) -> DataFrame:
    """One row for each filter: n_in, n_null_input and n_out, from one pass over the unfiltered table."""
    passed, aggregates = F.lit(True), []
    for k, slot in enumerate(slots):
        own = F.coalesce(FILTERS.find(slot.type)(df, slot), F.lit(False))
        empty = F.col(f"`{slot.field}`").isNull() if slot.field else F.lit(False)
        aggregates += [F.count_if(passed).alias(f"in{k}"), F.count_if(passed & empty).alias(f"null{k}")]
        passed = passed & own
        aggregates.append(F.count_if(passed).alias(f"out{k}"))
    rows = F.array(
        *(F.struct(F.lit(k).alias("slot"), F.lit(s.type).alias("type"), F.col(f"in{k}").alias("n_in"), F.col(f"null{k}").alias("n_null_input"), F.col(f"out{k}").alias("n_out")) for k, s in enumerate(slots))
    )
    return df.agg(*aggregates).select(F.inline(rows))
