"""Windows over result rows, or over records where nothing is grouped. Rows keep their order and number.

A slot's params: ``partition_by`` (list of columns), ``order_by`` (list of column names or (name, desc) pairs), and
``frame`` ({"preceding": n or None, "following": n or None}). Nulls sort last both ways.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.errors import RequestError
from tessella.operators.slots import Registry, Slot, expression, number

WINDOWS = Registry("window")


def ordering(order: list, tie: str | None = None) -> list[Column]:
    out = []
    for o in order:
        name, desc = (o, False) if isinstance(o, str) else (o[0], bool(o[1]))
        c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if desc else c.asc_nulls_last())
    return out + ([F.col(f"`{tie}`").asc()] if tie else [])


def spec(slot: Slot, tie: bool = False) -> WindowSpec:
    part = Window.partitionBy(*(F.col(f"`{c}`") for c in slot.get("partition_by", [])))
    return part.orderBy(*ordering(slot.need("order_by"), slot.get("tie") if tie else None))


def framed(slot: Slot) -> WindowSpec:
    frame = slot.need("frame")
    before, after = frame.get("preceding"), frame.get("following")
    return spec(slot, True).rowsBetween(
        Window.unboundedPreceding if before is None else -int(before), Window.unboundedFollowing if after is None else int(after)
    )


@WINDOWS.add("WIN_ROW_NUMBER")
def row_number(df: DataFrame, slot: Slot) -> Column:
    return F.row_number().over(spec(slot, True))


@WINDOWS.add("WIN_RANK")
def rank(df: DataFrame, slot: Slot) -> Column:
    return F.rank().over(spec(slot))


@WINDOWS.add("WIN_DENSE_RANK")
def dense_rank(df: DataFrame, slot: Slot) -> Column:
    return F.dense_rank().over(spec(slot))


@WINDOWS.add("WIN_LAG")
def lag(df: DataFrame, slot: Slot) -> Column:
    return F.lag(F.col(f"`{slot.field}`"), int(slot.get("offset", 1)), slot.get("default")).over(spec(slot, True))


@WINDOWS.add("WIN_LEAD")
def lead(df: DataFrame, slot: Slot) -> Column:
    return F.lead(F.col(f"`{slot.field}`"), int(slot.get("offset", 1)), slot.get("default")).over(spec(slot, True))


@WINDOWS.add("WIN_DELTA")
def delta(df: DataFrame, slot: Slot) -> Column:
    x = number(df, slot)
    return x - F.lag(x, int(slot.get("periods", 1))).over(spec(slot, True))


@WINDOWS.add("WIN_PCT_CHANGE")
def pct_change(df: DataFrame, slot: Slot) -> Column:
    """Null where the earlier value is 0."""
    x = number(df, slot)
    prior = F.lag(x, int(slot.get("periods", 1))).over(spec(slot, True))
    return F.when(prior != 0, (x - prior) / prior)


@WINDOWS.add("WIN_RUNNING_SUM")
def running_sum(df: DataFrame, slot: Slot) -> Column:
    return F.sum(number(df, slot)).over(framed(slot))


@WINDOWS.add("WIN_RUNNING_AVG")
def running_avg(df: DataFrame, slot: Slot) -> Column:
    return F.avg(number(df, slot)).over(framed(slot))


@WINDOWS.add("WIN_MOVING_AVG")
def moving_avg(df: DataFrame, slot: Slot) -> Column:
    frame = slot.need("frame")
    if frame.get("preceding") is None or frame.get("following") is None:
        raise RequestError("WIN_MOVING_AVG: both ends of the frame must be set")
    return running_avg(df, slot)


def _share(x: Column, slot: Slot) -> Column:
    whole = Window.partitionBy(*(F.col(f"`{c}`") for c in slot.get("partition_by", [])))
    part = F.sum(x).over(spec(slot, True).rowsBetween(Window.unboundedPreceding, 0)) if slot.get("cumulative") else x
    return F.try_divide(part, F.sum(x).over(whole))


@WINDOWS.add("WIN_SHARE")
def share(df: DataFrame, slot: Slot) -> Column:
    return _share(number(df, slot), slot)


@WINDOWS.add("WIN_LIFT")
def lift(df: DataFrame, slot: Slot) -> Column:
    base = number(df, Slot(slot.type, slot.need("base")))
    return F.try_divide(_share(number(df, slot), slot), _share(base, slot))


@WINDOWS.add("WIN_FORMULA")
def formula(df: DataFrame, slot: Slot) -> Column:
    return expression(df, slot.need("expression"), slot.get("constants"), slot.get("lookups"), None, slot.get("models")).cast("double")


def kernel(slot: Slot) -> list[float]:
    """Lag weights from lag 0 on: geometric (decay^l), delayed (decay^((l - peak)^2)), weibull_cdf (running products of
    the survival function) or weibull_pdf (the density, scaled to a largest weight of 1)."""
    kind, most = slot.get("kernel", "geometric"), int(slot.get("max_lag", 8))
    lags = range(most + 1)
    if kind == "geometric":
        out = [float(slot.need("decay")) ** k for k in lags]
    elif kind == "delayed":
        out = [float(slot.need("decay")) ** ((k - float(slot.get("peak", 0))) ** 2) for k in lags]
    elif kind in ("weibull_cdf", "weibull_pdf"):
        shape, scale = float(slot.need("shape")), float(slot.need("scale"))
        if kind == "weibull_cdf":
            out = [1.0]
            for k in range(1, most + 1):
                out.append(out[-1] * math.exp(-((k / scale) ** shape)))
        else:
            density = [shape / scale * ((k + 1) / scale) ** (shape - 1) * math.exp(-(((k + 1) / scale) ** shape)) for k in lags]
            out = [d / max(density) if max(density) > 0 else 0.0 for d in density]
    else:
        raise RequestError(f"WIN_DISTRIBUTED_LAG: no kernel {kind!r}")
    total = sum(out)
    return [w / total for w in out] if slot.get("normalize") and total > 0 else out


@WINDOWS.add("WIN_DISTRIBUTED_LAG")
def distributed_lag(df: DataFrame, slot: Slot) -> Column:
    """Missing earlier rows and nulls add nothing; a null row stays null."""
    x, over = number(df, slot), spec(slot, True)
    out = F.lit(0.0)
    for k, w in enumerate(kernel(slot)):
        out = out + F.coalesce((F.lag(x, k).over(over) if k else x) * w, F.lit(0.0))
    return F.when(x.isNotNull(), out)


#: Windows that are recursions: they work on each partition as a whole.
RECURSIONS = Registry("recursive window")


@RECURSIONS.add("WIN_EWMA")
def ewma(df: DataFrame, slot: Slot) -> DataFrame:
    """s = alpha x + (1 - alpha) s, from the first value on; a null row stays null and leaves the state. A partition is
    one series, read in Arrow batches: only the last state is carried along."""
    alpha = float(slot.get("alpha", 1 - float(slot.get("decay", 0.5))))
    if not 0 < alpha <= 1:
        raise RequestError("WIN_EWMA: alpha must be above 0 and at most 1")
    keys, name, field = list(slot.get("partition_by", [])), slot.name(), slot.field
    number(df, slot)
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            tags = list(zip(*(batch[k].tolist() for k in keys))) if keys else [()] * len(batch)
            for tag, x in zip(tags, batch[field].tolist()):
                if tag != key:
                    key, state = tag, None
                if x is None or x != x:
                    out.append(None)
                else:
                    state = float(x) if state is None else alpha * float(x) + (1 - alpha) * state
                    out.append(state)
            batch = batch.copy()
            batch[name] = pd.Series(out, dtype="float64", index=batch.index)
            yield batch

    dealt = df.repartition(*(F.col(f"`{k}`") for k in keys)) if keys else df.repartition(1)
    inside = dealt.sortWithinPartitions(*(F.col(f"`{k}`") for k in keys), *ordering(slot.need("order_by"), slot.get("tie")))
    return inside.mapInPandas(run, schema)


def apply_windows(df: DataFrame, slots: list[Slot]) -> DataFrame:
    for slot in slots:
        if slot.type in RECURSIONS:
            df = RECURSIONS[slot.type](df, slot)
        else:
            df = df.withColumn(slot.name(), WINDOWS.find(slot.type)(df, slot))
    return df
