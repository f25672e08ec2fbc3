"""Aggregations. Most are one column of the group's single aggregate; a few need a stage of their own.

A stage is a table by the group's keys that joins the others on them. With a weight, a row whose weight is null, NaN,
zero or below takes no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions.dist import normal_quantile
from tessella.functions.quantiles import exact_quantiles, same, with_keys
from tessella.functions.running import running_totals
from tessella.operators.slots import Registry, Slot, clean, column, is_decimal, kind, number, valid_weight

AGGREGATES = Registry("aggregation")
#: Those that a whole table by keys is made for: (df, keys, slot) to a DataFrame of keys and the slot's name.
STAGES = Registry("staged aggregation")


def _w(df: DataFrame, slot: Slot) -> Column | None:
    return valid_weight(df, slot.weight) if slot.weight else None


@AGGREGATES.add("AGG_COUNT")
def count(df: DataFrame, slot: Slot) -> Column:
    c, w = (column(df, slot) if slot.field else F.lit(1)), _w(df, slot)
    return F.count(c) if w is None else F.coalesce(F.sum(F.when(c.isNotNull(), w)), F.lit(0.0))


@AGGREGATES.add("AGG_SUM")
def total(df: DataFrame, slot: Slot) -> Column:
    """Of nothing: 0. A decimal stays one."""
    if is_decimal(df, slot) and not slot.weight:
        return F.coalesce(F.sum(column(df, slot)), F.lit(0).cast(kind(df, slot.field)))
    x, w = number(df, slot), _w(df, slot)
    return F.coalesce(F.sum(x if w is None else x * w), F.lit(0.0))


def _mean(x: Column, w: Column | None) -> Column:
    return F.avg(x) if w is None else F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


@AGGREGATES.add("AGG_AVERAGE")
def average(df: DataFrame, slot: Slot) -> Column:
    if is_decimal(df, slot) and not slot.weight:
        of = kind(df, slot.field)
        return F.bround(F.avg(column(df, slot)), of.scale).cast(of)
    return clean(_mean(number(df, slot), _w(df, slot)))


@AGGREGATES.add("AGG_WEIGHTED_MEAN")
def weighted_mean(df: DataFrame, slot: Slot) -> Column:
    return clean(_mean(number(df, slot), valid_weight(df, slot.need("weight_field"))))


def _level(df: DataFrame, slot: Slot) -> Column:
    """Rank of an ordered level, from 0; null for levels that aren't listed."""
    levels = list(slot.need("levels"))
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), column(df, slot).cast("string")), F.lit(0)).cast("int") - 1


def _named(rank: Column, slot: Slot) -> Column:
    return F.get(F.array(*map(F.lit, slot.need("levels"))), rank)


@AGGREGATES.add("AGG_MIN")
def least(df: DataFrame, slot: Slot) -> Column:
    return _named(F.min(_level(df, slot)), slot) if slot.get("ordered") else F.min(column(df, slot, "ordered"))


@AGGREGATES.add("AGG_MAX")
def greatest(df: DataFrame, slot: Slot) -> Column:
    return _named(F.max(_level(df, slot)), slot) if slot.get("ordered") else F.max(column(df, slot, "ordered"))


@AGGREGATES.add("AGG_RANGE")
def spread(df: DataFrame, slot: Slot) -> Column:
    x = number(df, slot)
    return F.max(x) - F.min(x)


def _variance(df: DataFrame, slot: Slot) -> Column:
    """Population by default; ``ddof`` 1 for a sample. Weighted, from sums of w, wx and wx² around the values' scale;
    probability weights are rescaled to the number of rows."""
    x, w, ddof = number(df, slot), _w(df, slot), int(slot.get("ddof", 0))
    if w is None:
        return F.when(F.count(x) > ddof, F.var_samp(x) if ddof else F.var_pop(x))
    w = F.when(x.isNotNull(), w)
    n = F.sum(w) if slot.weight_kind == "frequency" else F.count(F.when(x.isNotNull(), w))
    mean = F.try_divide(F.sum(w * x), F.sum(w))
    second = F.greatest(F.try_divide(F.sum(w * x * x), F.sum(w)) - mean * mean, F.lit(0.0))
    return F.when(n > ddof, second * n / (n - ddof))


@AGGREGATES.add("AGG_VARIANCE")
def variance(df: DataFrame, slot: Slot) -> Column:
    return clean(_variance(df, slot))


@AGGREGATES.add("AGG_STDDEV")
def stddev(df: DataFrame, slot: Slot) -> Column:
    return clean(F.sqrt(_variance(df, slot)))


@AGGREGATES.add("AGG_SKEWNESS")
def skewness(df: DataFrame, slot: Slot) -> Column:
    x = number(df, slot)
    return F.when((F.count(x) > 1) & (F.var_pop(x) > 0), F.skewness(x))


@AGGREGATES.add("AGG_KURTOSIS")
def kurtosis(df: DataFrame, slot: Slot) -> Column:
    x = number(df, slot)
    return F.when((F.count(x) > 1) & (F.var_pop(x) > 0), F.kurtosis(x))


@AGGREGATES.add("AGG_WELFORD")
def welford(df: DataFrame, slot: Slot) -> Column:
    x = number(df, slot)
    return F.struct(F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.var_samp(x)).alias("variance"), F.count(x).alias("n"))


def _bound(df: DataFrame, slot: Slot, sign: int) -> Column:
    x = number(df, slot)
    z = normal_quantile((1 + float(slot.get("confidence", 0.95))) / 2)
    return F.when(F.count(x) > 1, F.avg(x) + sign * F.lit(z) * F.sqrt(F.var_samp(x) / F.count(x)))


@AGGREGATES.add("AGG_CI_LOWER")
def ci_lower(df: DataFrame, slot: Slot) -> Column:
    return _bound(df, slot, -1)


@AGGREGATES.add("AGG_CI_UPPER")
def ci_upper(df: DataFrame, slot: Slot) -> Column:
    return _bound(df, slot, 1)


@AGGREGATES.add("AGG_CONSTANT")
def constant(df: DataFrame, slot: Slot) -> Column:
    return F.max(F.lit(slot.need("value")).cast(slot.get("type", "double")))


@AGGREGATES.add("AGG_DISTINCT_COUNT")
def distinct_count(df: DataFrame, slot: Slot) -> Column:
    c = column(df, slot)
    return F.approx_count_distinct(c) if slot.get("approximate") else F.count_distinct(c)


@AGGREGATES.add("AGG_NULL_COUNT")
def null_count(df: DataFrame, slot: Slot) -> Column:
    return F.count_if(column(df, slot).isNull())


@AGGREGATES.add("AGG_FREQUENCY")
def frequency(df: DataFrame, slot: Slot) -> Column:
    return F.count_if(column(df, slot) == F.lit(slot.need("value"))).cast("double")


@AGGREGATES.add("AGG_MODE")
def mode(df: DataFrame, slot: Slot) -> Column:
    """Ties go to the smallest value."""
    return F.mode(column(df, slot, "ordered"), True)


@AGGREGATES.add("AGG_RATIO")
def ratio(df: DataFrame, slot: Slot) -> Column:
    a, b = (F.col(f"`{slot.need(k)}`").cast("double") for k in ("numerator_field", "denominator_field"))
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.sum(F.when(both, a)), F.sum(F.when(both, b)))


def _errors(df: DataFrame, slot: Slot) -> tuple[Column, Column]:
    y = number(df, slot)
    return y, y - F.col(f"`{slot.need('prediction_field')}`").cast("double")


@AGGREGATES.add("AGG_MAE")
def mae(df: DataFrame, slot: Slot) -> Column:
    return F.avg(F.abs(_errors(df, slot)[1]))


@AGGREGATES.add("AGG_RMSE")
def rmse(df: DataFrame, slot: Slot) -> Column:
    e = _errors(df, slot)[1]
    return F.sqrt(F.avg(e * e))


@AGGREGATES.add("AGG_MAPE")
def mape(df: DataFrame, slot: Slot) -> Column:
    """A fraction; rows whose actual value is 0 take no part."""
    y, e = _errors(df, slot)
    return F.avg(F.when(y != 0, F.abs(e) / F.abs(y)))


def _share(slot: Slot) -> float:
    p = 0.5 if slot.type == "AGG_MEDIAN" else float(slot.need("percentile")) / 100
    if not 0 <= p <= 1:
        raise RequestError("AGG_PERCENTILE: percentile must be from 0 to 100")
    return p


def ordered_quantile(df: DataFrame, slot: Slot) -> Column:
    """The first of the listed levels whose share reaches p; what a group holds is a count for each level."""
    return _named(F.expr(f"percentile_disc({_share(slot)}) within group (order by _level_{slot.field})"), slot)


def windowed_quantile(df: DataFrame, slot: Slot) -> Column:
    """For event-time windows of a stream, which can't be read twice: exact, with the window's distinct values as state."""
    return ordered_quantile(df, slot) if slot.get("ordered") else F.percentile(number(df, slot), _share(slot))


# ---- sets


def _size(df: DataFrame, slot: Slot) -> Column:
    c = column(df, slot, "set")
    return F.when(c.isNotNull(), F.size(c))


@AGGREGATES.add("AGG_SET_CARDINALITY_SUM")
def cardinality_sum(df: DataFrame, slot: Slot) -> Column:
    return F.coalesce(F.sum(_size(df, slot)), F.lit(0))


@AGGREGATES.add("AGG_SET_CARDINALITY_AVG")
def cardinality_avg(df: DataFrame, slot: Slot) -> Column:
    return F.avg(_size(df, slot))


@AGGREGATES.add("AGG_SET_DISTINCT_VALUES")
def set_distinct(df: DataFrame, slot: Slot) -> Column:
    return F.count_distinct(F.array_sort(F.array_distinct(column(df, slot, "set"))))


@AGGREGATES.add("AGG_SET_UNION")
def set_union(df: DataFrame, slot: Slot) -> Column:
    """Distinct sets are few where labels are (at most 256), so what a group gathers is bounded by them."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(column(df, slot, "set"))))))


@AGGREGATES.add("AGG_SET_INTERSECTION")
def set_intersection(df: DataFrame, slot: Slot) -> Column:
    seen = F.collect_set(F.array_sort(column(df, slot, "set")))
    return F.array_sort(F.aggregate(seen, F.get(seen, F.lit(0)), F.array_intersect))


# ---- vectors: an aggregate for each member, whose number ``dim`` is part of the type


def _members(df: DataFrame, slot: Slot, f: Callable[[Column], Column]) -> Column:
    c, dim = column(df, slot, "vector"), int(slot.need("dim"))
    at = lambda k: F.get(c, F.lit(k)).cast("double")
    if slot.get("element") is not None:
        return f(at(int(slot.get("element"))))
    return F.array(*(f(F.when(~F.isnan(at(k)), at(k))) for k in range(dim)))


@AGGREGATES.add("AGG_VEC_MEAN")
def vec_mean(df: DataFrame, slot: Slot) -> Column:
    return _members(df, slot, F.avg)


@AGGREGATES.add("AGG_VEC_SUM")
def vec_sum(df: DataFrame, slot: Slot) -> Column:
    return _members(df, slot, F.sum)


@AGGREGATES.add("AGG_VEC_SD")
def vec_sd(df: DataFrame, slot: Slot) -> Column:
    return _members(df, slot, F.stddev_samp)


# ---- stages


@STAGES.add("AGG_MODE_COUNT")
def mode_count(df: DataFrame, keys: list[str], slot: Slot) -> DataFrame:
    c = column(df, slot)
    counts = df.where(c.isNotNull()).groupBy(*keys, c.alias("_value")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max("_n").cast("double").alias(slot.name()))


@STAGES.add("AGG_DISTINCT_SUM")
def distinct_sum(df: DataFrame, keys: list[str], slot: Slot) -> DataFrame:
    """The first value of each key by ``order`` (a unique column), then their sum."""
    by, order = slot.need("distinct_by"), slot.get("order")
    x = number(df, slot)
    rows = df.where(x.isNotNull() & F.col(f"`{by}`").isNotNull())
    first = F.min_by(x, F.col(f"`{order}`")) if order else F.min(x)
    once = rows.groupBy(*keys, F.col(f"`{by}`").alias("_by")).agg(first.alias("_x"))
    return once.groupBy(*keys).agg(F.sum("_x").alias(slot.name()))


@STAGES.add("AGG_SET_FREQUENCY")
def set_frequency(df: DataFrame, keys: list[str], slot: Slot) -> DataFrame:
    c = column(df, slot, "set")
    each = df.select(*keys, F.explode(F.array_distinct(c)).alias("_label")).groupBy(*keys, "_label").agg(F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct("_label", "_n")))
    return each.groupBy(*keys).agg(F.map_from_entries(entries).alias(slot.name()))


@STAGES.add("AGG_AUC")
def auc(df: DataFrame, keys: list[str], slot: Slot) -> DataFrame:
    """Rank sum over counts by score; ties count one half. Null unless both outcomes occur."""
    x, y = number(df, slot), F.col(f"`{slot.need('outcome')}`")
    hit = (y == F.lit(slot.get("positive", 1))).cast("int")
    rows = df.where(x.isNotNull() & y.isNotNull()).select(*keys, (x + 0.0).alias("_x"), hit.alias("_hit"))
    counts = rows.groupBy(*keys, "_x").agg(F.sum("_hit").alias("_p"), F.sum(1 - F.col("_hit")).alias("_q"))
    placed = running_totals(counts, "_x", {"_below": F.col("_q")}, keys, rows)
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2))
    return placed.groupBy(*keys).agg(F.try_divide(wins, F.sum("_p") * F.sum("_q")).alias(slot.name()))


@STAGES.add("AGG_ZSCORE")
def zscore(df: DataFrame, keys: list[str], slot: Slot) -> DataFrame:
    """The last row's z-score by ``order`` (a unique column), with mean and population deviation of the group."""
    x, order = number(df, slot), F.col(f"`{slot.need('order')}`")
    last = F.max_by(x, F.when(x.isNotNull(), order))
    return df.groupBy(*keys).agg(F.try_divide(last - F.avg(x), F.stddev_pop(x)).alias(slot.name()))


@STAGES.add("AGG_MEDIAN")
@STAGES.add("AGG_PERCENTILE")
def quantile(df: DataFrame, keys: list[str], slot: Slot) -> DataFrame:
    """Exact, by linear interpolation; of ordered levels the first whose share reaches p. Weights repeat rows: the place
    (n - 1) p counts whole weights."""
    if slot.get("ordered"):
        return df.groupBy(*keys).agg(ordered_quantile(df, slot).alias(slot.name()))
    x, p = number(df, slot), _share(slot)
    if not slot.weight:
        return exact_quantiles(df, keys, x, {slot.name(): p})
    w = valid_weight(df, slot.weight).cast("bigint")
    rows = df.where(x.isNotNull() & (w > 0)).select(*keys, (x + 0.0).alias("_x"), w.alias("_w"))
    counts = rows.groupBy(*keys, "_x").agg(F.sum("_w").alias("_n"))
    placed = running_totals(counts, "_x", {"_before": F.col("_n")}, keys, rows)
    placed = with_keys(placed, rows.groupBy(*keys).agg(F.sum("_w").alias("_all")), keys)
    place, upto = (F.col("_all") - 1) * p, F.col("_before") + F.col("_n")
    low, high = (F.min(F.when(upto > at, F.col("_x"))) for at in (F.floor(place), F.ceil(place)))
    share = F.first(place - F.floor(place))
    return placed.groupBy(*keys).agg(((1 - share) * low + share * high).alias(slot.name()))


@STAGES.add("AGG_QUANTILE_WEIGHTED")
def weighted_quantile(df: DataFrame, keys: list[str], slot: Slot) -> DataFrame:
    """Quantile under probability weights: weights are rescaled to the number of rows n, and the value at place
    1 + (n - 1) p of the running weights is interpolated, as unweighted quantiles are."""
    x, w, p = number(df, slot), valid_weight(df, slot.weight or slot.need("weight_field")), float(slot.need("percentile")) / 100
    each = df.where(x.isNotNull() & w.isNotNull()).select(*keys, (x + 0.0).alias("_x"), w.alias("_w"))
    rows = each.groupBy(*keys, "_x").agg(F.sum("_w").alias("_w"))
    whole = each.groupBy(*keys).agg(F.sum("_w").alias("_tw"), F.count("*").alias("_tn"))
    placed = with_keys(running_totals(rows, "_x", {"_before": F.col("_w")}, keys, each), whole, keys)
    placed = placed.withColumn("_c", F.round((F.col("_before") + F.col("_w")) * F.col("_tn") / F.col("_tw"), 9))
    at = 1 + (F.col("_tn") - 1) * p
    low = F.min(F.when(F.col("_c") >= F.floor(at), F.col("_x")))
    high = F.min(F.when(F.col("_c") >= F.least(F.floor(at) + 1, F.col("_tn")), F.col("_x")))
    share = F.first(at - F.floor(at))
    return placed.groupBy(*keys).agg((low + share * (high - low)).alias(slot.name()))


#: Measures that follow from sums over parts: state columns with how they merge, and the measure from merged states.
def states(df: DataFrame, slot: Slot) -> tuple[dict[str, tuple[Column, Callable]], Callable[[dict[str, Column]], Column]] | None:
    """None for a measure that does not merge this way."""
    if slot.type in ("AGG_COUNT", "AGG_SUM"):
        return {"a": (AGGREGATES.find(slot.type)(df, slot), F.sum)}, lambda s: s["a"]
    if slot.type in ("AGG_MIN", "AGG_MAX") and not slot.get("ordered"):
        return {"a": (AGGREGATES.find(slot.type)(df, slot), F.min if slot.type == "AGG_MIN" else F.max)}, lambda s: s["a"]
    if slot.type == "AGG_RANGE":
        x = number(df, slot)
        return {"a": (F.min(x), F.min), "b": (F.max(x), F.max)}, lambda s: s["b"] - s["a"]
    if slot.type == "AGG_AVERAGE" and not is_decimal(df, slot):
        x, w = number(df, slot), _w(df, slot)
        parts = (F.sum(x), F.count(x)) if w is None else (F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))
        return {"a": (parts[0], F.sum), "b": (parts[1], F.sum)}, lambda s: clean(F.try_divide(s["a"], s["b"]))
    return None


def with_levels(df: DataFrame, slots: list[Slot]) -> DataFrame:
    """Adds the level ranks that ordered quantiles sort by."""
    for slot in slots:
        if slot.get("ordered") and slot.type in ("AGG_MEDIAN", "AGG_PERCENTILE"):
            df = df.withColumn(f"_level_{slot.field}", _level(df, slot))
    return df


def aggregate(df: DataFrame, keys: list[str], slots: list[Slot]) -> DataFrame:
    """One row for each combination of keys, with a column for each slot: one aggregate for all plain slots, and a
    join on the keys for each staged one."""
    names = [s.name() for s in slots]
    if len(set(names)) < len(names):
        raise RequestError(f"aggregations share a label: {names}")
    df = with_levels(df, slots)
    plain = [s for s in slots if s.type not in STAGES or s.type in AGGREGATES]
    columns = [AGGREGATES.find(s.type)(df, s).alias(s.name()) for s in plain]
    staged = [s for s in slots if s not in plain]
    out = df.groupBy(*keys).agg(*columns) if columns else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    for slot in staged:
        part = STAGES.find(slot.type)(df, keys, slot)
        if keys:
            out = out.alias("_a").join(part.alias("_b"), same("_a", "_b", keys), "left").select("_a.*", F.col(f"_b.`{slot.name()}`"))
        else:
            out = out.join(F.broadcast(part), how="left")
    return out.select(*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{n}`") for n in names))
