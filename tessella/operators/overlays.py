"""Overlays: decorations of a finished result, which they never change.

A host is a result table. A series host has key columns and a value; a matrix host is a crosstab in long form (row key,
column key, value, without margins); comparisons with another slot, stage or population take a second table. Each
overlay adds a column. Hosts have as many rows as a result, so p-values are worked out by vectorised functions on them.

Params: ``value``, ``partition_by``, ``order_by``, ``row``, ``col``, ``on`` (keys of a second table), and those of each kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.errors import RequestError
from tessella.functions import dist
from tessella.operators.slots import Registry, Slot, expression
from tessella.operators.windows import ordering

OVERLAYS = Registry("overlay")


def _vector(f: Callable[..., float]) -> Callable[..., Column]:
    """A function of numbers as a vectorised column function; null where an input is null or the result undefined."""

    @F.pandas_udf(DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            good = all(v is not None and v == v for v in row)
            out.append(f(*map(float, row)) if good else None)
        return pd.Series(out, dtype="float64").where(lambda s: s.notna(), None)

    return run


normal_p = _vector(dist.normal_tail)
t_p = _vector(lambda t, df: dist.t_tail(t, df) if df > 0 else float("nan"))
chisq_p = _vector(lambda x, df: dist.chisq_tail(x, df) if df > 0 else float("nan"))
probit = _vector(lambda p: dist.normal_quantile(p) if 0 < p < 1 else float("nan"))
fisher_p = _vector(lambda a, b, c, d: _fisher(a, b, c, d))


def _fisher(a: float, b: float, c: float, d: float) -> float:
    from tessella.operators.tests import fisher_of

    return fisher_of(np.array([[a, b], [c, d]]).round()) if min(a, b, c, d) >= 0 else float("nan")


def _value(slot: Slot) -> Column:
    return F.col(f"`{slot.get('value', slot.field)}`").cast("double")


def _part(slot: Slot):
    return Window.partitionBy(*(F.col(f"`{c}`") for c in slot.get("partition_by", [])))


def _ordered(slot: Slot):
    return _part(slot).orderBy(*ordering(slot.need("order_by")))


def _add(name: str) -> Callable:
    """Registers a column-valued overlay."""

    def keep(f: Callable[[DataFrame, Slot], Column]) -> Callable:
        OVERLAYS[name] = lambda df, slot, other=None: df.withColumn(slot.name(), f(df, slot))
        return f

    return keep


# ---- series


def _index(x: Column, base: Column, slot: Slot) -> Column:
    return F.try_divide(x, base) * float(slot.get("scale", 100))


def _prior(slot: Slot, x: Column) -> Column:
    return F.lag(x).over(_ordered(slot))


def _baseline(slot: Slot, x: Column) -> Column:
    whole = _ordered(slot).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(x, int(slot.get("baseline_position", 0)) + 1).over(whole)


def _sibling(slot: Slot, x: Column) -> Column:
    return F.max(F.when(F.col(f"`{slot.need('key')}`").cast("string") == str(slot.need("sibling")), x)).over(_part(slot))


def _total(slot: Slot, x: Column) -> Column:
    return F.sum(x).over(_part(slot))


for _kind, _base in (("PRIOR", _prior), ("BASELINE", _baseline), ("SIBLING", _sibling), ("TOTAL", _total)):
    _add(f"OVERLAY_INDEX_VS_{_kind}")(lambda df, s, b=_base: _index(_value(s), b(s, _value(s)), s))
    if _kind != "TOTAL":
        _add(f"OVERLAY_DELTA_VS_{_kind}")(lambda df, s, b=_base: _value(s) - b(s, _value(s)))


def _rolling(slot: Slot, f: Callable[[Column], Column]) -> Column:
    """Over the ``window`` rows before; null below ``min_periods`` values."""
    n = int(slot.need("window"))
    over = _ordered(slot).rowsBetween(-n, -1)
    return F.when(F.count(_value(slot)).over(over) >= int(slot.get("min_periods", n)), f(_value(slot)).over(over))


@_add("OVERLAY_INDEX_VS_ROLLING_MEAN")
def index_rolling(df: DataFrame, slot: Slot) -> Column:
    return _index(_value(slot), _rolling(slot, F.avg), slot)


@_add("OVERLAY_ZSCORE_VS_ROLLING")
def z_rolling(df: DataFrame, slot: Slot) -> Column:
    return F.try_divide(_value(slot) - _rolling(slot, F.avg), _rolling(slot, F.stddev_samp))


@_add("OVERLAY_ZSCORE_VS_TOTAL")
def z_total(df: DataFrame, slot: Slot) -> Column:
    x = _value(slot)
    return F.try_divide(x - F.avg(x).over(_part(slot)), F.stddev_pop(x).over(_part(slot)))


@_add("OVERLAY_SHARE_OF_TOTAL")
def share_total(df: DataFrame, slot: Slot) -> Column:
    return F.try_divide(_value(slot), _total(slot, _value(slot)))


@_add("OVERLAY_FORMULA")
def overlay_formula(df: DataFrame, slot: Slot) -> Column:
    return expression(df, slot.need("formula")).cast("double")


def _yoy(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
    """Against the same period a year before: keys 2024, 2024-Q1, 2024-05, 2024-W09, 2024-05-17 or with FY before them."""
    key, parts = slot.need("period"), list(slot.get("partition_by", []))
    c = F.col(f"`{key}`")
    year = F.regexp_extract(c, r"(\d{4})", 1)
    earlier = F.concat(F.regexp_extract(c, r"^(\D*)", 1), (year.cast("int") - 1).cast("string"), F.regexp_extract(c, r"\d{4}(.*)$", 1))
    past = df.select(c.alias("_past"), *(F.col(f"`{p}`").alias(f"_p{i}") for i, p in enumerate(parts)), _value(slot).alias("_v"))
    match = earlier == F.col("_past")
    for i, p in enumerate(parts):
        match = match & F.col(f"`{p}`").eqNullSafe(F.col(f"_p{i}"))
    out = df.join(past, match, "left")
    return out.select(*(F.col(f"`{n}`") for n in df.columns), _index(_value(slot), F.col("_v"), slot).alias(slot.name()))


OVERLAYS["OVERLAY_YOY"] = _yoy


def _samples(slot: Slot, x: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    return x(slot.get("n", "n")), x(slot.get("mean", "mean")), x(slot.get("variance", "variance"))


def _welch(a: tuple, b: tuple) -> tuple[Column, Column]:
    (na, ma, va), (nb, mb, vb) = a, b
    sa, sb = va / na, vb / nb
    t = F.try_divide(ma - mb, F.sqrt(sa + sb))
    free = F.try_divide((sa + sb) * (sa + sb), sa * sa / (na - 1) + sb * sb / (nb - 1))
    return t, free


def _prop(ka: Column, na: Column, kb: Column, nb: Column) -> Column:
    pool = (ka + kb) / (na + nb)
    return F.try_divide(ka / na - kb / nb, F.sqrt(pool * (1 - pool) * (1 / na + 1 / nb)))


@_add("OVERLAY_T_VS_PRIOR")
def t_prior(df: DataFrame, slot: Slot) -> Column:
    now = _samples(slot, lambda n: F.col(n).cast("double"))
    return t_p(*_welch(now, tuple(_prior(slot, c) for c in now)))


@_add("OVERLAY_Z_VS_PRIOR")
def z_prior(df: DataFrame, slot: Slot) -> Column:
    now = _samples(slot, lambda n: F.col(n).cast("double"))
    return normal_p(_welch(now, tuple(_prior(slot, c) for c in now))[0])


@_add("OVERLAY_PROP_Z_VS_PRIOR")
def prop_prior(df: DataFrame, slot: Slot) -> Column:
    k, n = F.col(slot.get("k", "k")).cast("double"), F.col(slot.get("n", "n")).cast("double")
    return normal_p(_prop(k, n, _prior(slot, k), _prior(slot, n)))


# ---- matrices: row and column margins are sums of the cells along an axis


def _margins(slot: Slot) -> tuple[Column, Column, Column, Column]:
    x = _value(slot)
    row, col = (Window.partitionBy(F.col(f"`{slot.need(k)}`")) for k in ("row", "col"))
    return x, F.sum(x).over(row), F.sum(x).over(col), F.sum(x).over(Window.partitionBy())


def _axis(slot: Slot) -> Column:
    _, r, c, g = _margins(slot)
    return {"row": r, "col": c, "grand": g}[slot.get("margin", "row")]


@_add("OVERLAY_SHARE_OF_ROW")
def share_row(df: DataFrame, slot: Slot) -> Column:
    x, r, _, _ = _margins(slot)
    return F.try_divide(x, r)


@_add("OVERLAY_SHARE_OF_COL")
def share_col(df: DataFrame, slot: Slot) -> Column:
    x, _, c, _ = _margins(slot)
    return F.try_divide(x, c)


@_add("OVERLAY_INDEX_VS_MARGIN")
def index_margin(df: DataFrame, slot: Slot) -> Column:
    return _index(_value(slot), _axis(slot), slot)


@_add("OVERLAY_DELTA_VS_MARGIN")
def delta_margin(df: DataFrame, slot: Slot) -> Column:
    return _value(slot) - _axis(slot)


@_add("OVERLAY_ZSCORE_VS_MARGIN")
def z_margin(df: DataFrame, slot: Slot) -> Column:
    axis = Window.partitionBy(*({"row": [slot.need("row")], "col": [slot.need("col")], "grand": []}[slot.get("margin", "row")]))
    return F.try_divide(_value(slot) - _axis(slot), F.stddev_pop(_value(slot)).over(axis))


def _chi(slot: Slot) -> Column:
    x, r, c, g = _margins(slot)
    e = r * c / g
    return F.try_divide((x - e) * (x - e), e)


def _levels(name: str) -> Column:
    return F.size(F.collect_set(F.col(f"`{name}`")).over(Window.partitionBy()))


def _chi_total(slot: Slot, axis: str | None) -> Column:
    return F.sum(F.col("_chi")).over(Window.partitionBy(*([F.col(f"`{axis}`")] if axis else [])))


def _chi_overlay(axis: str | None) -> Callable:
    def run(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
        """Adds the statistic and its p; the degrees of freedom come from the levels of the other axis, or of both."""
        rows, cols = _levels(slot.need("row")), _levels(slot.need("col"))
        free = {"row": cols - 1, "col": rows - 1, None: (rows - 1) * (cols - 1)}[axis]
        out = df.withColumn("_chi", _chi(slot)).withColumn("_df", free)
        out = out.withColumn(slot.name(), _chi_total(slot, slot.get(axis) if axis else None))
        return out.withColumn(f"{slot.name()}_p", chisq_p(F.col(slot.name()), F.col("_df").cast("double"))).drop("_chi", "_df")

    return run


OVERLAYS["OVERLAY_CHISQ_MATRIX"] = _chi_overlay(None)
OVERLAYS["OVERLAY_CHISQ_ROW"] = _chi_overlay("row")
OVERLAYS["OVERLAY_CHISQ_COL"] = _chi_overlay("col")


def _std_residual(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
    """Haberman's adjusted residual, the expected count and the two-sided p."""
    x, r, c, g = _margins(slot)
    e = r * c / g
    z = F.try_divide(x - e, F.sqrt(e * (1 - r / g) * (1 - c / g)))
    out = df.withColumn(slot.name(), z).withColumn(f"{slot.name()}_expected", e)
    return out.withColumn(f"{slot.name()}_p", normal_p(F.col(slot.name())))


OVERLAYS["OVERLAY_STD_RESIDUAL"] = _std_residual


def _fisher_cell(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
    x, r, c, g = _margins(slot)
    out = df.withColumns({"_a": x, "_b": r - x, "_c": c - x, "_d": g - r - c + x})
    return out.withColumn(slot.name(), fisher_p("_a", "_b", "_c", "_d")).drop("_a", "_b", "_c", "_d")


OVERLAYS["OVERLAY_FISHER_EXACT_CELL"] = _fisher_cell


@_add("OVERLAY_RANK")
def rank(df: DataFrame, slot: Slot) -> Column:
    keys = {"row": [slot.get("row")], "column": [slot.get("col")], "matrix": []}[slot.get("population", "matrix")]
    return F.rank().over(Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(_value(slot).desc_nulls_last()))


def _pairwise(test: Callable[[Callable[[str], Column], Callable[[str], Column], Slot], Column]) -> Callable:
    """All pairs of levels of ``pair`` within each level of ``within``: rows (within, a, b, p)."""

    def run(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
        pair, within = slot.need("pair"), list(slot.get("within", []))
        sides = [df.select(*(F.col(f"`{w}`").alias(f"w{i}") for i, w in enumerate(within)), F.col(f"`{pair}`").alias(s), *(F.col(f"`{c}`").alias(f"{s}_{c}") for c in df.columns if c != pair and c not in within)) for s in "ab"]
        match = F.col("a") < F.col("b")
        left, right = sides[0].alias("l"), sides[1].alias("r")
        for i in range(len(within)):
            match = match & F.col(f"l.w{i}").eqNullSafe(F.col(f"r.w{i}"))
        joined = left.join(right, match)
        p = test(lambda n: F.col(f"a_{n}").cast("double"), lambda n: F.col(f"b_{n}").cast("double"), slot)
        return joined.select(*(F.col(f"l.w{i}").alias(w) for i, w in enumerate(within)), "a", "b", p.alias(slot.name()))

    return run


def _kn(slot: Slot, x: Callable[[str], Column]) -> tuple[Column, Column]:
    return x(slot.get("k", "k")), x(slot.get("n", "n"))


def _probit_t(a: Callable, b: Callable, slot: Slot) -> Column:
    (ka, na), (kb, nb) = _kn(slot, a), _kn(slot, b)
    za, zb = probit(ka / na), probit(kb / nb)
    density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    spread = lambda k, n, z: (k / n) * (1 - k / n) / (n * density(z) * density(z))
    return t_p(F.try_divide(za - zb, F.sqrt(spread(ka, na, za) + spread(kb, nb, zb))), na + nb - 2)


def _weighted(slot: Slot, x: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """n is the sum of weights, or by ``n_basis`` "kish" its square over the sum of squared weights."""
    w = x(slot.get("w", "w"))
    n = w if slot.need("n_basis") == "weights" else w * w / x(slot.get("w2", "w2"))
    return n, x(slot.get("mean", "mean")), x(slot.get("variance", "variance"))


OVERLAYS["OVERLAY_PAIRWISE_PROP_Z"] = _pairwise(lambda a, b, s: normal_p(_prop(*_kn(s, a), *_kn(s, b))))
OVERLAYS["OVERLAY_PAIRWISE_PROBIT_T"] = _pairwise(_probit_t)
OVERLAYS["OVERLAY_PAIRWISE_TWO_MEANS_Z"] = _pairwise(lambda a, b, s: normal_p(_welch(_samples(s, a), _samples(s, b))[0]))
OVERLAYS["OVERLAY_PAIRWISE_WELCH_T"] = _pairwise(lambda a, b, s: t_p(*_welch(_samples(s, a), _samples(s, b))))
OVERLAYS["OVERLAY_PAIRWISE_WEIGHTED_TWO_MEANS_Z"] = _pairwise(lambda a, b, s: normal_p(_welch(_weighted(s, a), _weighted(s, b))[0]))


def _group_summary(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
    """Per cell over the group buckets: mean, min, max, range and how many contribute."""
    x = _value(slot)
    keys = [F.col(f"`{c}`") for c in (slot.need("row"), slot.need("col"))]
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"), F.count(x).alias("groups"))


OVERLAYS["OVERLAY_MATRIX_GROUP_SUMMARY"] = _group_summary


# ---- against a second table with the same keys


def _against(value: Callable[[Callable[[str], Column], Callable[[str], Column], Slot], Column]) -> Callable:
    def run(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
        if other is None:
            raise RequestError(f"{slot.type} needs a reference table")
        on = list(slot.need("on"))
        side = other.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(on)), *(F.col(f"`{c}`").alias(f"_ref_{c}") for c in other.columns if c not in on))
        match = F.lit(True)
        for i, k in enumerate(on):
            match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
        joined = df.join(side, match, "left")
        out = value(lambda n: F.col(f"`{n}`").cast("double"), lambda n: F.col(f"`_ref_{n}`").cast("double"), slot)
        return joined.select(*(F.col(f"`{c}`") for c in df.columns), out.alias(slot.name()))

    return run


def _name(slot: Slot) -> str:
    return slot.get("value", slot.field)


for _n in ("REF", "STAGE"):
    OVERLAYS[f"OVERLAY_INDEX_VS_{_n}"] = _against(lambda a, b, s: _index(a(_name(s)), b(_name(s)), s))
    OVERLAYS[f"OVERLAY_DELTA_VS_{_n}"] = _against(lambda a, b, s: a(_name(s)) - b(_name(s)))
for _n in ("OVERLAY_T_CELL", "OVERLAY_T_VS_REF"):
    OVERLAYS[_n] = _against(lambda a, b, s: t_p(*_welch(_samples(s, a), _samples(s, b))))
for _n in ("OVERLAY_Z_CELL", "OVERLAY_Z_VS_REF"):
    OVERLAYS[_n] = _against(lambda a, b, s: normal_p(_welch(_samples(s, a), _samples(s, b))[0]))
OVERLAYS["OVERLAY_PROP_Z_CELL"] = _against(lambda a, b, s: normal_p(_prop(*_kn(s, a), *_kn(s, b))))


def panel_index(targets: dict[str, DataFrame], reference: DataFrame, slot: Slot) -> dict[str, DataFrame]:
    """One indexed layer for each target slot."""
    return {n: OVERLAYS["OVERLAY_INDEX_VS_REF"](df, slot, reference) for n, df in targets.items()}


def prop_panel(slots: dict[str, DataFrame], slot: Slot) -> DataFrame:
    """p for each pair of slots and cell: the slots stack into one table whose label is paired within each cell."""
    stacked = None
    for name, df in slots.items():
        one = df.withColumn("_slot", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    inner = Slot("OVERLAY_PAIRWISE_PROP_Z", None, slot.name(), dict(slot.params) | {"pair": "_slot", "within": list(slot.need("on"))})
    return OVERLAYS["OVERLAY_PAIRWISE_PROP_Z"](stacked, inner)


OVERLAYS["OVERLAY_PANEL_INDEX_VS_REF"] = lambda df, slot, other=None: OVERLAYS["OVERLAY_INDEX_VS_REF"](df, slot, other)
OVERLAYS["OVERLAY_PROP_Z_PANEL"] = lambda df, slot, other=None: prop_panel({"target": df, "reference": other}, slot)


def _chisq_ref(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
    """Of the whole matrix against the reference, rescaled to the target's total."""
    name = _name(slot)
    both = _against(lambda a, b, s: b(name))(df, Slot(slot.type, slot.field, "_e", slot.params), other)
    g = Window.partitionBy()
    e = F.col("_e") * F.sum(F.col(f"`{name}`").cast("double")).over(g) / F.sum("_e").over(g)
    both = both.withColumn("_x", F.try_divide((F.col(f"`{name}`") - e) * (F.col(f"`{name}`") - e), e))
    both = both.withColumn(slot.name(), F.sum("_x").over(g)).withColumn("_df", (F.count("_x").over(g) - 1).cast("double"))
    return both.withColumn(f"{slot.name()}_p", chisq_p(F.col(slot.name()), F.col("_df"))).drop("_e", "_x", "_df")


OVERLAYS["OVERLAY_CHISQ_VS_REF"] = _chisq_ref
OVERLAYS["OVERLAY_CHISQ_VS_POP"] = _chisq_ref


def _pop_share(slot: Slot, a: Callable, b: Callable) -> tuple[Column, Column]:
    g = Window.partitionBy()
    return a(_name(slot)) / F.sum(a(_name(slot))).over(g), b(_name(slot)) / F.sum(b(_name(slot))).over(g)


def _index_pop(a: Callable, b: Callable, slot: Slot) -> Column:
    x, y = _pop_share(slot, a, b)
    return _index(x, y, slot)


def _z_pop(a: Callable, b: Callable, slot: Slot) -> Column:
    """Difference of shares over the binomial deviation of the population share."""
    x, y = _pop_share(slot, a, b)
    return F.try_divide(x - y, F.sqrt(y * (1 - y)))


OVERLAYS["OVERLAY_INDEX_VS_POP"] = _against(_index_pop)
OVERLAYS["OVERLAY_ZSCORE_VS_POP"] = _against(_z_pop)


def _ks_pop(df: DataFrame, slot: Slot, other: DataFrame | None = None) -> DataFrame:
    """Distance and p of two distributions given as counts by numeric value (``key``, ``value``)."""
    key, name = slot.need("key"), _name(slot)
    a, b = (t.select(F.col(f"`{key}`").cast("double").alias("v"), F.col(f"`{name}`").cast("double").alias(s)) for t, s in ((df, "a"), (other, "b")))
    rows = a.join(b, "v", "full").fillna(0.0, ["a", "b"])
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    g = Window.partitionBy()
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(g) - F.sum("b").over(upto) / F.sum("b").over(g))
    got = rows.select(gap.alias("d"), "a", "b").agg(F.max("d").alias(slot.name()), F.sum("a").alias("n"), F.sum("b").alias("m"))
    p = _vector(lambda d, n, m: dist.kolmogorov_tail(d * math.sqrt(n * m / (n + m))))
    return got.select(slot.name(), p(slot.name(), "n", "m").alias(f"{slot.name()}_p"))


OVERLAYS["OVERLAY_KS_VS_POP"] = _ks_pop


# ---- closed on the driver: square matrices of a result


def matrix_of(df: DataFrame, slot: Slot, most: int = 4000) -> tuple[list[str], list[str], np.ndarray]:
    rows = df.select(F.col(f"`{slot.need('row')}`").cast("string"), F.col(f"`{slot.need('col')}`").cast("string"), _value(slot)).limit(most * most + 1).collect()
    names = [sorted({r[k] for r in rows}) for k in (0, 1)]
    if max(map(len, names), default=0) > most:
        raise RequestError(f"{slot.type}: more than {most} levels")
    at = [{n: i for i, n in enumerate(x)} for x in names]
    out = np.zeros((len(names[0]), len(names[1])))
    for r, c, v in rows:
        out[at[0][r], at[1][c]] = v or 0.0
    return names[0], names[1], out


def _square(df: DataFrame, slot: Slot) -> tuple[list[str], np.ndarray]:
    rows, cols, m = matrix_of(df, slot)
    names = sorted({*rows, *cols})
    out = np.zeros((len(names), len(names)))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            out[names.index(r), names.index(c)] = m[i, j]
    return names, out


def markov(df: DataFrame, slot: Slot) -> dict:
    """Transition matrix, its power by ``steps``, the steady state, and steps to absorption by starting state."""
    names, m = _square(df, slot)
    size = m.sum(1, keepdims=True)
    p = np.where(size > 0, m / np.where(size > 0, size, 1), np.eye(len(m)))
    values, vectors = np.linalg.eig(p.T)
    steady = np.abs(vectors[:, np.argmin(np.abs(values - 1))].real)
    absorbing = [names.index(a) for a in slot.get("absorbing", []) if a in names]
    rest, left = [i for i in range(len(names)) if i not in absorbing], None
    if absorbing and rest:
        inner = np.eye(len(rest)) - p[np.ix_(rest, rest)]
        left = dict(zip([names[i] for i in rest], np.linalg.lstsq(inner, np.ones(len(rest)), rcond=None)[0].tolist()))
    return {"primary": p, "names": names, "power": np.linalg.matrix_power(p, int(slot.get("steps", 1))), "steady": steady / steady.sum(), "to_absorption": left}


def retention(df: DataFrame, slot: Slot) -> DataFrame:
    """Per starting state: shares that stayed, switched and went to the ``absorbing`` state."""
    x, r, c = _value(slot), F.col(f"`{slot.need('row')}`").cast("string"), F.col(f"`{slot.need('col')}`").cast("string")
    lost = c == F.lit(slot.get("absorbing"))
    lost = F.coalesce(lost, F.lit(False))
    total = F.sum(x)
    return df.groupBy(r.alias(slot.need("row"))).agg(
        F.try_divide(F.sum(F.when(r == c, x).otherwise(0.0)), total).alias("stayed"),
        F.try_divide(F.sum(F.when((r != c) & ~lost, x).otherwise(0.0)), total).alias("switched"),
        F.try_divide(F.sum(F.when((r != c) & lost, x).otherwise(0.0)), total).alias("churned"),
    )


def symmetry(df: DataFrame, slot: Slot) -> dict:
    """McNemar's test of a 2 by 2 table (corrected for continuity unless told otherwise), Bowker's of a larger one."""
    names, m = _square(df, slot)
    k = len(names)
    off = [(m[i, j], m[j, i]) for i in range(k) for j in range(i) if m[i, j] + m[j, i] > 0]
    if k == 2:
        b, c = off[0] if off else (0.0, 0.0)
        if slot.get("exact"):
            n, low = int(b + c), int(min(b, c))
            p = min(1.0, 2 * math.fsum(math.comb(n, i) for i in range(low + 1)) / 2**n)
            return {"statistic": low, "df": None, "p": p}
        d = max(0.0, abs(b - c) - (1 if slot.get("correct", True) else 0))
        x = d * d / (b + c) if b + c else 0.0
        return {"statistic": x, "df": 1, "p": dist.chisq_tail(x, 1)}
    x = sum((b - c) ** 2 / (b + c) for b, c in off)
    return {"statistic": x, "df": len(off), "p": dist.chisq_tail(x, len(off)) if off else None}


def correspondence(df: DataFrame, slot: Slot) -> dict:
    rows, cols, m = matrix_of(df, slot)
    p = m / m.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    k = min(int(slot.get("dimensions", 2)), min(m.shape) - 1)
    return {
        "inertia": (s**2)[: min(m.shape) - 1], "rows": dict(zip(rows, ((u * s)[:, :k] / np.sqrt(r)[:, None]).tolist())),
        "columns": dict(zip(cols, ((v.T * s)[:, :k] / np.sqrt(c)[:, None]).tolist())), "names": rows, "primary": (u * s)[:, :k] / np.sqrt(r)[:, None],
    }


def rake_matrix(df: DataFrame, slot: Slot) -> dict:
    """Fits a table to row and column targets by iterative proportional fitting."""
    rows, cols, m = matrix_of(df, slot)
    tr, tc = (np.array([float(slot.need(k)[n]) for n in names]) for k, names in (("row_targets", rows), ("col_targets", cols)))
    if slot.get("targets_as") == "share":
        tr, tc = tr * m.sum(), tc * m.sum()
    x, steps = m.copy(), 0
    for steps in range(1, int(slot.get("max_iter", 200)) + 1):
        x *= (tr / np.where(x.sum(1) > 0, x.sum(1), 1))[:, None]
        x *= tc / np.where(x.sum(0) > 0, x.sum(0), 1)
        if np.abs(x.sum(1) - tr).max() < float(slot.get("tolerance", 1e-8)):
            break
    return {"primary": x, "rows": rows, "columns": cols, "iterations": steps, "gap": float(np.abs(x.sum(1) - tr).max())}


def _long(rows: list[str], cols: list[str], m: np.ndarray, df: DataFrame, slot: Slot) -> DataFrame:
    got = [(r, c, float(m[i, j])) for i, r in enumerate(rows) for j, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(got, f"{slot.get('row')} string, {slot.get('col')} string, {slot.name()} double")


OVERLAYS["OVERLAY_RETENTION"] = lambda df, slot, other=None: retention(df, slot)
OVERLAYS["OVERLAY_MARKOV"] = lambda df, slot, other=None: (lambda g: _long(g["names"], g["names"], g["power"], df, slot))(markov(df, slot))
OVERLAYS["OVERLAY_RAKE"] = lambda df, slot, other=None: (lambda g: _long(g["rows"], g["columns"], g["primary"], df, slot))(rake_matrix(df, slot))
OVERLAYS["OVERLAY_SYMMETRY"] = lambda df, slot, other=None: (lambda g: df.sparkSession.createDataFrame([(float(g["statistic"]), None if g["p"] is None else float(g["p"]))], f"{slot.name()} double, p double"))(symmetry(df, slot))
OVERLAYS["OVERLAY_CORRESPONDENCE"] = lambda df, slot, other=None: df.sparkSession.createDataFrame(
    [(i + 1, float(v)) for i, v in enumerate(correspondence(df, slot)["inertia"])], f"dimension int, {slot.name()} double"
)


def overlay(df: DataFrame, slot: Slot | dict, other: DataFrame | None = None) -> DataFrame:
    slot = Slot.of(slot)
    return OVERLAYS.find(slot.type)(df, slot, other)
