"""Attributes: derived columns on the filtered rows, before grouping.

Statistics of the whole table that an attribute needs come from one-row aggregates, which are joined back: attributes
that don't read each other share one aggregate (a layer).
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
from tessella.functions.running import running_totals
from tessella.operators.filters import FILTERS
from tessella.operators.slots import Registry, Slot, check, column, expression, kind, local_time, number

#: Row-local: (df, slot) to a column.
ROWS = Registry("attribute")
#: From one-row statistics: (df, slot) to ({name: aggregate}, function of the statistics' columns to a column).
LAYERED = Registry("layered attribute")
#: Whole-table: (df, slot) to a DataFrame with the slot's column.
TABLES = Registry("whole-table attribute")


@ROWS.add("ATTR_CODE_IN")
def code_in(df: DataFrame, slot: Slot) -> Column:
    return F.coalesce(column(df, slot).isin(*slot.need("codes")), F.lit(False)).cast("double")


@ROWS.add("ATTR_DATE_PART")
def date_part(df: DataFrame, slot: Slot) -> Column:
    column(df, slot, "date")
    d = local_time(df, slot.field, slot.get("zone"))
    parts = {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "quarter": F.quarter(d), "hour": F.hour(d.cast("timestamp")),
        "iso_weekday": F.weekday(d) + 1, "iso_week": F.weekofyear(d), "day_of_year": F.dayofyear(d),
        "year_month": F.year(d) * 100 + F.month(d), "year_quarter": F.year(d) * 10 + F.quarter(d),
        "year_week": F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d),
    }
    if slot.need("part") not in parts:
        raise RequestError(f"ATTR_DATE_PART: no part {slot.get('part')!r}; one of {sorted(parts)}")
    return parts[slot.get("part")].cast("double")


@ROWS.add("ATTR_SET_HAS")
def set_has(df: DataFrame, slot: Slot) -> Column:
    return F.coalesce(F.array_contains(column(df, slot, "set"), slot.need("label")), F.lit(False)).cast("double")


@ROWS.add("ATTR_SET_POPCOUNT")
def set_popcount(df: DataFrame, slot: Slot) -> Column:
    c = column(df, slot, "set")
    return F.when(c.isNotNull(), F.size(c)).cast("double")


def members(df: DataFrame, slot: Slot) -> list[Column]:
    """The members of a vector: numeric fields, or the elements of one array field of ``dim`` members."""
    if names := slot.get("members"):
        for n in names:
            check(kind(df, n), "number", Slot(slot.type, n))
        return [F.col(f"`{n}`").cast("double") for n in names]
    c = column(df, slot, "vector")
    return [F.get(c, F.lit(k)).cast("double") for k in range(int(slot.need("dim")))]


def _present(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def complete(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & _present(c)
    return out


@ROWS.add("ATTR_SCALE_SCORE")
def scale_score(df: DataFrame, slot: Slot) -> Column:
    """Mean of the valid items, or their sum prorated to all items; ``reverse`` items count from the other end."""
    cols, names = members(df, slot), list(slot.get("members", []))
    low, high = slot.get("scale_min"), slot.get("scale_max")
    if slot.get("reverse"):
        if low is None or high is None:
            raise RequestError("ATTR_SCALE_SCORE: reverse needs scale_min and scale_max")
        cols = [low + high - c if n in slot.get("reverse") else c for n, c in zip(names, cols)]
    n = sum((_present(c).cast("int") for c in cols), F.lit(0))
    total = sum((F.when(_present(c), c).otherwise(0.0) for c in cols), F.lit(0.0))
    mean = F.when(n >= F.lit(max(1, int(slot.get("min_valid", 1)))), total / n)
    return mean * len(cols) if slot.get("stat", "mean") == "sum" else mean


def _profile(df: DataFrame, slot: Slot) -> list[tuple[Column, float]]:
    reference = [float(v) for v in slot.need("reference")]
    cols = members(df, slot)
    if len(cols) != len(reference):
        raise RequestError(f"{slot.type}: {len(cols)} members and {len(reference)} reference values")
    return list(zip(cols, reference))


def _over(pairs: list[tuple[Column, float]], f: Callable[[Column, float], Column]) -> Column:
    return sum((F.when(_present(c), f(c, r)).otherwise(0.0) for c, r in pairs), F.lit(0.0))


@ROWS.add("ATTR_PROFILE_SIMILARITY")
def profile_similarity(df: DataFrame, slot: Slot) -> Column:
    """Correlation or cosine with a reference profile over the members that are present."""
    if isinstance(slot.need("reference")[0], str):
        return _set_similarity(df, slot)
    pairs, metric = _profile(df, slot), slot.get("metric", "correlation")
    n = _over(pairs, lambda c, r: F.lit(1.0))
    sx, sy = _over(pairs, lambda c, r: c), _over(pairs, lambda c, r: F.lit(r))
    xx, yy, xy = _over(pairs, lambda c, r: c * c), _over(pairs, lambda c, r: F.lit(r * r)), _over(pairs, lambda c, r: c * r)
    if metric == "cosine":
        value = F.try_divide(xy, F.sqrt(xx * yy))
    elif metric == "correlation":
        under = F.greatest(n * xx - sx * sx, F.lit(0.0)) * F.greatest(n * yy - sy * sy, F.lit(0.0))
        value = F.try_divide(n * xy - sx * sy, F.sqrt(under))
    else:
        raise RequestError(f"ATTR_PROFILE_SIMILARITY: no metric {metric!r}")
    return F.when(n >= F.lit(float(slot.get("min_valid", 2))), value)


def _set_similarity(df: DataFrame, slot: Slot) -> Column:
    from tessella.functions.expressions import FUNCTIONS

    metric = slot.get("metric", "jaccard")
    if metric not in ("jaccard", "dice", "overlap", "hamming"):
        raise RequestError(f"{slot.type}: no set metric {metric!r}")
    return FUNCTIONS[metric](column(df, slot, "set"), F.array(*map(F.lit, slot.get("reference")))).cast("double")


@ROWS.add("ATTR_FORMULA")
def attr_formula(df: DataFrame, slot: Slot) -> Column:
    return expression(df, slot.need("expression"), slot.get("constants"), slot.get("lookups"), None, slot.get("models")).cast("double")


# ---- layered


@LAYERED.add("ATTR_ZSCORE")
def zscore(df: DataFrame, slot: Slot) -> tuple:
    x = number(df, slot)
    return {"m": F.avg(x), "s": F.stddev_pop(x)}, lambda s: F.when(s["s"] > 0, (x - s["m"]) / s["s"])


@LAYERED.add("ATTR_TSCORE")
def tscore(df: DataFrame, slot: Slot) -> tuple:
    stats, f = zscore(df, slot)
    return stats, lambda s: 50 + 10 * f(s)


@LAYERED.add("ATTR_NORMALIZED")
def normalized(df: DataFrame, slot: Slot) -> tuple:
    x = number(df, slot)
    return {"a": F.min(x), "b": F.max(x)}, lambda s: F.when(s["b"] > s["a"], (x - s["a"]) / (s["b"] - s["a"]))


def _fit_rows(df: DataFrame, slot: Slot) -> Column:
    on = slot.get("fit_on")
    return F.coalesce(FILTERS.find(on["type"])(df, Slot.of(on)), F.lit(False)) if on else F.lit(True)


# ---- whole-table


@TABLES.add("ATTR_PERCENTILE")
def percentile_rank(df: DataFrame, slot: Slot) -> DataFrame:
    """rank / n * 100, in (0, 100]. Ties rank by ``tie`` (a unique column) where it is given, else they share their last
    rank. Counts by value add up in ranges; only rows that tie are numbered, within their value."""
    x = number(df, slot)
    rows = df.where(_present(x)).select((x + 0.0).alias("_x"))  # -0.0 and 0.0 are one value
    counts = rows.groupBy("_x").agg(F.count("*").alias("_n"))
    placed = running_totals(counts, "_x", {"_before": F.col("_n")}, like=rows)
    total = rows.agg(F.count("*").alias("_all"))
    ranks = placed.join(F.broadcast(total)).select("_x", "_before", "_n", "_all")
    joined = df.join(ranks, x == F.col("_x"), "left")
    within = F.col("_n")
    if slot.get("tie"):
        within = F.row_number().over(Window.partitionBy("_x").orderBy(F.col(f"`{slot.get('tie')}`")))
    return joined.withColumn(slot.name(), F.when(F.col("_x").isNotNull(), (F.col("_before") + within) / F.col("_all") * 100)).drop("_x", "_before", "_n", "_all")


@TABLES.add("ATTR_PREVIOUS_STATE")
def previous_state(df: DataFrame, slot: Slot) -> DataFrame:
    """The state a subject held at its previous time point; null at its first one, and where the rows of the previous
    point don't agree. Runs over the whole panel, before filters."""
    subject, order = slot.need("subject_field"), slot.need("order_field")
    state = column(df, slot)
    points = df.where(F.col(subject).isNotNull() & F.col(order).isNotNull()).groupBy(F.col(subject).alias("_s"), F.col(order).alias("_o")).agg(
        F.min(state).alias("_low"), F.max(state).alias("_high"), F.count_if(state.isNull()).alias("_none")
    )
    held = F.when((F.col("_low") == F.col("_high")) & (F.col("_none") == 0), F.col("_low"))
    before = points.withColumn("_held", held).select("_s", "_o", F.lag("_held").over(Window.partitionBy("_s").orderBy("_o")).alias(slot.name()))
    return df.join(before, (F.col(subject) == F.col("_s")) & (F.col(order) == F.col("_o")), "left").drop("_s", "_o")


def moments(df: DataFrame, cols: list[Column], where: Column | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and sample covariance of complete rows, from one aggregate of p (p + 3) / 2 sums around the first means."""
    rows = df.where(complete(cols) if where is None else complete(cols) & where)
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in cols), *(F.covar_samp(cols[i], cols[j]) for i, j in pairs)).first()
    cov = np.full((p, p), np.nan)
    for k, (i, j) in enumerate(pairs):
        v = got[1 + p + k]
        cov[i, j] = cov[j, i] = np.nan if v is None else v
    return int(got[0]), np.array([np.nan if v is None else v for v in got[1 : 1 + p]]), cov


def quadratic(cols: list[Column], centre: np.ndarray, inverse: np.ndarray) -> Column:
    """(x - centre)' inverse (x - centre), as one column."""
    d = [c - F.lit(float(m)) for c, m in zip(cols, centre)]
    out = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            w = float(inverse[i, j]) * (1 if i == j else 2)
            out = out + d[i] * d[j] * F.lit(w)
    return out


def _inverse(cov: np.ndarray, slot: Slot) -> np.ndarray:
    if not np.isfinite(cov).all() or np.linalg.matrix_rank(cov) < len(cov):
        raise RequestError(f"{slot.type}: the covariance of the members is singular")
    return np.linalg.inv(cov)


def chisq_tail_column(x: Column, k: int) -> Column:
    """The upper tail of a chi-square with a whole number of degrees of freedom, as its finite sum. For odd k the sum
    begins with a two-sided normal tail, which is a vectorised function."""
    half = F.greatest(x, F.lit(0.0)) / 2
    if k % 2 == 0:
        term = out = F.lit(1.0)
        for i in range(1, k // 2):
            term = term * half / i
            out = out + term
        return F.exp(-half) * out
    out, term = _normal_tail(F.sqrt(2 * half)), F.sqrt(2 * half) * math.sqrt(2 / math.pi)
    for i in range(1, k - 1, 2):
        out = out + F.exp(-half) * term
        term = term * 2 * half / (i + 2)
    return out


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    tail = np.frompyfunc(lambda v: math.erfc(abs(v) / math.sqrt(2)), 1, 1)
    return pd.Series(tail(z.to_numpy(float)).astype(float) if len(z) else [], dtype="float64")


@TABLES.add("ATTR_MAHALANOBIS")
def mahalanobis(df: DataFrame, slot: Slot) -> DataFrame:
    """D² from the mean and covariance of the complete rows (of ``fit_on``), or its chi-square p by ``output`` "p"."""
    cols = members(df, slot)
    _, centre, cov = moments(df, cols, _fit_rows(df, slot))
    d2 = F.when(complete(cols), quadratic(cols, centre, _inverse(cov, slot)))
    if slot.get("output") == "p":
        d2 = F.when(complete(cols), chisq_tail_column(d2, len(cols)))
    return df.withColumn(slot.name(), d2)


@TABLES.add("ATTR_VEC_DISTANCE")
def vec_distance(df: DataFrame, slot: Slot) -> DataFrame:
    """Distance to a reference profile: euclidean, sq_euclidean, manhattan, chebyshev, cosine, correlation, hamming, or
    with a fit over the table std_euclidean and mahalanobis."""
    metric = slot.get("metric", "euclidean")
    if metric in ("cosine", "correlation"):
        other = Slot(slot.type, slot.field, slot.label, dict(slot.params) | {"metric": metric})
        return df.withColumn(slot.name(), 1 - profile_similarity(df, other))
    if isinstance(slot.need("reference")[0], str):
        return df.withColumn(slot.name(), _set_similarity(df, slot) if metric == "hamming" else 1 - _set_similarity(df, slot))
    pairs = _profile(df, slot)
    cols, target = [c for c, _ in pairs], np.array([r for _, r in pairs])
    n = _over(pairs, lambda c, r: F.lit(1.0))
    enough = n >= F.lit(float(slot.get("min_valid", len(cols))))
    squares = _over(pairs, lambda c, r: (c - r) * (c - r))
    if metric in ("std_euclidean", "mahalanobis"):
        _, _, cov = moments(df, cols, _fit_rows(df, slot))
        inverse = np.diag(1 / np.diag(cov)) if metric == "std_euclidean" else _inverse(cov, slot)
        return df.withColumn(slot.name(), F.when(complete(cols), F.sqrt(quadratic(cols, target, inverse))))
    value = {
        "euclidean": F.sqrt(squares),
        "sq_euclidean": squares,
        "manhattan": _over(pairs, lambda c, r: F.abs(c - r)),
        "chebyshev": F.greatest(F.lit(0.0), *(F.when(_present(c), F.abs(c - r)) for c, r in pairs)),
        "hamming": _over(pairs, lambda c, r: (c != r).cast("double")),
    }.get(metric)
    if value is None:
        raise RequestError(f"ATTR_VEC_DISTANCE: no metric {metric!r}")
    return df.withColumn(slot.name(), F.when(enough, value))


@TABLES.add("ATTR_PC_SCORE")
def pc_score(df: DataFrame, slot: Slot) -> DataFrame:
    from tessella.operators.matrices import principal

    cols = members(df, slot)
    _, centre, cov = moments(df, cols, _fit_rows(df, slot))
    values, vectors = principal(cov, slot.get("on", "correlation"))
    k = int(slot.get("component", 1)) - 1
    scale = np.sqrt(np.diag(cov)) if slot.get("on", "correlation") == "correlation" else np.ones(len(cols))
    weights = vectors[:, k] / scale / np.sqrt(values[k])
    return df.withColumn(slot.name(), F.when(complete(cols), _linear(cols, centre, weights)))


@TABLES.add("ATTR_FACTOR_SCORE")
def factor_score(df: DataFrame, slot: Slot) -> DataFrame:
    """Regression (Thurstone) or Bartlett scores of one factor."""
    from tessella.operators.matrices import correlation_of, factor_fit

    cols = members(df, slot)
    _, centre, cov = moments(df, cols, _fit_rows(df, slot))
    r = correlation_of(cov)
    fit = factor_fit(r, int(slot.get("factors", 1)), slot.get("extraction", "minres"), slot.get("rotation", "none"))
    load, psi = fit["loadings"], fit["uniqueness"]
    if slot.get("method", "regression") == "bartlett":
        inner = load.T / psi
        w = np.linalg.solve(inner @ load, inner).T
    else:
        w = np.linalg.solve(r, fit["structure"])
    weights = w[:, int(slot.get("factor", 1)) - 1] / np.sqrt(np.diag(cov))
    return df.withColumn(slot.name(), F.when(complete(cols), _linear(cols, centre, weights)))


@TABLES.add("ATTR_SEM_SCORE")
def sem_score(df: DataFrame, slot: Slot) -> DataFrame:
    from tessella.operators.sem import fit_sem, sem_weights

    fit = fit_sem(df, slot.need("model"))
    names, weights = sem_weights(fit, slot.need("latent"), slot.get("method", "regression"))
    cols = [F.col(f"`{n}`").cast("double") for n in names]
    return df.withColumn(slot.name(), F.when(complete(cols), _linear(cols, fit["means"], weights)))


def _linear(cols: list[Column], centre: np.ndarray, weights: np.ndarray) -> Column:
    return sum(((c - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(cols, centre, weights)), F.lit(0.0))


@TABLES.add("ATTR_REG_FITTED", "ATTR_REG_RESIDUAL", "ATTR_REG_LEVERAGE", "ATTR_REG_INFLUENCE", "ATTR_REG_PREDICT")
def regression_column(df: DataFrame, slot: Slot) -> DataFrame:
    """From a model bound by ``fit`` (a fitted dict), or from a least-squares fit of ``target`` on ``predictors``."""
    from tessella.operators.regressions import fit_ols, predict

    fit = slot.get("fit") or fit_ols(df, slot)
    names = list(fit["predictors"])
    x = [F.col(f"`{n}`").cast("double") for n in names]
    fitted = F.when(complete(x), predict(fit, x, slot.get("scale", "response"), slot.get("category")))
    if slot.type in ("ATTR_REG_FITTED", "ATTR_REG_PREDICT"):
        return df.withColumn(slot.name(), fitted)
    y = F.col(f"`{fit['target']}`").cast("double")
    residual = F.when(_present(y), y - fitted)
    if slot.type == "ATTR_REG_RESIDUAL" and slot.get("kind", "raw") == "raw":
        return df.withColumn(slot.name(), residual)
    design = [F.lit(1.0), *x]
    leverage = F.when(complete(x), quadratic(design, np.zeros(len(design)), np.array(fit["xtx_inverse"])))
    p, s2, n = len(design), fit["sigma2"], fit["n"]
    standard = residual / F.sqrt(F.lit(s2) * (1 - leverage))
    deleted = standard * F.sqrt(F.lit(float(n - p - 1)) / (F.lit(float(n - p)) - standard * standard))
    value = {
        "ATTR_REG_LEVERAGE": leverage,
        "ATTR_REG_RESIDUAL": {"standardized": standard, "studentized": deleted, "pearson": residual / F.lit(s2**0.5)}.get(slot.get("kind", "raw")),
        "ATTR_REG_INFLUENCE": deleted * F.sqrt(leverage / (1 - leverage)) if slot.get("measure", "cooks") == "dffits" else standard * standard / p * leverage / (1 - leverage),
    }[slot.type]
    if value is None:
        raise RequestError(f"ATTR_REG_RESIDUAL: no kind {slot.get('kind')!r}")
    return df.withColumn(slot.name(), value)


def apply_attributes(df: DataFrame, slots: list[Slot]) -> DataFrame:
    """In declared order; runs of layered attributes that don't read each other share one aggregate."""
    waiting: list[Slot] = []

    def flush(df: DataFrame) -> DataFrame:
        if not waiting:
            return df
        made = [LAYERED[s.type](df, s) for s in waiting]
        stats = df.agg(*(c.alias(f"_st{k}_{n}") for k, (need, _) in enumerate(made) for n, c in need.items()))
        out = df.join(F.broadcast(stats))
        for k, (slot, (need, f)) in enumerate(zip(waiting, made)):
            out = out.withColumn(slot.name(), f({n: F.col(f"_st{k}_{n}") for n in need}))
        waiting.clear()
        return out.drop(*stats.columns)

    for slot in slots:
        if slot.type in LAYERED:
            if slot.field in {w.name() for w in waiting}:
                df = flush(df)
            waiting.append(slot)
            continue
        df = flush(df)
        if slot.type == "ATTR_FORMULA" and "total(" in slot.need("expression"):
            df = _with_totals(df, slot)
        elif slot.type in TABLES:
            df = TABLES[slot.type](df, slot)
        else:
            df = df.withColumn(slot.name(), ROWS.find(slot.type)(df, slot))
    return flush(df)


def _with_totals(df: DataFrame, slot: Slot) -> DataFrame:
    """``total(e)``: the sum of e over the filtered rows, from one aggregate for all totals of the formula."""
    seen: list[Column] = []

    def held(c: Column) -> Column:
        seen.append(c)
        return F.col(f"_total{len(seen) - 1}")

    value = expression(df, slot.get("expression"), slot.get("constants"), slot.get("lookups"), held, slot.get("models")).cast("double")
    totals = df.agg(*(F.sum(c).alias(f"_total{k}") for k, c in enumerate(seen)))
    return df.join(F.broadcast(totals)).withColumn(slot.name(), value).drop(*totals.columns)
