"""Hypothesis tests. Spark works out sufficient statistics, tables of counts or mid-ranks; the closing maths is on the
driver, over as many rows as there are groups or distinct values' sums, never over the data.

A test returns a dict with ``statistic``, ``p`` and what else it knows. Groups go by label in byte order; ``reference``
moves one of two groups to second place.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType, TimestampNTZType, TimestampType

from tessella.errors import RequestError
from tessella.functions import dist
from tessella.functions.concordance import net_concordance
from tessella.functions.quantiles import exact_quantiles, with_keys
from tessella.functions.running import mid_ranks, running_totals
from tessella.operators.attributes import complete, members, moments
from tessella.operators.slots import Registry, Slot, kind, number

TESTS = Registry("test")


def _by(slot: Slot) -> Column:
    return F.col(f"`{slot.need('split_by')}`").cast("string")


def _limit(df: DataFrame, slot: Slot) -> int:
    return int(slot.get("max_groups", 10_000))


def _groups_of(rows: DataFrame, slot: Slot) -> list:
    """All rows of a result with one row a group, refused beyond the limit of groups."""
    most = _limit(rows, slot)
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise RequestError(f"{slot.type}: more than {most} groups")
    return got


def group_moments(df: DataFrame, slot: Slot, least: int = 2) -> list[tuple[str, int, float, float]]:
    """(label, n, mean, sample variance) of each group with values, in byte order of labels."""
    x = number(df, slot)
    rows = df.where(x.isNotNull() & ~F.isnan(x) & _by(slot).isNotNull()).groupBy(_by(slot).alias("g")).agg(F.count(x), F.avg(x), F.var_samp(x))
    got = rows.limit(_limit(df, slot) + 1).collect()
    if not least <= len(got) <= _limit(df, slot):
        raise RequestError(f"{slot.type}: {len(got)} groups; from {least} to {_limit(df, slot)} are needed")
    return sorted(((r[0], int(r[1]), float(r[2]), float("nan") if r[3] is None else float(r[3])) for r in got), key=lambda r: r[0].encode())


def two_groups(df: DataFrame, slot: Slot) -> list[tuple[str, int, float, float]]:
    got = group_moments(df, slot)
    if len(got) != 2:
        raise RequestError(f"{slot.type}: {len(got)} groups, two are needed")
    return got[::-1] if slot.get("reference") == got[0][0] else got


def _welch(a: tuple, b: tuple) -> dict:
    va, vb = a[3] / a[1], b[3] / b[1]
    se = math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (a[1] - 1) + vb**2 / (b[1] - 1)) if se else float("nan")
    t = (a[2] - b[2]) / se if se else float("nan")
    return {"statistic": t, "df": df, "difference": a[2] - b[2], "se": se, "p": dist.t_tail(t, df) if se else None, "groups": [a[0], b[0]]}


@TESTS.add("TEST_WELCH")
def welch(df: DataFrame, slot: Slot) -> dict:
    return _welch(*two_groups(df, slot))


@TESTS.add("TEST_T")
def t_test(df: DataFrame, slot: Slot) -> dict:
    """One sample against ``mu``, or with ``split_by`` two samples: Welch's, or by ``variance`` "equal" Student's."""
    if not slot.get("split_by"):
        x = number(df, slot)
        n, mean, var = df.agg(F.count(x), F.avg(x), F.var_samp(x)).first()
        return _one_sample(n, mean, var, float(slot.get("mu", 0)))
    a, b = two_groups(df, slot)
    if slot.get("variance") != "equal":
        return _welch(a, b)
    free = a[1] + b[1] - 2
    pooled = ((a[1] - 1) * a[3] + (b[1] - 1) * b[3]) / free
    t = (a[2] - b[2]) / math.sqrt(pooled * (1 / a[1] + 1 / b[1]))
    return {"statistic": t, "df": free, "difference": a[2] - b[2], "p": dist.t_tail(t, free), "groups": [a[0], b[0]]}


def _one_sample(n: int, mean: float, var: float, mu: float) -> dict:
    if n < 2 or not var:
        return {"statistic": None, "df": n - 1, "mean": mean, "p": None}
    t = (mean - mu) / math.sqrt(var / n)
    return {"statistic": t, "df": n - 1, "mean": mean, "p": dist.t_tail(t, n - 1)}


@TESTS.add("TEST_PAIRED_T")
def paired_t(df: DataFrame, slot: Slot) -> dict:
    d = number(df, slot) - number(df, Slot(slot.type, slot.need("field2")))
    return _one_sample(*df.agg(F.count(d), F.avg(d), F.var_samp(d)).first(), 0.0)


@TESTS.add("TEST_Z_TWO_SAMPLE")
def z_two_sample(df: DataFrame, slot: Slot) -> dict:
    out = _welch(*two_groups(df, slot))
    return out | {"df": None, "p": dist.normal_tail(out["statistic"])}


@TESTS.add("TEST_PROP_Z")
def prop_z(df: DataFrame, slot: Slot) -> dict:
    """Two proportions by the pooled standard error, or one against ``p0``."""
    hit = (F.col(f"`{slot.field}`") == F.lit(slot.get("success", 1))).cast("int")
    if not slot.get("split_by"):
        n, k = df.agg(F.count(hit), F.sum(hit)).first()
        p0 = float(slot.need("p0"))
        z = (k / n - p0) / math.sqrt(p0 * (1 - p0) / n)
        return {"statistic": z, "share": k / n, "n": n, "p": dist.normal_tail(z)}
    got = sorted(map(tuple, df.where(_by(slot).isNotNull()).groupBy(_by(slot).alias("g")).agg(F.count(hit), F.sum(hit)).limit(_limit(df, slot)).collect()))
    if len(got) != 2:
        raise RequestError(f"TEST_PROP_Z: {len(got)} groups, two are needed")
    (ga, na, ka), (gb, nb, kb) = got[::-1] if slot.get("reference") == got[0][0] else got
    pool = (ka + kb) / (na + nb)
    se = math.sqrt(pool * (1 - pool) * (1 / na + 1 / nb))
    z = (ka / na - kb / nb) / se if se else float("nan")
    return {"statistic": z, "shares": [ka / na, kb / nb], "p": dist.normal_tail(z) if se else None, "groups": [ga, gb]}


@TESTS.add("TEST_ANOVA_F")
def anova(df: DataFrame, slot: Slot) -> dict:
    return anova_of([(n, m, v) for _, n, m, v in group_moments(df, slot)])


def anova_of(groups: list[tuple[int, float, float]]) -> dict:
    n = sum(g[0] for g in groups)
    grand = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - grand) ** 2 for g in groups)
    within = sum((g[0] - 1) * g[2] for g in groups if g[0] > 1)
    a, b = len(groups) - 1, n - len(groups)
    f = between / a / (within / b) if within and b else float("nan")
    return {"statistic": f, "df": [a, b], "ss_between": between, "ss_within": within, "p": dist.f_tail(f, a, b) if f == f else None}


@TESTS.add("TEST_ANOVA_WELCH")
def anova_welch(df: DataFrame, slot: Slot) -> dict:
    got = group_moments(df, slot)
    w = [n / v for _, n, _, v in got]
    total, k = sum(w), len(got)
    mean = sum(a * g[2] for a, g in zip(w, got)) / total
    spread = sum((1 - a / total) ** 2 / (g[1] - 1) for a, g in zip(w, got))
    f = sum(a * (g[2] - mean) ** 2 for a, g in zip(w, got)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * spread)
    b = (k * k - 1) / (3 * spread)
    return {"statistic": f, "df": [k - 1, b], "p": dist.f_tail(f, k - 1, b)}


@TESTS.add("TEST_ANOVA_RM")
def anova_rm(df: DataFrame, slot: Slot) -> dict:
    """Repeated measures: subjects that have every condition; each cell is its rows' mean."""
    x, subject, by = number(df, slot), slot.need("subject_field"), _by(slot)
    cells = df.where(x.isNotNull()).groupBy(F.col(subject).alias("s"), by.alias("c")).agg(F.avg(x).alias("x"))
    k = len(_groups_of(cells.select("c").distinct(), slot))
    whole = Window.partitionBy("s")
    full = cells.withColumns({"k": F.count("*").over(whole), "m": F.avg("x").over(whole)}).where(F.col("k") == k)
    by_c = full.groupBy("c").agg(F.count("*").alias("n"), F.avg("x").alias("m")).collect()
    n, grand, total, subjects = full.agg(F.count("*") / k, F.avg("x"), F.var_pop("x") * F.count("x"), F.var_pop("m") * F.count("m")).first()
    between = sum(n * (r["m"] - grand) ** 2 for r in by_c)
    error, a, b = total - subjects - between, k - 1, (k - 1) * (n - 1)
    f = between / a / (error / b)
    return {"statistic": f, "df": [a, b], "subjects": int(n), "p": dist.f_tail(f, a, b)}


@TESTS.add("TEST_BROWN_FORSYTHE")
def brown_forsythe(df: DataFrame, slot: Slot) -> dict:
    x, by = number(df, slot), _by(slot)
    rows = df.where(x.isNotNull() & by.isNotNull()).select(by.alias("g"), x.alias("x"))
    far = with_keys(rows, exact_quantiles(rows, ["g"], F.col("x"), {"m": 0.5}), ["g"]).select("g", F.abs(F.col("x") - F.col("m")).alias("d"))
    got = group_moments(far, Slot(slot.type, "d", None, {"split_by": "g"}))
    return anova_of([(n, m, v) for _, n, m, v in got])


def table_of(df: DataFrame, slot: Slot) -> tuple[list, list, np.ndarray]:
    """Row labels, column labels and counts of a contingency table."""
    r, c = (F.col(f"`{slot.need(k)}`").cast("string") for k in ("rows", "cols"))
    got = df.where(r.isNotNull() & c.isNotNull()).groupBy(r.alias("r"), c.alias("c")).count().limit(int(slot.get("max_cells", 100_000)) + 1).collect()
    if len(got) > int(slot.get("max_cells", 100_000)):
        raise RequestError(f"{slot.type}: too many cells")
    rows, cols = (sorted({x[k] for x in got}, key=str.encode) for k in (0, 1))
    out = np.zeros((len(rows), len(cols)))
    for x in got:
        out[rows.index(x[0]), cols.index(x[1])] = x[2]
    return rows, cols, out


def chisq_of(o: np.ndarray, correct: bool = False) -> dict:
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    d = np.abs(o - e)
    if correct and o.shape == (2, 2):
        d = d - min(0.5, d.min())
    x, df = float((d**2 / e).sum()), (o.shape[0] - 1) * (o.shape[1] - 1)
    v = math.sqrt(x / (o.sum() * max(1, min(o.shape) - 1)))
    return {"statistic": x, "df": df, "p": dist.chisq_tail(x, df) if df else None, "cramers_v": v, "low_expected": int((e < 5).sum())}


@TESTS.add("TEST_CHISQ")
def chisq(df: DataFrame, slot: Slot) -> dict:
    """Independence of ``rows`` and ``cols``, or with ``expected`` shares the fit of ``rows`` to them."""
    if expected := slot.get("expected"):
        c = F.col(f"`{slot.need('rows')}`").cast("string")
        got = {r[0]: r[1] for r in df.where(c.isin(*expected)).groupBy(c).count().collect()}
        n, share = sum(got.values()), sum(expected.values())
        x = sum((got.get(k, 0) - n * s / share) ** 2 / (n * s / share) for k, s in expected.items())
        return {"statistic": x, "df": len(expected) - 1, "p": dist.chisq_tail(x, len(expected) - 1)}
    return chisq_of(table_of(df, slot)[2], bool(slot.get("correct")))


def fisher_of(t: np.ndarray) -> float:
    """Two-sided: the tables with these margins that are no likelier, up to rounding."""
    a, b, c, d = (int(v) for v in t.ravel())
    n1, n2, k = a + b, c + d, a + c
    low, high = max(0, k - n2), min(k, n1)
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    logs = [choose(n1, i) + choose(n2, k - i) - choose(n1 + n2, k) for i in range(low, high + 1)]
    own = logs[a - low] + math.log1p(1e-7)
    return min(1.0, math.fsum(math.exp(v) for v in logs if v <= own))


@TESTS.add("TEST_FISHER_EXACT")
def fisher(df: DataFrame, slot: Slot) -> dict:
    t = table_of(df, slot)[2]
    if t.shape != (2, 2):
        raise RequestError(f"TEST_FISHER_EXACT: the table is {t.shape[0]} by {t.shape[1]}")
    a, b, c, d = t.ravel()
    return {"statistic": a * d / (b * c) if b * c else math.inf, "p": fisher_of(t)}


@TESTS.add("TEST_PEARSON_R")
def pearson(df: DataFrame, slot: Slot) -> dict:
    x, y = number(df, slot), number(df, Slot(slot.type, slot.need("field2")))
    both = x.isNotNull() & y.isNotNull()
    n, r = df.where(both).agg(F.count("*"), F.corr(x, y)).first()
    return _correlation(n, r)


def _correlation(n: int, r: float | None) -> dict:
    if r is None or n < 3 or abs(r) >= 1:
        return {"statistic": r, "n": n, "p": 0.0 if r is not None and abs(r) >= 1 else None}
    t = r * math.sqrt((n - 2) / (1 - r * r))
    return {"statistic": r, "n": n, "t": t, "df": n - 2, "p": dist.t_tail(t, n - 2)}


@TESTS.add("TEST_SPEARMAN_R")
def spearman(df: DataFrame, slot: Slot) -> dict:
    other = slot.need("field2")
    x, y = number(df, slot), number(df, Slot(slot.type, other))
    rows = df.where(x.isNotNull() & y.isNotNull()).select(x.alias("x"), y.alias("y"))
    a, b = mid_ranks(rows, "x").select(F.col("value").alias("x"), F.col("rank").alias("rx")), mid_ranks(rows, "y").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    ranked = rows.join(a, "x").join(b, "y")
    return _correlation(*ranked.agg(F.count("*"), F.corr("rx", "ry")).first())


def _tie_sums(counts: DataFrame, axis: str) -> list[float]:
    """Over the values of an axis and how many rows each has, t: sums of t(t-1), t(t-1)(t-2) and t(t-1)(2t+5)."""
    t = F.col("t")
    ties = counts.groupBy(axis).agg(F.sum("n").cast("double").alias("t"))
    return [float(v or 0.0) for v in ties.agg(F.sum(t * (t - 1)), F.sum(t * (t - 1) * (t - 2)), F.sum(t * (t - 1) * (2 * t + 5))).first()]


@TESTS.add("TEST_KENDALL_TAU")
def kendall(df: DataFrame, slot: Slot) -> dict:
    """tau-b with the tie-corrected normal p. Pairs are counted over distinct values, by ranges of both axes
    (``functions/concordance.py``), at any size."""
    x, y = number(df, slot), number(df, Slot(slot.type, slot.need("field2")))
    counts = df.where(x.isNotNull() & y.isNotNull()).groupBy((x + 0.0).alias("x"), (y + 0.0).alias("y")).agg(F.count("*").alias("n"))
    n = float(counts.agg(F.sum("n")).first()[0] or 0)
    (a, a3, a5), (b, b3, b5) = _tie_sums(counts, "x"), _tie_sums(counts, "y")
    pairs = n * (n - 1)
    if n < 2 or a == pairs or b == pairs:
        return {"statistic": None, "n": int(n), "z": None, "p": None}
    s = net_concordance(counts)
    tau = s / math.sqrt((pairs - a) / 2 * ((pairs - b) / 2))
    v1 = a * b / (2 * pairs)
    v2 = a3 * b3 / (9 * pairs * (n - 2)) if n > 2 else 0
    z = s / math.sqrt((pairs * (2 * n + 5) - a5 - b5) / 18 + v1 + v2)
    return {"statistic": float(tau), "n": int(n), "z": float(z), "p": dist.normal_tail(float(z))}


def _ranked_groups(df: DataFrame, slot: Slot) -> tuple[DataFrame, float]:
    """A table of g, n and rank sum of each group, and the sum of t³ - t over ties, from value counts."""
    x, by = number(df, slot), _by(slot)
    rows = df.where(x.isNotNull() & by.isNotNull()).select(x.alias("x"), by.alias("g"))
    ranks = mid_ranks(rows, "x")
    cells = rows.groupBy("g", "x").agg(F.count("*").alias("n"))
    sums = cells.join(ranks, F.col("x") == F.col("value")).groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = ranks.agg(F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()[0] or 0.0
    return sums, float(ties)


def rank_sums(df: DataFrame, slot: Slot) -> tuple[list[tuple[str, int, float]], float]:
    """(label, n, rank sum) of each group and the sum of t³ - t over ties."""
    sums, ties = _ranked_groups(df, slot)
    return sorted(((r[0], int(r[1]), float(r[2])) for r in _groups_of(sums, slot)), key=lambda r: r[0].encode()), ties


@TESTS.add("TEST_MANN_WHITNEY_U")
def mann_whitney(df: DataFrame, slot: Slot) -> dict:
    """U of the first group; normal p with corrections for ties and continuity."""
    got, ties = rank_sums(df, slot)
    if len(got) != 2:
        raise RequestError(f"TEST_MANN_WHITNEY_U: {len(got)} groups, two are needed")
    (ga, a, ra), (gb, b, _) = got[::-1] if slot.get("reference") == got[0][0] else got
    u, n = ra - a * (a + 1) / 2, a + b
    var = a * b / 12 * ((n + 1) - ties / (n * (n - 1)))
    d = u - a * b / 2
    z = (d - math.copysign(0.5, d) if d else 0.0) / math.sqrt(var) if var else float("nan")
    return {"statistic": u, "z": z, "p": dist.normal_tail(z) if var else None, "groups": [ga, gb]}


@TESTS.add("TEST_KRUSKAL_WALLIS")
def kruskal(df: DataFrame, slot: Slot) -> dict:
    """The groups' terms are summed in Spark, so their number has no limit."""
    sums, ties = _ranked_groups(df, slot)
    k, n, terms = sums.agg(F.count("*"), F.sum("n"), F.sum(F.col("r") * F.col("r") / F.col("n"))).first()
    h = (12 / (n * (n + 1)) * terms - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return {"statistic": h, "df": k - 1, "p": dist.chisq_tail(h, k - 1)}


@TESTS.add("TEST_WILCOXON_SR")
def wilcoxon(df: DataFrame, slot: Slot) -> dict:
    """Signed ranks of the non-zero differences; normal p with corrections for ties and continuity."""
    d = number(df, slot) - number(df, Slot(slot.type, slot.need("field2")))
    rows = df.where(d.isNotNull() & (d != 0)).select(F.abs(d).alias("a"), (d > 0).cast("int").alias("up"))
    ranks = mid_ranks(rows, "a")
    cells = rows.groupBy("a").agg(F.sum("up").alias("up"))
    v = cells.join(ranks, F.col("a") == F.col("value")).agg(F.sum(F.col("up") * F.col("rank"))).first()[0] or 0.0
    n, ties = ranks.agg(F.sum("count"), F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()
    off = v - n * (n + 1) / 4
    z = (off - math.copysign(0.5, off) if off else 0.0) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return {"statistic": v, "n": n, "z": z, "p": dist.normal_tail(z)}


@TESTS.add("TEST_KS")
def ks(df: DataFrame, slot: Slot) -> dict:
    """Largest gap of two distribution functions, from counts by value that add up in ranges; asymptotic p."""
    x, by = number(df, slot), _by(slot)
    rows = df.where(x.isNotNull() & by.isNotNull()).select(x.alias("x"), by.alias("g"))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("g").count().limit(_limit(df, slot)).collect())
    if len(sizes) != 2:
        raise RequestError(f"TEST_KS: {len(sizes)} groups, two are needed")
    (ga, na), (gb, nb) = sizes
    cells = rows.groupBy("x").agg(F.count_if(F.col("g") == ga).alias("a"), F.count_if(F.col("g") == gb).alias("b"))
    placed = running_totals(cells, "x", {"fa": F.col("a"), "fb": F.col("b")})
    d = placed.agg(F.max(F.abs((F.col("fa") + F.col("a")) / na - (F.col("fb") + F.col("b")) / nb))).first()[0]
    return {"statistic": d, "n": [na, nb], "p": dist.kolmogorov_tail(d * math.sqrt(na * nb / (na + nb)))}


@F.pandas_udf(StructType([StructField("m", DoubleType()), StructField("mm", DoubleType())]))
def _normal_scores(before: pd.Series, count: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums, and sums of squares, of the normal scores of a value's places."""
    score = np.frompyfunc(NormalDist().inv_cdf, 1, 1)
    out = []
    for first, times, total in zip(before, count, n):
        m = mm = 0.0
        for low in range(int(first) + 1, int(first) + int(times) + 1, 1 << 20):
            places = np.arange(low, min(low + (1 << 20), int(first) + int(times) + 1))
            z = score((places - 0.375) / (total + 0.25)).astype(float)
            m, mm = m + z.sum(), mm + z @ z
        out.append((m, mm))
    return pd.DataFrame(out, columns=["m", "mm"])


@TESTS.add("TEST_SHAPIRO_WILK")
def shapiro_francia(df: DataFrame, slot: Slot) -> dict:
    """W', the squared correlation of the ordered values with normal scores, from counts by value. From 5 values on; beyond
    5000, for which the approximation of p was not made, ``advisory`` says so."""
    x = number(df, slot)
    rows = df.where(x.isNotNull()).select((x + 0.0).alias("x"))
    n, mean, spread = rows.agg(F.count("*"), F.avg("x"), F.var_pop("x")).first()
    if n < 5:
        raise RequestError("TEST_SHAPIRO_WILK: 5 values at least are needed")
    if not spread:
        return {"statistic": None, "n": n, "p": None, "advisory": n > 5000}
    counts = rows.groupBy("x").agg(F.count("*").alias("c"))
    placed = running_totals(counts, "x", {"before": F.col("c")}, like=rows)
    scored = placed.select("x", _normal_scores("before", "c", F.lit(n)).alias("s"))
    both, squares = scored.agg(F.sum((F.col("x") - mean) * F.col("s.m")), F.sum("s.mm")).first()
    w = min(1.0, both * both / (squares * n * spread))
    u = math.log(n)
    v = math.log(u)
    z = (math.log(max(1 - w, 1e-300)) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    return {"statistic": w, "n": n, "p": 1 - dist.normal_cdf(z), "advisory": n > 5000}


@TESTS.add("TEST_TREND")
def trend(df: DataFrame, slot: Slot) -> dict:
    """Mann-Kendall over the values in order of ``order_by``, from three rows on and at any size; rows that tie on the
    order are no pair."""
    x, by = number(df, slot), slot.need("order_by")
    of, t = kind(df, by), F.col(f"`{by}`")
    t = F.unix_date(t) if isinstance(of, DateType) else F.unix_micros(t.cast("timestamp")) if isinstance(of, (TimestampType, TimestampNTZType)) else t
    rows = df.where(x.isNotNull() & t.isNotNull()).select(t.cast("double").alias("x"), (x + 0.0).alias("y"))
    counts = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    n = float(counts.agg(F.sum("n")).first()[0] or 0)
    if n < 3:
        raise RequestError("TEST_TREND: three rows at least are needed")
    s = net_concordance(counts)
    var = (n * (n - 1) * (2 * n + 5) - _tie_sums(counts, "y")[2]) / 18
    z = (s - math.copysign(1, s)) / math.sqrt(var) if s and var > 0 else 0.0
    return {"statistic": s, "z": z, "n": int(n), "p": dist.normal_tail(z)}


@TESTS.add("TEST_TUKEY_HSD")
def tukey(df: DataFrame, slot: Slot) -> dict:
    """All pairs of groups by Tukey and Kramer."""
    got = group_moments(df, slot)
    k, free = len(got), sum(g[1] for g in got) - len(got)
    within = sum((g[1] - 1) * g[3] for g in got) / free
    pairs = []
    for i, a in enumerate(got):
        for b in got[i + 1 :]:
            q = abs(a[2] - b[2]) / math.sqrt(within / 2 * (1 / a[1] + 1 / b[1]))
            pairs.append({"a": a[0], "b": b[0], "difference": a[2] - b[2], "q": q, "p": dist.tukey_tail(q, k, free)})
    return {"statistic": max(p["q"] for p in pairs), "df": free, "p": min(p["p"] for p in pairs), "pairs": pairs}


# ---- of vectors


def _grouped(df: DataFrame, slot: Slot) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    cols, by = members(df, slot), _by(slot)
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.where(complete(cols) & by.isNotNull()).groupBy(by.alias("g")).agg(
        F.count("*"), *(F.avg(c) for c in cols), *(F.covar_samp(cols[i], cols[j]) for i, j in pairs)
    )
    out = []
    for r in sorted(_groups_of(rows, slot), key=lambda r: r[0].encode()):
        cov = np.zeros((p, p))
        for v, (i, j) in zip(r[2 + p :], pairs):
            cov[i, j] = cov[j, i] = v
        out.append((r[0], int(r[1]), np.array(r[2 : 2 + p]), cov))
    return out


@TESTS.add("TEST_HOTELLING_T2")
def hotelling(df: DataFrame, slot: Slot) -> dict:
    """One mean vector against ``mu``, or with ``split_by`` two of them under a pooled covariance."""
    cols = members(df, slot)
    p = len(cols)
    if not slot.get("split_by"):
        n, mean, cov = moments(df, cols)
        d = mean - np.array(slot.get("mu", [0.0] * p))
        t2 = float(n * d @ np.linalg.solve(cov, d))
        f = (n - p) / (p * (n - 1)) * t2
        return {"statistic": t2, "f": f, "df": [p, n - p], "p": dist.f_tail(f, p, n - p)}
    got = _grouped(df, slot)
    if len(got) != 2:
        raise RequestError(f"TEST_HOTELLING_T2: {len(got)} groups, two are needed")
    (_, a, ma, ca), (_, b, mb, cb) = got
    pooled = ((a - 1) * ca + (b - 1) * cb) / (a + b - 2)
    t2 = float(a * b / (a + b) * (ma - mb) @ np.linalg.solve(pooled, ma - mb))
    f = (a + b - p - 1) / (p * (a + b - 2)) * t2
    return {"statistic": t2, "f": f, "df": [p, a + b - p - 1], "p": dist.f_tail(f, p, a + b - p - 1)}


@TESTS.add("TEST_MANOVA")
def manova(df: DataFrame, slot: Slot) -> dict:
    got = _grouped(df, slot)
    n, k, p = sum(g[1] for g in got), len(got), len(got[0][2])
    grand = sum(g[1] * g[2] for g in got) / n
    h = sum(g[1] * np.outer(g[2] - grand, g[2] - grand) for g in got)
    e = sum((g[1] - 1) * g[3] for g in got)
    roots = np.clip(np.linalg.eigvals(np.linalg.solve(e, h)).real, 0, None)
    pillai = float((roots / (1 + roots)).sum())
    s, m, r = min(p, k - 1), (abs(p - k + 1) - 1) / 2, (n - k - p - 1) / 2
    f = (2 * r + s + 1) / (2 * m + s + 1) * pillai / (s - pillai)
    a, b = s * (2 * m + s + 1), s * (2 * r + s + 1)
    return {
        "statistic": pillai, "f": f, "df": [a, b], "p": dist.f_tail(f, a, b), "wilks": float(np.prod(1 / (1 + roots))),
        "hotelling_lawley": float(roots.sum()), "roy": float(roots.max()),
    }


@TESTS.add("TEST_BOX_M")
def box_m(df: DataFrame, slot: Slot) -> dict:
    got = _grouped(df, slot)
    p, k, n = len(got[0][2]), len(got), sum(g[1] for g in got)
    pooled = sum((g[1] - 1) * g[3] for g in got) / (n - k)
    m = (n - k) * np.linalg.slogdet(pooled)[1] - sum((g[1] - 1) * np.linalg.slogdet(g[3])[1] for g in got)
    c = (sum(1 / (g[1] - 1) for g in got) - 1 / (n - k)) * (2 * p * p + 3 * p - 1) / (6 * (p + 1) * (k - 1))
    x, free = float(m * (1 - c)), p * (p + 1) * (k - 1) / 2
    return {"statistic": x, "df": free, "m": float(m), "p": dist.chisq_tail(x, free)}


@TESTS.add("TEST_BARTLETT_SPHERICITY")
def bartlett(df: DataFrame, slot: Slot) -> dict:
    n, _, cov = moments(df, members(df, slot))
    p, sd = len(cov), np.sqrt(np.diag(cov))
    x = float(-(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(cov / np.outer(sd, sd))[1])
    return {"statistic": x, "df": p * (p - 1) / 2, "p": dist.chisq_tail(x, p * (p - 1) / 2)}


@TESTS.add("TEST_MARDIA")
def mardia(df: DataFrame, slot: Slot) -> dict:
    """Skewness from the third moments of the whitened members (p³ sums, not n² pairs), kurtosis from squared distances."""
    cols = members(df, slot)
    n, mean, cov = moments(df, cols)
    p = len(cols)
    white = np.linalg.inv(np.linalg.cholesky(cov * (n - 1) / n))
    z = [sum(((c - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(cols, mean, row)), F.lit(0.0)) for row in white]
    rows = df.where(complete(cols)).select(*(c.alias(f"z{i}") for i, c in enumerate(z)))
    triples = [(i, j, k) for i in range(p) for j in range(i, p) for k in range(j, p)]
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))
    got = rows.agg(F.avg(d2 * d2), *(F.avg(F.col(f"z{i}") * F.col(f"z{j}") * F.col(f"z{k}")) for i, j, k in triples)).first()
    repeat = [{1: 1, 2: 3, 3: 6}[len(set(t))] for t in triples]
    skew = sum(w * v * v for w, v in zip(repeat, got[1:]))
    kurt = got[0]
    x, free = n * skew / 6, p * (p + 1) * (p + 2) / 6
    zk = (kurt - p * (p + 2)) / math.sqrt(8 * p * (p + 2) / n)
    return {"statistic": x, "df": free, "p": dist.chisq_tail(x, free), "skewness": skew, "kurtosis": kurt, "kurtosis_z": zk, "kurtosis_p": dist.normal_tail(zk)}


def run_tests(df: DataFrame, slots: list, multiplicity: str | None = None) -> list[dict]:
    """Results of several tests; ``multiplicity`` adds p-values adjusted over all of them."""
    made = [Slot.of(s) for s in slots]
    out = [{"label": s.name()} | TESTS.find(s.type)(df, s) for s in made]
    if multiplicity:
        for r, p in zip(out, dist.adjust([r["p"] for r in out], multiplicity)):
            r["p_adjusted"] = p
    return out


def as_row(df: DataFrame, slot: Mapping | Slot, fields: dict[str, str] | None = None) -> DataFrame:
    """A test's result as a one-row table of its numbers."""
    slot = Slot.of(slot)
    got = TESTS.find(slot.type)(df, slot)
    shown = {k: float(v) for k, v in got.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    shown = {name: shown[k] for k, name in (fields or {k: k for k in shown}).items()}
    return df.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in shown.items()))
