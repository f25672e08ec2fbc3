"""Regressions. Least squares close over one aggregate of cross products; likelihood fits take one aggregate a step."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions import dist
from tessella.operators.attributes import complete
from tessella.operators.slots import Registry, Slot, check, kind, valid_weight

REGRESSIONS = Registry("regression")


def _fields(df: DataFrame, slot: Slot) -> tuple[Column, list[Column], list[str]]:
    names = list(slot.need("predictors"))
    for n in [*names, *([slot.need("target")] if slot.type not in ("REG_MULTINOMIAL", "REG_ORDINAL") else [])]:
        check(kind(df, n), "number", Slot(slot.type, n))
    return F.col(f"`{slot.need('target')}`"), [F.col(f"`{n}`").cast("double") for n in names], names


def _sums(rows: DataFrame, design: list[Column], w: Column, extra: list[Column]) -> tuple[np.ndarray, list[np.ndarray], list]:
    """Weighted cross products of a design, its products with each extra column, and the extras' own sums of squares."""
    p = len(design)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    terms = [F.sum(w * design[i] * design[j]) for i, j in pairs] + [F.sum(w * d * y) for y in extra for d in design] + [F.sum(w * y * y) for y in extra]
    got = [0.0 if v is None else float(v) for v in rows.agg(*terms).first()]
    gram = np.zeros((p, p))
    for v, (i, j) in zip(got, pairs):
        gram[i, j] = gram[j, i] = v
    at = len(pairs)
    return gram, [np.array(got[at + k * p : at + (k + 1) * p]) for k in range(len(extra))], got[at + len(extra) * p :]


def _usable(df: DataFrame, slot: Slot, y: Column, x: list[Column]) -> tuple[DataFrame, Column]:
    w = valid_weight(df, slot.weight) if slot.weight else F.lit(1.0)
    finite = complete([y, *x]) & (F.abs(y) < float("inf"))
    return df.where(finite & w.isNotNull()), w


def fit_ols(df: DataFrame, slot: Slot) -> dict:
    """Least squares with optional ``penalty`` l2, l1 or elasticnet of strength ``alpha`` (no standardising, the
    intercept unpenalised: (1/2n)|y - Xb|² + alpha (l1_ratio |b|₁ + (1 - l1_ratio)/2 |b|²)), or ``bounds`` nonnegative.

    Sums run around rounded means, so cross products keep their digits. ``covariance`` hc0 to hc3 adds one pass."""
    target, x, names = _fields(df, slot)
    y = target.cast("double")
    rows, w = _usable(df, slot, y, x)
    p = len(x)
    got = rows.agg(F.sum(w), F.count(F.lit(1)), *(F.sum(w * c) for c in [*x, y])).first()
    if not got[1]:
        raise RequestError(f"{slot.type}: no complete rows")
    total = float(got[0])
    centre = np.array([float(v) for v in got[2:]]) / total
    n = total if slot.weight_kind == "frequency" and slot.weight else float(got[1])
    d = [c - F.lit(float(m)) for c, m in zip([*x, y], centre)]
    gram, (xy,), (yy,) = _sums(rows, d[:p], w, [d[p]])
    scale = n / total
    gram, xy, yy = gram * scale, xy * scale, yy * scale
    penalty, alpha = slot.get("penalty"), float(slot.get("alpha", 0.0))
    if slot.get("bounds") == "nonnegative":
        beta = _nonnegative(gram, xy)
    elif penalty in ("l1", "elasticnet"):
        beta = _descend(gram / n, xy / n, alpha, 1.0 if penalty == "l1" else float(slot.get("l1_ratio", 0.5)))
    elif penalty == "l2":
        beta = np.linalg.solve(gram + n * alpha * np.eye(p), xy)
    else:
        if np.linalg.matrix_rank(correlation(gram)) < p:
            raise RequestError(f"{slot.type}: the predictors are collinear")
        beta = np.linalg.solve(gram, xy)
    rss = max(0.0, float(yy - 2 * beta @ xy + beta @ gram @ beta))
    out = {"target": slot.get("target"), "predictors": names, "n": n, "family": "gaussian", "link": "identity", "rss": rss, "r2": 1 - rss / yy if yy else None}
    coef = np.append(centre[p] - beta @ centre[:p], beta)
    # (X'X)^-1 with the intercept, from that of the centred columns
    if penalty is None and slot.get("bounds") is None:
        inner = np.linalg.inv(gram)
        full = np.zeros((p + 1, p + 1))
        full[1:, 1:] = inner
        full[0, 1:] = full[1:, 0] = -inner @ centre[:p]
        full[0, 0] = 1 / n + centre[:p] @ inner @ centre[:p]
        s2 = rss / (n - p - 1) if n > p + 1 else float("nan")
        cov = full * s2
        if slot.get("covariance"):
            cov = _robust(rows, w, x, y, coef, full, slot.get("covariance"), n)
        se = np.sqrt(np.diag(cov))
        out |= {"sigma2": s2, "df": n - p - 1, "xtx_inverse": full.tolist(), "se": se.tolist(), "vcov": cov.tolist()}
        out["t"] = [c / s if s else None for c, s in zip(coef, se)]
        out["p"] = [None if t is None else dist.t_tail(float(t), n - p - 1) for t in out["t"]]
        f = (yy - rss) / p / s2 if p and s2 else None
        out |= {"f": f, "f_p": dist.f_tail(f, p, n - p - 1) if f else None, "adjusted_r2": 1 - (1 - out["r2"]) * (n - 1) / (n - p - 1) if yy else None}
        loglik = -n / 2 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1)
        out |= {"loglik": loglik, "aic": -2 * loglik + 2 * (p + 2), "bic": -2 * loglik + math.log(n) * (p + 2)}
    out["coefficients"] = dict(zip(["(intercept)", *names], coef.tolist()))
    out["gram"], out["xy"], out["yy"], out["means"] = gram.tolist(), xy.tolist(), float(yy), centre.tolist()
    return out


def correlation(gram: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.clip(np.diag(gram), 1e-300, None))
    return gram / np.outer(size, size)


def _robust(rows: DataFrame, w: Column, x: list[Column], y: Column, coef: np.ndarray, inverse: np.ndarray, how: str, n: float) -> np.ndarray:
    from tessella.operators.attributes import quadratic

    design = [F.lit(1.0), *x]
    e = y - sum((F.lit(float(b)) * c for b, c in zip(coef, design)), F.lit(0.0))
    leverage = quadratic(design, np.zeros(len(design)), inverse)
    power = {"hc0": 0, "hc1": 0, "hc2": 1, "hc3": 2}
    if how not in power:
        raise RequestError(f"REG_OLS: no covariance {how!r}")
    weight = e * e / F.pow(1 - leverage, F.lit(float(power[how])))
    meat, _, _ = _sums(rows, design, w * w * weight, [])
    out = inverse @ meat @ inverse
    return out * n / (n - len(design)) if how == "hc1" else out


def _descend(gram: np.ndarray, xy: np.ndarray, alpha: float, ratio: float) -> np.ndarray:
    """Coordinate descent on the cross products."""
    beta = np.zeros(len(xy))
    for _ in range(100_000):
        most = 0.0
        for j in range(len(beta)):
            r = xy[j] - gram[j] @ beta + gram[j, j] * beta[j]
            new = math.copysign(max(abs(r) - alpha * ratio, 0.0), r) / (gram[j, j] + alpha * (1 - ratio)) if gram[j, j] else 0.0
            most = max(most, abs(new - beta[j]) * math.sqrt(gram[j, j]))
            beta[j] = new
        if most < 1e-12:
            break
    return beta


def _nonnegative(gram: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares with no coefficient below zero, by coordinate descent on the cross products."""
    beta = np.zeros(len(xy))
    for _ in range(100_000):
        old = beta.copy()
        for j in range(len(beta)):
            beta[j] = max(0.0, beta[j] + (xy[j] - gram[j] @ beta) / gram[j, j])
        if np.abs(beta - old).max() < 1e-13 * (1 + np.abs(beta).max()):
            break
    return beta


@REGRESSIONS.add("REG_OLS")
def ols(df: DataFrame, slot: Slot) -> dict:
    if slot.get("selection"):
        return select(df, slot)
    return resample(df, slot, fit_ols) if slot.get("resample") else fit_ols(df, slot)


@REGRESSIONS.add("REG_BAYES_LINEAR")
def bayes_linear(df: DataFrame, slot: Slot) -> dict:
    """Conjugate normal-inverse-gamma prior with mean ``prior_mu``, precision ``prior_precision``, shape and rate."""
    target, x, names = _fields(df, slot)
    y = target.cast("double")
    rows, w = _usable(df, slot, y, x)
    design = [F.lit(1.0), *x]
    gram, (xy,), (yy,) = _sums(rows, design, w, [y])
    p = len(design)
    prior, mu = np.eye(p) * float(slot.get("prior_precision", 1e-6)), np.full(p, float(slot.get("prior_mu", 0.0)))
    a0, b0 = float(slot.get("prior_shape", 1e-3)), float(slot.get("prior_rate", 1e-3))
    precision = prior + gram
    mean = np.linalg.solve(precision, prior @ mu + xy)
    n = gram[0, 0]
    a = a0 + n / 2
    b = b0 + 0.5 * float(yy + mu @ prior @ mu - mean @ precision @ mean)
    scale = np.sqrt(b / a * np.diag(np.linalg.inv(precision)))
    q = dist.t_quantile(0.5 + float(slot.get("credible_level", 0.95)) / 2, 2 * a)
    return {
        "target": slot.get("target"), "predictors": names, "n": n, "family": "gaussian", "link": "identity",
        "coefficients": dict(zip(["(intercept)", *names], mean.tolist())), "se": scale.tolist(), "shape": a, "rate": b,
        "lower": (mean - q * scale).tolist(), "upper": (mean + q * scale).tolist(),
    }


LINKS: dict[str, tuple[Callable, Callable]] = {
    # inverse link, and the derivative of the mean by the linear predictor
    "identity": (lambda e: e, lambda e, m: F.lit(1.0)),
    "log": (F.exp, lambda e, m: m),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m)),
    "inverse": (lambda e: 1 / e, lambda e, m: -m * m),
    "cloglog": (lambda e: 1 - F.exp(-F.exp(e)), lambda e, m: (1 - m) * F.exp(e)),
}
#: Family to default link and variance function.
FAMILIES: dict[str, tuple[str, Callable]] = {
    "gaussian": ("identity", lambda m, k: F.lit(1.0)),
    "binomial": ("logit", lambda m, k: m * (1 - m)),
    "poisson": ("log", lambda m, k: m),
    "gamma": ("inverse", lambda m, k: m * m),
    "negative_binomial": ("log", lambda m, k: m + m * m / k),
}


def _deviance(family: str, y: Column, m: Column, theta: float) -> Column:
    log = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    return {
        "gaussian": lambda: (y - m) * (y - m),
        "binomial": lambda: 2 * (log(y, m) + log(1 - y, 1 - m)),
        "poisson": lambda: 2 * (log(y, m) - (y - m)),
        "gamma": lambda: 2 * ((y - m) / m - F.log(y / m)),
        "negative_binomial": lambda: 2 * (log(y, m) - (y + theta) * F.log((y + theta) / (m + theta))),
    }[family]()


@REGRESSIONS.add("REG_GLM")
def glm(df: DataFrame, slot: Slot) -> dict:
    """Iteratively reweighted least squares, one aggregate a step. The rows are read anew each time; cache the table
    beforehand if its source is slow."""
    if slot.get("resample"):
        return resample(df, slot, _glm)
    return _glm(df, slot)


def _glm(df: DataFrame, slot: Slot) -> dict:
    target, x, names = _fields(df, slot)
    family = slot.get("family", "binomial")
    if family not in FAMILIES:
        raise RequestError(f"REG_GLM: no family {family!r}")
    link, theta = slot.get("link", FAMILIES[family][0]), float(slot.get("theta", 1.0))
    if link not in LINKS:
        raise RequestError(f"REG_GLM: no link {link!r}")
    inverse, slope = LINKS[link]
    y = target.cast("double")
    rows, w = _usable(df, slot, y, x)
    design = [F.lit(1.0), *x]
    ridge = float(slot.get("alpha", 0.0)) if slot.get("penalty") == "l2" else 0.0
    n, mean = rows.agg(F.sum(w), F.sum(w * y) / F.sum(w)).first()
    if not n:
        raise RequestError("REG_GLM: no complete rows")
    start = {"log": lambda v: math.log(max(v, 1e-8)), "logit": lambda v: math.log(v / (1 - v)) if 0 < v < 1 else 0.0, "inverse": lambda v: 1 / v, "identity": lambda v: v, "cloglog": lambda v: math.log(-math.log(1 - v)) if 0 < v < 1 else 0.0}[link](mean)
    beta, steps, last = np.array([start, *[0.0] * len(x)]), 0, math.inf
    converged = False
    penalty = np.diag([0.0, *[ridge * n] * len(x)])
    for steps in range(1, int(slot.get("max_iters", 50)) + 1):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, design)), F.lit(0.0))
        m = inverse(eta)
        d = slope(eta, m)
        weight = w * d * d / FAMILIES[family][1](m, theta)
        p = len(design)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        z = eta + (y - m) / d
        terms = [F.sum(weight * design[i] * design[j]) for i, j in pairs] + [F.sum(weight * c * z) for c in design] + [F.sum(w * _deviance(family, y, m, theta)), F.sum(w * (y - m) * (y - m) / FAMILIES[family][1](m, theta))]
        got = [float("nan") if v is None else float(v) for v in rows.agg(*terms).first()]
        gram = np.zeros((p, p))
        for v, (i, j) in zip(got, pairs):
            gram[i, j] = gram[j, i] = v
        deviance, chi2 = got[-2], got[-1]
        if abs(last - deviance) < float(slot.get("tol", 1e-10)) * (abs(deviance) + 0.1):
            converged = True
            break
        last = deviance
        beta = np.linalg.solve(gram + penalty, np.array(got[len(pairs) : len(pairs) + p]))
    dispersion = 1.0 if family in ("binomial", "poisson", "negative_binomial") else chi2 / (n - len(design))
    cov = np.linalg.inv(gram + penalty) * dispersion
    se = np.sqrt(np.diag(cov))
    stat = beta / se
    tail = dist.normal_tail if dispersion == 1.0 else lambda v: dist.t_tail(v, n - len(design))
    return {
        "target": slot.get("target"), "predictors": names, "n": n, "family": family, "link": link, "deviance": deviance, "dispersion": dispersion,
        "coefficients": dict(zip(["(intercept)", *names], beta.tolist())), "se": se.tolist(), "z": stat.tolist(), "p": [tail(float(v)) for v in stat],
        "iterations": steps, "converged": converged, "vcov": cov.tolist(),
    }


@REGRESSIONS.add("REG_MULTINOMIAL")
def multinomial(df: DataFrame, slot: Slot) -> dict:
    """Baseline-category logistic regression by Newton steps, one aggregate each."""
    target, x, names = _fields(df, slot)
    y = target.cast("string")
    w = valid_weight(df, slot.weight) if slot.weight else F.lit(1.0)
    rows = df.where(complete(x) & y.isNotNull() & w.isNotNull())
    levels = sorted((r[0] for r in rows.select(y).distinct().limit(201).collect()), key=str.encode)
    if not 2 <= len(levels) <= 200:
        raise RequestError(f"REG_MULTINOMIAL: {len(levels)} levels; from 2 to 200 are needed")
    base = slot.get("reference", levels[0])
    rest, design = [v for v in levels if v != base], [F.lit(1.0), *x]
    p, k = len(design), len(rest)
    beta = np.zeros((k, p))
    converged, loglik = False, -math.inf
    for steps in range(1, int(slot.get("max_iters", 50)) + 1):
        eta = [sum((F.lit(float(b)) * c for b, c in zip(row, design)), F.lit(0.0)) for row in beta]
        top = F.greatest(F.lit(0.0), *eta)
        total = F.exp(-top) + sum((F.exp(e - top) for e in eta), F.lit(0.0))
        prob = [F.exp(e - top) / total for e in eta]
        own = sum((F.when(y == v, e).otherwise(0.0) for v, e in zip(rest, eta)), F.lit(0.0)) - top - F.log(total)
        keys = [(a, b, i, j) for a in range(k) for b in range(a, k) for i in range(p) for j in range(p)]
        wide = rows.select(w.alias("w"), own.alias("l"), *(c.alias(f"x{i}") for i, c in enumerate(design)), *(q.alias(f"p{a}") for a, q in enumerate(prob)), *((y == v).cast("double").alias(f"y{a}") for a, v in enumerate(rest)))
        col = F.col
        terms = [F.sum("l"), *(F.sum(col("w") * (col(f"y{a}") - col(f"p{a}")) * col(f"x{i}")) for a in range(k) for i in range(p))]
        terms += [F.sum(col("w") * col(f"p{a}") * (F.lit(float(a == b)) - col(f"p{b}")) * col(f"x{i}") * col(f"x{j}")) for a, b, i, j in keys]
        got = [float(v) for v in wide.agg(*terms).first()]
        gradient = np.array(got[1 : 1 + k * p])
        h = np.zeros((k * p, k * p))
        for v, (a, b, i, j) in zip(got[1 + k * p :], keys):
            h[a * p + i, b * p + j] = h[b * p + j, a * p + i] = v
        done = abs(got[0] - loglik) < 1e-10 * (abs(got[0]) + 1)
        loglik = got[0]
        if done:
            converged = True
            break
        beta = beta + np.linalg.solve(h, gradient).reshape(k, p)
    se = np.sqrt(np.diag(np.linalg.inv(h))).reshape(k, p)
    heads = ["(intercept)", *names]
    return {
        "target": slot.get("target"), "predictors": names, "family": "multinomial", "link": "softmax", "reference": base, "levels": levels, "loglik": loglik,
        "coefficients": {v: dict(zip(heads, row.tolist())) for v, row in zip(rest, beta)}, "se": {v: row.tolist() for v, row in zip(rest, se)},
        "iterations": steps, "converged": converged,
    }


@REGRESSIONS.add("REG_ORDINAL")
def ordinal(df: DataFrame, slot: Slot) -> dict:
    """Proportional odds: logit P(y <= j) = threshold_j - x'b, by Newton steps with numerical-free derivatives: the score
    and information of each row are sums of products of the two cumulative slopes that bound its level."""
    target, x, names = _fields(df, slot)
    y = target.cast("string")
    rows = df.where(complete(x) & y.isNotNull())
    most = int(slot.get("max_levels", 50))
    found = sorted(r[0] for r in rows.select(y).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise RequestError(f"REG_ORDINAL: more than {most} levels")
    levels = list(slot.get("levels") or found)
    if unknown := sorted(set(found) - set(levels)):
        raise RequestError(f"REG_ORDINAL: rows have levels that aren't listed: {unknown}")
    if absent := [v for v in levels if v not in found]:
        raise RequestError(f"REG_ORDINAL: no rows have the levels {absent}")
    if len(levels) < 2:
        raise RequestError("REG_ORDINAL: two levels at least are needed")
    k, p = len(levels) - 1, len(x)
    counts = dict(map(tuple, rows.groupBy(y).count().collect()))
    cum = np.cumsum([counts.get(v, 0) for v in levels])[:-1] / sum(counts.values())
    params = np.concatenate([np.log(cum / (1 - cum)), np.zeros(p)])
    place = F.array_position(F.array(*map(F.lit, levels)), y).cast("int") - 1
    loglik, converged, steps = -math.inf, False, 0
    sig = lambda e: 1 / (1 + F.exp(-e))
    for steps in range(1, int(slot.get("max_iters", 50)) + 1):
        lin = sum((F.lit(float(b)) * c for b, c in zip(params[k:], x)), F.lit(0.0))
        cut = F.array(*(F.lit(float(t)) for t in params[:k]))
        hi = F.when(place == k, 1.0).otherwise(sig(F.get(cut, place) - lin))
        lo = F.when(place == 0, 0.0).otherwise(sig(F.get(cut, place - 1) - lin))
        base = rows.select(place.alias("j"), hi.alias("h"), lo.alias("l"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
        pr = F.col("h") - F.col("l")
        dh, dl = F.col("h") * (1 - F.col("h")), F.col("l") * (1 - F.col("l"))
        d2h, d2l = dh * (1 - 2 * F.col("h")), dl * (1 - 2 * F.col("l"))
        # derivative of the bounds by each parameter: +1 for the own threshold, -x for a slope
        gh = [(F.col("j") == t).cast("double") for t in range(k)] + [-F.col(f"x{i}") for i in range(p)]
        gl = [(F.col("j") == t + 1).cast("double") for t in range(k)] + [-F.col(f"x{i}") for i in range(p)]
        score = [(dh * a - dl * b) / pr for a, b in zip(gh, gl)]
        pairs = [(i, j) for i in range(k + p) for j in range(i, k + p)]
        terms = [F.sum(F.log(pr)), *map(F.sum, score)] + [F.sum(score[i] * score[j] - (d2h * gh[i] * gh[j] - d2l * gl[i] * gl[j]) / pr) for i, j in pairs]
        got = [float(v) for v in base.agg(*terms).first()]
        h = np.zeros((k + p, k + p))
        for v, (i, j) in zip(got[1 + k + p :], pairs):
            h[i, j] = h[j, i] = v
        done, loglik = abs(got[0] - loglik) < 1e-10 * (abs(got[0]) + 1), got[0]
        if done:
            converged = True
            break
        params = params + np.linalg.solve(h, np.array(got[1 : 1 + k + p]))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    return {
        "target": slot.get("target"), "predictors": names, "family": "ordinal", "link": "logit", "levels": levels, "thresholds": params[:k].tolist(),
        "coefficients": dict(zip(names, params[k:].tolist())), "se": se.tolist(), "loglik": loglik, "iterations": steps, "converged": converged,
    }


def predict(fit: dict, x: list[Column], scale: str = "response", category: str | None = None) -> Column:
    """A fitted model as a column."""
    names = fit["predictors"]
    line = lambda c: sum((F.lit(float(c[n])) * v for n, v in zip(names, x)), F.lit(float(c.get("(intercept)", 0.0))))
    if fit["family"] == "multinomial":
        scores = {v: line(c) for v, c in fit["coefficients"].items()} | {fit["reference"]: F.lit(0.0)}
        total = sum((F.exp(e) for e in scores.values()), F.lit(0.0))
        return F.exp(scores[category or fit["levels"][-1]]) / total
    if fit["family"] == "ordinal":
        j = fit["levels"].index(category or fit["levels"][-1])
        upto = lambda t: F.lit(1.0) if t == len(fit["levels"]) - 1 else F.lit(0.0) if t < 0 else 1 / (1 + F.exp(line(fit["coefficients"]) - F.lit(fit["thresholds"][t])))
        return upto(j) - upto(j - 1)
    eta = line(fit["coefficients"])
    return eta if scale == "link" else LINKS[fit["link"]][0](eta)


@REGRESSIONS.add("REG_RESAMPLE")
def resampled(df: DataFrame, slot: Slot) -> dict:
    return resample(df, slot, fit_ols if slot.get("family") is None else _glm)


def resample(df: DataFrame, slot: Slot, fit: Callable[[DataFrame, Slot], dict]) -> dict:
    """Standard errors from refits. ``jackknife``: rows in ``jackknife_groups`` groups by a hash of ``key`` (a unique
    column), each left out once. ``bootstrap``: Poisson weights by a hash of key and replicate, so that the draws don't
    hang on partitioning. Least squares need one aggregate for all jackknife groups' sums only in each refit."""
    full, key = fit(df, slot), F.col(f"`{slot.need('key')}`")
    seed, fits = int(slot.get("rng_seed", 0)), []
    if slot.get("resample") == "jackknife":
        g = int(slot.get("jackknife_groups", 10))
        fold = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(g))
        fits = [fit(df.where(fold != i), slot) for i in range(g)]
    else:
        b = int(slot.get("bootstrap_iters", 50))
        cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
        for i in range(b):
            u = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(1 << 40)) / float(1 << 40)
            draw = sum(((u >= float(c)).cast("int") for c in cuts), F.lit(0))
            fits.append(fit(df.withColumn("_draw", draw.cast("double")), Slot(slot.type, slot.field, slot.label, slot.params, "_draw", "frequency")))
    names = list(full["coefficients"])
    draws = np.array([[f["coefficients"][c] for c in names] for f in fits])
    if slot.get("resample") == "jackknife":
        se = np.sqrt((len(fits) - 1) / len(fits) * ((draws - draws.mean(0)) ** 2).sum(0))
    else:
        se = draws.std(0, ddof=1)
        full |= {"lower": np.percentile(draws, 2.5, axis=0).tolist(), "upper": np.percentile(draws, 97.5, axis=0).tolist()}
    return full | {"se": se.tolist(), "resample": slot.get("resample"), "replicates": len(fits)}


@REGRESSIONS.add("REG_SELECTION")
def select(df: DataFrame, slot: Slot) -> dict:
    """Forward, backward or stepwise search by aic or bic over sub-blocks of one matrix of cross products, then one fit
    of the chosen predictors."""
    if slot.get("penalty"):
        raise RequestError("selection doesn't go with a penalty")
    params = {k: v for k, v in slot.params.items() if k not in ("selection", "criterion")}
    full = fit_ols(df, Slot("REG_OLS", None, None, params, slot.weight, slot.weight_kind))
    names, n = full["predictors"], full["n"]
    gram, xy, yy = np.array(full["gram"]), np.array(full["xy"]), full["yy"]
    price = math.log(n) if slot.get("criterion", "aic") == "bic" else 2.0

    def score(chosen: frozenset[int]) -> float:
        k = sorted(chosen)
        rss = yy - (xy[k] @ np.linalg.solve(gram[np.ix_(k, k)], xy[k]) if k else 0.0)
        return n * math.log(max(rss, 1e-300) / n) + price * (len(k) + 2)

    how = slot.get("selection", "forward")
    now = frozenset() if how == "forward" else frozenset(range(len(names)))
    best, path = score(now), []
    while True:
        moves = [now | {j} for j in range(len(names)) if j not in now and how != "backward"] + [now - {j} for j in now if how != "forward"]
        found = min(((score(m), sorted(m)) for m in moves), default=None)
        if found is None or found[0] >= best - 1e-9:
            break
        best, now = found[0], frozenset(found[1])
        path.append([names[j] for j in sorted(now)])
    if not now:
        raise RequestError("selection left no predictor")
    return fit_ols(df, Slot("REG_OLS", None, None, params | {"predictors": [names[j] for j in sorted(now)]}, slot.weight, slot.weight_kind)) | {"path": path}


def fit_row(df: DataFrame, result: dict) -> DataFrame:
    """Coefficients in long form: term, estimate, se."""
    rows = []
    if result["family"] == "multinomial":
        for level, c in result["coefficients"].items():
            rows += [(f"{level}:{t}", float(v), float(s)) for (t, v), s in zip(c.items(), result["se"][level])]
    else:
        terms = dict(zip((f"cut{j + 1}" for j in range(len(result.get("thresholds", [])))), result.get("thresholds", []))) | result["coefficients"]
        se = result.get("se") or [None] * len(terms)
        rows = [(t, float(v), None if s is None else float(s)) for (t, v), s in zip(terms.items(), se)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double")
