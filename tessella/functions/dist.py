"""Distribution functions in plain numpy and math: tails and quantiles that closing maths on the driver needs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

SMALL = 1e-300


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection to a bracket and Newton steps on the exact distribution function."""
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    low, high = -40.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    z = (low + high) / 2
    for _ in range(3):
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        if density > 0:
            z -= (normal_cdf(z) - p) / density
    return z


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > SMALL else SMALL)
    out = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > SMALL else SMALL), c if abs(c) > SMALL else SMALL
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / SMALL, 1 / b
    out = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or SMALL)
        c = b + k / c or SMALL
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def chisq_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2) if x > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    if math.isinf(t):
        return 0.0
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        below = 1 - t_tail(mid, df) / 2 if mid > 0 else t_tail(mid, df) / 2
        low, high = (mid, high) if below < p else (low, mid)
    return (low + high) / 2


def f_tail(f: float, a: float, b: float) -> float:
    return beta_cdf(b / (b + a * f), b / 2, a / 2) if f > 0 else 1.0


def kolmogorov_tail(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


@lru_cache(maxsize=4)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def range_cdf(w: float, k: int) -> float:
    """Of the range of k standard normal values."""
    if w <= 0:
        return 0.0
    x, weight = _nodes(96)
    z = x * 8.0
    inside = (_erf((z + w) / math.sqrt(2)) - _erf(z / math.sqrt(2))) / 2
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return float(min(1.0, k * 8.0 * (weight * density * inside ** (k - 1)).sum()))


def tukey_tail(q: float, k: int, df: float) -> float:
    """Of the studentised range: the range's distribution averaged over the scale's."""
    if q <= 0:
        return 1.0
    if df > 5000:
        return 1 - range_cdf(q, k)
    x, weight = _nodes(96)
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - spread), 1 + spread
    s = (high - low) / 2 * x + (high + low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    inner = np.array([range_cdf(q * v, k) for v in s])
    return float(min(1.0, max(0.0, 1 - (high - low) / 2 * (weight * np.exp(log_density) * inner).sum())))


def adjust(p: list[float | None], method: str) -> list[float | None]:
    """Adjusted p-values: bonferroni, holm, bh or by; nulls stay and don't count."""
    at = [i for i, x in enumerate(p) if x is not None]
    n, out = len(at), list(p)
    if method == "bonferroni":
        for i in at:
            out[i] = min(1.0, p[i] * n)
        return out
    order = sorted(at, key=lambda i: p[i], reverse=method != "holm")
    best = 0.0 if method == "holm" else 1.0
    factor = sum(1 / k for k in range(1, n + 1)) if method == "by" else 1.0
    for k, i in enumerate(order):
        if method == "holm":
            best = max(best, min(1.0, p[i] * (n - k)))
        else:
            best = min(best, p[i] * factor * n / (n - k))
        out[i] = best
    return out
