"""Structural equation models by maximum likelihood on the members' covariance.

The model text has lines ``latent =~ a + b + c`` (the first loading is 1), ``y ~ x1 + x2`` and ``a ~~ b``; ``1*a`` fixes
a coefficient. Variances are free; latents that nothing predicts covary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions import dist
from tessella.operators.attributes import moments


def parse_model(text: str) -> list[tuple[str, str, str, float | None]]:
    """(left, operator, right, fixed value or None) for each term."""
    out = []
    for line in filter(None, (x.split("#")[0].strip() for x in text.replace(";", "\n").splitlines())):
        op = next((o for o in ("=~", "~~", "~") if o in line), None)
        if op is None:
            raise RequestError(f"model line {line!r} has no =~, ~ or ~~")
        left, right = (x.strip() for x in line.split(op, 1))
        for k, term in enumerate(x.strip() for x in right.split("+")):
            value, _, name = term.rpartition("*")
            fixed = float(value) if value.strip() else None
            if op == "=~" and k == 0 and not value:
                fixed = 1.0
            out.append((left, op, name.strip(), fixed))
    return out


class Model:
    """Matrices A (directed, from column to row) and S (symmetric) over observed and latent variables."""

    def __init__(self, text: str) -> None:
        terms = parse_model(text)
        self.latent = list(dict.fromkeys(t[0] for t in terms if t[1] == "=~"))
        named = dict.fromkeys(v for t in terms for v in (t[2], t[0]) if v not in self.latent)
        self.observed = list(named)
        self.names = self.observed + self.latent
        at = {n: i for i, n in enumerate(self.names)}
        self.free: list[tuple[str, int, int]] = []
        size = len(self.names)
        self.a, self.s = np.zeros((size, size)), np.zeros((size, size))
        predicted = set()
        for left, op, right, fixed in terms:
            kind, i, j = ("S", at[left], at[right]) if op == "~~" else ("A", at[right], at[left]) if op == "=~" else ("A", at[left], at[right])
            predicted |= {i} if kind == "A" else set()
            if fixed is None:
                self.free.append((kind, i, j))
            else:
                (self.a if kind == "A" else self.s)[i, j] = fixed
        given = {(i, j) for k, i, j in self.free if k == "S"} | {(i, i) for i in range(size) if self.s[i, i]}
        self.free += [("S", i, i) for i in range(size) if (i, i) not in given]
        outer = [i for i in range(size) if i not in predicted]
        named_pairs = {tuple(sorted((i, j))) for k, i, j in self.free if k == "S"}
        self.free += [("S", i, j) for x, i in enumerate(outer) for j in outer[:x] if tuple(sorted((i, j))) not in named_pairs]

    def matrices(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, s = self.a.copy(), self.s.copy()
        for v, (k, i, j) in zip(theta, self.free):
            if k == "A":
                a[i, j] = v
            else:
                s[i, j] = s[j, i] = v
        return a, s

    def implied(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Covariance of the observed variables, of all variables, and the total effects."""
        a, s = self.matrices(theta)
        b = np.linalg.inv(np.eye(len(a)) - a)
        whole = b @ s @ b.T
        p = len(self.observed)
        return whole[:p, :p], whole, b

    def derivatives(self, theta: np.ndarray) -> list[np.ndarray]:
        _, whole, b = self.implied(theta)
        p, out = len(self.observed), []
        for k, i, j in self.free:
            if k == "A":
                d = np.outer(b[:, i], whole[j])
            else:
                d = np.outer(b[:, i], b[:, j]) / (1 if i != j else 2)
            out.append((d + d.T)[:p, :p])
        return out

    def start(self, cov: np.ndarray) -> np.ndarray:
        p = len(self.observed)
        return np.array([
            0.7 if k == "A" and j >= p else 0.0 if i != j else cov[i, i] / 2 if i < p else 0.5 * float(np.median(np.diag(cov))) for k, i, j in self.free
        ])


def fit_sem(df: DataFrame, text: str, steps: int = 500) -> dict:
    """Fisher scoring with step halving: estimates, standard errors and fit indices."""
    model = Model(text)
    cols = [F.col(f"`{n}`").cast("double") for n in model.observed]
    n, means, cov = moments(df, cols)
    sample = cov * (n - 1) / n
    p, logdet = len(sample), np.linalg.slogdet(sample)[1]

    def discrepancy(theta: np.ndarray) -> float:
        sigma = model.implied(theta)[0]
        sign, value = np.linalg.slogdet(sigma)
        if sign <= 0 or np.linalg.eigvalsh(sigma)[0] <= 0:
            return np.inf
        return float(value + np.trace(np.linalg.solve(sigma, sample)) - logdet - p)

    theta = model.start(sample)
    now = discrepancy(theta)
    for _ in range(steps):
        sigma = model.implied(theta)[0]
        inverse = np.linalg.inv(sigma)
        parts = [inverse @ d for d in model.derivatives(theta)]
        gradient = np.array([np.trace(q) - np.trace(q @ inverse @ sample) for q in parts])
        information = np.array([[np.trace(x @ y) for y in parts] for x in parts])
        step, size = np.linalg.lstsq(information, -gradient, rcond=None)[0], 1.0
        while size > 1e-8 and not discrepancy(theta + size * step) < now + 1e-14:
            size /= 2
        if size <= 1e-8:
            break
        theta = theta + size * step
        last, now = now, discrepancy(theta)
        if abs(last - now) < 1e-14 or np.abs(gradient).max() < 1e-10:
            break
    parts = [np.linalg.solve(model.implied(theta)[0], d) for d in model.derivatives(theta)]
    information = np.array([[np.trace(x @ y) for y in parts] for x in parts]) * n / 2
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(information)), 0, None))
    free = p * (p + 1) // 2 - len(theta)
    x2, base = n * now, n * float(np.log(np.diag(sample)).sum() - logdet)
    base_df = p * (p - 1) // 2
    names = model.names
    labels = [f"{names[j]}{'->' if k == 'A' else '~~'}{names[i]}" for k, i, j in model.free]
    gap, base_gap = max(x2 - free, 0), max(base - base_df, x2 - free, 1e-300)
    return {
        "primary": model.implied(theta)[0], "names": model.observed, "n": n, "means": means, "theta": theta, "model": text, "sample": sample,
        "estimates": dict(zip(labels, theta.tolist())), "se": dict(zip(labels, se.tolist())), "chisq": x2, "df": free,
        "p": dist.chisq_tail(x2, free) if free else None, "cfi": 1 - gap / base_gap, "rmsea": float(np.sqrt(gap / (n * free))) if free else 0.0,
    }


def sem_weights(fit: dict, latent: str, method: str = "regression") -> tuple[list[str], np.ndarray]:
    """Observed names and the weights of a latent's score."""
    model = Model(fit["model"])
    sigma, whole, b = model.implied(fit["theta"])
    p, k = len(model.observed), model.names.index(latent)
    if method == "regression":
        return model.observed, np.linalg.solve(sigma, whole[:p, k])
    latents = [model.names.index(x) for x in model.latent]
    load = b[np.ix_(range(p), latents)]
    theta = np.diag(np.diag(model.matrices(fit["theta"])[1])[:p])
    inner = load.T @ np.linalg.inv(theta)
    return model.observed, np.linalg.solve(inner @ load, inner)[latents.index(k)]
