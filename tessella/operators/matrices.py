"""Matrices of a vector's members: Spark works out co-moments, the driver closes over p by p numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions import dist
from tessella.functions.running import mid_ranks
from tessella.operators.attributes import complete, members, moments
from tessella.operators.groupers import apply_groupers
from tessella.operators.slots import Registry, Slot, valid_weight

MATRICES = Registry("matrix")


def correlation_of(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = cov / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    return r


def names_of(slot: Slot, p: int) -> list[str]:
    return list(slot.get("members") or slot.get("labels") or [f"{slot.field}_{i}" for i in range(p)])


def weighted_moments(df: DataFrame, cols: list[Column], w: Column, ddof: int, frequency: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments under weights, around the weighted means: probability weights are rescaled to the number of rows."""
    rows = df.where(complete(cols) & w.isNotNull())
    p = len(cols)
    first = rows.agg(F.sum(w), F.count(F.lit(1)), *(F.sum(w * c) for c in cols)).first()
    total = float(first[0])
    means = np.array(first[2:]) / total
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    d = [c - F.lit(float(m)) for c, m in zip(cols, means)]
    got = rows.agg(*(F.sum(w * d[i] * d[j]) for i, j in pairs)).first()
    n = total if frequency else float(first[1])
    cov = np.zeros((p, p))
    for v, (i, j) in zip(got, pairs):
        cov[i, j] = cov[j, i] = v / total * n / (n - ddof)
    return n, means, cov


def _cov(df: DataFrame, slot: Slot) -> tuple[float, np.ndarray, np.ndarray]:
    cols = members(df, slot)
    if slot.weight:
        return weighted_moments(df, cols, valid_weight(df, slot.weight), 1, slot.weight_kind == "frequency")
    return moments(df, cols)


@MATRICES.add("MAT_COVARIANCE")
def covariance(df: DataFrame, slot: Slot) -> dict:
    """Sample by default (``ddof`` 1); listwise, or with ``missing`` "pairwise" each pair by its own complete rows."""
    ddof, cols = int(slot.get("ddof", 1)), members(df, slot)
    if slot.get("missing") == "pairwise":
        return {"primary": pairwise(df, cols, F.covar_samp if ddof else F.covar_pop), "names": names_of(slot, len(cols))}
    n, mean, cov = _cov(df, slot)
    return {"primary": cov * (n - 1) / (n - ddof), "names": names_of(slot, len(cols)), "n": n, "means": mean}


def pairwise(df: DataFrame, cols: list[Column], f) -> np.ndarray:
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    both = lambda i, j: complete([cols[i], cols[j]])
    got = df.agg(*(f(F.when(both(i, j), cols[i]), F.when(both(i, j), cols[j])) for i, j in pairs)).first()
    out = np.full((p, p), np.nan)
    for v, (i, j) in zip(got, pairs):
        out[i, j] = out[j, i] = np.nan if v is None else v
    return out


@MATRICES.add("MAT_CORRELATION")
def correlation(df: DataFrame, slot: Slot) -> dict:
    """Pearson, or by ``method`` spearman (mid-ranks) or kendall (tau-b)."""
    cols, method = members(df, slot), slot.get("method", "pearson")
    names = names_of(slot, len(cols))
    if method == "kendall":
        from tessella.operators.tests import kendall

        rows = df.where(complete(cols)).select(*(c.alias(f"c{i}") for i, c in enumerate(cols)))
        r = np.eye(len(cols))
        for i in range(len(cols)):
            for j in range(i):
                r[i, j] = r[j, i] = kendall(rows, Slot("TEST_KENDALL_TAU", f"c{i}", None, {"field2": f"c{j}"}))["statistic"]
        return {"primary": r, "names": names}
    if method == "spearman":
        rows = df.where(complete(cols)).select(*(c.alias(f"c{i}") for i, c in enumerate(cols)))
        for i in range(len(cols)):
            ranks = mid_ranks(rows, f"c{i}").select(F.col("value").alias(f"c{i}"), F.col("rank").alias(f"r{i}"))
            rows = rows.join(ranks, f"c{i}")
        n, _, cov = moments(rows, [F.col(f"r{i}") for i in range(len(cols))])
    elif slot.get("missing") == "pairwise":
        return {"primary": pairwise(df, cols, F.corr), "names": names}
    else:
        n, _, cov = _cov(df, slot)
    r = correlation_of(cov)
    out = {"primary": r, "names": names, "n": n}
    if slot.get("inference"):
        with np.errstate(divide="ignore"):
            t = r * np.sqrt((n - 2) / np.maximum(1 - r * r, 1e-300))
        out["p"] = np.array([[dist.t_tail(float(v), n - 2) for v in row] for row in t])
    return out


@MATRICES.add("MAT_PARTIAL_CORRELATION")
def partial_correlation(df: DataFrame, slot: Slot) -> dict:
    """Each pair with all other members held fixed, or with the ``control`` fields."""
    control = list(slot.get("control", []))
    names = names_of(slot, len(members(df, slot)))
    whole = Slot(slot.type, None, None, {"members": names + control})
    n, _, cov = _cov(df, whole)
    p = len(names)
    if control:
        a, b, c = cov[:p, :p], cov[:p, p:], cov[p:, p:]
        r = correlation_of(a - b @ np.linalg.solve(c, b.T))
    else:
        inverse = np.linalg.inv(correlation_of(cov))
        r = -correlation_of(inverse)
        np.fill_diagonal(r, 1.0)
    return {"primary": r, "names": names, "n": n}


def principal(cov: np.ndarray, on: str = "correlation") -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, and eigenvectors whose largest element (the first of equal ones) is positive."""
    values, vectors = np.linalg.eigh(correlation_of(cov) if on == "correlation" else cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = np.abs(vectors)
    first = (size > size.max(0) - 1e-9).argmax(0)
    return values, vectors * np.where(vectors[first, np.arange(len(values))] < 0, -1.0, 1.0)


@MATRICES.add("MAT_PCA")
def pca(df: DataFrame, slot: Slot) -> dict:
    """Loadings of the components whose eigenvalue is above the mean one, or of ``components``."""
    n, _, cov = _cov(df, slot)
    values, vectors = principal(cov, slot.get("on", "correlation"))
    k = int(slot.get("components") or max(1, (values > values.mean() + 1e-12).sum()))
    loadings = vectors[:, :k] * np.sqrt(np.clip(values[:k], 0, None))
    if slot.get("rotation") == "varimax":
        loadings = rotate(loadings)
    share = values / values.sum()
    return {"primary": loadings, "names": names_of(slot, len(cov)), "n": n, "eigenvalues": values, "explained": share, "cumulative": np.cumsum(share), "eigenvectors": vectors[:, :k]}


def rotate(load: np.ndarray, gamma: float = 1.0, steps: int = 500) -> np.ndarray:
    """Orthomax rotation (varimax at gamma 1, quartimax at 0) by singular value decompositions, Kaiser-normalised."""
    size = np.sqrt((load**2).sum(1, keepdims=True))
    size[size == 0] = 1
    a, turn, best = load / size, np.eye(load.shape[1]), 0.0
    for _ in range(steps):
        b = a @ turn
        u, s, v = np.linalg.svd(a.T @ (b**3 - gamma / len(a) * b * (b**2).sum(0)))
        turn = u @ v
        if s.sum() < best * (1 + 1e-10):
            break
        best = s.sum()
    return a @ turn * size


def factor_fit(r: np.ndarray, k: int, extraction: str = "minres", rotation: str = "none") -> dict:
    """Uniquenesses by minimum residuals, principal axes or maximum likelihood; loadings, optionally rotated."""
    smc = 1 - 1 / np.diag(np.linalg.inv(r))

    def load(psi: np.ndarray) -> np.ndarray:
        if extraction == "ml":
            root = np.sqrt(psi)
            values, vectors = np.linalg.eigh(r / np.outer(root, root))
            top = slice(-1, -k - 1, -1)
            return root[:, None] * vectors[:, top] * np.sqrt(np.clip(values[top] - 1, 0, None))
        values, vectors = np.linalg.eigh(r - np.diag(psi))
        top = slice(-1, -k - 1, -1)
        return vectors[:, top] * np.sqrt(np.clip(values[top], 0, None))

    psi = np.clip(1 - smc, 0.005, 1)
    for _ in range(5000):  # the communalities of the loadings are a fixed point of each of the three criteria
        new = np.clip(1 - (load(psi) ** 2).sum(1), 0.005, 1)
        done = np.abs(new - psi).max() < 1e-9
        psi = new
        if done:
            break
    loadings = load(psi)
    loadings = loadings * np.where(loadings.sum(0) < 0, -1.0, 1.0)
    phi = np.eye(k)
    if rotation in ("varimax", "quartimax") and k > 1:
        loadings = rotate(loadings, 1.0 if rotation == "varimax" else 0.0)
    elif rotation == "promax" and k > 1:
        base = rotate(loadings)
        target = base * np.abs(base) ** 3
        u = np.linalg.lstsq(base, target, rcond=None)[0]
        u = u * np.sqrt(np.diag(np.linalg.inv(u.T @ u)))
        loadings, inverse = base @ u, np.linalg.inv(u)
        phi = inverse @ inverse.T
    elif rotation not in ("none", "varimax", "quartimax", "promax"):
        raise RequestError(f"factor: no rotation {rotation!r}")
    return {"loadings": loadings, "uniqueness": psi, "phi": phi, "structure": loadings @ phi}


@MATRICES.add("MAT_FACTOR")
def factor(df: DataFrame, slot: Slot) -> dict:
    n, _, cov = _cov(df, slot)
    r = correlation_of(cov)
    fit = factor_fit(r, int(slot.get("factors", 1)), slot.get("extraction", "minres"), slot.get("rotation", "none"))
    left = r - fit["loadings"] @ fit["phi"] @ fit["loadings"].T
    np.fill_diagonal(left, 0)
    return {"primary": fit["loadings"], "names": names_of(slot, len(r)), "n": n, "uniqueness": fit["uniqueness"], "communality": 1 - fit["uniqueness"], "phi": fit["phi"], "rmsr": math.sqrt((left**2).sum() / max(1, len(r) * (len(r) - 1)))}


@MATRICES.add("MAT_RELIABILITY")
def reliability(df: DataFrame, slot: Slot) -> dict:
    """Cronbach's alpha, its standardised form, omega by one minres factor, and each item's alpha if it were dropped."""
    n, _, cov = _cov(df, slot)
    names = names_of(slot, len(cov))
    for i, m in enumerate(names):
        if m in slot.get("reverse", []):
            cov[i, :] *= -1
            cov[:, i] *= -1
    alpha = lambda c: len(c) / (len(c) - 1) * (1 - np.trace(c) / c.sum())
    r, p = correlation_of(cov), len(cov)
    mean_r = (r.sum() - p) / (p * (p - 1))
    fit = factor_fit(r, 1)
    top = fit["loadings"].sum() ** 2
    rest = [[j for j in range(p) if j != i] for i in range(p)]
    item = [(cov[i, k].sum()) / math.sqrt(cov[i, i] * cov[np.ix_(k, k)].sum()) for i, k in enumerate(rest)]
    return {
        "primary": r, "names": names, "n": n, "alpha": float(alpha(cov)), "standardized_alpha": float(p * mean_r / (1 + (p - 1) * mean_r)),
        "omega": float(top / (top + fit["uniqueness"].sum())), "mean_r": float(mean_r), "item_rest_r": item,
        "alpha_dropped": [float(alpha(cov[np.ix_(k, k)])) if len(k) > 1 else None for k in rest],
    }


@MATRICES.add("MAT_COLLINEARITY")
def collinearity(df: DataFrame, slot: Slot) -> dict:
    """VIF and tolerance of each predictor, and the condition indices of the scaled design with its intercept."""
    n, mean, cov = _cov(df, slot)
    vif = np.diag(np.linalg.inv(correlation_of(cov)))
    p = len(cov)
    gram = np.zeros((p + 1, p + 1))
    gram[0, 0], gram[0, 1:], gram[1:, 0] = n, n * mean, n * mean
    gram[1:, 1:] = cov * (n - 1) + n * np.outer(mean, mean)
    size = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram / np.outer(size, size))
    values, vectors = np.clip(values[::-1], 1e-300, None), vectors[:, ::-1]
    phi = vectors**2 / values
    return {"primary": (phi / phi.sum(1, keepdims=True)).T, "names": names_of(slot, p), "n": n, "vif": vif, "tolerance": 1 / vif, "condition": np.sqrt(values[0] / values)}


@MATRICES.add("MAT_DISTANCE")
def distances(df: DataFrame, slot: Slot) -> dict:
    """Distances between the centroids of the buckets of ``between`` (a grouper slot)."""
    cols = members(df, slot)
    keyed, keys, orders = apply_groupers(df.withColumns({f"_m{i}": c for i, c in enumerate(cols)}), [Slot.of(slot.need("between"))])
    rows = keyed.groupBy(*keys).agg(F.min(orders[0]).alias("_o"), *(F.avg(f"_m{i}") for i in range(len(cols)))).orderBy("_o").limit(2001).collect()
    if len(rows) > 2000:
        raise RequestError("MAT_DISTANCE: more than 2000 buckets")
    x = np.array([r[2:] for r in rows], float)
    d = x[:, None, :] - x[None, :, :]
    metric = slot.get("metric", "euclidean")
    out = {"euclidean": lambda: np.sqrt((d**2).sum(2)), "manhattan": lambda: np.abs(d).sum(2), "chebyshev": lambda: np.abs(d).max(2)}.get(metric)
    if out is None:
        raise RequestError(f"MAT_DISTANCE: no metric {metric!r}")
    return {"primary": out(), "names": [r[0] for r in rows]}


@MATRICES.add("MAT_SEM")
def sem(df: DataFrame, slot: Slot) -> dict:
    from tessella.operators.sem import fit_sem

    return fit_sem(df, slot.need("model"))


def as_rows(df: DataFrame, result: dict, part: str = "primary") -> DataFrame:
    """A matrix in long form: row_key, col_key, value."""
    m, names = np.atleast_2d(result[part]), result["names"]
    cols = names if m.shape[1] == len(names) else [str(j + 1) for j in range(m.shape[1])]
    keys = names if m.shape[0] == len(names) else [str(i + 1) for i in range(m.shape[0])]
    rows = [(keys[i], cols[j], None if not np.isfinite(m[i, j]) else float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return df.sparkSession.createDataFrame(rows, "row_key string, col_key string, value double")
