"""Media-mix regressions: carry-over and saturation of channels, by least squares or by sampling the posterior.

The rows are periods, weeks or days of one series, which are few: their number is checked and they go to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.operators.regressions import REGRESSIONS, _nonnegative
from tessella.operators.slots import Slot
from tessella.plans.batch import adaptive

MOST_PERIODS = 20_000


def periods(df: DataFrame, slot: Slot) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[str]]:
    """Target, channel spend and controls in order of time."""
    channels, controls = list(slot.need("channels")), [c for c in slot.get("predictors", []) if c not in slot.need("channels")]
    names = [slot.need("target"), *channels, *controls]
    rows = df.orderBy(F.col(f"`{slot.need('time')}`")).select(*(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names)).limit(MOST_PERIODS + 1).collect()
    if not len(names) < len(rows) <= MOST_PERIODS:
        raise RequestError(f"{slot.type}: {len(rows)} periods; more than {len(names)} and at most {MOST_PERIODS} are needed")
    data = np.array(rows, float)
    k = 1 + len(channels)
    return data[:, 0], data[:, 1:k], data[:, k:], channels, controls


def carried(x: np.ndarray, decay: float, lags: int) -> np.ndarray:
    """Geometric carry-over, weights scaled to 1."""
    w = decay ** np.arange(lags + 1)
    out = np.zeros_like(x)
    for k, v in enumerate(w / w.sum()):
        out[k:] += v * x[: len(x) - k]
    return out


def hill(x: np.ndarray, half: float, shape: float) -> np.ndarray:
    z = np.power(np.maximum(x, 0), shape)
    return z / (z + half**shape)


@REGRESSIONS.add("REG_MMM_HILL")
def mmm_hill(df: DataFrame, slot: Slot) -> dict:
    """Coefficient, decay, half-saturation and shape of each channel, jointly: given the curves' parameters the
    coefficients are a least-squares fit (channels not below zero); the parameters are searched by seeded differential
    evolution."""
    y, x, z, channels, controls = periods(df, slot)
    lags = int(slot.get("max_lag", 8))
    top = np.maximum(x.max(0), 1e-9)
    bounds = {}
    for i, c in enumerate(channels):
        bounds |= {f"{c}.decay": (0.0, 0.9), f"{c}.half": (0.05 * top[i], 2 * top[i]), f"{c}.shape": (0.5, 3.0)}

    def curves(p: dict) -> np.ndarray:
        return np.column_stack([hill(carried(x[:, i], p[f"{c}.decay"], lags), p[f"{c}.half"], p[f"{c}.shape"]) for i, c in enumerate(channels)])

    def solve(p: dict) -> tuple[np.ndarray, float]:
        media = curves(p)
        rest = np.column_stack([np.ones(len(y)), z])
        clear = lambda m: m - rest @ np.linalg.lstsq(rest, m, rcond=None)[0]
        a, b = clear(media), clear(y)
        gram = a.T @ a + 1e-9 * np.eye(a.shape[1])
        beta = _nonnegative(gram, a.T @ b) if slot.get("nonnegative", True) else np.linalg.solve(gram, a.T @ b)
        other = np.linalg.lstsq(rest, y - media @ beta, rcond=None)[0]
        return np.concatenate([other, beta]), float(((b - a @ beta) ** 2).sum())

    best, rss = adaptive(lambda p: solve(p)[1], bounds, int(slot.get("rounds", 40)), 12, int(slot.get("rng_seed", 0)))
    coef, _ = solve(best)
    names = ["(intercept)", *controls, *channels]
    return {
        "target": slot.get("target"), "predictors": channels, "family": "mmm", "link": "identity", "n": len(y), "rss": rss,
        "r2": 1 - rss / float(((y - y.mean()) ** 2).sum()), "coefficients": dict(zip(names, coef.tolist())) | best,
    }


def hmc(log_density: Callable[[np.ndarray], float], start: np.ndarray, draws: int, warmup: int, seed: int, steps: int = 12, gradient: Callable | None = None) -> tuple[np.ndarray, float]:
    """Hamiltonian Monte Carlo with dual averaging of the step size and a diagonal metric from the warm-up."""
    rng = np.random.default_rng(seed)
    dim = len(start)

    def slope(q: np.ndarray) -> np.ndarray:
        h = 1e-5
        return np.array([(log_density(q + h * e) - log_density(q - h * e)) / (2 * h) for e in np.eye(dim)])

    slope = gradient or slope
    q, value = start.copy(), log_density(start)
    metric, seen, out = np.ones(dim), [], []
    log_eps, mean_log, total, mu, accepted = math.log(0.05), 0.0, 0.0, math.log(0.5), 0.0
    for t in range(1, warmup + draws + 1):
        eps = math.exp(log_eps if t <= warmup else mean_log)
        p = rng.standard_normal(dim) / np.sqrt(metric)
        new, energy = q.copy(), value - 0.5 * (metric * p * p).sum()
        momentum = p + eps / 2 * slope(new)
        count = 1 + int(rng.integers(steps))
        for k in range(count):
            new = new + eps * metric * momentum
            momentum = momentum + (eps if k < count - 1 else eps / 2) * slope(new)
        got = log_density(new)
        change = got - 0.5 * (metric * momentum * momentum).sum() - energy
        chance = min(1.0, math.exp(min(0.0, change))) if np.isfinite(change) else 0.0
        if rng.random() < chance:
            q, value = new, got
        if t <= warmup:
            total += (0.8 - chance - total) / (t + 10)
            log_eps = mu - math.sqrt(t) / 0.05 * total
            mean_log += (log_eps - mean_log) * t**-0.75
            seen.append(q)
            if t == warmup // 2:
                metric = np.var(np.array(seen[len(seen) // 2 :]), axis=0) + 1e-6
                total, mean_log, mu = 0.0, log_eps, math.log(10) + log_eps
        else:
            out.append(q)
            accepted += chance / draws
    return np.array(out), accepted


def nuts(log_density: Callable[[np.ndarray], float], start: np.ndarray, draws: int, warmup: int, seed: int, depth: int = 8, gradient: Callable | None = None) -> tuple[np.ndarray, float]:
    """The No-U-Turn sampler with multinomial choice along the trajectory, dual averaging of the step size and a diagonal
    metric from the warm-up; also the mean chance of acceptance."""
    rng, dim = np.random.default_rng(seed), len(start)
    rough = lambda q: np.array([(log_density(q + 1e-5 * e) - log_density(q - 1e-5 * e)) / 2e-5 for e in np.eye(dim)])
    slope, metric = gradient or rough, np.ones(dim)
    energy = lambda q, p: log_density(q) - 0.5 * (metric * p * p).sum()

    def turned(a: tuple, b: tuple) -> bool:
        way = b[0] - a[0]
        return way @ (metric * a[1]) < 0 or way @ (metric * b[1]) < 0

    def tree(end: tuple, eps: float, level: int, base: float) -> tuple:
        """From an end point on: both ends, a point chosen by weight, log of the weights' sum, whether it goes on, chances
        and their number."""
        if level == 0:
            q, p = end
            p = p + eps / 2 * slope(q)
            q = q + eps * metric * p
            p = p + eps / 2 * slope(q)
            weight = energy(q, p) - base
            weight = weight if np.isfinite(weight) else -math.inf
            return (q, p), (q, p), q, weight, weight > -1000, math.exp(min(0.0, weight)), 1
        near, far, point, weight, fine, chance, count = tree(end, eps, level - 1, base)
        if fine:
            _, further, other, more, good, c, k = tree(far, eps, level - 1, base)
            total = np.logaddexp(weight, more)
            if math.log(rng.random()) < more - total:
                point = other
            first, last = (near, further) if eps > 0 else (further, near)
            far, weight, fine, chance, count = further, total, good and not turned(first, last), chance + c, count + k
        return near, far, point, weight, fine, chance, count

    q, out, seen, accepted = start.astype(float).copy(), [], [], 0.0
    log_eps, mean_log, total, mu = math.log(0.1), 0.0, 0.0, math.log(1.0)
    for t in range(1, warmup + draws + 1):
        eps = math.exp(log_eps if t <= warmup else mean_log)
        p = rng.standard_normal(dim) / np.sqrt(metric)
        base, low, high, weight = energy(q, p), (q, p), (q, p), 0.0
        chances, count = 0.0, 0
        for level in range(depth):
            ahead = rng.random() < 0.5
            _, far, point, more, fine, c, k = tree(high if ahead else low, eps if ahead else -eps, level, base)
            chances, count = chances + c, count + k
            if not fine:
                break
            if math.log(rng.random()) < more - weight:
                q = point
            low, high = (low, far) if ahead else (far, high)
            weight = np.logaddexp(weight, more)
            if turned(low, high):
                break
        chance = chances / max(1, count)
        if t <= warmup:
            total += (0.8 - chance - total) / (t + 10)
            log_eps = mu - math.sqrt(t) / 0.05 * total
            mean_log += (log_eps - mean_log) * t**-0.75
            seen.append(q)
            if t == warmup // 2:
                metric = np.var(np.array(seen[len(seen) // 2 :]), axis=0) + 1e-6
                total, mean_log, mu = 0.0, log_eps, math.log(10) + log_eps
        else:
            out.append(q)
            accepted += chance / draws
    return np.array(out), accepted


def diagnose(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Split R-hat and effective sample sizes by initial monotone autocorrelations."""
    halves = [h for c in chains for h in (c[: len(c) // 2], c[len(c) // 2 : 2 * (len(c) // 2)])]
    x = np.array(halves)
    m, n, _ = x.shape
    within = x.var(1, ddof=1).mean(0)
    between = n * x.mean(1).var(0, ddof=1)
    whole = (n - 1) / n * within + between / n
    rhat = np.sqrt(whole / np.maximum(within, 1e-300))
    d = x - x.mean(1, keepdims=True)
    tau = np.ones(x.shape[2])
    live = np.ones(x.shape[2], bool)
    for lag in range(1, n - 2, 2):
        rho = [1 - (within - (d[:, k:] * d[:, : n - k]).sum(1).mean(0) / (n - k)) / np.maximum(whole, 1e-300) for k in (lag, lag + 1)]
        pair = rho[0] + rho[1]
        live &= pair > 0
        if not live.any():
            break
        tau += np.where(live, 2 * pair, 0)
    return rhat, m * n / tau


@REGRESSIONS.add("REG_MMM_BAYES")
def mmm_bayes(df: DataFrame, slot: Slot) -> dict:
    """Posterior of intercept, channel coefficients (above zero), decays (0 to 1), half-saturations and noise, in units
    of the standardised target and of each channel's largest spend."""
    y, x, z, channels, controls = periods(df, slot)
    lags, c, k = int(slot.get("max_lag", 8)), len(channels), len(controls)
    centre, scale = float(y.mean()), float(y.std()) or 1.0
    target, spend = (y - centre) / scale, x / np.maximum(x.max(0), 1e-9)
    other = (z - z.mean(0)) / np.where(z.std(0) > 0, z.std(0), 1) if k else z

    def unpack(q: np.ndarray) -> tuple:
        return q[0], np.exp(q[1 : 1 + c]), 1 / (1 + np.exp(-q[1 + c : 1 + 2 * c])), np.exp(q[1 + 2 * c : 1 + 3 * c]), q[1 + 3 * c : 1 + 3 * c + k], math.exp(q[-1])

    def log_density(q: np.ndarray) -> float:
        if np.abs(q).max() > 30:
            return -1e10
        a, beta, decay, half, gamma, sigma = unpack(q)
        mean = a + sum(beta[i] * hill(carried(spend[:, i], decay[i], lags), half[i], 1.0) for i in range(c)) + (other @ gamma if k else 0.0)
        r = target - mean
        prior = -0.5 * a * a - 0.5 * ((q[1 : 1 + c] + 1) ** 2).sum() - 0.5 * ((q[1 + c : 1 + 2 * c] / 1.5) ** 2).sum() - 0.5 * ((q[1 + 2 * c : 1 + 3 * c] + 0.7) ** 2).sum() - 0.5 * (gamma**2).sum() - 0.5 * (q[-1] + 0.5) ** 2
        return float(prior - len(r) * math.log(sigma) - 0.5 * (r @ r) / sigma**2)

    start = np.concatenate([[0.0], np.full(c, -1.0), np.zeros(c), np.full(c, -0.7), np.zeros(k), [-0.3]])
    seed, chains, accept = int(slot.get("rng_seed", 0)), [], []
    for i in range(int(slot.get("chains", 2))):
        got, rate = hmc(log_density, start, int(slot.get("draws", 500)), int(slot.get("warmup", 500)), seed + i)
        chains.append(got)
        accept.append(rate)
    draws = np.concatenate(chains)
    parts = {"(intercept)": centre + scale * draws[:, 0]}
    for i, name in enumerate(channels):
        parts |= {name: scale * np.exp(draws[:, 1 + i]), f"{name}.decay": 1 / (1 + np.exp(-draws[:, 1 + c + i])), f"{name}.half": np.exp(draws[:, 1 + 2 * c + i]) * max(float(x[:, i].max()), 1e-9)}
    parts |= {n: scale * draws[:, 1 + 3 * c + i] for i, n in enumerate(controls)} | {"sigma": scale * np.exp(draws[:, -1])}
    rhat, ess = diagnose(chains)
    return {
        "target": slot.get("target"), "predictors": channels, "family": "mmm", "link": "identity", "n": len(y),
        "coefficients": {n: float(v.mean()) for n, v in parts.items()}, "se": [float(v.std(ddof=1)) for v in parts.values()],
        "lower": {n: float(np.quantile(v, 0.025)) for n, v in parts.items()}, "upper": {n: float(np.quantile(v, 0.975)) for n, v in parts.items()},
        "rhat": rhat.tolist(), "ess": ess.tolist(), "accept": accept,
    }
