"""Several requests: chains, batches, sweeps, banners, and bounded optimisation over fitted models."""

from __future__ import annotations

import dataclasses
import functools
import itertools
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor, as_completed
from copy import deepcopy

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions.dist import normal_quantile, normal_tail
from tessella.operators.aggregates import aggregate
from tessella.operators.groupers import apply_groupers
from tessella.operators.regressions import REGRESSIONS
from tessella.operators.slots import Slot, column
from tessella.plans.request import process


def chain(df: DataFrame, stages: list[Mapping], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Each stage reads the rows of the one before, whose keys are text and whose outputs are doubles. A join is for the
    first stage only."""
    for k, stage in enumerate(stages):
        if k and (stage.get("join") or stage.get("crosstab")):
            raise RequestError(f"stage {k}: a join or crosstab is for the first stage only")
        result = process(df, stage, tables)
        df = result.rows
        if result.keys:
            df = df.select(*(F.col(f"`{c}`").cast("string" if c in result.keys else "double").alias(c) if c in result.keys or not t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes))
    return df


def merged(base: Mapping, request: Mapping) -> dict:
    """A request over a base: lists follow the base's, other keys replace them."""
    out = deepcopy(dict(base))
    for k, v in request.items():
        out[k] = [*out.get(k, []), *v] if isinstance(v, list) else v
    return out


def compose(df: DataFrame, requests: Mapping[str, Mapping], base: Mapping | None = None, fits: Mapping[str, Mapping] | None = None, tables: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Independent requests over one table, as lazy results by name. ``fits`` are models fitted once, which slots name
    by ``{"fit": name}`` in their params, and expressions by ``coef``, ``response`` and ``sweep_axis``."""
    models = {n: REGRESSIONS.find(f["type"])(df, Slot.of(f)) for n, f in (fits or {}).items()}

    def bound(x):
        if isinstance(x, Mapping):
            own = {"models": {**models, **x.get("models", {})}} if models and "expression" in x else {}
            return {k: models[v] if k == "fit" and isinstance(v, str) else bound(v) for k, v in x.items()} | own
        return [bound(v) for v in x] if isinstance(x, list) else x

    return {n: process(df, bound(merged(base or {}, r)), tables).rows for n, r in requests.items()}


def compose_parallel(df: DataFrame, requests: Mapping[str, Mapping], deliver: Callable[[str, DataFrame], object], workers: int = 4, **options) -> dict[str, object]:
    """Runs the results' actions from a bounded pool of threads; Spark interleaves their jobs. The first error stops it."""
    with ThreadPoolExecutor(workers) as pool:
        found = {n: pool.submit(deliver, n, rows) for n, rows in compose(df, requests, **options).items()}
        try:
            return {n: f.result() for n, f in found.items()}
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise


def compose_stream(df: DataFrame, requests: Mapping[str, Mapping], workers: int = 4, **options) -> Iterator[tuple[str, list]]:
    """Names and rows of the results, each as soon as it is finished; results are for the driver, so keep them small."""
    with ThreadPoolExecutor(workers) as pool:
        found = {pool.submit(rows.collect): n for n, rows in compose(df, requests, **options).items()}
        for f in as_completed(found):
            yield found[f], f.result()


def for_each(request: Mapping, name: str, items: list) -> dict[str, dict]:
    """One request for each item; ``{"$param": name}`` stands for it."""
    return {str(i): {**request, "params": {**request.get("params", {}), name: i}} for i in items}


def sweep(axes: Mapping[str, list], mode: str = "grid", n: int = 0, seed: int = 0) -> list[dict]:
    """Points of a sweep: grid, zip, random or lhs (Latin hypercube; an axis is then a [low, high] pair)."""
    names = list(axes)
    rng = np.random.default_rng(seed)
    if mode == "grid":
        return [dict(zip(names, p)) for p in itertools.product(*axes.values())]
    if mode == "zip":
        if len({len(v) for v in axes.values()}) > 1:
            raise RequestError("sweep: zipped axes differ in length")
        return [dict(zip(names, p)) for p in zip(*axes.values())]
    if mode not in ("random", "lhs"):
        raise RequestError(f"sweep: no mode {mode!r}")
    unit = rng.random((n, len(names)))
    if mode == "lhs":
        unit = (np.array([rng.permutation(n) for _ in names]).T + unit) / n
    return [{k: lo + float(u) * (hi - lo) for (k, (lo, hi)), u in zip(axes.items(), row)} for row in unit]


def adaptive(objective: Callable[[dict], float], bounds: Mapping[str, tuple[float, float]], rounds: int = 30, size: int = 20, seed: int = 0) -> tuple[dict, float]:
    """Seeded differential evolution towards the smallest objective."""
    rng, names = np.random.default_rng(seed), list(bounds)
    low, high = (np.array([bounds[n][k] for n in names], float) for k in (0, 1))
    pop = low + rng.random((size, len(names))) * (high - low)
    cost = np.array([objective(dict(zip(names, p.tolist()))) for p in pop])
    for _ in range(rounds):
        for i in range(size):
            a, b, c = pop[rng.choice([j for j in range(size) if j != i], 3, replace=False)]
            cross = rng.random(len(names)) < 0.9
            cross[rng.integers(len(names))] = True
            trial = np.where(cross, np.clip(a + 0.7 * (b - c), low, high), pop[i])
            new = objective(dict(zip(names, trial.tolist())))
            if new <= cost[i]:
                pop[i], cost[i] = trial, new
    best = int(np.argmin(cost))
    return dict(zip(names, pop[best].tolist())), float(cost[best])


def rank(points: list[dict], objective: Callable[[dict], float], top: int | None = None, maximise: bool = False) -> list[dict]:
    """The points of a sweep by rising (or with ``maximise`` falling) objective, each with ``value`` and ``rank`` from 1;
    ties share a rank and keep the sweep's order. A point whose objective is no number comes last, without a rank."""
    scored = [(*((False, v if not maximise else -v) if (v := objective(p)) is not None and np.isfinite(v) else (True, 0.0)), k, v) for k, p in enumerate(points)]
    out: list[dict] = []
    for place, (lost, key, k, v) in enumerate(sorted(scored, key=lambda x: x[:3]), 1):
        tied = out and not lost and out[-1]["rank"] is not None and out[-1]["value"] == v
        out.append({**points[k], "value": None if lost else v, "rank": None if lost else out[-1]["rank"] if tied else place})
    return out[:top]


def bayesian(objective: Callable[[dict], float], bounds: Mapping[str, tuple[float, float]], start: int = 8, rounds: int = 24, seed: int = 0) -> tuple[dict, float]:
    """Towards the smallest objective with few evaluations: a Gaussian process (squared exponential; the length of best
    likelihood on a grid) over what was seen, and each next point where the expected improvement is largest."""
    rng, names = np.random.default_rng(seed), list(bounds)
    low, wide = np.array([bounds[n][0] for n in names], float), np.array([bounds[n][1] - bounds[n][0] for n in names], float)
    at = (np.array([rng.permutation(start) for _ in names]).T + rng.random((start, len(names)))) / start
    run = lambda u: float(objective(dict(zip(names, (low + u * wide).tolist()))))
    seen = [run(u) for u in at]

    def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * length * length))

    for _ in range(rounds):
        y = np.array(seen)
        spread = y.std() or 1.0
        z, best = (y - y.mean()) / spread, None
        for length in (0.05, 0.1, 0.2, 0.4, 0.8):
            factor = np.linalg.cholesky(kernel(at, at, length) + 1e-6 * np.eye(len(at)))
            half = np.linalg.solve(factor, z)
            fit = -half @ half / 2 - np.log(np.diag(factor)).sum()
            if best is None or fit > best[0]:
                best = (fit, length, factor, np.linalg.solve(factor.T, half))
        _, length, factor, weights = best
        near = np.clip(at[int(np.argmin(y))] + rng.normal(0, 0.05, (256, len(names))), 0, 1)
        tried = np.concatenate([rng.random((1024, len(names))), near])
        k = kernel(tried, at, length)
        mean, sd = k @ weights, np.sqrt(np.maximum(1e-12, 1 - (np.linalg.solve(factor, k.T) ** 2).sum(0)))
        gain = (z.min() - mean) / sd
        density = np.exp(-gain * gain / 2) / np.sqrt(2 * np.pi)
        below = np.array([1 - normal_tail(g) / 2 if g > 0 else normal_tail(g) / 2 for g in gain])
        u = tried[int(np.argmax(sd * (gain * below + density)))]
        at, seen = np.vstack([at, u]), [*seen, run(u)]
    best_at = int(np.argmin(seen))
    return dict(zip(names, (low + at[best_at] * wide).tolist())), seen[best_at]


POST_FITS: dict[str, Callable[[Mapping[str, Mapping], Mapping], Mapping]] = {}


def post_fit(models: Mapping[str, Mapping], steps: list[Mapping]) -> dict[str, Mapping]:
    """Registered computations over finished fits, in order: each step names its ``type``, the ``fits`` that it reads and
    its ``params``; later steps may read the results of earlier ones by label."""
    known, out = dict(models), {}
    for k, step in enumerate(steps):
        if step.get("type") not in POST_FITS:
            raise RequestError(f"no post-fit operator {step.get('type')!r}")
        if missing := [n for n in step.get("fits", []) if n not in known]:
            raise RequestError(f"post-fit: no fits {missing}")
        label = step.get("label", f"{step['type']}_{k}")
        out[label] = known[label] = POST_FITS[step["type"]]({n: known[n] for n in step.get("fits", [])}, step.get("params", {}))
    return out


def optimize(objective: Callable[[np.ndarray], float], start: list[float], bounds: list[tuple[float, float]], budget: float | None = None, steps: int = 2000) -> dict:
    """Maximises a smooth function over a box, and under a total of ``budget``, by projected gradient steps with halving."""
    low, high = (np.array([b[k] for b in bounds], float) for k in (0, 1))

    def project(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, low, high)
        if budget is None or abs(x.sum() - budget) < 1e-12:
            return x
        if not low.sum() - 1e-9 <= budget <= high.sum() + 1e-9:
            raise RequestError("optimize: no point of the box has this total")
        a, b = -1e12, 1e12
        for _ in range(200):
            mid = (a + b) / 2
            a, b = (mid, b) if np.clip(x + mid, low, high).sum() < budget else (a, mid)
        return np.clip(x + (a + b) / 2, low, high)

    x = project(np.array(start, float))
    value, size = objective(x), float((high - low).max()) / 4
    scale = np.maximum(high - low, 1e-12) * 1e-6
    for _ in range(steps):
        gradient = np.array([(objective(x + e) - objective(x - e)) / (2 * s) for e, s in ((np.eye(len(x))[i] * scale[i], scale[i]) for i in range(len(x)))])
        norm = np.linalg.norm(gradient)
        if norm < 1e-14 or size < 1e-12:
            break
        new = project(x + size * gradient / norm)
        got = objective(new)
        if got > value + 1e-15 * abs(value):
            x, value, size = new, got, size * 1.5
        else:
            size /= 2
    return {"x": x.tolist(), "value": float(value)}


def banner(df: DataFrame, rows: list[Mapping], groups: list[Mapping], cell: Mapping, total: bool = True, letters: float | None = None) -> DataFrame:
    """A survey table: each section of ``rows`` by a Total column and each of ``groups``; section, row, block, column and
    the cell. Sections and blocks are grouper slots of any type. Those by category share one scan: every row is dealt to
    its sections and blocks, then one aggregate; every other pair of a section and a block is an aggregate of its own.

    With ``letters``, a level such as 0.05, the columns of a block are lettered a, b, .. in order of value, and a column
    ``letters`` lists those that a cell exceeds significantly: shares of the column's rows for a count (pooled two-sided
    z-test), means for an average (unpooled z-test). Total takes no part."""
    measure = Slot.of(cell)
    sections, blocks = ([(s.label or s.field, s) for s in map(Slot.of, given)] for given in (rows, groups))
    slots = [measure]
    if letters is not None:
        if measure.type not in ("AGG_COUNT", "AGG_AVERAGE"):
            raise RequestError("banner: letters need a count or an average")
        slots += [Slot("AGG_COUNT", measure.field, "_n")]
        slots += [Slot("AGG_VARIANCE", measure.field, "_var", {"ddof": 1})] if measure.type == "AGG_AVERAGE" else []
    plain = lambda s: s.type == "GROUP_CATEGORY" and not s.params
    parts = [_dealt(df, [x for x in sections if plain(x[1])], [x for x in blocks if plain(x[1])], slots, total)]
    for section, s in sections:
        for block, b in [*([("Total", None)] if total else []), *blocks]:
            if plain(s) and (b is None or plain(b)):
                continue
            given = [dataclasses.replace(s, label="_row"), *([dataclasses.replace(b, label="_column")] if b else [])]
            keyed, names, _ = apply_groupers(df, given)
            made = aggregate(keyed, names, slots)
            parts.append(
                made.select(
                    F.lit(section).alias("section"), F.col("_row").cast("string").alias("row"), F.lit(block).alias("block"),
                    (F.col("_column").cast("string") if b else F.lit("Total")).alias("column"), *(F.col(f"`{x.name()}`") for x in slots),
                )
            )
    out = functools.reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    return out if letters is None else _lettered(out, measure, letters)


def _dealt(df: DataFrame, sections: list, blocks: list, slots: list[Slot], total: bool) -> DataFrame | None:
    """Sections by blocks of plain categories; a null key takes the row out of that section or block only."""
    if not sections or not (blocks or total):
        return None
    key = lambda s: F.col(f"`{s.field}`").cast("string")
    for _, s in [*sections, *blocks]:
        column(df, s)
    cells = F.array(*(F.struct(F.lit(name).alias("section"), key(s).alias("row")) for name, s in sections))
    columns = [F.struct(F.lit(name).alias("block"), key(s).alias("column")) for name, s in blocks]
    if total:
        columns = [F.struct(F.lit("Total").alias("block"), F.lit("Total").alias("column")), *columns]
    dealt = df.withColumn("_r", F.explode(cells)).withColumn("_c", F.explode(F.array(*columns)))
    dealt = dealt.where(F.col("_r.row").isNotNull() & F.col("_c.column").isNotNull())
    dealt = dealt.withColumns({"section": F.col("_r.section"), "row": F.col("_r.row"), "block": F.col("_c.block"), "column": F.col("_c.column")})
    return aggregate(dealt, ["section", "row", "block", "column"], slots)


def _lettered(table: DataFrame, measure: Slot, level: float) -> DataFrame:
    """Windows and joins run on the finished table, which has a row for each cell."""
    least = normal_quantile(1 - level / 2)
    name = measure.name()
    places = table.where("block <> 'Total'").select("section", "block", "column").distinct()
    order = Window.partitionBy("section", "block").orderBy("column")
    n = F.row_number().over(order) - 1
    places = places.withColumn("_letter", F.concat(F.when(n >= 26, F.char(F.floor(n / 26) + 96)).otherwise(""), F.char(n % 26 + 97)))
    base = F.sum("_n").over(Window.partitionBy("section", "block", "column"))
    cells = table.withColumn("_base", base).join(places, ["section", "block", "column"], "left")
    if measure.type == "AGG_COUNT":
        cells = cells.withColumns({"_m": F.try_divide(F.col("_n"), F.col("_base")), "_v": F.lit(0.0)})
    else:
        cells = cells.withColumns({"_m": F.col(f"`{name}`"), "_v": F.try_divide(F.col("_var"), F.col("_n"))})
    one, two = cells.alias("_a"), cells.select("section", "row", "block", *(F.col(c).alias(f"{c}2") for c in ("_letter", "_n", "_base", "_m", "_v"))).alias("_b")
    pairs = one.join(two, ["section", "row", "block"]).where(F.col("_letter") != F.col("_letter2"))
    pooled = (F.col("_n") + F.col("_n2")) / (F.col("_base") + F.col("_base2"))
    spread = pooled * (1 - pooled) * (1 / F.col("_base") + 1 / F.col("_base2")) if measure.type == "AGG_COUNT" else F.col("_v") + F.col("_v2")
    better = pairs.where(F.try_divide(F.col("_m") - F.col("_m2"), F.sqrt(spread)) > least)
    found = better.groupBy("section", "row", "block", "column").agg(F.array_join(F.array_sort(F.collect_set("_letter2")), " ").alias("letters"))
    return table.drop("_n", "_var").join(found, ["section", "row", "block", "column"], "left").withColumn("letters", F.coalesce("letters", F.lit("")))
