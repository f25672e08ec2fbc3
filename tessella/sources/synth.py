"""Generated tables: columns of named distributions over ``spark.range``.

Every value comes from hashes of the row number, the seed and the column's name, so a table is the same however it is
partitioned and however many rows come after.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.operators.slots import Registry

DISTRIBUTIONS = Registry("distribution")


class Draw:
    """Uniform and normal draws of one column."""

    def __init__(self, seed: int, name: str) -> None:
        self.seed, self.name, self.row = seed, name, F.col("_row")

    def uniform(self, k: object = 0) -> Column:
        """In (0, 1), with 52 bits."""
        h = F.xxhash64(self.row, F.lit(self.seed), F.lit(self.name), F.lit(str(k)))
        return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def normal(self, k: object = 0) -> Column:
        return F.sqrt(-2 * F.log(self.uniform(f"{k}a"))) * F.cos(2 * math.pi * self.uniform(f"{k}b"))


def _pick(u: Column, values: list, weights: list[float] | None) -> Column:
    weights = [1.0] * len(values) if weights is None else [float(w) for w in weights]
    if len(weights) != len(values) or min(weights, default=0) < 0 or sum(weights) <= 0:
        raise RequestError("as many weights as values are needed, none below 0 and some above")
    bounds = [sum(weights[: k + 1]) / sum(weights) for k in range(len(values))]
    out = F.lit(values[-1])
    for v, upto in reversed([*zip(values, bounds)][:-1]):
        out = F.when(u < upto, F.lit(v)).otherwise(out)
    return out


@DISTRIBUTIONS.add("constant")
def constant(d: Draw, p: Mapping) -> Column:
    return F.lit(p["value"])


@DISTRIBUTIONS.add("bernoulli")
def bernoulli(d: Draw, p: Mapping) -> Column:
    return (d.uniform() < float(p["p"])).cast("int")


@DISTRIBUTIONS.add("discrete", "weighted_categorical")
def discrete(d: Draw, p: Mapping) -> Column:
    return _pick(d.uniform(), list(p["values"]), p.get("weights"))


@DISTRIBUTIONS.add("uniform")
def uniform(d: Draw, p: Mapping) -> Column:
    low, high = float(p.get("min", 0)), float(p.get("max", 1))
    return low + d.uniform() * (high - low)


@DISTRIBUTIONS.add("normal")
def normal(d: Draw, p: Mapping) -> Column:
    x = float(p.get("mean", 0)) + d.normal() * float(p.get("std", 1))
    x = F.greatest(x, F.lit(float(p["min"]))) if "min" in p else x
    return F.least(x, F.lit(float(p["max"]))) if "max" in p else x


@DISTRIBUTIONS.add("lognormal")
def lognormal(d: Draw, p: Mapping) -> Column:
    return F.exp(float(p.get("mu", 0)) + d.normal() * float(p.get("sigma", 1)))


@DISTRIBUTIONS.add("exponential")
def exponential(d: Draw, p: Mapping) -> Column:
    return -F.log(d.uniform()) / float(p["lambda"])


@DISTRIBUTIONS.add("pareto")
def pareto(d: Draw, p: Mapping) -> Column:
    return float(p.get("xm", 1)) / F.pow(d.uniform(), F.lit(1 / float(p["alpha"])))


@DISTRIBUTIONS.add("mixture")
def mixture(d: Draw, p: Mapping) -> Column:
    at = _pick(d.uniform("part"), list(range(len(p["means"]))), p.get("weights"))
    part = lambda k: F.get(F.array(*(F.lit(float(v)) for v in p[k])), at)
    return part("means") + d.normal() * part("stds")


@DISTRIBUTIONS.add("poisson")
def poisson(d: Draw, p: Mapping) -> Column:
    """By the inverse distribution function: the number of its steps that lie below the draw."""
    mean = float(p["lambda"])
    if mean >= 200:
        return F.greatest(F.round(mean + math.sqrt(mean) * d.normal()), F.lit(0.0)).cast("bigint")
    term = total = math.exp(-mean)
    steps, k = [total], 0
    while total < 1 - 1e-15 and k < 1000:
        k += 1
        term *= mean / k
        if term == 0:
            break
        total += term
        steps.append(total)
    u = d.uniform()
    return F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s < u)).cast("bigint")


@DISTRIBUTIONS.add("monotonic_from")
def monotonic(d: Draw, p: Mapping) -> Column:
    return F.lit(int(p.get("start", 0))) + d.row * int(p.get("step", 1))


@DISTRIBUTIONS.add("set_bernoulli")
def set_bernoulli(d: Draw, p: Mapping) -> Column:
    options = sorted(zip(p["options"], p["frequencies"]))
    parts = [F.when(d.uniform(o) < float(f), F.lit(o)) for o, f in options]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _month_weighted(d: Draw, first: dt.date, days: int, weights: list[float] | None) -> Column:
    if not weights:
        return F.date_add(F.lit(first), F.floor(d.uniform() * days).cast("int"))
    months: dict[tuple[int, int], list[int]] = {}
    for k in range(days):
        day = first + dt.timedelta(k)
        months.setdefault((day.year, day.month), []).append(k)
    at = _pick(d.uniform("month"), list(range(len(months))), [weights[m - 1] * len(v) for (_, m), v in months.items()])
    starts, sizes = (F.array(*map(F.lit, x)) for x in ([v[0] for v in months.values()], [len(v) for v in months.values()]))
    return F.date_add(F.lit(first), (F.get(starts, at) + F.floor(d.uniform("day") * F.get(sizes, at))).cast("int"))


@DISTRIBUTIONS.add("uniform_date")
def uniform_date(d: Draw, p: Mapping) -> Column:
    first, last = dt.date.fromisoformat(str(p["start"])), dt.date.fromisoformat(str(p["end"]))
    return _month_weighted(d, first, (last - first).days + 1, p.get("month_weights"))


@DISTRIBUTIONS.add("uniform_datetime")
def uniform_datetime(d: Draw, p: Mapping) -> Column:
    """A wall-clock time by hour weights, on a day by weekday and month weights, as the UTC instant it names in the zone.
    Weekdays go by rejection of a draw in favour of one of 16 more."""
    first, last = dt.date.fromisoformat(str(p["start"])[:10]), dt.date.fromisoformat(str(p["end"])[:10])
    day = _month_weighted(d, first, (last - first).days + 1, p.get("month_weights"))
    if weekly := p.get("weekday_weights"):
        top = max(weekly)
        chance = F.array(*(F.lit(float(w) / top) for w in weekly))
        tries = [_month_weighted(Draw(d.seed, f"{d.name}/{k}"), first, (last - first).days + 1, p.get("month_weights")) for k in range(16)]
        day = F.coalesce(*(F.when(d.uniform(f"keep{k}") < F.get(chance, F.weekday(t)), t) for k, t in enumerate(tries)), day)
    hour = _pick(d.uniform("hour"), list(range(24)), p.get("hour_weights"))
    second = F.floor(d.uniform("second") * 3600).cast("int")
    local = F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400 + hour * 3600 + second)
    return F.to_utc_timestamp(local, p.get("time_zone", "UTC"))


@DISTRIBUTIONS.add("regex")
def regex(d: Draw, p: Mapping) -> Column:
    """Text that a pattern of literals, classes, groups, alternatives and repetitions matches."""
    import re._parser as parser

    most = int(p.get("max_repeat", 8))
    count = iter(range(10_000))

    def pick(chars: list[str]) -> Column:
        text = "".join(chars)
        return F.substr(F.lit(text), F.floor(d.uniform(next(count)) * len(text)).cast("int") + 1, F.lit(1))

    def chars_of(items: list) -> list[str]:
        out, negate = [], False
        for op, value in items:
            name = str(op)
            if name == "NEGATE":
                negate = True
            elif name == "LITERAL":
                out.append(chr(value))
            elif name == "RANGE":
                out += map(chr, range(value[0], value[1] + 1))
            elif name == "CATEGORY":
                out += {"CATEGORY_DIGIT": "0123456789", "CATEGORY_WORD": "abcdefghijklmnopqrstuvwxyz0123456789_", "CATEGORY_SPACE": " "}[str(value)]
        return [chr(c) for c in range(32, 127) if chr(c) not in out] if negate else out

    def walk(items) -> Column:
        parts = []
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                parts.append(F.lit(chr(value)))
            elif name == "ANY":
                parts.append(pick([chr(c) for c in range(33, 127)]))
            elif name == "IN":
                parts.append(pick(chars_of(value)))
            elif name == "SUBPATTERN":
                parts.append(walk(value[-1]))
            elif name == "BRANCH":
                parts.append(_choice([walk(b) for b in value[1]]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high = value[0], min(int(value[1]), max(value[0], most))
                n = low + F.floor(d.uniform(next(count)) * (high - low + 1)).cast("int")
                parts += [F.when(n > k, walk(value[2])).otherwise("") for k in range(high)]
            elif name == "AT":
                continue
            else:
                raise RequestError(f"regex: {name} isn't generated")
        return F.concat(*parts) if parts else F.lit("")

    def _choice(options: list[Column]) -> Column:
        at, out = F.floor(d.uniform(next(count)) * len(options)), options[-1]
        for k, o in reversed([*enumerate(options[:-1])]):
            out = F.when(at == k, o).otherwise(out)
        return out

    return walk(parser.parse(p["pattern"]))


def generate(spark: SparkSession, n: int, columns: list[Mapping], seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``columns``: name, distribution, params, and null_rate, type and when ({value of an earlier column: params})."""
    df = spark.range(0, n, 1, partitions).withColumnRenamed("id", "_row") if partitions else spark.range(n).withColumnRenamed("id", "_row")
    for c in columns:
        draw, make = Draw(seed, c["name"]), DISTRIBUTIONS.find(c["distribution"])
        value = make(draw, c.get("params", {}))
        for field, cases in c.get("when", {}).items():
            for level, params in cases.items():
                value = F.when(F.col(f"`{field}`").cast("string") == str(level), make(draw, params)).otherwise(value)
        if c.get("type"):
            value = value.cast(c["type"])
        if rate := float(c.get("null_rate", 0)):
            value = F.when(draw.uniform("null") >= rate, value)
        df = df.withColumn(c["name"], value)
    return df.drop("_row")


def profile(df: DataFrame, fields: list[str], max_levels: int = 1000) -> list[dict]:
    """Column specs that ``generate`` makes a like table from: numbers as normals within their range, others as levels."""
    out = []
    kinds = dict(df.dtypes)
    for f in fields:
        c = F.col(f"`{f}`")
        if kinds[f] in ("string", "boolean"):
            rows = df.where(c.isNotNull()).groupBy(c.cast("string")).count().orderBy(F.desc("count")).limit(max_levels).collect()
            n, total = df.agg(F.count(c), F.count(F.lit(1))).first()
            out.append({"name": f, "distribution": "weighted_categorical", "params": {"values": [r[0] for r in rows], "weights": [r[1] for r in rows]}, "null_rate": 1 - n / total if total else 0})
        else:
            m, s, a, b, n, total = df.agg(F.avg(c), F.stddev_pop(c), F.min(c), F.max(c), F.count(c), F.count(F.lit(1))).first()
            out.append({"name": f, "distribution": "normal", "params": {"mean": float(m), "std": float(s), "min": float(a), "max": float(b)}, "null_rate": 1 - n / total if total else 0})
    return out
