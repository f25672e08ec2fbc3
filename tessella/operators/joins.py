"""Joins of a request's table with another, unions with a source label, and point lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, NumericType, StringType

from tessella.errors import RequestError

#: inner is the request language's own; the others are extensions that Spark gives for free.
KINDS = ("inner", "left", "full", "left_semi", "left_anti")


def _family(of: DataType) -> str:
    if isinstance(of, ArrayType):
        return "set"
    if isinstance(of, DecimalType):
        return "u64" if of.scale == 0 and of.precision == 20 else "decimal"
    if isinstance(of, (NumericType, BooleanType)):
        return "number"
    return "text" if isinstance(of, StringType) else of.typeName()


def check_keys(left: DataType, right: DataType, name: str) -> None:
    """Text with text, numbers with numbers; sets with nothing, a decimal with decimals, a u64 not with floats."""
    a, b = _family(left), _family(right)
    floats = any(isinstance(t, (DoubleType, FloatType)) for t in (left, right))
    if "set" in (a, b) or a != b and {a, b} != {"number", "u64"} or "u64" in (a, b) and floats:
        raise RequestError(f"join key {name!r}: {left.simpleString()} doesn't match {right.simpleString()}")


def join(left: DataFrame, right: DataFrame, spec: dict) -> DataFrame:
    """``on``: pairs of (left key, right key), all of which must agree; null never matches. ``as`` prefixes the right
    columns; a name that both sides have is refused otherwise. Right keys are dropped.

    No side is broadcast by hand: Spark takes the smaller one if its size, which it knows, is below its threshold."""
    how = spec.get("kind", "inner")
    if how not in KINDS:
        raise RequestError(f"no join kind {how!r}")
    on = [(p, p) if isinstance(p, str) else tuple(p) for p in spec["on"]]
    if not on:
        raise RequestError("a join needs keys")
    for a, b in on:
        if a not in left.columns or b not in right.columns:
            raise RequestError(f"join key {a!r} = {b!r}: no such field")
        check_keys(left.schema[a].dataType, right.schema[b].dataType, a)
    prefix, keys = spec.get("as"), [b for _, b in on]
    names = {c: f"{prefix}_{c}" if prefix else c for c in right.columns if c not in keys}
    if how not in ("left_semi", "left_anti") and (clash := set(names.values()) & set(left.columns)):
        raise RequestError(f"join: both sides have {sorted(clash)}; 'as' prefixes the right ones")
    side = right.select(*(F.col(f"`{b}`").alias(f"_right_{k}") for k, b in enumerate(keys)), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    match = reduce(lambda x, y: x & y, (F.col(f"`{a}`") == F.col(f"_right_{k}") for k, (a, _) in enumerate(on)))
    joined = left.join(side, match, how)
    if how == "full":
        for k, (a, _) in enumerate(on):
            joined = joined.withColumn(a, F.coalesce(F.col(f"`{a}`"), F.col(f"_right_{k}")))
    return joined.drop(*(f"_right_{k}" for k in range(len(on))))


def union(parts: dict[str, DataFrame], label: str = "_source") -> DataFrame:
    """All rows of labelled tables of one schema, with the label of each; other column orders are fine."""
    first = next(iter(parts.values()))
    kinds = dict(first.dtypes)
    for name, df in parts.items():
        if dict(df.dtypes) != kinds:
            raise RequestError(f"union: the columns of {name!r} differ: {sorted(set(df.dtypes) ^ set(first.dtypes))}")
    return reduce(DataFrame.unionByName, (df.withColumn(label, F.lit(n)) for n, df in parts.items()))


def lookup(df: DataFrame, key: dict, mode: str = "assert_unique", order: str | None = None) -> DataFrame:
    """Rows whose key fields have these values: all, the first by ``order``, or one that must be the only one."""
    found = df
    for name, value in key.items():
        found = found.where(F.col(f"`{name}`") == F.lit(value))
    if mode == "all":
        return found
    if mode == "first":
        return (found.orderBy(order) if order else found).limit(1)
    two = found.limit(2)
    if two.count() > 1:
        raise RequestError(f"lookup {key}: more than one row")
    return two
