"""Operators of one's own: functions that join the registries under a name of the caller's choice."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions.expressions import FUNCTIONS
from tessella.operators.aggregates import AGGREGATES
from tessella.operators.attributes import ROWS
from tessella.operators.features import FEATURES
from tessella.operators.filters import FILTERS
from tessella.operators.groupers import GROUPERS, _with
from tessella.operators.matrices import MATRICES
from tessella.operators.overlays import OVERLAYS
from tessella.operators.slots import Registry, Slot, column, number
from tessella.operators.tests import TESTS
from tessella.operators.windows import RECURSIONS
from tessella.plans.batch import POST_FITS


def _new(registry: Registry, name: str) -> None:
    if name in registry:
        raise RequestError(f"{registry.category} {name!r} is there already")


def add_aggregator(name: str, f: Callable[[pd.Series], float]) -> None:
    """A number from a group's values, as a grouped-aggregate vectorised function; groups must fit a task's memory. For
    larger ones add a column factory to the registry instead, whose partial sums merge."""
    _new(AGGREGATES, name)
    run = F.pandas_udf(f, "double", F.PandasUDFType.GROUPED_AGG)
    AGGREGATES[name] = lambda df, slot: run(number(df, slot))


def add_attribute(name: str, f: Callable[[pd.Series], pd.Series], returns: str = "double") -> None:
    _new(ROWS, name)
    run = F.pandas_udf(f, returns)
    ROWS[name] = lambda df, slot: run(column(df, slot))


def add_feature(name: str, make: Callable[[DataFrame, Slot], DataFrame]) -> None:
    """Columns of the raw table, before any filter: ``make`` returns the table with them."""
    _new(FEATURES, name)
    FEATURES[name] = make


def add_matrix(name: str, f: Callable[[DataFrame, Slot], dict]) -> None:
    """A figure from sums over the rows of several members."""
    _new(MATRICES, name)
    MATRICES[name] = f


def add_post_fit(name: str, f: Callable[[Mapping[str, Mapping], Mapping], Mapping]) -> None:
    """A computation over finished fits, by name, and its parameters; see ``plans.batch.post_fit``."""
    if name in POST_FITS:
        raise RequestError(f"post-fit operator {name!r} is there already")
    POST_FITS[name] = f


def add_filter(name: str, make: Callable[[DataFrame, Slot], Column]) -> None:
    _new(FILTERS, name)
    FILTERS[name] = make


def add_grouper(name: str, key: Callable[[DataFrame, Slot], Column], many: bool = False) -> None:
    """``key`` gives a row's key, or with ``many`` an array of keys, each of which the row counts under."""
    _new(GROUPERS, name)

    def make(df: DataFrame, slot: Slot):
        if many:
            df = df.withColumn("_each", F.explode(key(df, slot)))
            return _with(df, slot, F.col("_each"), F.col("_each"))
        return _with(df, slot, key(df, slot), key(df, slot))

    GROUPERS[name] = make


def add_window(name: str, f: Callable[[pd.DataFrame], pd.Series]) -> None:
    """A column from a whole partition in order; partitions must fit a task's memory."""
    _new(RECURSIONS, name)

    def make(df: DataFrame, slot: Slot) -> DataFrame:
        keys, order = list(slot.get("partition_by", [])), list(slot.need("order_by"))
        label = slot.name()

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(order)
            return part.assign(**{label: f(part)})

        fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.groupBy(*keys).applyInPandas(run, f"{fields}, `{label}` double")

    RECURSIONS[name] = make


def add_test(name: str, f: Callable[[DataFrame, Slot], dict]) -> None:
    _new(TESTS, name)
    TESTS[name] = f


def add_overlay(name: str, f: Callable[[DataFrame, Slot, DataFrame | None], DataFrame]) -> None:
    _new(OVERLAYS, name)
    OVERLAYS[name] = f


def add_function(name: str, f: Callable[..., Column]) -> None:
    if name in FUNCTIONS:
        raise RequestError(f"function {name!r} is there already")
    FUNCTIONS[name] = f
