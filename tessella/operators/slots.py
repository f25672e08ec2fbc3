"""Slots of a request and the context in which their operators are built."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, NumericType, StringType, TimestampNTZType, TimestampType

from tessella.errors import RequestError
from tessella.functions.expressions import Scope, compile_expression


@dataclass(frozen=True)
class Slot:
    """One operator of a request."""

    type: str
    field: str | None = None
    label: str | None = None
    params: Mapping = dataclasses.field(default_factory=dict)
    weight: str | None = None
    weight_kind: str = "probability"

    @classmethod
    def of(cls, given: Mapping | Slot) -> Slot:
        if isinstance(given, Slot):
            return given
        extra = set(given) - {"type", "field", "label", "params", "weight", "weight_kind"}
        if extra or "type" not in given:
            raise RequestError(f"slot {given!r}: unknown keys {sorted(extra)}" if extra else f"slot {given!r} has no type")
        return cls(**given)

    def name(self) -> str:
        return self.label or "_".join(x for x in (self.type, self.field) if x)

    def need(self, key: str):
        if key not in self.params:
            raise RequestError(f"{self.type}: parameter {key!r} is missing")
        return self.params[key]

    def get(self, key: str, default=None):
        return self.params.get(key, default)


class Registry(dict):
    """Operator name to factory."""

    def __init__(self, category: str) -> None:
        super().__init__()
        self.category = category

    def add(self, *names: str) -> Callable:
        def keep(f: Callable) -> Callable:
            for n in names:
                self[n] = f
            return f

        return keep

    def find(self, name: str) -> Callable:
        if name not in self:
            raise RequestError(f"no {self.category} operator {name!r}")
        return self[name]


def kind(df: DataFrame, name: str) -> DataType:
    if name not in df.columns:
        raise RequestError(f"no field {name!r}")
    return df.schema[name].dataType


def column(df: DataFrame, slot: Slot, accepts: str = "any") -> Column:
    """The slot's field, once its type is found acceptable."""
    if slot.field is None:
        raise RequestError(f"{slot.type} needs a field")
    check(kind(df, slot.field), accepts, slot)
    return F.col(f"`{slot.field}`")


def check(of: DataType, accepts: str, slot: Slot) -> None:
    good = {
        "any": True,
        "number": isinstance(of, (NumericType, BooleanType)),
        "set": isinstance(of, ArrayType) and isinstance(of.elementType, StringType),
        "vector": isinstance(of, ArrayType) and isinstance(of.elementType, NumericType),
        "date": isinstance(of, (DateType, TimestampType, TimestampNTZType)),
        "ordered": isinstance(of, (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType, StringType)),
    }[accepts]
    if not good:
        raise RequestError(f"{slot.type}: field {slot.field!r} is {of.simpleString()}, a {accepts} is needed")


def number(df: DataFrame, slot: Slot) -> Column:
    """The slot's field as a double; NaN counts as a value."""
    return column(df, slot, "number").cast("double")


def is_decimal(df: DataFrame, slot: Slot) -> bool:
    return slot.field is not None and isinstance(kind(df, slot.field), DecimalType)


def local_time(df: DataFrame, name: str, zone: str | None) -> Column:
    """A date or time as wall-clock time in a zone; a time without zone is read as UTC."""
    col = F.col(f"`{name}`")
    if isinstance(kind(df, name), DateType) or not zone or zone == "UTC":
        return col
    return F.from_utc_timestamp(col.cast("timestamp"), zone)


def valid_weight(df: DataFrame, name: str) -> Column:
    """The weight of a row, null where it is none: null, NaN, infinite, zero or below."""
    w = F.col(f"`{name}`").cast("double")
    return F.when((w > 0) & ~F.isnan(w) & (w < float("inf")), w)


def expression(df: DataFrame, text: str, constants: Mapping | None = None, lookups: Mapping | None = None, totals=None, models: Mapping | None = None) -> Column:
    columns = {c: F.col(f"`{c}`") for c in df.columns}
    return compile_expression(text, Scope(columns, constants or {}, lookups or {}, totals, models=models or {}))


def clean(c: Column) -> Column:
    """An undefined figure is null in every output."""
    return F.when(~F.isnan(c), c)
