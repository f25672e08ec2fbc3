"""One request: features, filters, attributes, groups, aggregations, windows, sort; or a crosstab.

A request is a dict. ``validate`` and ``process`` share every check: validation builds the same lazy plan over the
table's schema and runs nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from tessella.errors import RequestError
from tessella.operators.aggregates import aggregate
from tessella.operators.attributes import apply_attributes
from tessella.operators.crosstab import crosstab
from tessella.operators.features import apply_features
from tessella.operators.filters import apply_filters
from tessella.operators.groupers import apply_groupers
from tessella.operators.joins import join
from tessella.operators.slots import Slot
from tessella.operators.windows import apply_windows, ordering

KEYS = {
    "join", "features", "filterers", "attributes", "groups", "aggregations", "windows", "sort", "crosstab", "weight",
    "weight_kind", "limit", "select", "exclude", "overlays", "labels", "precision", "params",
}


@dataclass
class Result:
    """The rows of a request and, where it has groups, the names of its keys."""

    rows: DataFrame
    keys: list[str]


def _slots(request: Mapping, key: str) -> list[Slot]:
    return [Slot.of(_filled(s, request) if isinstance(s, Mapping) else s) for s in request.get(key, [])]


def _filled(slot: Mapping, request: Mapping) -> Mapping:
    """Parameters: ``{"$param": name}`` takes a value of the request's ``params``; ``{{name}}`` in a text its text."""
    values = request.get("params", {})

    def named(m: re.Match) -> str:
        if m[1] not in values:
            raise RequestError(f"no parameter {m[1]!r}")
        return str(values[m[1]])

    def fill(x):
        if isinstance(x, str):
            return re.sub(r"\{\{\s*(\w+)\s*\}\}", named, x)
        if isinstance(x, Mapping):
            if set(x) == {"$param"}:
                if x["$param"] not in values:
                    raise RequestError(f"no parameter {x['$param']!r}")
                return values[x["$param"]]
            return {k: fill(v) for k, v in x.items()}
        return [fill(v) for v in x] if isinstance(x, list) else x

    return fill(slot)


def _defaults(df: DataFrame, slot: Mapping, what: str) -> Mapping:
    """A slot with a field and no type gets the default of its field's type."""
    if not isinstance(slot, Mapping) or "type" in slot or "field" not in slot:
        return slot
    if slot["field"] not in df.columns:
        raise RequestError(f"no field {slot['field']!r}")
    of = df.schema[slot["field"]].dataType
    is_date = isinstance(of, (DateType, TimestampType, TimestampNTZType))
    is_number = isinstance(of, NumericType) and not isinstance(of, BooleanType)
    if what == "groups":
        name = "GROUP_DATE" if is_date else "GROUP_RANGE" if is_number else "GROUP_CATEGORY"
    else:
        name = "AGG_SUM" if is_number else "AGG_MODE_COUNT"
    return {"type": name, **slot}


def process(df: DataFrame, request: Mapping, tables: Mapping[str, DataFrame] | None = None) -> Result:
    """The request's rows as a lazy DataFrame; ``tables`` names what a join may read."""
    if unknown := set(request) - KEYS:
        raise RequestError(f"unknown keys {sorted(unknown)}")
    if request.get("crosstab") and (request.get("groups") or request.get("aggregations")):
        raise RequestError("a crosstab excludes groups and aggregations")
    if spec := request.get("join"):
        if spec.get("table") not in (tables or {}):
            raise RequestError(f"no table {spec.get('table')!r}")
        df = join(df, tables[spec["table"]], spec)
    df = apply_features(df, _slots(request, "features"))
    panel = [s for s in _slots(request, "attributes") if s.type == "ATTR_PREVIOUS_STATE"]
    df = apply_attributes(df, panel)  # runs over the whole panel, before filters
    df = apply_filters(df, _slots(request, "filterers"))
    df = apply_attributes(df, [s for s in _slots(request, "attributes") if s.type != "ATTR_PREVIOUS_STATE"])
    if request.get("crosstab"):
        return Result(_finish(crosstab(df, request["crosstab"]), request), [])
    windows = _slots(request, "windows")
    groups = [Slot.of(_defaults(df, s, "groups")) for s in request.get("groups", [])]
    given = [_filled(_defaults(df, s, "aggregations"), request) for s in request.get("aggregations", [])]
    weight = {"weight": request["weight"], "weight_kind": request.get("weight_kind", "probability")} if request.get("weight") else {}
    slots = [Slot.of({**weight, **s} if isinstance(s, Mapping) else s) for s in given]
    first = [w for w in windows if w.name() in {s.field for s in slots} | {g.field for g in groups}]
    df = apply_windows(df, first)  # a window that a later slot reads runs on the records
    windows = [w for w in windows if w not in first]
    keys: list[str] = []
    if groups or slots:
        df, keys, orders = apply_groupers(df, groups)
        df = aggregate(df, [*keys, *orders], slots or [Slot("AGG_COUNT", None, "count")])
        df = apply_windows(df, windows)
        if not request.get("sort"):
            df = df.orderBy(*(F.col(f"`{o}`") for o in orders)) if orders else df
            return Result(_finish(df.drop(*orders), request, False), keys)
        df = df.drop(*orders)
    else:
        df = apply_windows(df, windows)
    return Result(_finish(df, request), keys)


def _finish(df: DataFrame, request: Mapping, sort: bool = True) -> DataFrame:
    """Sort (nulls last both ways), limit, output names, and rounding."""
    if sort and request.get("sort"):
        df = df.orderBy(*ordering([(s["field"], s.get("desc", False)) for s in request["sort"]]))
    if request.get("limit") is not None:
        df = df.limit(int(request["limit"]))
    for name, table in request.get("labels", {}).items():
        c = F.col(f"`{name}`")
        named = F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), c.cast("string"))
        df = df.withColumn(name, F.coalesce(named, c.cast("string")))
    if (digits := request.get("precision")) is not None:
        df = df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))
    if request.get("exclude"):
        df = df.drop(*request["exclude"])
    return df.select(*(f"`{c}`" for c in request["select"])) if request.get("select") else df


def validate(df: DataFrame, request: Mapping, tables: Mapping[str, DataFrame] | None = None) -> list[str]:
    """What is wrong with a request over a table's schema; nothing if it is fine. No job runs over the table: the plan
    is built on an empty table of the same schema."""
    empty = df.sparkSession.createDataFrame([], df.schema)
    others = {n: t.sparkSession.createDataFrame([], t.schema) for n, t in (tables or {}).items()}
    try:
        process(empty, request, others).rows.schema  # noqa: B018  analysis happens here
    except (RequestError, KeyError, TypeError) as e:
        return [str(e)]
    except Exception as e:  # an analysis error of Spark's
        return [str(e).splitlines()[0]]
    return []


def explain(request: Mapping) -> list[str]:
    """A request in plain sentences, one for each step in the order in which it runs."""
    out = []
    for key, verb in (("features", "derives"), ("filterers", "keeps rows by"), ("attributes", "adds"), ("groups", "groups by"), ("aggregations", "computes"), ("windows", "then adds")):
        for s in request.get(key, []):
            at = f" of {s['field']}" if s.get("field") else ""
            out.append(f"{verb} {s.get('type', 'the default')}{at}" + (f" as {s['label']}" if s.get("label") else ""))
    out += [f"sorts by {s['field']}" + " downwards" * bool(s.get("desc")) for s in request.get("sort", [])]
    return out


#: Operators that need their table twice, or an order over all of it; every other one runs in one pass.
TWO_PASS = {
    "ATTR_ZSCORE", "ATTR_TSCORE", "ATTR_NORMALIZED", "FEAT_FREQUENCY_ENCODE", "FEAT_TARGET_ENCODE", "FEAT_ONE_HOT", "AGG_MEDIAN",
    "AGG_PERCENTILE", "ATTR_MAHALANOBIS", "ATTR_PC_SCORE", "ATTR_FACTOR_SCORE", "ATTR_SEM_SCORE", "GROUP_KMEANS",
}
BUFFERED = {"ATTR_PERCENTILE", "GROUP_QUANTILE", "AGG_AUC", "AGG_QUANTILE_WEIGHTED", "ATTR_PREVIOUS_STATE", "FEAT_TRAIN_TEST_SPLIT"}
#: Bounds that a request is held against before it runs.
LIMITS = {"keys": 16, "measures": 500, "windows": 100, "members": 500}


def predict(df: DataFrame, request: Mapping, tables: Mapping[str, DataFrame] | None = None) -> dict:
    """What a request would do, from the schema alone: errors, columns with types, advisories, and whether it streams, takes
    two passes, or orders the whole table (buffered)."""
    errors = validate(df, request, tables)
    slots = [s for k in ("features", "filterers", "attributes", "groups", "aggregations", "windows") for s in request.get(k, [])]
    kinds = {s.get("type") for s in slots}
    advice = []
    for s in slots:
        if "expression" in s.get("params", {}):
            advice.append(f"{s['type']}: a null operand makes the value null")
        if s.get("field") in df.columns and df.schema[s["field"]].dataType.simpleString() == "double" and s.get("type", "").startswith("GROUP_CATEGORY"):
            advice.append(f"{s['type']}: {s['field']} is a double; every distinct value is a group")
    counts = {"keys": len(request.get("groups", [])), "measures": len(request.get("aggregations", [])), "windows": len(request.get("windows", []))}
    errors += [f"{n} {k}, at most {LIMITS[k]} are allowed" for k, n in counts.items() if n > LIMITS[k]]
    whole = bool(kinds & BUFFERED) or bool(request.get("sort")) or bool(request.get("windows") and not request.get("groups"))
    out = {"errors": errors, "advisories": advice, "passes": "buffered" if whole else "two-pass" if kinds & TWO_PASS or request.get("crosstab", {}).get("normalize", "none") != "none" else "streams"}
    if not errors:
        empty = df.sparkSession.createDataFrame([], df.schema)
        others = {n: t.sparkSession.createDataFrame([], t.schema) for n, t in (tables or {}).items()}
        out["columns"] = process(empty, request, others).rows.dtypes
    return out


def recommend(df: DataFrame, most_levels: int = 50, most: int = 5) -> list[dict]:
    """Draft requests for a table: counts and means of its numbers by each of its fields with few levels, by falling
    number of levels, and monthly totals by each date. Levels are estimated in one pass with sketches of bounded size."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]
    dates = [f.name for f in df.schema if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]
    flat = [f.name for f in df.schema if f.dataType.typeName() in ("string", "boolean", "integer", "byte", "short")]
    if not flat and not dates:
        return []
    levels = df.agg(*(F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in flat)).first().asDict() if flat else {}
    keys = sorted((c for c in flat if 1 < levels[c] <= most_levels), key=lambda c: (-levels[c], c))[:most]
    measures = [{"type": "AGG_COUNT", "label": "n"}, *({"type": "AGG_AVERAGE", "field": c, "label": f"mean_{c}"} for c in numbers if c not in keys)][: most + 1]
    out = [{"groups": [{"type": "GROUP_CATEGORY", "field": k}], "aggregations": measures} for k in keys]
    totals = [{"type": "AGG_COUNT", "label": "n"}, *({"type": "AGG_SUM", "field": c, "label": f"sum_{c}"} for c in numbers if c not in keys)][: most + 1]
    return out + [{"groups": [{"type": "GROUP_DATE", "field": d, "params": {"component": "month"}}], "aggregations": totals} for d in dates]


def resolve_label(labels: DataFrame, query: str, limit: int = 10, code: str = "code", label: str = "label") -> DataFrame:
    """The labels most like a text: code, label and score from 0 to 1. Same text (case, marks and spaces aside) scores 1, a
    beginning at least 0.9; else the better of the shared share of three-letter pieces and of the letters that no edit
    touches. Ties go by label, then code."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    wanted = " ".join(re.findall(r"[^\W_]+", query.lower()))
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda k: F.substring(F.concat(F.lit(" "), c, F.lit(" ")), k, F.lit(3))))
    text, query_text = plain(F.col(f"`{label}`")), F.lit(wanted)
    shared = F.size(F.array_intersect(pieces(text), pieces(query_text)))
    dice = F.try_divide(2.0 * shared, F.size(pieces(text)) + F.size(pieces(query_text)))
    edits = 1 - F.try_divide(F.levenshtein(text, query_text).cast("double"), F.greatest(F.char_length(text), F.char_length(query_text)))
    share = F.try_divide(F.lit(float(len(wanted))), F.char_length(text))
    score = F.when(text == query_text, 1.0).when(F.startswith(text, query_text), 0.9 + 0.1 * share).otherwise(F.greatest(dice, edits) * 0.9)
    rows = labels.select(F.col(f"`{code}`").alias("code"), F.col(f"`{label}`").alias("label"), F.round(score, 6).alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "label", "code").limit(limit)


def request_hash(request: Mapping) -> str:
    """A digest that doesn't hang on the order of keys."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()
