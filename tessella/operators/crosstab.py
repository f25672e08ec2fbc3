"""Crosstabs and facets. Cells are aggregated once; margins of measures that merge come from the cells' states, those of
other measures from the rows, by grouping sets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions.quantiles import exact_quantiles, same
from tessella.operators.aggregates import AGGREGATES, STAGES, aggregate, states
from tessella.operators.groupers import apply_groupers
from tessella.operators.slots import Slot, kind, number

MARGINS = {"row": "row", "column": "column", "grand": "grand"}


def by_sets(keyed: DataFrame, names: list[str], orders: list[str], sets: list[list[str]], slots: list[Slot]) -> DataFrame:
    """One row for each combination of each set of keys: ``_level`` (the grouping id over ``names``), names (null where a
    set lacks them), the least of each of ``orders``, and a column for each slot.

    Measures that merge are aggregated by all names first, so that what grouping sets multiply is the cells and not the
    rows. The others multiply the rows before partial aggregation, and staged ones take an aggregate for each set."""
    place = {n: F.col(f"`{n}`") for n in names}
    given = [[place[n] for n in one] for one in sets]
    level = F.grouping_id(*place.values()).alias("_level")
    merging = {s.name(): states(keyed, s) for s in slots}
    merging = {n: m for n, m in merging.items() if m}
    columns = {f"_s{k}_{c}": (made, merge) for k, (parts, _) in enumerate(merging.values()) for c, (made, merge) in parts.items()}
    cells = keyed.groupBy(*place.values()).agg(
        F.count(F.lit(1)).alias("_rows"), *(c.alias(n) for n, (c, _) in columns.items()), *(F.min(f"`{o}`").alias(o) for o in orders)
    )
    merged = [
        finish({c: columns[f"_s{k}_{c}"][1](f"_s{k}_{c}") for c in parts}).alias(name) for k, (name, (parts, finish)) in enumerate(merging.items())
    ]
    out = cells.groupingSets(given, *place.values()).agg(level, *merged, *(F.min(f"`{o}`").alias(o) for o in orders))

    def add(out: DataFrame, part: DataFrame, columns: list[str]) -> DataFrame:
        match = same("_a", "_b", ["_level", *names])
        return out.alias("_a").join(part.alias("_b"), match, "left").select("_a.*", *(F.col(f"_b.`{c}`") for c in columns))

    plain = [s for s in slots if s.name() not in merging and s.type in AGGREGATES]
    if plain:
        measures = [AGGREGATES.find(s.type)(keyed, s).alias(s.name()) for s in plain]
        out = add(out, keyed.groupingSets(given, *place.values()).agg(level, *measures), [s.name() for s in plain])
    staged = [s for s in slots if s.name() not in merging and s.type not in AGGREGATES]
    for s in staged:
        STAGES.find(s.type)
    if staged:
        parts = [aggregate(keyed, one, staged).withColumns({"_level": F.lit(code(names, one)).cast("bigint")} | {n: F.lit(None).cast("string") for n in names if n not in one}) for one in sets]
        out = add(out, functools.reduce(DataFrame.unionByName, parts), [s.name() for s in staged])
    return out


def code(names: list[str], inside: list[str]) -> int:
    """The grouping id of a set of keys."""
    return sum(1 << (len(names) - 1 - k) for k, n in enumerate(names) if n not in inside)


def _depth(spec: dict, key: str, axis: list[str], normalize: str) -> int | None:
    """How many keys of an axis a depth parameter takes."""
    if spec.get(key) is None:
        return None
    if normalize not in ("row", "column"):
        raise RequestError(f"crosstab: {key} needs normalize row or column")
    if not 0 <= int(spec[key]) < len(axis):
        raise RequestError(f"crosstab: {key} must be from 0 to {len(axis) - 1}")
    return int(spec[key]) + 1


def crosstab(df: DataFrame, spec: dict) -> DataFrame:
    """Long form: the axis keys, ``_margin`` (cell, row, column, grand) and a column for each cell measure.

    ``rows`` and ``columns`` are lists of grouper slots (no columns: one key "Total"); ``cells`` aggregation slots;
    ``margins`` those wanted; ``margin_aggregations`` slots that stand on margins only. ``normalize`` none, row, column or
    total divides each cell by its margin (a zero margin leaves no cell): that of the whole row or column key, of its first
    keys up to ``normalize_level``, and within the other axis' first keys up to ``normalize_within`` (both from 0).
    """
    cells = [Slot.of(c) for c in (spec.get("cells") or [spec["cell"]])]
    extra = [Slot.of(c) for c in spec.get("margin_aggregations", [])]
    labels = [s.name() for s in cells + extra]
    if len(set(labels)) < len(labels):
        raise RequestError(f"crosstab: measures share a label: {labels}")
    rows, columns = [Slot.of(s) for s in spec["rows"]], [Slot.of(s) for s in spec.get("columns", [])]
    keyed, names, orders = apply_groupers(df, rows + columns)
    r, c = names[: len(rows)], names[len(rows) :]
    if not c:
        keyed, c, names = keyed.withColumn("_column", F.lit("Total")), ["_column"], [*names, "_column"]
    wanted = set(spec.get("margins", []))
    normalize = spec.get("normalize", "none")
    if unknown := wanted - set(MARGINS):
        raise RequestError(f"crosstab: no margins {sorted(unknown)}")
    own, other = (r, c) if normalize == "row" else (c, r)
    base = [*own[: _depth(spec, "normalize_level", own, normalize)], *other[: _depth(spec, "normalize_within", other, normalize) or 0]]
    base = [] if normalize == "total" else base
    sets = [names, *([r] if "row" in wanted else []), *([c] if "column" in wanted else []), *([[]] if "grand" in wanted else [])]
    if normalize != "none" and not any(set(base) == set(one) for one in sets):
        sets.append(base)
    table = by_sets(keyed, names, orders, sets, cells + extra)
    place = {n: F.col(f"`{n}`") for n in names}
    at = lambda keys: F.col("_level") == code(names, keys)
    kinds = {"cell": names, "row": r, "column": c, "grand": []}
    margin = functools.reduce(lambda w, k: w.when(at(kinds[k]), k), [k for k in kinds if k != "cell"], F.when(at(names), "cell"))
    table = table.withColumn("_margin", margin)
    value = {s.name(): F.col(f"`{s.name()}`") for s in cells}
    if normalize != "none":
        part = Window.partitionBy(*(place[n] for n in names if n in base))
        of = {n: F.max(F.when(at(base), v.cast("double"))).over(part) for n, v in value.items()}
        value = {n: F.when(F.col("_margin") == "cell", F.try_divide(v.cast("double"), of[n])).otherwise(v.cast("double")) for n, v in value.items()}
    table = table.select(
        *place.values(), "_margin", *(v.alias(n) for n, v in value.items()),
        *(F.when(F.col("_margin") != "cell", F.col(f"`{s.name()}`")).alias(s.name()) for s in extra), *(F.col(f"`{o}`") for o in orders),
    )
    if normalize != "none":
        table = table.where((F.col("_margin") != "cell") | F.coalesce(*(F.col(f"`{s.name()}`") for s in cells)).isNotNull())
    shown = table.where(F.col("_margin").isin("cell", *wanted))
    return shown.orderBy(*(F.col(f"`{o}`").asc_nulls_last() for o in orders)).drop(*orders)


def pivoted(table: DataFrame, rows: list[str], column: str, cell: str, levels: list[str]) -> DataFrame:
    """The cells of a long crosstab as a matrix, with a column for each of ``levels``."""
    return table.where("_margin = 'cell'").groupBy(*rows).pivot(column, levels).agg(F.first(cell))


def facet_values(df: DataFrame, field: str, top: int | None = None) -> DataFrame:
    """Distinct values of a field with their counts, by falling count, then value; ``top`` keeps so many."""
    kind(df, field)
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), "value")
    return ordered if top is None else ordered.limit(top)


def facet_numbers(df: DataFrame, fields: list[str], percentiles: list[float] = ()) -> DataFrame:
    """One row for each numeric field: n, n_null, min, max, mean, sd (population) and percentiles."""
    parts, found = [], None
    for k, f in enumerate(fields if percentiles else ()):
        names = {f"p{p:g}": p / 100 for p in percentiles}
        part = exact_quantiles(df, [], number(df, Slot("facet", f)), names).select(F.lit(f).alias("_f"), *names)
        found = part if found is None else found.unionByName(part)
    for f in fields:
        x = number(df, Slot("facet", f))
        parts.append(
            F.struct(
                F.lit(f).alias("field"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_null"), F.min(x).alias("min"), F.max(x).alias("max"),
                F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"),
            )
        )
    out = df.agg(F.array(*parts).alias("f")).select(F.inline("f"))
    return out if found is None else out.join(F.broadcast(found), F.col("field") == F.col("_f"), "left").drop("_f")


def facet_histogram(df: DataFrame, field: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin of [low, high]; the last bin holds its upper end, what lies outside is dropped; empty bins count 0."""
    if not 1 <= bins <= 256 or high <= low:
        raise RequestError("facet: 1 to 256 bins over a range that isn't empty are needed")
    x, width = number(df, Slot("facet", field)), (high - low) / bins
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("from"), (low + (F.col("bin") + 1) * width).alias("to"), F.coalesce("n", F.lit(0)).alias("count")
    )


def facet_additive(df: DataFrame, filters: list[Slot], field: str) -> DataFrame:
    """Counts of each value of ``field`` under all filters but those on ``field`` itself."""
    from tessella.operators.filters import apply_filters

    return facet_values(apply_filters(df, [f for f in filters if f.field != field]), field)
