"""Registered queries: one for each operator at least, with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tessella.operators import crosstab as tabs
from tessella.operators.filters import filter_counts
from tessella.operators.joins import lookup, union
from tessella.operators.matrices import MATRICES, as_rows
from tessella.operators import mmm  # noqa: F401  registers its regressions
from tessella.operators.overlays import overlay
from tessella.operators.regressions import REGRESSIONS, fit_row
from tessella.operators.slots import Slot
from tessella.operators.tests import as_row
from tessella.plans import batch
from tessella.plans.request import process
from tessella.sources.io import rake, sample
from tessella.sources.synth import generate
from tessella.streaming.streams import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(
        *((F.round(F.col(f"`{f.name}`").cast("double"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema)
    )


def add(name: str, make: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


def request(name: str, source: str, req: dict, sql: str | None = None, derive: Callable[[DataFrame], DataFrame] | None = None, digits: int = DIGITS) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return rounded(process(derive(df) if derive else df, req).rows, digits)

    add(name, make, sql)


# ---- the flagship: pricing summary

FLAGSHIP = {
    "filterers": [{"type": "FILTER_EXPRESSION", "params": {"expression": "ship <= '1998-09-01'"}}],
    "attributes": [
        {"type": "ATTR_FORMULA", "label": "disc_price", "params": {"expression": "l_extendedprice * (1 - l_discount)"}},
        {"type": "ATTR_FORMULA", "label": "charge", "params": {"expression": "disc_price * (1 + l_tax)"}},
    ],
    "groups": [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}, {"type": "GROUP_CATEGORY", "field": "l_linestatus"}],
    "aggregations": [
        {"type": "AGG_SUM", "field": "l_quantity", "label": "sum_qty"},
        {"type": "AGG_SUM", "field": "l_extendedprice", "label": "sum_base_price"},
        {"type": "AGG_SUM", "field": "disc_price", "label": "sum_disc_price"},
        {"type": "AGG_SUM", "field": "charge", "label": "sum_charge"},
        {"type": "AGG_AVERAGE", "field": "l_quantity", "label": "avg_qty"},
        {"type": "AGG_AVERAGE", "field": "l_extendedprice", "label": "avg_price"},
        {"type": "AGG_AVERAGE", "field": "l_discount", "label": "avg_disc"},
        {"type": "AGG_COUNT", "field": "l_quantity", "label": "count_order"},
    ],
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("ship", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return rounded(process(df, FLAGSHIP).rows, 2)


add("pricing_summary", flagship, """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 2) AS avg_qty,
 round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 2) AS avg_disc, count(l_quantity) AS count_order
FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') <= '1998-09-01' GROUP BY ALL""")

# ---- aggregations: line items by return flag

BY_FLAG = [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}]
Q, P, D, T = "l_quantity", "l_extendedprice", "l_discount", "l_tax"


def aggregation(op: str, field: str | None, params: dict, sql: str, suffix: str = "", weight: dict | None = None, digits: int = DIGITS) -> None:
    slot = {"type": op, "field": field, "label": "value", "params": params, **(weight or {})}
    request(
        op.lower() + suffix, "lineitem", {"groups": BY_FLAG, "aggregations": [slot]},
        f"SELECT l_returnflag, {sql} AS value FROM lineitem GROUP BY ALL", digits=digits,
    )


R = lambda e, n=DIGITS: f"round({e}, {n})"
aggregation("AGG_COUNT", Q, {}, f"count({Q})")
aggregation("AGG_SUM", P, {}, R(f"sum({P})", 2), digits=2)
aggregation("AGG_AVERAGE", P, {}, R(f"avg({P})"))
aggregation("AGG_AVERAGE", P, {}, R(f"sum({P} * {Q}) / sum({Q})"), "_weighted", {"weight": Q})
aggregation("AGG_MIN", P, {}, f"min({P})")
aggregation("AGG_MAX", P, {}, f"max({P})")
aggregation("AGG_RANGE", P, {}, R(f"max({P}) - min({P})"))
aggregation("AGG_VARIANCE", Q, {}, R(f"var_pop({Q})"))
aggregation("AGG_VARIANCE", Q, {"ddof": 1}, R(f"var_samp({Q})"), "_sample")
aggregation("AGG_VARIANCE", D, {}, R(f"sum({Q} * {D} * {D}) / sum({Q}) - pow(sum({Q} * {D}) / sum({Q}), 2)", 8), "_weighted", {"weight": Q, "weight_kind": "frequency"}, 8)
aggregation("AGG_STDDEV", Q, {}, R(f"stddev_pop({Q})"))
aggregation("AGG_SKEWNESS", P, {}, R(f"(avg({P}*{P}*{P}) - 3*avg({P})*avg({P}*{P}) + 2*pow(avg({P}), 3)) / pow(var_pop({P}), 1.5)"))
aggregation("AGG_KURTOSIS", Q, {}, R(f"kurtosis_pop({Q})"))
aggregation("AGG_CI_LOWER", Q, {"confidence": 0.95}, R(f"avg({Q}) - 1.959963984540054 * sqrt(var_samp({Q}) / count({Q}))"))
aggregation("AGG_CI_UPPER", Q, {"confidence": 0.95}, R(f"avg({Q}) + 1.959963984540054 * sqrt(var_samp({Q}) / count({Q}))"))
aggregation("AGG_CONSTANT", None, {"value": 7}, "CAST(7 AS DOUBLE)")
aggregation("AGG_DISTINCT_COUNT", "l_suppkey", {}, "count(DISTINCT l_suppkey)")
aggregation("AGG_NULL_COUNT", Q, {}, f"count(*) FILTER ({Q} IS NULL)")
aggregation("AGG_FREQUENCY", "l_linenumber", {"value": 1}, "CAST(count(*) FILTER (l_linenumber = 1) AS DOUBLE)")
aggregation("AGG_RATIO", Q, {"numerator_field": P, "denominator_field": Q}, R(f"sum({P}) / sum({Q})"))
aggregation("AGG_MAE", Q, {"prediction_field": "l_linenumber"}, R(f"avg(abs({Q} - l_linenumber))"))
aggregation("AGG_RMSE", Q, {"prediction_field": "l_linenumber"}, R(f"sqrt(avg(pow({Q} - l_linenumber, 2)))"))
aggregation("AGG_MAPE", Q, {"prediction_field": "l_linenumber"}, R(f"avg(abs({Q} - l_linenumber) / abs({Q})) FILTER ({Q} <> 0)"))
aggregation("AGG_MEDIAN", P, {}, R(f"quantile_cont({P}, 0.5)"))
aggregation("AGG_PERCENTILE", P, {"percentile": 90}, R(f"quantile_cont({P}, 0.9)"))
aggregation("AGG_WEIGHTED_MEAN", P, {"weight_field": Q}, R(f"sum({P} * {Q}) / sum({Q})"))
aggregation("AGG_MODE", "l_linenumber", {}, "")
ORACLE_SQL["agg_mode"] = """SELECT l_returnflag, min(l_linenumber) AS value FROM (
 SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) AS r FROM (
 SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1 GROUP BY ALL"""
aggregation("AGG_MODE_COUNT", "l_linenumber", {}, "")
ORACLE_SQL["agg_mode_count"] = """SELECT l_returnflag, CAST(max(n) AS DOUBLE) AS value FROM (
 SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL"""
aggregation("AGG_AUC", P, {"outcome": "l_linestatus", "positive": "O"}, "")
ORACLE_SQL["agg_auc"] = """WITH c AS (SELECT l_returnflag, l_extendedprice AS x, sum(CAST(l_linestatus = 'O' AS INT)) AS p,
 sum(CAST(l_linestatus <> 'O' AS INT)) AS q FROM lineitem GROUP BY ALL),
 w AS (SELECT *, sum(q) OVER (PARTITION BY l_returnflag ORDER BY x) - q AS below FROM c)
SELECT l_returnflag, CASE WHEN sum(p) * sum(q) > 0 THEN round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 4) END AS value FROM w GROUP BY ALL"""
request("agg_distinct_sum", "orders", {
    "groups": [{"type": "GROUP_CATEGORY", "field": "o_orderstatus"}],
    "aggregations": [{"type": "AGG_DISTINCT_SUM", "field": "o_totalprice", "label": "value", "params": {"distinct_by": "o_custkey", "order": "o_orderkey"}}],
}, """SELECT o_orderstatus, round(sum(x), 2) AS value FROM (SELECT o_orderstatus, o_custkey, arg_min(o_totalprice, o_orderkey) AS x
 FROM orders GROUP BY ALL) GROUP BY ALL""", digits=2)  # fmt: skip
request("agg_zscore", "orders", {
    "groups": [{"type": "GROUP_CATEGORY", "field": "o_orderstatus"}],
    "aggregations": [{"type": "AGG_ZSCORE", "field": "o_totalprice", "label": "value", "params": {"order": "o_orderkey"}}],
}, """SELECT o_orderstatus, round((arg_max(o_totalprice, o_orderkey) - avg(o_totalprice)) / stddev_pop(o_totalprice), 4) AS value
 FROM orders GROUP BY ALL""")  # fmt: skip
request("agg_quantile_weighted", "lineitem", {
    "groups": BY_FLAG, "aggregations": [{"type": "AGG_QUANTILE_WEIGHTED", "field": "l_linenumber", "label": "value", "params": {"percentile": 50, "weight_field": Q}}],
}, f"""WITH c AS (SELECT l_returnflag, l_linenumber AS x, sum({Q}) AS w, count(*) AS n FROM lineitem GROUP BY ALL),
 s AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS tn,
  round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) * sum(n) OVER (PARTITION BY l_returnflag) / sum(w) OVER (PARTITION BY l_returnflag), 9) AS c FROM c)
SELECT l_returnflag, round(low + sh * (high - low), 4) AS value FROM (SELECT l_returnflag, min(x) FILTER (c >= floor(1 + (tn - 1) * 0.5)) AS low,
 min(x) FILTER (c >= least(floor(1 + (tn - 1) * 0.5) + 1, tn)) AS high, any_value((1 + (tn - 1) * 0.5) - floor(1 + (tn - 1) * 0.5)) AS sh
 FROM s GROUP BY ALL)""")  # fmt: skip


def add_welford() -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        req = {"groups": BY_FLAG, "aggregations": [{"type": "AGG_WELFORD", "field": Q, "label": "w"}]}
        return rounded(process(table(spark, sf_dir, "lineitem"), req).rows.select("l_returnflag", "w.*"))

    add("agg_welford", make, f"SELECT l_returnflag, round(avg({Q}), 4) AS mean, round(var_samp({Q}), 4) AS variance, count({Q}) AS n FROM lineitem GROUP BY ALL")


add_welford()

# ---- sets: return flags and line numbers of each order


def order_sets(df: DataFrame) -> DataFrame:
    return df.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.sum("l_quantity").alias("qty"), F.max("l_linestatus").alias("status"))


SETS = """WITH sets AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS flags, sum(l_quantity) AS qty, max(l_linestatus) AS status
 FROM lineitem GROUP BY ALL) """


def set_query(name: str, req: dict, sql: str, show: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(show(process(order_sets(table(spark, sf_dir, "lineitem")), req).rows))

    add(name, make, SETS + sql)


BY_STATUS = [{"type": "GROUP_CATEGORY", "field": "status"}]
for _op, _sql in (
    ("AGG_SET_CARDINALITY_SUM", "sum(len(flags))::BIGINT"),
    ("AGG_SET_CARDINALITY_AVG", "round(avg(len(flags)), 4)"),
    ("AGG_SET_DISTINCT_VALUES", "count(DISTINCT array_to_string(flags, '|'))"),
):
    set_query(_op.lower(), {"groups": BY_STATUS, "aggregations": [{"type": _op, "field": "flags", "label": "value"}]}, f"SELECT status, {_sql} AS value FROM sets GROUP BY ALL")
set_query("agg_set_union", {"groups": BY_STATUS, "aggregations": [{"type": "AGG_SET_UNION", "field": "flags", "label": "value"}]},
          "SELECT status, array_to_string(list_sort(list_distinct(flatten(list(flags)))), '|') AS value FROM sets GROUP BY ALL",
          lambda df: df.withColumn("value", F.array_join("value", "|")))
set_query("agg_set_intersection", {"groups": BY_STATUS, "aggregations": [{"type": "AGG_SET_INTERSECTION", "field": "flags", "label": "value"}]},
          """SELECT status, coalesce(string_agg(f, '|' ORDER BY f) FILTER (n = total), '') AS value FROM (
 SELECT s.status, f, count(*) AS n, any_value(total) AS total FROM (SELECT status, unnest(flags) AS f FROM sets) s
 JOIN (SELECT status, count(*) AS total FROM sets GROUP BY ALL) t USING (status) GROUP BY s.status, f) GROUP BY status""",
          lambda df: df.withColumn("value", F.array_join("value", "|")))
set_query("agg_set_frequency", {"groups": BY_STATUS, "aggregations": [{"type": "AGG_SET_FREQUENCY", "field": "flags", "label": "value"}]},
          "SELECT status, f AS label, count(*) AS n FROM (SELECT status, unnest(flags) AS f FROM sets) GROUP BY ALL",
          lambda df: df.select("status", F.explode("value").alias("label", "n")))
for _op, _sql in (
    ("FILTER_SET_CONTAINS_ALL", "list_has_all(flags, ['A', 'R'])"), ("FILTER_SET_CONTAINS_ANY", "list_has_any(flags, ['A', 'R'])"),
    ("FILTER_SET_CONTAINS_NONE", "NOT list_has_any(flags, ['A', 'R'])"), ("FILTER_SET_EQUALS", "flags = ['A', 'R']"),
):
    set_query(_op.lower(), {"filterers": [{"type": _op, "field": "flags", "params": {"values": ["A", "R"]}}], "aggregations": [{"type": "AGG_COUNT", "field": "qty", "label": "n"}]},
              f"SELECT count(*) AS n FROM sets WHERE {_sql}")
set_query("group_set_value", {"groups": [{"type": "GROUP_SET_VALUE", "field": "flags"}], "aggregations": [{"type": "AGG_SUM", "field": "qty", "label": "qty"}]},
          "SELECT array_to_string(flags, '|') AS flags, round(sum(qty), 4) AS qty FROM sets GROUP BY ALL")
set_query("group_set_per_element", {"groups": [{"type": "GROUP_SET_PER_ELEMENT", "field": "flags"}], "aggregations": [{"type": "AGG_SUM", "field": "qty", "label": "qty"}]},
          "SELECT f AS flags, round(sum(qty), 4) AS qty FROM (SELECT unnest(flags) AS f, qty FROM sets) GROUP BY ALL")
set_query("attr_set_has", {"attributes": [{"type": "ATTR_SET_HAS", "field": "flags", "label": "a", "params": {"label": "A"}}], "select": ["l_orderkey", "a"]},
          "SELECT l_orderkey, CAST(list_contains(flags, 'A') AS DOUBLE) AS a FROM sets")
set_query("attr_set_popcount", {"attributes": [{"type": "ATTR_SET_POPCOUNT", "field": "flags", "label": "a"}], "select": ["l_orderkey", "a"]},
          "SELECT l_orderkey, CAST(len(flags) AS DOUBLE) AS a FROM sets")

# ---- filters on plain columns


def filtered(op: str, source: str, field: str | None, params: dict, sql: str, derive: Callable | None = None, suffix: str = "") -> None:
    request(op.lower() + suffix, source, {"filterers": [{"type": op, "field": field, "params": params}], "aggregations": [{"type": "AGG_COUNT", "label": "n"}]},
            f"SELECT count(*) AS n FROM {source} WHERE {sql}", derive)


filtered("FILTER_INCLUDE", "lineitem", "l_returnflag", {"values": ["A", "R"]}, "l_returnflag IN ('A', 'R')")
filtered("FILTER_EXCLUDE", "lineitem", "l_returnflag", {"values": ["A"]}, "l_returnflag IS NULL OR l_returnflag <> 'A'")
filtered("FILTER_RANGE", "lineitem", Q, {"values": [10, 20]}, f"{Q} BETWEEN 10 AND 20")
filtered("FILTER_NULL", "orders", "o_orderpriority", {"values": ["not_null"]}, "o_orderpriority IS NOT NULL")
filtered("FILTER_EXPRESSION", "lineitem", None, {"expression": "l_quantity * l_discount > 1.5 and l_returnflag in ['A', 'N'] and not (l_linestatus == 'F')"},
         f"{Q} * {D} > 1.5 AND l_returnflag IN ('A', 'N') AND l_linestatus <> 'F'")
_big = lambda df: df.withColumn("big", F.col("o_totalprice") > 100000)
filtered("FILTER_TRUE", "orders", "big", {}, "o_totalprice > 100000", _big)
filtered("FILTER_FALSE", "orders", "big", {}, "NOT (o_totalprice > 100000)", _big)
filtered("FILTER_DATE_RANGES", "orders", "o_orderdate", {"ranges": [{"label": "a", "start": "1995-01-01", "end": "1995-03-31"}, {"label": "b", "start": "1996-06-01", "end": "1996-06-30"}]},
         "CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-03-31' OR CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-01' AND DATE '1996-06-30'")
add("filter_counts", lambda spark, d: filter_counts(table(spark, d, "lineitem"), [
    Slot("FILTER_RANGE", Q, None, {"values": [10, 40]}), Slot("FILTER_INCLUDE", "l_returnflag", None, {"values": ["A"]}),
]), f"""SELECT 0 AS slot, 'FILTER_RANGE' AS type, count(*) AS n_in, count(*) FILTER ({Q} IS NULL) AS n_null_input, count(*) FILTER ({Q} BETWEEN 10 AND 40) AS n_out FROM lineitem
UNION ALL SELECT 1, 'FILTER_INCLUDE', count(*) FILTER ({Q} BETWEEN 10 AND 40), count(*) FILTER ({Q} BETWEEN 10 AND 40 AND l_returnflag IS NULL),
 count(*) FILTER ({Q} BETWEEN 10 AND 40 AND l_returnflag = 'A') FROM lineitem""")  # fmt: skip

# ---- groupers


def grouped(name: str, source: str, slot: dict, key: str, measure: str, digits: int = 2) -> None:
    label = slot.get("label", slot["field"])
    request(name, source, {"groups": [slot], "aggregations": [{"type": "AGG_SUM", "field": measure, "label": "total"}, {"type": "AGG_COUNT", "field": measure, "label": "n"}]},
            f"SELECT {key} AS {label}, round(sum({measure}), {digits}) AS total, count({measure}) AS n FROM {source} GROUP BY 1 HAVING {key} IS NOT NULL", digits=digits)


grouped("group_category", "orders", {"type": "GROUP_CATEGORY", "field": "o_orderpriority"}, "o_orderpriority", "o_totalprice")
grouped("group_range", "lineitem", {"type": "GROUP_RANGE", "field": Q, "label": "bucket", "params": {"interval": 10}},
        f"CAST(CAST(floor({Q} / 10) * 10 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor({Q} / 10) * 10 + 10 AS BIGINT) AS VARCHAR)", P)
grouped("group_rounded", "lineitem", {"type": "GROUP_ROUNDED", "field": Q, "label": "bucket", "params": {"interval": 5}}, f"CAST(CAST(floor({Q} / 5) * 5 AS BIGINT) AS VARCHAR)", P)
grouped("group_numeric_ranges", "lineitem", {"type": "GROUP_NUMERIC_RANGES", "field": Q, "label": "bucket", "params": {"ranges": [{"label": "low", "end": 10}, {"label": "mid", "start": 10, "end": 30}], "unmatched_label": "high"}},
        f"CASE WHEN {Q} < 10 THEN 'low' WHEN {Q} < 30 THEN 'mid' ELSE 'high' END", P)
grouped("group_date_ranges", "orders", {"type": "GROUP_DATE_RANGES", "field": "o_orderdate", "label": "bucket", "params": {"ranges": [{"label": "h1", "start": "1995-01-01", "end": "1995-06-30"}, {"label": "h2", "start": "1995-07-01", "end": "1995-12-31"}], "unmatched_label": "other"}},
        "CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' THEN 'h1' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-07-01' AND DATE '1995-12-31' THEN 'h2' ELSE 'other' END", "o_totalprice")
for _part, _key in (
    ("year", "CAST(year(o_orderdate) AS VARCHAR)"), ("quarter", "year(o_orderdate) || '-Q' || quarter(o_orderdate)"), ("month", "strftime(o_orderdate, '%Y-%m')"),
    ("week", "isoyear(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0')"), ("day", "strftime(o_orderdate, '%Y-%m-%d')"),
    ("weekday", "dayname(o_orderdate)"), ("month_of_year", "monthname(o_orderdate)"),
):
    grouped(f"group_date_{_part}", "orders", {"type": "GROUP_DATE", "field": "o_orderdate", "label": "bucket", "params": {"component": _part}}, _key, "o_totalprice")
grouped("group_date_fiscal", "orders", {"type": "GROUP_DATE", "field": "o_orderdate", "label": "bucket", "params": {"component": "quarter", "fiscal_offset": 3}},
        "'FY' || year(o_orderdate + INTERVAL 3 MONTH) || '-Q' || quarter(o_orderdate + INTERVAL 3 MONTH)", "o_totalprice")
grouped("group_date_hour_of_day", "events", {"type": "GROUP_DATE", "field": "ts", "label": "bucket", "params": {"component": "hour_of_day"}}, "lpad(CAST(hour(ts) AS VARCHAR), 2, '0')", "value")
request("group_quantile", "orders", {"groups": [{"type": "GROUP_QUANTILE", "field": "o_totalprice", "label": "bucket", "params": {"interval": 4}}], "aggregations": [{"type": "AGG_COUNT", "field": "o_orderkey", "label": "n"}, {"type": "AGG_MIN", "field": "o_totalprice", "label": "low"}]},
        """SELECT 'Q' || CAST(floor((rank() OVER (ORDER BY o_totalprice) - 1) * 4 / count(*) OVER ()) + 1 AS BIGINT) AS bucket, o_totalprice FROM orders""")  # fmt: skip
ORACLE_SQL["group_quantile"] = f"SELECT bucket, count(*) AS n, round(min(o_totalprice), 4) AS low FROM ({ORACLE_SQL['group_quantile']}) GROUP BY ALL"
request("group_kmeans", "customer", {"groups": [{"type": "GROUP_KMEANS", "label": "cluster", "params": {"members": ["c_acctbal", "c_nationkey"], "k": 3, "seed": 7, "standardize": True}}], "aggregations": [{"type": "AGG_COUNT", "field": "c_custkey", "label": "n"}]})

# ---- windows over monthly order totals

MONTHLY = {"groups": [{"type": "GROUP_DATE", "field": "o_orderdate", "label": "m", "params": {"component": "month"}}, {"type": "GROUP_CATEGORY", "field": "o_orderstatus"}],
           "aggregations": [{"type": "AGG_SUM", "field": "o_totalprice", "label": "x"}, {"type": "AGG_COUNT", "field": "o_totalprice", "label": "n"}]}
MONTHS_SQL = "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus, sum(o_totalprice) AS x, count(o_totalprice) AS n FROM orders GROUP BY ALL) "
OVER = "OVER (PARTITION BY o_orderstatus ORDER BY m"
HOW = {"partition_by": ["o_orderstatus"], "order_by": ["m"]}


def windowed(op: str, params: dict, sql: str, suffix: str = "") -> None:
    slot = {"type": op, "field": "x", "label": "w", "params": {**HOW, **params}}
    request(op.lower() + suffix, "orders", {**MONTHLY, "windows": [slot]}, MONTHS_SQL + f"SELECT m, o_orderstatus, round(x, 2) AS x, n, {sql} AS w FROM m", digits=2)


_frame = {"frame": {"preceding": 2, "following": 0}}
windowed("WIN_ROW_NUMBER", {}, f"row_number() {OVER})")
windowed("WIN_RANK", {"order_by": [("n", True)]}, "rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC)")
windowed("WIN_DENSE_RANK", {"order_by": [("n", True)]}, "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC)")
windowed("WIN_LAG", {"offset": 2}, f"round(lag(x, 2) {OVER}), 2)")
windowed("WIN_LEAD", {}, f"round(lead(x) {OVER}), 2)")
windowed("WIN_DELTA", {}, f"round(x - lag(x) {OVER}), 2)")
windowed("WIN_PCT_CHANGE", {}, f"round((x - lag(x) {OVER})) / lag(x) {OVER}), 2)")
windowed("WIN_RUNNING_SUM", {"frame": {"preceding": None, "following": 0}}, f"round(sum(x) {OVER} ROWS UNBOUNDED PRECEDING), 2)")
windowed("WIN_RUNNING_AVG", _frame, f"round(avg(x) {OVER} ROWS 2 PRECEDING), 2)")
windowed("WIN_MOVING_AVG", {"frame": {"preceding": 1, "following": 1}}, f"round(avg(x) {OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2)")
windowed("WIN_SHARE", {}, "round(x / sum(x) OVER (PARTITION BY o_orderstatus), 2)")
windowed("WIN_SHARE", {"cumulative": True}, f"round(sum(x) {OVER} ROWS UNBOUNDED PRECEDING) / sum(x) OVER (PARTITION BY o_orderstatus), 2)", "_cumulative")
windowed("WIN_LIFT", {"base": "n"}, "round((x / sum(x) OVER (PARTITION BY o_orderstatus)) / (n / sum(n) OVER (PARTITION BY o_orderstatus)), 2)")
windowed("WIN_FORMULA", {"expression": "x / n"}, "round(x / n, 2)")
windowed("WIN_DISTRIBUTED_LAG", {"decay": 0.5, "max_lag": 2}, f"round(x + 0.5 * coalesce(lag(x, 1) {OVER}), 0) + 0.25 * coalesce(lag(x, 2) {OVER}), 0), 2)")
windowed("WIN_EWMA", {"alpha": 0.5}, "0")
ORACLE_SQL["win_ewma"] = """WITH RECURSIVE m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus, sum(o_totalprice) AS x, count(o_totalprice) AS n FROM orders GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY m) AS i FROM m),
 s AS (SELECT *, x AS w FROM k WHERE i = 1 UNION ALL SELECT k.*, 0.5 * k.x + 0.5 * s.w FROM s JOIN k ON k.o_orderstatus = s.o_orderstatus AND k.i = s.i + 1)
SELECT m, o_orderstatus, round(x, 2) AS x, n, round(w, 2) AS w FROM s"""

# ---- features and attributes on orders and line items


def derived(op: str, kind: str, source: str, field: str | None, params: dict, keep: list[str], sql: str, label: str | None = "v", suffix: str = "", derive: Callable | None = None, digits: int = DIGITS) -> None:
    slot = {"type": op, "field": field, "label": label, "params": params}
    request(op.lower() + suffix, source, {kind: [slot], "select": keep}, sql, derive, digits)


O = "SELECT o_orderkey, "  # noqa: E741
KEEP = ["o_orderkey", "v"]
derived("FEAT_LOG", "features", "orders", "o_totalprice", {}, KEEP, O + "round(ln(1 + o_totalprice), 4) AS v FROM orders")
derived("FEAT_SQRT", "features", "orders", "o_totalprice", {}, KEEP, O + "round(sqrt(o_totalprice), 4) AS v FROM orders")
derived("FEAT_POLY", "features", "lineitem", Q, {"degree": 3}, ["l_orderkey", "l_linenumber", "q_2", "q_3"], f"SELECT l_orderkey, l_linenumber, round({Q} * {Q}, 4) AS q_2, round({Q} * {Q} * {Q}, 4) AS q_3 FROM lineitem", "q")
derived("FEAT_BUCKETIZE", "features", "orders", "o_totalprice", {"boundaries": [50000, 150000]}, KEEP, O + "CAST(CASE WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice <= 150000 THEN 1 ELSE 2 END AS DOUBLE) AS v FROM orders")
derived("FEAT_BUCKETIZE", "features", "orders", "o_totalprice", {"quantiles": 4}, KEEP, """WITH c AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS c FROM orders)
SELECT o_orderkey, CAST(CAST(o_totalprice > c[1] AS INT) + CAST(o_totalprice > c[2] AS INT) + CAST(o_totalprice > c[3] AS INT) AS DOUBLE) AS v FROM orders, c""", suffix="_quantiles")
derived("FEAT_DATE_FEATURES", "features", "orders", "o_orderdate", {}, ["o_orderkey", "d_year", "d_month", "d_day", "d_dow", "d_quarter", "d_hour"],
        O + "CAST(year(o_orderdate) AS DOUBLE) AS d_year, CAST(month(o_orderdate) AS DOUBLE) AS d_month, CAST(day(o_orderdate) AS DOUBLE) AS d_day, CAST(isodow(o_orderdate) AS DOUBLE) AS d_dow, CAST(quarter(o_orderdate) AS DOUBLE) AS d_quarter, CAST(hour(o_orderdate) AS DOUBLE) AS d_hour FROM orders", "d")
derived("FEAT_ONE_HOT", "features", "orders", "o_orderstatus", {}, ["o_orderkey", "s_F", "s_O"], O + "CAST(o_orderstatus = 'F' AS DOUBLE) AS s_F, CAST(o_orderstatus = 'O' AS DOUBLE) AS s_O FROM orders", "s")
derived("FEAT_FREQUENCY_ENCODE", "features", "orders", "o_orderpriority", {}, KEEP, O + "round(count(*) OVER (PARTITION BY o_orderpriority) / CAST(count(*) OVER () AS DOUBLE), 4) AS v FROM orders")
derived("FEAT_TARGET_ENCODE", "features", "orders", "o_orderpriority", {"target": "o_totalprice", "smoothing": 10.0}, KEEP,
        O + "round((sum(o_totalprice) OVER (PARTITION BY o_orderpriority) + 10 * avg(o_totalprice) OVER ()) / (count(*) OVER (PARTITION BY o_orderpriority) + 10), 2) AS v FROM orders", digits=2)
derived("FEAT_TRAIN_TEST_SPLIT", "features", "orders", None, {"mode": "temporal", "order_by": "o_orderdate", "ratios": [0.7, 0.1, 0.2]}, KEEP,
        """SELECT o_orderkey, CASE WHEN u < 0.7 THEN 0 WHEN u < 0.7 + 0.1 THEN 1 ELSE 2 END AS v FROM (
 SELECT o_orderkey, CAST(count(*) OVER (ORDER BY o_orderdate) AS DOUBLE) / count(*) OVER () - 1e-12 AS u FROM orders)""", suffix="_temporal")  # fmt: skip
derived("FEAT_TRAIN_TEST_SPLIT", "features", "orders", None, {"key": "o_orderkey", "seed": 3}, KEEP, "")
derived("ATTR_CODE_IN", "attributes", "orders", "o_orderstatus", {"codes": ["F", "P"]}, KEEP, O + "CAST(o_orderstatus IN ('F', 'P') AS DOUBLE) AS v FROM orders")
derived("ATTR_DATE_PART", "attributes", "orders", "o_orderdate", {"part": "year_month"}, KEEP, O + "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS DOUBLE) AS v FROM orders")
derived("ATTR_FORMULA", "attributes", "orders", None, {"expression": "o_totalprice / total(o_totalprice) * 1000"}, KEEP, O + "round(o_totalprice / sum(o_totalprice) OVER () * 1000, 4) AS v FROM orders")
derived("ATTR_ZSCORE", "attributes", "orders", "o_totalprice", {}, KEEP, O + "round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 4) AS v FROM orders")
derived("ATTR_TSCORE", "attributes", "orders", "o_totalprice", {}, KEEP, O + "round(50 + 10 * (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 4) AS v FROM orders")
derived("ATTR_NORMALIZED", "attributes", "orders", "o_totalprice", {}, KEEP, O + "round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 4) AS v FROM orders")
derived("ATTR_PERCENTILE", "attributes", "orders", "o_totalprice", {"tie": "o_orderkey"}, KEEP, O + "round(row_number() OVER (ORDER BY o_totalprice, o_orderkey) * 100.0 / count(*) OVER (), 4) AS v FROM orders")
derived("ATTR_PREVIOUS_STATE", "attributes", "orders", "o_orderstatus", {"subject_field": "o_custkey", "order_field": "o_orderdate"}, KEEP,
        """WITH p AS (SELECT o_custkey, o_orderdate, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS s FROM orders GROUP BY ALL),
 q AS (SELECT o_custkey, o_orderdate, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS v FROM p)
SELECT o_orderkey, v FROM orders JOIN q USING (o_custkey, o_orderdate)""")  # fmt: skip
LK = ["l_orderkey", "l_linenumber", "v"]
L = "SELECT l_orderkey, l_linenumber, "
derived("ATTR_SCALE_SCORE", "attributes", "lineitem", None, {"members": [Q, "l_linenumber"], "stat": "mean"}, LK, L + f"round(({Q} + l_linenumber) / 2, 4) AS v FROM lineitem")
derived("ATTR_VEC_DISTANCE", "attributes", "lineitem", None, {"members": [Q, "l_linenumber"], "reference": [10.0, 2.0], "metric": "euclidean"}, LK, L + f"round(sqrt(pow({Q} - 10, 2) + pow(l_linenumber - 2, 2)), 4) AS v FROM lineitem")
derived("ATTR_PROFILE_SIMILARITY", "attributes", "lineitem", None, {"members": [Q, "l_linenumber"], "reference": [10.0, 2.0], "metric": "cosine"}, LK,
        L + f"round((10 * {Q} + 2 * l_linenumber) / sqrt(({Q} * {Q} + l_linenumber * l_linenumber) * 104), 4) AS v FROM lineitem")
derived("ATTR_MAHALANOBIS", "attributes", "lineitem", None, {"members": [Q, "l_linenumber"]}, LK, f"""WITH s AS (SELECT avg({Q}) AS mx, avg(l_linenumber) AS my, var_samp({Q}) AS a, var_samp(l_linenumber) AS c, covar_samp({Q}, l_linenumber) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round((c * pow({Q} - mx, 2) - 2 * b * ({Q} - mx) * (l_linenumber - my) + a * pow(l_linenumber - my, 2)) / (a * c - b * b), 4) AS v FROM lineitem, s""")
_reg = {"target": P, "predictors": [Q]}
_line = f"(SELECT regr_slope({P}, {Q}) AS b, regr_intercept({P}, {Q}) AS a, avg({Q}) AS m, regr_sxx({P}, {Q}) AS sxx, count(*) AS n, regr_syy({P}, {Q}) - pow(regr_sxy({P}, {Q}), 2) / regr_sxx({P}, {Q}) AS rss FROM lineitem)"
derived("ATTR_REG_FITTED", "attributes", "lineitem", None, _reg, LK, L + f"round(a + b * {Q}, 2) AS v FROM lineitem, {_line}", digits=2)
derived("ATTR_REG_PREDICT", "attributes", "lineitem", None, _reg, LK, L + f"round(a + b * {Q}, 2) AS v FROM lineitem, {_line}", digits=2)
derived("ATTR_REG_RESIDUAL", "attributes", "lineitem", None, _reg, LK, L + f"round({P} - a - b * {Q}, 2) AS v FROM lineitem, {_line}", digits=2)
derived("ATTR_REG_LEVERAGE", "attributes", "lineitem", None, _reg, LK, L + f"round(1.0 / n + pow({Q} - m, 2) / sxx, 8) AS v FROM lineitem, {_line}", digits=8)
derived("ATTR_REG_INFLUENCE", "attributes", "lineitem", None, _reg, LK, f"""SELECT l_orderkey, l_linenumber, round(pow(e, 2) / (2 * rss / (n - 2)) * h / pow(1 - h, 2), 8) AS v FROM (
 SELECT l_orderkey, l_linenumber, {P} - a - b * {Q} AS e, 1.0 / n + pow({Q} - m, 2) / sxx AS h, n, rss FROM lineitem, {_line})""", digits=8)
FOUR = ["f1", "f2", "f3", "f4"]


def four(df: DataFrame) -> DataFrame:
    """Four correlated numbers of a line item."""
    return df.select("l_orderkey", "l_linenumber", (F.col(Q) + F.col("l_linenumber")).alias("f1"), (F.col(Q) - 3 * F.col("l_linenumber")).alias("f2"), (F.col(Q) + 40 * F.col(D)).cast("double").alias("f3"), (F.col("l_linenumber") + 30 * F.col(T)).cast("double").alias("f4"))


for _op, _extra in (("ATTR_PC_SCORE", {}), ("ATTR_FACTOR_SCORE", {}), ("ATTR_SEM_SCORE", {"latent": "g", "model": "g =~ f1 + f2 + f3"})):
    derived(_op, "attributes", "lineitem", None, {"members": FOUR, **_extra}, LK, "", derive=four)
for _k, _f in (("MEAN", "avg"), ("SUM", "sum"), ("SD", "stddev_samp")):
    add(f"agg_vec_{_k.lower()}", lambda spark, d, k=_k: rounded(process(table(spark, d, "embeddings"), {
        "groups": [{"type": "GROUP_CATEGORY", "field": "label"}], "aggregations": [{"type": f"AGG_VEC_{k}", "field": "embedding", "label": "v", "params": {"dim": 4}}],
    }).rows.select("label", *(F.get("v", F.lit(i)).alias(f"v{i}") for i in range(4)))),
        "SELECT CAST(label AS VARCHAR) AS label, " + ", ".join(f"round({_f}(CAST(embedding[{i + 1}] AS DOUBLE)), 4) AS v{i}" for i in range(4)) + " FROM embeddings GROUP BY ALL")

# ---- crosstabs, facets, joins, unions

CROSS = {"rows": [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}], "columns": [{"type": "GROUP_CATEGORY", "field": "l_linestatus"}]}


def cross(name: str, spec: dict, sql: str) -> None:
    request(name, "lineitem", {"crosstab": {**CROSS, **spec}}, sql, digits=2)


_cell = {"type": "AGG_SUM", "field": Q, "label": "v"}
cross("crosstab_margins", {"cell": _cell, "margins": ["row", "column", "grand"]}, f"""SELECT l_returnflag, l_linestatus, CASE grouping(l_returnflag, l_linestatus) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'grand' END AS _margin,
 round(sum({Q}), 2) AS v FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
cross("crosstab_normalized", {"cell": _cell, "normalize": "row"}, f"""SELECT l_returnflag, l_linestatus, 'cell' AS _margin, round(v / sum(v) OVER (PARTITION BY l_returnflag), 2) AS v FROM (
 SELECT l_returnflag, l_linestatus, sum({Q}) AS v FROM lineitem GROUP BY ALL)""")
cross("crosstab_measures", {"cells": [_cell, {"type": "AGG_AVERAGE", "field": P, "label": "w"}]}, f"SELECT l_returnflag, l_linestatus, 'cell' AS _margin, round(sum({Q}), 2) AS v, round(avg({P}), 2) AS w FROM lineitem GROUP BY ALL")
request("crosstab_total_column", "lineitem", {"crosstab": {"rows": CROSS["rows"], "cell": _cell}}, f"SELECT l_returnflag, 'Total' AS _column, 'cell' AS _margin, round(sum({Q}), 2) AS v FROM lineitem GROUP BY ALL", digits=2)
add("crosstab_pivot", lambda spark, d: rounded(tabs.pivoted(process(table(spark, d, "lineitem"), {"crosstab": {**CROSS, "cell": _cell}}).rows, ["l_returnflag"], "l_linestatus", "v", ["F", "O"]), 2),
    f"SELECT l_returnflag, round(sum({Q}) FILTER (l_linestatus = 'F'), 2) AS F, round(sum({Q}) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY ALL")
add("facet_values", lambda spark, d: tabs.facet_values(table(spark, d, "part"), "p_brand"), "SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY ALL")
add("facet_top", lambda spark, d: tabs.facet_values(table(spark, d, "part"), "p_type", 5), "SELECT p_type AS value, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, value LIMIT 5")
add("facet_numbers", lambda spark, d: rounded(tabs.facet_numbers(table(spark, d, "part"), ["p_size", "p_retailprice"], [50])),
    " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n, count(*) FILTER ({c} IS NULL) AS n_null, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS sd, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50 FROM part" for c in ("p_size", "p_retailprice")))
add("facet_histogram", lambda spark, d: tabs.facet_histogram(table(spark, d, "part"), "p_size", 0, 50, 10),
    """SELECT CAST(b AS INT) AS bin, CAST(b * 5 AS DOUBLE) AS "from", CAST((b + 1) * 5 AS DOUBLE) AS "to", count(p_size) AS count FROM range(10) r(b)
 LEFT JOIN part ON least(floor(p_size / 5), 9) = b AND p_size BETWEEN 0 AND 50 GROUP BY ALL""")  # fmt: skip
add("facet_additive", lambda spark, d: tabs.facet_additive(table(spark, d, "part"), [Slot("FILTER_INCLUDE", "p_brand", None, {"values": ["Brand#11"]}), Slot("FILTER_RANGE", "p_size", None, {"values": [1, 25]})], "p_brand"),
    "SELECT p_brand AS value, count(*) AS count FROM part WHERE p_size BETWEEN 1 AND 25 GROUP BY ALL")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = {
        "join": {"table": "orders", "on": [("l_orderkey", "o_orderkey")]},
        "groups": [{"type": "GROUP_CATEGORY", "field": "o_orderpriority"}],
        "aggregations": [{"type": "AGG_SUM", "field": P, "label": "total"}],
    }
    return rounded(process(table(spark, sf_dir, "lineitem"), req, {"orders": table(spark, sf_dir, "orders")}).rows, 2)


add("join_inner", joined, f"SELECT o_orderpriority, round(sum({P}), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
add("join_left_anti", lambda spark, d: process(table(spark, d, "customer"), {"join": {"table": "orders", "on": [("c_custkey", "o_custkey")], "kind": "left_anti"}, "aggregations": [{"type": "AGG_COUNT", "label": "n"}]}, {"orders": table(spark, d, "orders")}).rows,
    "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("union_source", lambda spark, d: (lambda o: union({"open": o.where("o_orderstatus = 'O'"), "rest": o.where("o_orderstatus <> 'O'")}).groupBy("_source").agg(F.count("*").alias("n")))(table(spark, d, "orders")),
    "SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'rest' END AS _source, count(*) AS n FROM orders GROUP BY ALL")
add("point_lookup", lambda spark, d: lookup(table(spark, d, "nation"), {"n_nationkey": 7}).select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
add("sample_head", lambda spark, d: sample(table(spark, d, "nation"), 5, "n_nationkey").select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
request("sort_limit", "orders", {"sort": [{"field": "o_totalprice", "desc": True}, {"field": "o_orderkey"}], "limit": 10, "select": ["o_orderkey", "o_totalprice"]}, "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
request("labels_output", "orders", {"groups": [{"type": "GROUP_CATEGORY", "field": "o_orderstatus"}], "aggregations": [{"type": "AGG_COUNT", "field": "o_orderkey", "label": "n"}], "labels": {"o_orderstatus": {"F": "finished", "O": "open"}}},
        "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")

# ---- expressions

for _name, _expr, _sql in (
    ("arithmetic", "abs(l_quantity - 25) ** 2 + l_linenumber % 3", f"pow(abs({Q} - 25), 2) + l_linenumber % 3"),
    ("condition", "l_returnflag == 'A' ? 1 : (l_linestatus startsWith 'O' ? 2 : 3)", "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus LIKE 'O%' THEN 2 ELSE 3 END"),
    ("maths", "log(l_quantity) + sqrt(l_extendedprice) + hill(l_quantity, 10, 2)", f"ln({Q}) + sqrt({P}) + {Q} * {Q} / ({Q} * {Q} + 100)"),
    ("vector", "norm([l_quantity, l_linenumber]) + argmax([l_quantity, l_linenumber])", f"sqrt({Q} * {Q} + l_linenumber * l_linenumber) + CASE WHEN {Q} >= l_linenumber THEN 0 ELSE 1 END"),
    ("lambda", "reduce(map([1, 2, l_linenumber], # * 2), #acc + #) + count([1, 5, l_linenumber], # > 2)", "2 * (3 + l_linenumber) + 1 + CAST(l_linenumber > 2 AS INT)"),
    ("calendar", "month_index(l_shipdate) + weekday(l_shipdate) / 10.0", "year(l_shipdate) * 12 + month(l_shipdate) - 1 + isodow(l_shipdate) / 10.0"),
    ("lookup", "lookup('rate', l_returnflag, 0.0) * l_quantity", f"CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'R' THEN 0.25 ELSE 0 END * {Q}"),
    ("text", "len(split('a,b,' + l_returnflag, ',')) + indexOf(lower(l_returnflag), 'a')", "2 + instr(lower(l_returnflag), 'a')"),
    ("nulls", "(l_quantity / (l_linenumber - 1) ?? -1.0)", f"coalesce({Q} / nullif(l_linenumber - 1, 0), -1)"),
):
    request(f"expr_{_name}", "lineitem", {"attributes": [{"type": "ATTR_FORMULA", "label": "v", "params": {"expression": _expr, "lookups": {"rate": {"A": 0.5, "R": 0.25}}}}], "select": LK},
            L + f"round(CAST({_sql} AS DOUBLE), 4) AS v FROM lineitem")

# ---- hypothesis tests: the statistic against SQL (SQL has no distribution tails; tests of the library hold the p-values)


def tested(op: str, source: str, field: str | None, params: dict, sql: str | None = None, suffix: str = "", derive: Callable | None = None, digits: int = DIGITS) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        slot = Slot(op, field, None, params)
        return rounded(as_row(derive(df) if derive else df, slot, {"statistic": "statistic"}), digits)

    add(op.lower() + suffix, make, sql and f"SELECT round(CAST({sql[0]} AS DOUBLE), {digits}) AS statistic FROM {sql[1]}")


_two = f"(SELECT avg({P}) FILTER (l_linestatus = 'F') AS ma, avg({P}) FILTER (l_linestatus = 'O') AS mb, var_samp({P}) FILTER (l_linestatus = 'F') AS va, var_samp({P}) FILTER (l_linestatus = 'O') AS vb, count({P}) FILTER (l_linestatus = 'F') AS na, count({P}) FILTER (l_linestatus = 'O') AS nb FROM lineitem)"
_split = {"split_by": "l_linestatus"}
_welch = ("(ma - mb) / sqrt(va / na + vb / nb)", _two)
tested("TEST_WELCH", "lineitem", P, _split, _welch)
tested("TEST_T", "lineitem", P, _split, _welch)
tested("TEST_T", "lineitem", P, {**_split, "variance": "equal"}, ("(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb))", _two), "_equal")
tested("TEST_T", "lineitem", Q, {"mu": 25}, (f"(avg({Q}) - 25) / sqrt(var_samp({Q}) / count({Q}))", "lineitem"), "_one_sample")
tested("TEST_Z_TWO_SAMPLE", "lineitem", P, _split, _welch)
tested("TEST_PAIRED_T", "lineitem", Q, {"field2": "l_linenumber"}, (f"avg({Q} - l_linenumber) / sqrt(var_samp({Q} - l_linenumber) / count(*))", "lineitem"))
tested("TEST_PROP_Z", "lineitem", "l_linenumber", {**_split, "success": 1}, ("(ka / na - kb / nb) / sqrt((ka + kb) / (na + nb) * (1 - (ka + kb) / (na + nb)) * (1.0 / na + 1.0 / nb))",
       "(SELECT CAST(count(*) FILTER (l_linenumber = 1 AND l_linestatus = 'F') AS DOUBLE) AS ka, CAST(count(*) FILTER (l_linenumber = 1 AND l_linestatus = 'O') AS DOUBLE) AS kb, count(*) FILTER (l_linestatus = 'F') AS na, count(*) FILTER (l_linestatus = 'O') AS nb FROM lineitem)"))
_groups = f"(SELECT l_returnflag, count(*) AS n, avg({P}) AS m, var_samp({P}) AS v FROM lineitem GROUP BY ALL)"
_flag = {"split_by": "l_returnflag"}
tested("TEST_ANOVA_F", "lineitem", P, _flag, ("(sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*)))", _groups))
tested("TEST_ANOVA_WELCH", "lineitem", P, _flag, ("f", f"""(WITH g AS {_groups}, w AS (SELECT *, n / v AS w FROM g), t AS (SELECT *, sum(w) OVER () AS tw, sum(w * m) OVER () / sum(w) OVER () AS gm, count(*) OVER () AS k FROM w)
 SELECT sum(w * pow(m - gm, 2)) / (any_value(k) - 1) / (1 + 2.0 * (any_value(k) - 2) / (pow(any_value(k), 2) - 1) * sum(pow(1 - w / tw, 2) / (n - 1))) AS f FROM t)"""))
tested("TEST_ANOVA_RM", "orders", "o_totalprice", {"split_by": "o_orderstatus", "subject_field": "o_custkey"}, ("f", """(WITH c AS (SELECT o_custkey AS s, o_orderstatus AS c, avg(o_totalprice) AS x FROM orders GROUP BY ALL),
 k AS (SELECT count(DISTINCT c) AS k FROM c), f AS (SELECT c.*, k FROM c, k QUALIFY count(*) OVER (PARTITION BY s) = k),
 g AS (SELECT *, avg(x) OVER (PARTITION BY s) AS ms, avg(x) OVER (PARTITION BY c) AS mc, avg(x) OVER () AS gm, count(*) OVER () / k AS n FROM f)
 SELECT (sum(pow(mc - gm, 2)) / (any_value(k) - 1)) / (sum(pow(x - ms - mc + gm, 2)) / ((any_value(k) - 1) * (any_value(n) - 1))) AS f FROM g)"""))
tested("TEST_BROWN_FORSYTHE", "lineitem", P, _flag, ("(sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*)))",
       f"(SELECT l_returnflag, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM (SELECT l_returnflag, abs({P} - quantile_cont({P}, 0.5) OVER (PARTITION BY l_returnflag)) AS d FROM lineitem) GROUP BY ALL)"))
_table = "(SELECT l_returnflag AS r, l_linenumber AS c, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY ALL)"
tested("TEST_CHISQ", "lineitem", None, {"rows": "l_returnflag", "cols": "l_linenumber"}, ("sum(pow(o - e, 2) / e)", f"(SELECT o, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM {_table})"))
tested("TEST_FISHER_EXACT", "nation", None, {"rows": "a", "cols": "b"}, ("a * d / (b * c)", "(SELECT CAST(count(*) FILTER (NOT x AND NOT y) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT x AND y) AS DOUBLE) AS b, CAST(count(*) FILTER (x AND NOT y) AS DOUBLE) AS c, CAST(count(*) FILTER (x AND y) AS DOUBLE) AS d FROM (SELECT n_nationkey > 10 AS x, n_regionkey > 1 AS y FROM nation))"),
       derive=lambda df: df.select((F.col("n_nationkey") > 10).alias("a"), (F.col("n_regionkey") > 1).alias("b")))
tested("TEST_PEARSON_R", "lineitem", Q, {"field2": P}, (f"corr({Q}, {P})", "lineitem"))
tested("TEST_SPEARMAN_R", "lineitem", Q, {"field2": P}, ("corr(a, b)", f"(SELECT rank() OVER (ORDER BY {Q}) + (count(*) OVER (PARTITION BY {Q}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {P}) + (count(*) OVER (PARTITION BY {P}) - 1) / 2.0 AS b FROM lineitem)"))
tested("TEST_KENDALL_TAU", "supplier", "s_acctbal", {"field2": "s_nationkey"}, ("s / sqrt((p - tx) * (p - ty))", """(SELECT sum(sign(a.s_acctbal - b.s_acctbal) * sign(a.s_nationkey - b.s_nationkey)) AS s, count(*) AS p,
 count(*) FILTER (a.s_acctbal = b.s_acctbal) AS tx, count(*) FILTER (a.s_nationkey = b.s_nationkey) AS ty FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey)"""))
_ranked = "(SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders WHERE o_orderstatus IN ('F', 'O'))"
_fo = lambda df: df.where("o_orderstatus in ('F', 'O')")
_by_status = {"split_by": "o_orderstatus"}
tested("TEST_MANN_WHITNEY_U", "orders", "o_totalprice", _by_status, ("sum(r) - count(*) * (count(*) + 1) / 2", f"{_ranked} WHERE g = 'F'"), derive=_fo, digits=1)
tested("TEST_KRUSKAL_WALLIS", "lineitem", "l_linenumber", _flag, ("h / (1 - t / (n * n * n - n))", """(WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_linenumber) + (count(*) OVER (PARTITION BY l_linenumber) - 1) / 2.0 AS r FROM lineitem),
 s AS (SELECT g, count(*) AS k, sum(r) AS s FROM r GROUP BY g), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem),
 t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS t FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_linenumber))
 SELECT 12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / k) - 3 * (any_value(n) + 1) AS h, any_value(n) AS n, any_value(t) AS t FROM s, n, t)"""))
tested("TEST_WILCOXON_SR", "lineitem", Q, {"field2": "l_linenumber"}, ("sum(r) FILTER (d > 0)", f"(SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM (SELECT {Q} - l_linenumber AS d FROM lineitem) WHERE d <> 0)"), digits=1)
tested("TEST_KS", "orders", "o_totalprice", _by_status, ("max(abs(a - b))", """(SELECT o_totalprice, max(a) AS a, max(b) AS b FROM (SELECT o_totalprice, CAST(count(*) FILTER (o_orderstatus = 'F') OVER w AS DOUBLE) / count(*) FILTER (o_orderstatus = 'F') OVER () AS a,
 CAST(count(*) FILTER (o_orderstatus = 'O') OVER w AS DOUBLE) / count(*) FILTER (o_orderstatus = 'O') OVER () AS b FROM orders WHERE o_orderstatus IN ('F', 'O') WINDOW w AS (ORDER BY o_totalprice)) GROUP BY ALL)"""), derive=_fo)
tested("TEST_SHAPIRO_WILK", "supplier", "s_acctbal", {})
tested("TEST_TREND", "supplier", "s_acctbal", {"order_by": "s_suppkey"}, ("sum(sign(b.s_acctbal - a.s_acctbal))", "supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey"))
tested("TEST_TUKEY_HSD", "lineitem", P, _flag, ("max(abs(a.m - b.m) / sqrt(w / 2 * (1.0 / a.n + 1.0 / b.n)))", f"{_groups} a JOIN {_groups} b ON a.l_returnflag < b.l_returnflag, (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS w FROM {_groups})"))
_vec = {"members": FOUR}
tested("TEST_HOTELLING_T2", "lineitem", None, {"members": [Q, "l_linenumber"], "mu": [25.0, 3.0]}, ("n * (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b)",
       f"(SELECT count(*) AS n, avg({Q}) - 25 AS dx, avg(l_linenumber) - 3 AS dy, var_samp({Q}) AS a, covar_samp({Q}, l_linenumber) AS b, var_samp(l_linenumber) AS c FROM lineitem)"))
tested("TEST_BARTLETT_SPHERICITY", "lineitem", None, {"members": [Q, "l_linenumber"]}, ("-(n - 1 - 9 / 6.0) * ln(1 - r * r)", f"(SELECT count(*) AS n, corr({Q}, l_linenumber) AS r FROM lineitem)"))
tested("TEST_BOX_M", "lineitem", None, {"members": [Q, "l_linenumber"], **_flag})
tested("TEST_MANOVA", "lineitem", None, {"members": [Q, "l_linenumber"], **_flag})
tested("TEST_MARDIA", "lineitem", None, {"members": [Q, "l_linenumber"]})

# ---- matrices


def matrix(op: str, params: dict, sql: str | None = None, suffix: str = "", derive: Callable | None = None, part: str = "primary") -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem")
        df = derive(df) if derive else df
        return rounded(as_rows(df, MATRICES.find(op)(df, Slot(op, None, None, params)), part))

    add(op.lower() + suffix, make, sql)


_m3 = [Q, P, D]


def pairs_sql(f: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS row_key, '{b}' AS col_key, round({f.format(a=a, b=b)}, 4) AS value FROM lineitem" for a in _m3 for b in _m3)


matrix("MAT_COVARIANCE", {"members": _m3}, pairs_sql("covar_samp({a}, {b})"))
matrix("MAT_CORRELATION", {"members": _m3}, pairs_sql("corr({a}, {b})"))
matrix("MAT_CORRELATION", {"members": _m3, "missing": "pairwise"}, pairs_sql("corr({a}, {b})"), "_pairwise")
matrix("MAT_CORRELATION", {"members": [Q, P], "method": "spearman"}, f"""WITH r AS (SELECT rank() OVER (ORDER BY {Q}) + (count(*) OVER (PARTITION BY {Q}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {P}) + (count(*) OVER (PARTITION BY {P}) - 1) / 2.0 AS b FROM lineitem),
 c AS (SELECT round(corr(a, b), 4) AS v FROM r)
SELECT '{Q}' AS row_key, '{P}' AS col_key, v AS value FROM c UNION ALL SELECT '{P}', '{Q}', v FROM c UNION ALL SELECT '{Q}', '{Q}', 1.0 FROM c UNION ALL SELECT '{P}', '{P}', 1.0 FROM c""", "_spearman")
_abc = f"(SELECT corr({Q}, {P}) AS ab, corr({Q}, {D}) AS ac, corr({P}, {D}) AS bc FROM lineitem)"
_part = "round(({x} - {y} * {z}) / sqrt((1 - {y} * {y}) * (1 - {z} * {z})), 4)"
matrix("MAT_PARTIAL_CORRELATION", {"members": _m3}, " UNION ALL ".join(
    f"SELECT '{a}' AS row_key, '{b}' AS col_key, {_part.format(x=x, y=y, z=z) if a != b else '1.0'} AS value FROM {_abc}"
    for a, b, x, y, z in [(Q, P, "ab", "ac", "bc"), (P, Q, "ab", "ac", "bc"), (Q, D, "ac", "ab", "bc"), (D, Q, "ac", "ab", "bc"), (P, D, "bc", "ab", "ac"), (D, P, "bc", "ab", "ac"), (Q, Q, "", "", ""), (P, P, "", "", ""), (D, D, "", "", "")]
))
matrix("MAT_PCA", {"members": [Q, P], "components": 1}, f"""SELECT k AS row_key, '1' AS col_key, round(sqrt((1 + abs(corr({Q}, {P}))) / 2) * CASE k WHEN '{Q}' THEN 1 ELSE sign(corr({Q}, {P})) END, 4) AS value FROM lineitem, (SELECT unnest(['{Q}', '{P}']) AS k) GROUP BY k""")
matrix("MAT_FACTOR", {"members": FOUR, "factors": 1}, derive=four)
matrix("MAT_RELIABILITY", {"members": FOUR}, derive=four)
matrix("MAT_COLLINEARITY", {"members": [Q, P, D]}, part="vif")
matrix("MAT_DISTANCE", {"members": [Q, D], "between": {"type": "GROUP_CATEGORY", "field": "l_returnflag"}}, f"""WITH c AS (SELECT l_returnflag AS k, avg({Q}) AS x, avg({D}) AS y FROM lineitem GROUP BY ALL)
SELECT a.k AS row_key, b.k AS col_key, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS value FROM c a, c b""")
matrix("MAT_SEM", {"model": "g =~ f1 + f2 + f3"}, derive=four)

# ---- regressions


def regression(op: str, params: dict, sql: str | None = None, suffix: str = "", source: str = "lineitem", derive: Callable | None = None, digits: int = DIGITS) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = derive(df) if derive else df
        return rounded(fit_row(df, REGRESSIONS.find(op)(df, Slot(op, None, None, params))), digits)

    add(op.lower() + suffix, make, sql)


regression("REG_OLS", {"target": P, "predictors": [Q]}, f"""WITH f AS {_line}
SELECT '(intercept)' AS term, round(a, 2) AS estimate, round(sqrt(rss / (n - 2) * (1.0 / n + m * m / sxx)), 2) AS se FROM f UNION ALL SELECT '{Q}', round(b, 2), round(sqrt(rss / (n - 2) / sxx), 2) FROM f""", digits=2)
regression("REG_OLS", {"target": P, "predictors": [Q], "penalty": "l2", "alpha": 1.0}, f"""WITH s AS (SELECT regr_sxy({P}, {Q}) AS sxy, regr_sxx({P}, {Q}) AS sxx, count(*) AS n, avg({P}) AS my, avg({Q}) AS mx FROM lineitem)
SELECT '(intercept)' AS term, round(my - sxy / (sxx + n) * mx, 2) AS estimate, CAST(NULL AS DOUBLE) AS se FROM s UNION ALL SELECT '{Q}', round(sxy / (sxx + n), 2), NULL FROM s""", "_ridge", digits=2)
regression("REG_OLS", {"target": P, "predictors": [Q, D, T], "penalty": "l1", "alpha": 5.0}, suffix="_lasso", digits=2)
regression("REG_BAYES_LINEAR", {"target": P, "predictors": [Q]}, digits=1)
_labels = lambda df: df.withColumn("hit", (F.col("l_returnflag") == "A").cast("int"))
regression("REG_GLM", {"target": "hit", "predictors": [Q, D], "family": "binomial"}, derive=_labels)
regression("REG_GLM", {"target": "l_linenumber", "predictors": [Q], "family": "poisson"}, suffix="_poisson")
regression("REG_MULTINOMIAL", {"target": "l_returnflag", "predictors": [Q, D]})
regression("REG_ORDINAL", {"target": "l_returnflag", "predictors": [Q], "levels": ["A", "N", "R"]})
regression("REG_SELECTION", {"target": "f1", "predictors": ["f2", "f3", "f4"], "selection": "forward", "criterion": "bic"}, derive=four)
regression("REG_RESAMPLE", {"target": P, "predictors": [Q], "resample": "jackknife", "jackknife_groups": 5, "key": "l_orderkey"}, digits=1)
_weekly = lambda df: df.groupBy(F.date_trunc("week", "ts").alias("week")).agg(
    F.sum("value").alias("sales"), F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)).alias("tv"), F.sum(F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0)).alias("search"))
_mmm = {"target": "sales", "channels": ["tv", "search"], "time": "week", "max_lag": 2}
regression("REG_MMM_HILL", _mmm, source="events", derive=_weekly, digits=3)
regression("REG_MMM_BAYES", {**_mmm, "draws": 200, "warmup": 200, "chains": 1}, source="events", derive=_weekly, digits=3)

# ---- overlays: monthly series, and flag by status matrices


def series(op: str, params: dict, sql: str, digits: int = DIGITS) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        host = process(table(spark, sf_dir, "orders"), MONTHLY).rows
        return rounded(overlay(host, Slot(op, None, "o", {"value": "x", **HOW, **params})).select("m", "o_orderstatus", "o"), digits)

    add(op.lower(), make, MONTHS_SQL + f"SELECT m, o_orderstatus, round({sql}, {digits}) AS o FROM m")


_PART = "OVER (PARTITION BY o_orderstatus)"
series("OVERLAY_INDEX_VS_PRIOR", {}, f"x / lag(x) {OVER}) * 100")
series("OVERLAY_DELTA_VS_PRIOR", {}, f"x - lag(x) {OVER})", 2)
series("OVERLAY_INDEX_VS_BASELINE", {"baseline_position": 1}, f"x / nth_value(x, 2) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100")
series("OVERLAY_DELTA_VS_BASELINE", {}, f"x - first_value(x) {OVER})", 2)
series("OVERLAY_INDEX_VS_SIBLING", {"partition_by": ["m"], "key": "o_orderstatus", "sibling": "O"}, "x / max(x) FILTER (o_orderstatus = 'O') OVER (PARTITION BY m) * 100")
series("OVERLAY_DELTA_VS_SIBLING", {"partition_by": ["m"], "key": "o_orderstatus", "sibling": "O"}, "x - max(x) FILTER (o_orderstatus = 'O') OVER (PARTITION BY m)", 2)
series("OVERLAY_INDEX_VS_TOTAL", {}, f"x / sum(x) {_PART} * 100")
series("OVERLAY_SHARE_OF_TOTAL", {}, f"x / sum(x) {_PART}")
series("OVERLAY_ZSCORE_VS_TOTAL", {}, f"(x - avg(x) {_PART}) / stddev_pop(x) {_PART}")
series("OVERLAY_INDEX_VS_ROLLING_MEAN", {"window": 3}, f"CASE WHEN count(x) {OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 3 THEN x / avg(x) {OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) * 100 END")
series("OVERLAY_ZSCORE_VS_ROLLING", {"window": 3}, f"CASE WHEN count(x) {OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 3 THEN (x - avg(x) {OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) / stddev_samp(x) {OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END")
series("OVERLAY_FORMULA", {"formula": "x / n"}, "x / n", 2)
series("OVERLAY_YOY", {"period": "m", "partition_by": ["o_orderstatus"]}, "x / (SELECT p.x FROM m p WHERE p.o_orderstatus = m.o_orderstatus AND p.m = CAST(CAST(m.m[1:4] AS INT) - 1 AS VARCHAR) || m.m[5:]) * 100")

CELLS = {"groups": [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}, {"type": "GROUP_CATEGORY", "field": "l_shipmode_like"}],
         "aggregations": [{"type": "AGG_COUNT", "label": "k"}, {"type": "AGG_SUM", "field": Q, "label": "x"}, {"type": "AGG_AVERAGE", "field": Q, "label": "mean"}, {"type": "AGG_VARIANCE", "field": Q, "label": "variance", "params": {"ddof": 1}}]}
_mode = lambda df: df.withColumn("l_shipmode_like", F.col("l_linenumber") % 3)
CELLS_SQL = f"WITH c AS (SELECT l_returnflag, CAST(l_linenumber % 3 AS VARCHAR) AS l_shipmode_like, count(*) AS k, sum({Q}) AS x, avg({Q}) AS mean, var_samp({Q}) AS variance FROM lineitem GROUP BY ALL) "


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(_mode(table(spark, sf_dir, "lineitem")), CELLS).rows


def cells(op: str, params: dict, sql: str, keep: list[str] | None = None, digits: int = DIGITS, whole: bool = False, reference: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        host = cells_of(spark, sf_dir)
        slot = Slot(op, None, "o", {"value": "k", "row": "l_returnflag", "col": "l_shipmode_like", "on": ["l_returnflag", "l_shipmode_like"], "n": "k", **params})
        out = overlay(host, slot, reference(host) if reference else None)
        return rounded(out if whole else out.select(*(keep or ["l_returnflag", "l_shipmode_like", "o"])), digits)

    add(op.lower(), make, sql and CELLS_SQL + sql)


_sel = "SELECT l_returnflag, l_shipmode_like, round({}, 4) AS o FROM c"
_r, _c, _g = "sum(k) OVER (PARTITION BY l_returnflag)", "sum(k) OVER (PARTITION BY l_shipmode_like)", "sum(k) OVER ()"
cells("OVERLAY_SHARE_OF_ROW", {}, _sel.format(f"k / {_r}"))
cells("OVERLAY_SHARE_OF_COL", {}, _sel.format(f"k / {_c}"))
cells("OVERLAY_INDEX_VS_MARGIN", {"margin": "row"}, _sel.format(f"k / {_r} * 100"))
cells("OVERLAY_DELTA_VS_MARGIN", {"margin": "row"}, _sel.format(f"CAST(k - {_r} AS DOUBLE)"))
cells("OVERLAY_ZSCORE_VS_MARGIN", {"margin": "row"}, _sel.format(f"(k - {_r}) / stddev_pop(k) OVER (PARTITION BY l_returnflag)"))
cells("OVERLAY_RANK", {"population": "row"}, "SELECT l_returnflag, l_shipmode_like, rank() OVER (PARTITION BY l_returnflag ORDER BY k DESC) AS o FROM c")
_e = f"(CAST({_r} AS DOUBLE) * {_c} / {_g})"
cells("OVERLAY_STD_RESIDUAL", {}, f"SELECT l_returnflag, l_shipmode_like, round((k - e) / sqrt(e * (1 - r / g) * (1 - cc / g)), 4) AS o FROM (SELECT *, {_e} AS e, CAST({_r} AS DOUBLE) AS r, CAST({_c} AS DOUBLE) AS cc, {_g} AS g FROM c)")
for _op, _over in (("MATRIX", "OVER ()"), ("ROW", "OVER (PARTITION BY l_returnflag)"), ("COL", "OVER (PARTITION BY l_shipmode_like)")):
    cells(f"OVERLAY_CHISQ_{_op}", {}, f"SELECT l_returnflag, l_shipmode_like, round(sum(pow(k - e, 2) / e) {_over}, 4) AS o FROM (SELECT *, {_e} AS e FROM c)")
cells("OVERLAY_FISHER_EXACT_CELL", {}, "")
_twice = lambda host: host.select("l_returnflag", "l_shipmode_like", (F.col("k") + F.col("x")).cast("double").alias("k"), (F.col("x") / 2).alias("x"), (F.col("mean") + 1).alias("mean"), "variance")
for _n in ("REF", "STAGE"):
    cells(f"OVERLAY_INDEX_VS_{_n}", {}, _sel.format("k / (k + x) * 100"), reference=_twice)
    cells(f"OVERLAY_DELTA_VS_{_n}", {}, _sel.format("-x"), reference=_twice)
cells("OVERLAY_PANEL_INDEX_VS_REF", {}, _sel.format("k / (k + x) * 100"), reference=_twice)
cells("OVERLAY_INDEX_VS_POP", {}, _sel.format("k / sum(k) OVER () / ((k + x) / sum(k + x) OVER ()) * 100"), reference=_twice)
cells("OVERLAY_ZSCORE_VS_POP", {}, "SELECT l_returnflag, l_shipmode_like, round((a - b) / sqrt(b * (1 - b)), 4) AS o FROM (SELECT *, k / sum(k) OVER () AS a, (k + x) / sum(k + x) OVER () AS b FROM c)", reference=_twice)
_xref = "SELECT l_returnflag, l_shipmode_like, round(sum(pow(k - e, 2) / e) OVER (), 4) AS o FROM (SELECT *, (k + x) * sum(k) OVER () / sum(k + x) OVER () AS e FROM c)"
cells("OVERLAY_CHISQ_VS_REF", {}, _xref, reference=_twice)
cells("OVERLAY_CHISQ_VS_POP", {}, _xref, reference=_twice)
for _op in ("OVERLAY_T_CELL", "OVERLAY_T_VS_REF", "OVERLAY_Z_CELL", "OVERLAY_Z_VS_REF", "OVERLAY_PROP_Z_CELL"):
    cells(_op, {"k": "mean"} if "PROP" in _op else {}, "", reference=_twice)
cells("OVERLAY_MATRIX_GROUP_SUMMARY", {}, "SELECT l_returnflag, l_shipmode_like, CAST(k AS DOUBLE) AS mean, CAST(k AS DOUBLE) AS min, CAST(k AS DOUBLE) AS max, CAST(0 AS DOUBLE) AS range, CAST(1 AS BIGINT) AS groups FROM c", whole=True)
for _op in ("PROP_Z", "PROBIT_T", "TWO_MEANS_Z", "WELCH_T"):
    cells(f"OVERLAY_PAIRWISE_{_op}", {"pair": "l_shipmode_like", "within": ["l_returnflag"], "k": "mean"}, "", ["l_returnflag", "a", "b", "o"])
cells("OVERLAY_PAIRWISE_WEIGHTED_TWO_MEANS_Z", {"pair": "l_shipmode_like", "within": ["l_returnflag"], "w": "x", "n_basis": "weights"}, "", ["l_returnflag", "a", "b", "o"])
cells("OVERLAY_RETENTION", {"absorbing": "R"}, """, s AS (SELECT l_returnflag, sum(k) AS t, sum(k) FILTER (l_returnflag = l_shipmode_like) AS a FROM c GROUP BY ALL)
SELECT l_returnflag, round(coalesce(a, 0) / t, 4) AS stayed, round(1 - coalesce(a, 0) / t, 4) AS switched, CAST(0 AS DOUBLE) AS churned FROM s""".replace(", s AS", "SELECT * FROM (WITH s AS") + ")", whole=True)
cells("OVERLAY_RAKE", {"row_targets": {"A": 1.0, "N": 2.0, "R": 1.0}, "col_targets": {"0": 1.0, "1": 2.0, "2": 1.0}}, "", whole=True)
cells("OVERLAY_CORRESPONDENCE", {}, "", whole=True)
_moves = lambda df: df.select("o_custkey", "o_orderstatus", F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next")).where("next is not null").groupBy("o_orderstatus", "next").agg(F.count("*").alias("k"))
for _op in ("OVERLAY_MARKOV", "OVERLAY_SYMMETRY"):
    add(_op.lower(), lambda spark, d, op=_op: rounded(overlay(_moves(table(spark, d, "orders")), Slot(op, None, "o", {"value": "k", "row": "o_orderstatus", "col": "next"}))))
ORACLE_SQL["overlay_markov"] = """WITH m AS (SELECT o_orderstatus, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders),
 k AS (SELECT o_orderstatus, next, count(*) AS k FROM m WHERE next IS NOT NULL GROUP BY ALL), v AS (SELECT DISTINCT o_orderstatus AS s FROM orders)
SELECT a.s AS o_orderstatus, b.s AS next, round(coalesce(k, 0) / CAST(sum(coalesce(k, 0)) OVER (PARTITION BY a.s) AS DOUBLE), 4) AS o FROM v a CROSS JOIN v b LEFT JOIN k ON k.o_orderstatus = a.s AND k.next = b.s"""
_stats = {"groups": MONTHLY["groups"], "aggregations": [{"type": "AGG_COUNT", "field": "o_totalprice", "label": "n"}, {"type": "AGG_AVERAGE", "field": "o_totalprice", "label": "mean"}, {"type": "AGG_VARIANCE", "field": "o_totalprice", "label": "variance", "params": {"ddof": 1}}, {"type": "AGG_FREQUENCY", "field": "o_orderpriority", "label": "k", "params": {"value": "1-URGENT"}}]}
for _op in ("OVERLAY_T_VS_PRIOR", "OVERLAY_Z_VS_PRIOR", "OVERLAY_PROP_Z_VS_PRIOR"):
    add(_op.lower(), lambda spark, d, op=_op: rounded(overlay(process(table(spark, d, "orders"), _stats).rows, Slot(op, None, "o", HOW)).select("m", "o_orderstatus", "o")))
add("overlay_prop_z_panel", lambda spark, d: (lambda h: rounded(overlay(h, Slot("OVERLAY_PROP_Z_PANEL", None, "o", {"on": ["l_returnflag", "l_shipmode_like"], "k": "mean", "n": "k"}), h.withColumn("mean", F.col("mean") / 2))))(cells_of(spark, d)))
add("overlay_ks_vs_pop", lambda spark, d: (lambda t: rounded(overlay(t.where("p_size > 10").groupBy("p_size").count(), Slot("OVERLAY_KS_VS_POP", None, "o", {"key": "p_size", "value": "count"}), t.groupBy("p_size").count()).select("o")))(table(spark, d, "part")),
    """WITH a AS (SELECT p_size AS v, count(*) AS b, count(*) FILTER (p_size > 10) AS a FROM part GROUP BY ALL)
SELECT round(max(abs(x - y)), 4) AS o FROM (SELECT CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) / sum(a) OVER () AS x, CAST(sum(b) OVER (ORDER BY v) AS DOUBLE) / sum(b) OVER () AS y FROM a)""")  # fmt: skip

# ---- several requests, weights, generated tables, event time

add("process_chain", lambda spark, d: rounded(batch.chain(table(spark, d, "orders"), [MONTHLY, {"groups": [{"type": "GROUP_CATEGORY", "field": "o_orderstatus"}], "aggregations": [{"type": "AGG_AVERAGE", "field": "x", "label": "mean"}]}]), 2),
    MONTHS_SQL + "SELECT o_orderstatus, round(avg(x), 2) AS mean FROM m GROUP BY ALL")
add("compose", lambda spark, d: (lambda got: rounded(got["a"].select(F.lit("a").alias("slot"), "n").unionByName(got["b"].select(F.lit("b").alias("slot"), "n"))))(
    batch.compose(table(spark, d, "orders"), {k: {"filterers": [{"type": "FILTER_INCLUDE", "field": "o_orderstatus", "params": {"values": [v]}}]} for k, v in (("a", "F"), ("b", "O"))}, {"aggregations": [{"type": "AGG_COUNT", "label": "n"}]})),
    "SELECT 'a' AS slot, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderstatus = 'O'")
add("banner", lambda spark, d: rounded(batch.banner(table(spark, d, "orders"), [{"type": "GROUP_CATEGORY", "field": "o_orderstatus"}], [{"type": "GROUP_CATEGORY", "field": "o_orderpriority"}], {"type": "AGG_SUM", "field": "o_totalprice", "label": "v"}), 2),
    """SELECT 'o_orderstatus' AS section, o_orderstatus AS row, 'Total' AS block, 'Total' AS "column", round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL
UNION ALL SELECT 'o_orderstatus', o_orderstatus, 'o_orderpriority', o_orderpriority, round(sum(o_totalprice), 2) FROM orders GROUP BY ALL""")  # fmt: skip
add("rake_weights", lambda spark, d: rounded(rake(table(spark, d, "orders"), {"o_orderstatus": {"F": 0.5, "O": 0.3, "P": 0.2}})[0].groupBy("o_orderstatus").agg((F.sum("weight")).alias("w")), 2),
    "SELECT o_orderstatus, round(CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.3 ELSE 0.2 END * (SELECT count(*) FROM orders), 2) AS w FROM orders GROUP BY ALL")
_specs = [
    ("uniform", {}), ("normal", {"mean": 3, "std": 2}), ("lognormal", {}), ("exponential", {"lambda": 2}), ("pareto", {"alpha": 3}), ("poisson", {"lambda": 4}),
    ("bernoulli", {"p": 0.3}), ("discrete", {"values": [1, 2, 5], "weights": [1, 2, 1]}), ("weighted_categorical", {"values": ["a", "b"]}), ("mixture", {"means": [0, 9], "stds": [1, 2], "weights": [1, 3]}),
    ("constant", {"value": 5}), ("monotonic_from", {"start": 10, "step": 2}), ("set_bernoulli", {"options": ["x", "y"], "frequencies": [0.5, 0.1]}),
    ("uniform_date", {"start": "2024-01-01", "end": "2024-12-31"}), ("uniform_datetime", {"start": "2024-01-01", "end": "2024-01-31", "weekday_weights": [1, 1, 1, 1, 1, 0, 0]}), ("regex", {"pattern": "[A-C]{2}-[0-9]{3}(x|yz)?"}),
]
for _name, _params in _specs:
    add(f"synth_{_name}", lambda spark, d, n=_name, p=_params: rounded(generate(spark, 1000, [{"name": "v", "distribution": n, "params": p}], 42)))
ORACLE_SQL["synth_monotonic_from"] = "SELECT 10 + 2 * i AS v FROM range(1000) r(i)"
ORACLE_SQL["synth_constant"] = "SELECT 5 AS v FROM range(1000)"
add("event_windows", lambda spark, d: rounded(event_windows(table(spark, d, "events"), "ts", "1 day", [{"type": "AGG_COUNT", "field": "value", "label": "n"}, {"type": "AGG_SUM", "field": "value", "label": "v"}], ["event_type"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "v"), 2),
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(value) AS n, round(coalesce(sum(value), 0), 2) AS v FROM events GROUP BY ALL")

from tessella import catalog_checks, catalog_more  # noqa: E402, F401  register the rest
