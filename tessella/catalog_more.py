"""Registered queries of sources and files, streams, batches of requests, extension points, and what a request binds."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import MONTHS_SQL, MONTHLY, add, rounded, table
from tessella.errors import RequestError
from tessella.operators import extend
from tessella.operators.joins import join
from tessella.operators.matrices import MATRICES
from tessella.operators.mmm import diagnose, hmc, nuts
from tessella.operators.overlays import overlay
from tessella.operators.slots import Slot
from tessella.operators.tests import TESTS
from tessella.plans import batch
from tessella.plans.request import explain, predict, process, recommend, request_hash, resolve_label, validate
from tessella.sources import io as files
from tessella.sources.scratch import put_bytes, scratch_folder
from tessella.streaming.streams import process_stream, watch

NATION = "n_nationkey int, n_name string, n_regionkey int"
NATION_SQL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def facts(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- formats


def round_trip(name: str, extension: str, **options) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_folder(spark)}/nation.{extension}"
        files.write(table(spark, sf_dir, "nation"), path)
        return files.read(spark, path, **options).select("n_nationkey", "n_name", "n_regionkey")

    add(name, make, NATION_SQL)


round_trip("io_csv", "csv")
round_trip("io_csv_schema", "csv", schema=NATION)
round_trip("io_tsv", "tsv")
round_trip("io_ndjson", "ndjson", schema=NATION)
round_trip("io_parquet", "parquet")
round_trip("io_orc", "orc")


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/nation.json"
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").collect()]
    put_bytes(spark, path, json.dumps(rows).encode())
    return files.read(spark, path, schema=NATION).drop("_corrupt")


def arrow_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.feather as feather

    path, out = f"{scratch_folder(spark)}/nation.feather", io.BytesIO()
    feather.write_feather(pa.Table.from_pandas(table(spark, sf_dir, "nation").toPandas(), preserve_index=False), out, compression="uncompressed")
    put_bytes(spark, path, out.getvalue())
    return files.read(spark, path)


def workbook(rows: list[list]) -> bytes:
    """A workbook with one sheet of inline texts."""
    cells = "".join(
        f"<row r=\"{k}\">{''.join(f'<c t=\"inlineStr\"><is><t>{v}</t></is></c>' for v in row)}</row>" for k, row in enumerate(rows, 1)
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="nations" sheetId="1" r:id="a"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/nation.xlsx"
    rows = [list(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    put_bytes(spark, path, workbook([["n_nationkey", "n_name", "n_regionkey"], *rows]))
    return files.read(spark, path, schema=NATION, sheet="nations")


add("io_json_array", json_array, NATION_SQL)
add("io_arrow", arrow_file, NATION_SQL)
add("io_excel", excel, NATION_SQL)
_paths = ["a.csv", "b/c.TSV", "d.jsonl", "e.json", "f.parquet", "g.feather", "h.arrow", "i.xlsx", "j.orc/"]
add("io_format_from_path", lambda spark, d: facts(spark, [(p, files.format_of(p)) for p in _paths], "path string, format string"),
    "SELECT * FROM (VALUES ('a.csv', 'csv'), ('b/c.TSV', 'tsv'), ('d.jsonl', 'ndjson'), ('e.json', 'json'), ('f.parquet', 'parquet'), ('g.feather', 'arrow'), ('h.arrow', 'arrow'), ('i.xlsx', 'excel'), ('j.orc/', 'orc')) t(path, format)")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/part.csv"
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    files.write(parts, path)
    got = files.read(spark, path, schema="p_partkey long, p_type string, a int, b double", sets={"p_type": " "}, vectors={"v": ["a", "b"]})
    return rounded(got.select("p_partkey", F.size("p_type").alias("words"), F.array_join("p_type", "|").alias("p_type"), F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b")), 2)


add("io_import_sets_vectors", folded, """SELECT p_partkey, CAST(len(s) AS INT) AS words, array_to_string(s, '|') AS p_type, CAST(p_size AS DOUBLE) AS a, round(p_retailprice, 2) AS b
FROM (SELECT *, list_sort(list_distinct(list_filter(string_split(p_type, ' '), lambda x: x <> ''))) AS s FROM part)""")

_wall = ["2024-03-31 02:30:00", "2024-07-01 12:00:00", "2024-10-27 02:30:00", "2024-12-01 00:00:00"]
add("io_import_dst_policy", lambda spark, d: facts(spark, [(t,) for t in _wall], "wall string").select(
    "wall", *(F.date_format(files.zoned(F.col("wall").cast("timestamp_ntz"), "Europe/Berlin", p), "yyyy-MM-dd HH:mm").alias(p) for p in ("earlier", "later", "null"))),
    """SELECT * FROM (VALUES ('2024-03-31 02:30:00', '2024-03-31 01:30', '2024-03-31 01:30', NULL), ('2024-07-01 12:00:00', '2024-07-01 10:00', '2024-07-01 10:00', '2024-07-01 10:00'),
 ('2024-10-27 02:30:00', '2024-10-27 00:30', '2024-10-27 01:30', NULL), ('2024-12-01 00:00:00', '2024-11-30 23:00', '2024-11-30 23:00', '2024-11-30 23:00')) t(wall, earlier, later, "null")""")  # fmt: skip


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/months.csv"
    host = process(table(spark, sf_dir, "orders"), MONTHLY).rows
    share = overlay(host, Slot("OVERLAY_SHARE_OF_TOTAL", None, "share", {"value": "x", "partition_by": ["o_orderstatus"]}))
    files.export(host, path, overlays={"share": share})
    got = files.read(spark, f"{path}.overlays/share", "csv", "m string, o_orderstatus string, x double, n long, share double")
    return rounded(got.select("m", "o_orderstatus", "share"))


add("io_export_overlays", exported, MONTHS_SQL + "SELECT m, o_orderstatus, round(x / sum(x) OVER (PARTITION BY o_orderstatus), 4) AS share FROM m")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    files.write(table(spark, sf_dir, "nation"), f"{folder}/a.csv")
    files.convert(spark, f"{folder}/a.csv", f"{folder}/b.parquet", schema=NATION)
    return files.read(spark, f"{folder}/b.parquet").select("n_nationkey", "n_name", "n_regionkey")


def transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/orders.parquet"
    files.transfer(table(spark, sf_dir, "orders"), path)
    return files.read(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


add("io_convert", converted, NATION_SQL)
add("io_transfer", transferred, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")


# ---- shards


def sharded(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_folder(spark)
    nation = table(spark, sf_dir, "nation")
    for k in range(3):
        files.add_shard(nation.where(F.col("n_regionkey") == k), path, f"r{k}")
    files.add_shard(nation.where("n_regionkey = 2 and n_nationkey > 8"), path, "r2")  # replaces
    return path


_shards_sql = "SELECT n_nationkey, n_name, n_regionkey, 'r' || n_regionkey AS shard FROM nation WHERE n_regionkey < 2 OR n_regionkey = 2 AND n_nationkey > 8"
add("io_shards", lambda spark, d: files.shards(spark, sharded(spark, d)), _shards_sql)


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_folder(spark)
    files.compact(spark, sharded(spark, sf_dir), target)
    return files.shards(spark, target)


def widened(spark: SparkSession, sf_dir: str, step: Callable) -> DataFrame:
    path = sharded(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    nation.where("n_regionkey = 3").select(F.col("n_nationkey").cast("long"), "n_name").write.parquet(f"{path}/shard=r3")
    return step(spark, path)


def _verified(spark: SparkSession, path: str) -> DataFrame:
    return facts(spark, [(r["shard"], r["rows"], ",".join(r["differs"])) for r in files.verify_shards(spark, path)], "shard string, rows long, differs string")


def _repaired(spark: SparkSession, path: str) -> DataFrame:
    files.shards(spark, path).where("shard = 'r1'").drop("shard").write.parquet(f"{path}/_new_shard=r9")  # interrupted before its move
    done = files.repair_shards(spark, path)
    return facts(spark, [(",".join(done), files.shards(spark, path).where("shard = 'r9'").count())], "repaired string, rows long")


add("io_shards_compact", compacted, _shards_sql)
add("io_shards_verify", lambda spark, d: widened(spark, d, _verified), """SELECT 'r' || n_regionkey AS shard, count(*) AS rows, CASE WHEN n_regionkey = 3 THEN 'n_regionkey' ELSE 'n_nationkey' END AS differs
FROM nation WHERE n_regionkey IN (0, 1, 3) OR n_regionkey = 2 AND n_nationkey > 8 GROUP BY n_regionkey""")
add("io_shards_widen", lambda spark, d: widened(spark, d, lambda s, p: (files.widen_shards(s, p), files.shards(s, p))[1]),
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey, shard FROM (" + _shards_sql + ") UNION ALL SELECT n_nationkey, n_name, NULL, 'r3' FROM nation WHERE n_regionkey = 3")
add("io_shards_repair", lambda spark, d: widened(spark, d, _repaired), "SELECT 'r0,r1,r2,r3,r9' AS repaired, count(*) AS rows FROM nation WHERE n_regionkey = 1")
add("io_dedup_advisory", lambda spark, d: (lambda a: facts(spark, [(a["rows"], a["repeated_share"] > 0, a["rewrites"])], "rows long, repeats boolean, rewrites boolean"))(
    files.dedup_advisory(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])), "SELECT count(*) AS rows, true AS repeats, false AS rewrites FROM lineitem")


def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    output = [
        {"field": "o_orderkey", "as": "id"}, {"field": "o_orderstatus", "as": "status", "recode": {"F": "done", "O": "open"}, "other": "rest"},
        {"field": "o_totalprice", "as": "size", "bucket": [50_000, 150_000]}, {"field": "o_totalprice", "as": "cents", "type": "decimal(20,2)"},
    ]
    files.materialize(table(spark, sf_dir, "orders"), path, output, shards=["status"])
    return files.read(spark, path, "parquet").select("id", "status", "size", F.col("cents").cast("double").alias("cents"))


add("io_materialize", materialized, """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'rest' END AS status,
 CAST(o_totalprice >= 50000 AS INT) + CAST(o_totalprice >= 150000 AS INT) AS size, round(o_totalprice, 2) AS cents FROM orders""")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, filters = scratch_folder(spark), [{"type": "FILTER_RANGE", "field": "n_regionkey", "params": {"values": [1, 2]}}]
    first = files.filter_to_file(spark, f"{sf_dir}/nation.parquet", filters, folder)
    again = files.filter_to_file(spark, f"{sf_dir}/nation.parquet", filters, folder)
    return files.read(spark, again).withColumn("reused", F.lit(first == again))


add("io_filter_to_file", filtered, "SELECT n_nationkey, n_name, n_regionkey, true AS reused FROM nation WHERE n_regionkey BETWEEN 1 AND 2")
add("io_inspect", lambda spark, d: facts(spark, [(r["name"], r["type"], r["logical"]) for r in files.inspect(table(spark, d, "nation"))], "name string, type string, logical string"),
    "SELECT * FROM (VALUES ('n_nationkey', 'int', 'integer'), ('n_name', 'string', 'categorical'), ('n_regionkey', 'int', 'integer')) t(name, type, logical)")
add("io_hadoop_path", lambda spark, d: files.read(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/region.parquet").toString()), "SELECT * FROM region")


# ---- results in pieces, watched folders

PRIORITY = {"groups": [{"type": "GROUP_CATEGORY", "field": "o_orderpriority"}], "aggregations": [{"type": "AGG_COUNT", "label": "n"}]}
PRIORITY_SQL = "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = list(process_stream(table(spark, sf_dir, "orders"), PRIORITY, chunk=2))
    rows = [r for p in pieces if p["kind"] == "rows" for r in p["rows"]]
    if pieces[0]["columns"] != ["o_orderpriority", "n"] or pieces[-1]["rows"] != len(rows):
        raise RequestError("process_stream: header or end don't match the rows")
    return facts(spark, rows, "o_orderpriority string, n long")


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, orders, seen = scratch_folder(spark), table(spark, sf_dir, "orders"), []
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{folder}/in")
    query = watch(spark, f"{folder}/in", orders.schema, PRIORITY, lambda df, k: seen.append([tuple(r) for r in df.collect()]), f"{folder}/checkpoint")
    try:
        query.processAllAvailable()
        orders.where("o_orderkey % 2 <> 0").write.mode("append").parquet(f"{folder}/in")
        query.processAllAvailable()
    finally:
        query.stop()
    return facts(spark, seen[-1], "o_orderpriority string, n long")


add("process_stream", streamed, PRIORITY_SQL)
add("watch", watched, PRIORITY_SQL)
add("compose_stream", lambda spark, d: facts(spark, [(n, r[0], r[1]) for n, rows in batch.compose_stream(table(spark, d, "orders"), {k: {"filterers": [{"type": "FILTER_INCLUDE", "field": "o_orderstatus", "params": {"values": [k]}}]} for k in "FO"}, base=PRIORITY) for r in rows], "slot string, o_orderpriority string, n long"),
    "SELECT o_orderstatus AS slot, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL")
_gates = {
    "sum": PRIORITY, "median": {"aggregations": [{"type": "AGG_MEDIAN", "field": "o_totalprice"}]},
    "rank": {"attributes": [{"type": "ATTR_PERCENTILE", "field": "o_totalprice", "label": "p"}]}, "sorted": {"sort": [{"field": "o_orderkey"}]},
}
add("passes", lambda spark, d: facts(spark, [(n, predict(table(spark, d, "orders"), r)["passes"]) for n, r in _gates.items()], "request string, passes string"),
    "SELECT * FROM (VALUES ('sum', 'streams'), ('median', 'two-pass'), ('rank', 'buffered'), ('sorted', 'buffered')) t(request, passes)")


# ---- batches of requests

add("compose_parallel", lambda spark, d: facts(spark, [(k, n) for k, n in batch.compose_parallel(table(spark, d, "orders"), {k: {"filterers": [{"type": "FILTER_INCLUDE", "field": "o_orderstatus", "params": {"values": [k]}}]} for k in "FOP"}, lambda n, rows: rows.first()["n"], base={"aggregations": [{"type": "AGG_COUNT", "label": "n"}]}).items()], "o_orderstatus string, n long"),
    "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
_line = {"m": {"type": "REG_OLS", "params": {"target": "l_extendedprice", "predictors": ["l_quantity"]}}}
_fitted = {"attributes": [{"type": "ATTR_FORMULA", "label": "v", "params": {"expression": 'coef("m", "(intercept)") + coef("m", "l_quantity") * l_quantity'}}], "aggregations": [{"type": "AGG_SUM", "field": "v", "label": "v"}, {"type": "AGG_MAX", "field": "v", "label": "most"}]}
add("compose_fits", lambda spark, d: rounded(batch.compose(table(spark, d, "lineitem"), {"a": _fitted}, fits=_line)["a"], 0),
    "SELECT round(sum(a + b * l_quantity), 0) AS v, round(max(a + b * l_quantity), 0) AS most FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)")
_axes = {"a": [1, 2, 3], "b": [10, 20]}
add("sweep_grid", lambda spark, d: facts(spark, [(p["a"], p["b"]) for p in batch.sweep(_axes)], "a int, b int"), "SELECT a, b FROM (VALUES (1), (2), (3)) x(a), (VALUES (10), (20)) y(b)")
add("sweep_zip", lambda spark, d: facts(spark, [(p["a"], p["b"]) for p in batch.sweep({"a": [1, 2], "b": [10, 20]}, "zip")], "a int, b int"), "SELECT * FROM (VALUES (1, 10), (2, 20)) t(a, b)")
add("sweep_lhs", lambda spark, d: facts(spark, [(int(p["a"] * 8), 1) for p in batch.sweep({"a": [0.0, 1.0], "b": [5.0, 6.0]}, "lhs", 8, 3)], "cell int, n int"),
    "SELECT CAST(i AS INT) AS cell, 1 AS n FROM range(8) r(i)")
add("sweep_random", lambda spark, d: facts(spark, [(len(ps := batch.sweep({"a": [2.0, 3.0]}, "random", 50, 3)), all(2 <= p["a"] < 3 for p in ps))], "n int, inside boolean"), "SELECT 50 AS n, true AS inside")
add("sweep_rank", lambda spark, d: facts(spark, [(p["a"], p["b"], p["value"], p["rank"]) for p in batch.rank(batch.sweep(_axes), lambda p: float(abs(p["a"] * 10 - p["b"])))], "a int, b int, value double, rank int"),
    "SELECT a, b, CAST(abs(a * 10 - b) AS DOUBLE) AS value, CAST(rank() OVER (ORDER BY abs(a * 10 - b)) AS INT) AS rank FROM (VALUES (1), (2), (3)) x(a), (VALUES (10), (20)) y(b)")
_bowl = lambda p: (p["x"] - 1.5) ** 2 + (p["y"] + 0.5) ** 2 + 3
_box = {"x": (-4.0, 4.0), "y": (-4.0, 4.0)}
add("sweep_adaptive", lambda spark, d: facts(spark, [tuple(abs(round(v, 2)) * (1 if v > 0 else -1) for v in (g[0]["x"], g[0]["y"], g[1])) for g in [batch.adaptive(_bowl, _box, 60)]], "x double, y double, value double"), "SELECT 1.5::DOUBLE AS x, -0.5::DOUBLE AS y, 3.0::DOUBLE AS value")
add("sweep_bayesian", lambda spark, d: facts(spark, [(abs(g[0]["x"] - 1.5) < 0.2, abs(g[0]["y"] + 0.5) < 0.2, g[1] < 3.05) for g in [batch.bayesian(_bowl, _box)]], "x boolean, y boolean, value boolean"), "SELECT true AS x, true AS y, true AS value")


def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two square-root responses under a budget: spend goes as the squared coefficients do."""
    got = batch.optimize(lambda x: float(3 * np.sqrt(x[0] + 1e-9) + 4 * np.sqrt(x[1] + 1e-9)), [50.0, 50.0], [(0.0, 100.0), (0.0, 100.0)], 100.0)
    return facts(spark, [(float(round(got["x"][0], 1)), float(round(got["x"][1], 1)), float(round(got["value"], 3)))], "a double, b double, value double")


add("compose_optimize", best_split, "SELECT 36.0::DOUBLE AS a, 64.0::DOUBLE AS b, 50.0::DOUBLE AS value")


def after_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {n: {"coefficients": {"a": v}} for n, v in (("one", 2.0), ("two", 6.0))}
    batch.POST_FITS.setdefault("mean_coefficient", lambda fits, params: {"value": sum(f["coefficients"][params["term"]] for f in fits.values()) / len(fits)})
    got = batch.post_fit(models, [{"type": "mean_coefficient", "fits": ["one", "two"], "params": {"term": "a"}, "label": "m"}])
    return facts(spark, [(n, r["value"]) for n, r in got.items()], "label string, value double")


add("post_fit", after_fits, "SELECT 'm' AS label, 4.0::DOUBLE AS value")
_each = {"filterers": [{"type": "FILTER_INCLUDE", "field": "o_orderstatus", "params": {"values": [{"$param": "s"}]}}], "aggregations": [{"type": "AGG_COUNT", "label": "n"}]}
add("for_each", lambda spark, d: facts(spark, [(k, process(table(spark, d, "orders"), r).rows.first()["n"]) for k, r in batch.for_each(_each, "s", ["F", "P"]).items()], "item string, n long"),
    "SELECT o_orderstatus AS item, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL")
_template = {"params": {"field": "o_totalprice", "low": 100000}, "filterers": [{"type": "FILTER_EXPRESSION", "params": {"expression": "{{field}} > {{ low }}"}}], "aggregations": [{"type": "AGG_COUNT", "label": "n"}]}
add("template", lambda spark, d: process(table(spark, d, "orders"), _template).rows, "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
add("return_shaping", lambda spark, d: process(table(spark, d, "supplier"), {"exclude": ["s_name", "s_nationkey"], "precision": 1}).rows, "SELECT s_suppkey, round(s_acctbal, 1) AS s_acctbal FROM supplier")
_bad = {"aggregations": [{"type": "AGG_SUM", "field": "no_such"}]}
add("predict", lambda spark, d: facts(spark, [("good", len(predict(table(spark, d, "orders"), PRIORITY)["errors"]), str(predict(table(spark, d, "orders"), PRIORITY)["columns"])), ("bad", len(validate(table(spark, d, "orders"), _bad)), "")], "request string, errors int, columns string"),
    "SELECT 'good' AS request, 0 AS errors, '[(''o_orderpriority'', ''string''), (''n'', ''bigint'')]' AS columns UNION ALL SELECT 'bad', 1, ''")
add("explain", lambda spark, d: facts(spark, [(k, s) for k, s in enumerate(explain(PRIORITY))], "step int, sentence string"),
    "SELECT 0 AS step, 'groups by GROUP_CATEGORY of o_orderpriority' AS sentence UNION ALL SELECT 1, 'computes AGG_COUNT as n'")
add("recommend", lambda spark, d: facts(spark, [(r["groups"][0]["type"], r["groups"][0]["field"], len(validate(table(spark, d, "orders"), r))) for r in recommend(table(spark, d, "orders"))], "grouper string, field string, errors int"),
    "SELECT * FROM (VALUES ('GROUP_CATEGORY', 'o_orderpriority', 0), ('GROUP_CATEGORY', 'o_orderstatus', 0), ('GROUP_DATE', 'o_orderdate', 0)) t(grouper, field, errors)")
_labels = [("a", "Very Satisfied"), ("b", "Satisfied"), ("c", "Dissatisfied"), ("d", "Blue")]
add("labels_resolve", lambda spark, d: resolve_label(facts(spark, _labels, "code string, label string"), "satisfied", 2).select("code", (F.col("score") == 1).alias("same")),
    "SELECT * FROM (VALUES ('b', true), ('a', false)) t(code, same)")
_many = {"groups": [{"type": "GROUP_CATEGORY", "field": "o_orderstatus", "label": f"k{i}"} for i in range(17)]}
add("limits", lambda spark, d: facts(spark, [("keys", any("at most 16" in e for e in predict(table(spark, d, "orders"), _many)["errors"]))], "what string, refused boolean"), "SELECT 'keys' AS what, true AS refused")
add("request_hash", lambda spark, d: facts(spark, [(request_hash({"a": 1, "b": [2]}) == request_hash({"b": [2], "a": 1}), request_hash({"a": 1}) == request_hash({"a": 2}))], "same boolean, other boolean"), "SELECT true AS same, false AS other")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normal density with means 2 and -1, deviations 0.5 and 2, by either sampler, from two chains."""
    density = lambda q: float(-((q[0] - 2) ** 2) / 0.5 - (q[1] + 1) ** 2 / 8)
    out = []
    for name, run in (("hmc", hmc), ("nuts", nuts)):
        chains = [run(density, np.zeros(2), 1500, 500, k)[0] for k in (7, 8)]
        both, (rhat, _) = np.concatenate(chains), diagnose(chains)
        out.append((name, bool((abs(both.mean(0) - [2, -1]) < [0.1, 0.4]).all()), bool((abs(both.std(0) - [0.5, 2]) < [0.1, 0.4]).all()), bool((rhat < 1.05).all())))
    return facts(spark, out, "sampler string, mean boolean, sd boolean, rhat boolean")


add("mcmc", sampled, "SELECT s AS sampler, true AS mean, true AS sd, true AS rhat FROM (VALUES ('hmc'), ('nuts')) t(s)")


# ---- what expressions bind, sets, and joins


def formula(name: str, source: str, expression: str, sql: str, digits: int = 4, derive: Callable | None = None, keep: list[str] | None = None, **params) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = derive(df) if derive else df
        req = {"attributes": [{"type": "ATTR_FORMULA", "label": "v", "params": {"expression": expression, **params}}]}
        return rounded(process(df, req).rows.select(*(keep or [df.columns[0]]), "v"), digits)

    add(name, make, sql)


_sets = lambda df: df.select("p_partkey", F.split("p_brand", "").alias("a"), F.split("p_type", "").alias("b"))
_sets_sql = "(SELECT p_partkey, list_distinct(list_filter(string_split(p_brand, ''), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(p_type, ''), lambda x: x <> '')) AS b FROM part)"
_distinct = lambda df: _sets(df).select("p_partkey", *(F.array_distinct(F.filter(c, lambda x: x != "")).alias(c) for c in "ab"))
_and, _or = "len(list_intersect(a, b))", "len(list_distinct(list_concat(a, b)))"
for _name, _expression, _sql in (
    ("union", "popcount(set_union(a, b))", _or), ("intersect", "popcount(set_intersect(a, b))", _and), ("diff", "popcount(set_diff(a, b))", f"len(a) - {_and}"),
    ("xor", "popcount(set_xor(a, b))", f"{_or} - {_and}"), ("jaccard", "jaccard(a, b)", f"{_and} / CAST({_or} AS DOUBLE)"), ("dice", "dice(a, b)", f"2.0 * {_and} / (len(a) + len(b))"),
    ("overlap", "overlap(a, b)", f"CAST({_and} AS DOUBLE) / least(len(a), len(b))"), ("hamming", "hamming(a, b)", f"{_or} - {_and}"),
    ("has", "(has_any(a, b) ? 1 : 0) + (has_all(a, b) ? 2 : 0) + (has_none(a, b) ? 4 : 0)", f"CASE WHEN {_and} > 0 THEN 1 ELSE 4 END + CASE WHEN {_and} = len(b) THEN 2 ELSE 0 END"),
):
    formula(f"expr_set_{_name}", "part", _expression, f"SELECT p_partkey, round(CAST({_sql} AS DOUBLE), 4) AS v FROM {_sets_sql}", derive=_distinct)
formula("expr_range_label", "supplier", 'range_label("band", s_acctbal, "none") == "low" ? 1 : range_label("band", s_acctbal, "none") == "mid" ? 2 : 3',
        "SELECT s_suppkey, CAST(CASE WHEN s_acctbal < 1000 THEN 1 WHEN s_acctbal < 5000 THEN 2 ELSE 3 END AS DOUBLE) AS v FROM supplier", lookups={"band": [(None, 1000, "low"), (1000, 5000, "mid")]})
formula("expr_ref", "nation", 'dot(ref("profile", n_regionkey), [1, 10])', "SELECT n_nationkey, CAST(n_regionkey + 10 * (n_regionkey + 1) AS DOUBLE) AS v FROM nation", lookups={"profile": {str(k): [k, k + 1] for k in range(5)}})
formula("expr_total", "supplier", "s_acctbal / total(s_acctbal)", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (), 4) AS v FROM supplier")
formula("expr_from_json", "events", 'int(fromJSON(note).k) * 2', "SELECT event_id, CAST(2 * event_id AS DOUBLE) AS v FROM events", derive=lambda df: df.select("event_id", F.to_json(F.struct(F.col("event_id").alias("k"))).alias("note")))
formula("expr_duration", "events", 'to_day(at + duration("36h")) - to_day(at)', "SELECT event_id, CAST(CAST(ts + INTERVAL 36 HOUR AS DATE) - CAST(ts AS DATE) AS DOUBLE) AS v FROM events", derive=lambda df: df.select("event_id", F.col("ts").alias("at")))
_models = {"m": {"coefficients": {"tv": 5.0, "tv.half": 2.0, "tv.shape": 1.0}, "se": [0.5, 0.1, 0.1], "swept": {"lag": 3}}, "done": {"total": 7.0}}
formula("expr_models", "nation", 'response("m", "tv", n_regionkey) + coef("m", "tv", "se") + sweep_axis("m", "lag") + result("done", "total")',
        "SELECT n_nationkey, round(5.0 * n_regionkey / (n_regionkey + 2) + 10.5, 4) AS v FROM nation", models=_models)


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    texts = ["n_nationkey + ", "no_such + 1", "nothing(n_nationkey)", "n_nationkey + 1"]
    ask = lambda e: validate(df, {"attributes": [{"type": "ATTR_FORMULA", "label": "v", "params": {"expression": e}}]})
    return facts(spark, [(t, len(ask(t))) for t in texts], "expression string, errors int")


add("expr_compile", refusals, "SELECT * FROM (VALUES ('n_nationkey + ', 1), ('no_such + 1', 1), ('nothing(n_nationkey)', 1), ('n_nationkey + 1', 0)) t(expression, errors)")


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    left = lines.withColumn("l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")))  # null keys never match
    joined = join(left, lines, {"on": ["l_orderkey", "l_linenumber"], "as": "other"})
    return rounded(joined.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity") - F.col("other_l_quantity")).alias("gap")), 2)


def refused_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tries = {
        "text with number": (nation, region, {"on": [("n_name", "r_regionkey")]}), "decimal with number": (nation.withColumn("k", F.col("n_regionkey").cast("decimal(18,2)")), region, {"on": [("k", "r_regionkey")]}),
        "one name twice": (nation.withColumnRenamed("n_name", "r_name"), region, {"on": [("n_regionkey", "r_regionkey")]}), "prefixed": (nation.withColumnRenamed("n_name", "r_name"), region, {"on": [("n_regionkey", "r_regionkey")], "as": "r"}),
    }
    out = []
    for name, args in tries.items():
        try:
            out.append((name, join(*args).count()))
        except RequestError:
            out.append((name, -1))
    return facts(spark, out, "case string, rows long")


add("join_composite", composite, "SELECT count(*) AS n, 0.0::DOUBLE AS gap FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_linenumber > 1")
add("join_refusals", refused_joins, 'SELECT * FROM (VALUES (\'text with number\', -1), (\'decimal with number\', -1), (\'one name twice\', -1), (\'prefixed\', 25)) t("case", rows)')

_axis = [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}, {"type": "GROUP_CATEGORY", "field": "l_linestatus"}]
_lines_sql = "(SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL)"


def shares(name: str, normalize: str, over: str, **more) -> None:
    spec = {"rows": _axis, "columns": [{"type": "GROUP_CATEGORY", "field": "l_linenumber"}], "cell": {"type": "AGG_COUNT", "label": "v"}, "normalize": normalize, **more}
    add(name, lambda spark, d: rounded(process(table(spark, d, "lineitem"), {"crosstab": spec}).rows), f"SELECT l_returnflag, l_linestatus, l_linenumber, 'cell' AS _margin, round(k / CAST(sum(k) OVER (PARTITION BY {over}) AS DOUBLE), 4) AS v FROM {_lines_sql}")


shares("crosstab_normalize_level", "row", "l_returnflag", normalize_level=0)
shares("crosstab_normalize_within", "column", "l_linenumber, l_returnflag", normalize_within=0)
_margins = {"rows": _axis[:1], "columns": _axis[1:], "cell": {"type": "AGG_COUNT", "label": "n"}, "margins": ["row", "grand"], "margin_aggregations": [{"type": "AGG_AVERAGE", "field": "l_quantity", "label": "mean"}, {"type": "AGG_MEDIAN", "field": "l_quantity", "label": "median"}]}
add("crosstab_margin_aggregations", lambda spark, d: rounded(process(table(spark, d, "lineitem"), {"crosstab": _margins}).rows),
    """SELECT l_returnflag, l_linestatus, CASE grouping_id(l_returnflag, l_linestatus) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' ELSE 'grand' END AS _margin, count(*) AS n,
 CASE WHEN grouping_id(l_returnflag, l_linestatus) > 0 THEN round(avg(l_quantity), 4) END AS mean, CASE WHEN grouping_id(l_returnflag, l_linestatus) > 0 THEN quantile_cont(l_quantity, 0.5) END AS median
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")  # fmt: skip
add("banner_letters", lambda spark, d: batch.banner(table(spark, d, "orders"), [{"type": "GROUP_CATEGORY", "field": "o_orderstatus"}], [{"type": "GROUP_DATE", "field": "o_orderdate", "label": "year", "params": {"component": "year"}}], {"type": "AGG_COUNT", "label": "n"}, letters=0.05),
    """WITH c AS (SELECT o_orderstatus AS row, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n FROM orders GROUP BY ALL),
 p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS b, chr(CAST(96 + dense_rank() OVER (ORDER BY y) AS INT)) AS letter FROM c),
 w AS (SELECT u.row, u.y, string_agg(v.letter, ' ' ORDER BY v.letter) AS letters FROM p u JOIN p v ON u.row = v.row AND u.y <> v.y
  WHERE (u.n / u.b - v.n / v.b) / sqrt((u.n + v.n) / (u.b + v.b) * (1 - (u.n + v.n) / (u.b + v.b)) * (1 / u.b + 1 / v.b)) > 1.959963984540054 GROUP BY ALL)
SELECT 'o_orderstatus' AS section, row, 'year' AS block, y AS "column", n, coalesce(letters, '') AS letters FROM p LEFT JOIN w USING (row, y)
UNION ALL SELECT 'o_orderstatus', o_orderstatus, 'Total', 'Total', count(*), '' FROM orders GROUP BY ALL""")  # fmt: skip


# ---- operators of one's own; a name is registered once


def _once(register: Callable, name: str, *args) -> None:
    try:
        register(name, *args)
    except RequestError:
        pass  # an earlier call in this interpreter


def own_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_aggregator, "AGG_MIDRANGE", lambda s: float((s.min() + s.max()) / 2))
    req = {"groups": [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}], "aggregations": [{"type": "AGG_MIDRANGE", "field": "l_quantity", "label": "v"}]}
    return rounded(process(table(spark, sf_dir, "lineitem"), req).rows)


def own_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_attribute, "ATTR_TWICE", lambda s: s * 2.0)
    return rounded(process(table(spark, sf_dir, "supplier"), {"attributes": [{"type": "ATTR_TWICE", "field": "s_acctbal", "label": "v"}], "select": ["s_suppkey", "v"]}).rows, 2)


def own_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_feature, "FEAT_PARITY", lambda df, slot: df.withColumn(slot.label, F.col(slot.field) % 2))
    return process(table(spark, sf_dir, "supplier"), {"features": [{"type": "FEAT_PARITY", "field": "s_suppkey", "label": "v"}], "select": ["s_suppkey", "v"]}).rows


def own_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_filter, "FILTER_MULTIPLE", lambda df, slot: F.col(slot.field) % int(slot.need("of")) == 0)
    return process(table(spark, sf_dir, "supplier"), {"filterers": [{"type": "FILTER_MULTIPLE", "field": "s_suppkey", "params": {"of": 7}}], "select": ["s_suppkey"]}).rows


def own_grouper(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_grouper, "GROUP_LETTERS", lambda df, slot: F.array(F.substring(slot.field, 1, 1), F.lit("any")), True)
    req = {"groups": [{"type": "GROUP_LETTERS", "field": "n_name", "label": "k"}], "aggregations": [{"type": "AGG_COUNT", "label": "n"}]}
    return process(table(spark, sf_dir, "nation"), req).rows


def own_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_window, "WIN_DOUBLING", lambda part: part["s_acctbal"].cumsum())
    req = {"windows": [{"type": "WIN_DOUBLING", "field": "s_acctbal", "label": "v", "params": {"partition_by": ["s_nationkey"], "order_by": ["s_suppkey"]}}], "select": ["s_suppkey", "v"]}
    return rounded(process(table(spark, sf_dir, "supplier"), req).rows, 2)


def own_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_test, "TEST_SIGN", lambda df, slot: {"statistic": float(df.where(F.col(slot.field) > 0).count()), "p": None})
    return facts(spark, [(TESTS.find("TEST_SIGN")(table(spark, sf_dir, "supplier"), Slot("TEST_SIGN", "s_acctbal"))["statistic"],)], "statistic double")


def own_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_matrix, "MAT_COUNTS", lambda df, slot: {c: df.where(F.col(c).isNotNull()).count() for c in slot.need("members")})
    got = MATRICES.find("MAT_COUNTS")(table(spark, sf_dir, "supplier"), Slot("MAT_COUNTS", None, None, {"members": ["s_acctbal", "s_nationkey"]}))
    return facts(spark, list(got.items()), "member string, n long")


def own_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_overlay, "OVERLAY_HALF", lambda df, slot, other=None: df.withColumn(slot.name(), F.col(slot.need("value")) / 2))
    return overlay(process(table(spark, sf_dir, "orders"), PRIORITY).rows, Slot("OVERLAY_HALF", None, "o", {"value": "n"}))


def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    _once(extend.add_function, "thrice", lambda x: x * 3)
    req = {"attributes": [{"type": "ATTR_FORMULA", "label": "v", "params": {"expression": "thrice(n_nationkey)"}}], "select": ["n_nationkey", "v"]}
    return process(table(spark, sf_dir, "nation"), req).rows


add("extend_aggregator", own_aggregator, "SELECT l_returnflag, round((min(l_quantity) + max(l_quantity)) / 2, 4) AS v FROM lineitem GROUP BY ALL")
add("extend_attribute", own_attribute, "SELECT s_suppkey, round(s_acctbal * 2, 2) AS v FROM supplier")
add("extend_feature", own_feature, "SELECT s_suppkey, s_suppkey % 2 AS v FROM supplier")
add("extend_filter", own_filter, "SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0")
add("extend_grouper", own_grouper, "SELECT n_name[1:1] AS k, count(*) AS n FROM nation GROUP BY ALL UNION ALL SELECT 'any', count(*) FROM nation")
add("extend_window", own_window, "SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 2) AS v FROM supplier")
add("extend_test", own_test, "SELECT CAST(count(*) AS DOUBLE) AS statistic FROM supplier WHERE s_acctbal > 0")
add("extend_matrix", own_matrix, "SELECT 's_acctbal' AS member, count(s_acctbal) AS n FROM supplier UNION ALL SELECT 's_nationkey', count(s_nationkey) FROM supplier")
add("extend_overlay", own_overlay, "SELECT o_orderpriority, count(*) AS n, count(*) / 2.0::DOUBLE AS o FROM orders GROUP BY ALL")
add("extend_function", own_function, "SELECT n_nationkey, CAST(3 * n_nationkey AS DOUBLE) AS v FROM nation")
