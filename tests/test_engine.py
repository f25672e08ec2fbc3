"""The request engine on small tables: null rules, refusals, and closed forms."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.errors import RequestError
from tessella.functions import dist
from tessella.functions.running import mid_ranks, running_totals
from tessella.operators.joins import join, union
from tessella.operators.matrices import MATRICES, factor_fit
from tessella.operators.overlays import markov, overlay, rake_matrix, symmetry
from tessella.operators.regressions import REGRESSIONS
from tessella.operators.slots import Slot
from tessella.operators.tests import TESTS, run_tests
from tessella.plans.batch import adaptive, banner, chain, compose, for_each, optimize, sweep
from tessella.plans.request import explain, process, request_hash, validate
from tessella.sources.io import filter_to_file, inspect, rake, read, write
from tessella.sources.synth import generate, profile


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "a", 1.0, True, ["x", "y"], dt.date(2024, 1, 1)),
        (2, "b", None, False, [], dt.date(2023, 12, 31)),
        (3, "a", 3.0, None, None, None),
        (4, None, float("nan"), True, ["y"], dt.date(2027, 1, 1)),
        (5, "b", 3.0, False, ["x"], dt.date(1969, 7, 20)),
    ]
    return spark.createDataFrame(rows, "id long, g string, v double, ok boolean, tags array<string>, d date").cache()


def ids(df, *filters):
    return sorted(r["id"] for r in process(df, {"filterers": list(filters)}).rows.collect())


def test_filters_and_nulls(people):
    def of(op, field, **params):
        return ids(people, {"type": op, "field": field, "params": params})

    assert of("FILTER_INCLUDE", "g", values=["a"]) == [1, 3]
    assert of("FILTER_EXCLUDE", "g", values=["a"]) == [2, 4, 5]
    assert of("FILTER_NULL", "v", values=["null"]) == [2]
    assert of("FILTER_RANGE", "v", values=[1, 3]) == [1, 3, 5]
    assert of("FILTER_TRUE", "ok") == [1, 4]
    assert of("FILTER_FALSE", "ok") == [2, 5]
    assert of("FILTER_FALSE", "v", values=["truthy"]) == [2, 4]
    assert of("FILTER_SET_CONTAINS_ANY", "tags", values=["x"]) == [1, 5]
    assert of("FILTER_SET_CONTAINS_ALL", "tags", values=[]) == [1, 2, 4, 5]
    assert of("FILTER_SET_CONTAINS_NONE", "tags", values=["x"]) == [2, 3, 4]
    assert of("FILTER_SET_EQUALS", "tags", values=[]) == [2]
    assert of("FILTER_EXPRESSION", None, expression="v > 2 or g == nil") == [3, 4, 5]
    ranges = [{"label": "r", "start": "2023-12-31", "end": "2024-01-01"}]
    assert of("FILTER_DATE_RANGES", "d", ranges=ranges) == [1, 2]


def test_refusals(people):
    bad = [
        {"filterers": [{"type": "FILTER_TRUE", "field": "v"}]},
        {"aggregations": [{"type": "AGG_SUM", "field": "tags"}]},
        {"aggregations": [{"type": "NO_SUCH", "field": "v"}]},
        {"attributes": [{"type": "ATTR_FORMULA", "label": "f", "params": {"expression": "nothing + 1"}}]},
        {"unknown": []},
        {"filterers": [{"type": "FILTER_DATE_RANGES", "field": "d", "params": {"ranges": [{"label": "a", "start": "2024-01-01", "end": "2024-02-01"}, {"label": "b", "start": "2024-01-15", "end": "2024-03-01"}]}}]},
    ]
    for request in bad:
        assert validate(people, request)
    assert validate(people, {"aggregations": [{"field": "v"}]}) == []


def test_groups_drop_null_keys_and_keep_order(people):
    req = {"groups": [{"type": "GROUP_CATEGORY", "field": "g"}], "aggregations": [{"type": "AGG_SUM", "field": "id", "label": "s"}, {"type": "AGG_NULL_COUNT", "field": "v", "label": "n"}]}
    assert [tuple(r) for r in process(people, req).rows.collect()] == [("a", 4.0, 0), ("b", 7.0, 1)]
    week = process(people, {"groups": [{"type": "GROUP_DATE", "field": "d", "params": {"component": "week"}}], "aggregations": [{"type": "AGG_COUNT", "field": "id", "label": "n"}]})
    assert [r[0] for r in week.rows.collect()] == ["1969-W29", "2023-W52", "2024-W01", "2026-W53"]


def test_empty_aggregates(people):
    none = {"filterers": [{"type": "FILTER_RANGE", "field": "id", "params": {"values": [100, 200]}}]}
    row = process(people, {**none, "aggregations": [{"type": f"AGG_{k}", "field": "v", "label": k} for k in ("SUM", "AVERAGE", "MIN", "STDDEV", "SKEWNESS", "COUNT")]}).rows.first()
    assert row.asDict() == {"SUM": 0.0, "AVERAGE": None, "MIN": None, "STDDEV": None, "SKEWNESS": None, "COUNT": 0}


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 4.0), ("b", 1, 2.0)], "k string, t int, x double")
    how = {"partition_by": ["k"], "order_by": ["t"]}
    rows = process(df, {"windows": [{"type": "WIN_EWMA", "field": "x", "label": "e", "params": {**how, "alpha": 0.5}}, {"type": "WIN_DISTRIBUTED_LAG", "field": "x", "label": "d", "params": {**how, "decay": 0.5, "max_lag": 2}}]}).rows
    assert sorted(map(tuple, rows.select("k", "t", "e", "d").collect())) == [("a", 1, 1.0, 1.0), ("a", 2, None, None), ("a", 3, 2.5, 4.25), ("b", 1, 2.0, 2.0)]
    with pytest.raises(RequestError):
        process(df, {"windows": [{"type": "WIN_MOVING_AVG", "field": "x", "params": {**how, "frame": {"preceding": 1}}}]})


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    for req in (
        {"attributes": [{"type": "ATTR_PERCENTILE", "field": "x", "label": "p", "params": {"tie": "id"}}], "select": ["id", "p"]},
        {"groups": [{"type": "GROUP_QUANTILE", "field": "x", "params": {"interval": 10}}], "aggregations": [{"type": "AGG_COUNT", "field": "id", "label": "n"}]},
        {"features": [{"type": "FEAT_TRAIN_TEST_SPLIT", "params": {"key": "id"}}], "select": ["id", "split"]},
    ):
        one, many = (sorted(map(tuple, process(df.repartition(n), req).rows.collect())) for n in (1, 17))
        assert one == many


def test_running_totals_and_ranks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 400).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    ranks = {r["value"]: r["rank"] for r in mid_ranks(df, "x").collect()}
    for v in set(x):
        assert ranks[v] == (x < v).sum() + ((x == v).sum() + 1) / 2
    counts = df.groupBy("x").agg(F.count("*").alias("n"))
    assert all(r["b"] == (x < r["x"]).sum() for r in running_totals(counts, "x", {"b": F.col("n")}).collect())


def test_weights_equal_repeated_rows(spark):
    rows = [(1.0, 2), (4.0, 1), (9.0, 3), (100.0, 0)]
    weighted = spark.createDataFrame(rows, "x double, w int")
    repeated = spark.createDataFrame([(x, 1) for x, w in rows for _ in range(w)], "x double, w int")
    slots = [{"type": f"AGG_{k}", "field": "x", "label": k} for k in ("COUNT", "SUM", "AVERAGE", "VARIANCE")]
    a = process(weighted, {"aggregations": slots, "weight": "w", "weight_kind": "frequency"}).rows.first()
    b = process(repeated, {"aggregations": slots}).rows.first()
    assert all(math.isclose(x, y) for x, y in zip(a, b))


def test_joins_and_unions(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "id int, x double")
    b = spark.createDataFrame([(1, 5.0), (None, 6.0), (3, 7.0)], "id int, x double")
    assert [tuple(r) for r in join(a, b, {"on": ["id"], "as": "r"}).collect()] == [(1, 1.0, 5.0)]
    with pytest.raises(RequestError):
        join(a, b, {"on": ["id"]})
    with pytest.raises(RequestError):
        join(a, b.withColumn("id", F.col("id").cast("string")), {"on": ["id"], "as": "r"})
    assert union({"a": a, "b": b}).groupBy("_source").count().count() == 2
    with pytest.raises(RequestError):
        union({"a": a, "b": b.drop("x")})


def test_distributions():
    assert math.isclose(dist.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(dist.t_tail(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(dist.f_tail(4.0, 2, 12), 0.046656, rel_tol=1e-4)
    assert math.isclose(dist.chisq_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.t_quantile(0.975, 5), 2.570581836, rel_tol=1e-8)
    assert math.isclose(dist.tukey_tail(3.877676, 3, 10), 0.05, rel_tol=2e-3)
    assert dist.adjust([0.01, 0.04, None, 0.03], "holm") == pytest.approx([0.03, 0.06, None, 0.06])
    assert dist.adjust([0.01, 0.04, 0.03], "bh") == pytest.approx([0.03, 0.04, 0.04])


def test_hypothesis_tests(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 40), rng.normal(0.8, 2, 30)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, x double")
    got = TESTS["TEST_WELCH"](df, Slot("TEST_WELCH", "x", None, {"split_by": "g"}))
    se = math.sqrt(a.var(ddof=1) / 40 + b.var(ddof=1) / 30)
    assert math.isclose(got["statistic"], (a.mean() - b.mean()) / se)
    u = TESTS["TEST_MANN_WHITNEY_U"](df, Slot("TEST_MANN_WHITNEY_U", "x", None, {"split_by": "g"}))
    assert u["statistic"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = run_tests(df, [{"type": "TEST_WELCH", "field": "x", "params": {"split_by": "g"}}, {"type": "TEST_KS", "field": "x", "params": {"split_by": "g"}}], "holm")
    assert all(r["p_adjusted"] >= r["p"] for r in both)


def test_fisher_and_kendall(spark):
    rows = [("y", "t")] * 3 + [("y", "f")] * 1 + [("n", "t")] * 1 + [("n", "f")] * 3
    df = spark.createDataFrame(rows, "a string, b string")
    assert math.isclose(TESTS["TEST_FISHER_EXACT"](df, Slot("t", None, None, {"rows": "a", "cols": "b"}))["p"], 0.4857142857, rel_tol=1e-8)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0)], "x double, y double")
    assert math.isclose(TESTS["TEST_KENDALL_TAU"](pairs, Slot("t", "x", None, {"field2": "y"}))["statistic"], 0.6)


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=300)
    p = 1 / (1 + np.exp(-(0.3 + x @ [1, -0.5])))
    z = (rng.random(300) < p).astype(float)
    rows = [(i, float(a), float(b), float(c), float(d), "lmh"[min(2, int(max(0, c + 1)))]) for i, (a, b, c, d) in enumerate(zip(x[:, 0], x[:, 1], y, z))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, z double, o string").cache(), x, y, z


def test_least_squares(design):
    df, x, y, _ = design
    full = np.column_stack([np.ones(len(y)), x])
    beta, rss = np.linalg.lstsq(full, y, rcond=None)[:2]
    fit = REGRESSIONS["REG_OLS"](df, Slot("REG_OLS", None, None, {"target": "y", "predictors": ["a", "b"]}))
    assert np.allclose(list(fit["coefficients"].values()), beta)
    assert np.allclose(fit["se"], np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rss / (len(y) - 3)))
    hc = REGRESSIONS["REG_OLS"](df, Slot("REG_OLS", None, None, {"target": "y", "predictors": ["a", "b"], "covariance": "hc0"}))
    e, inner = y - full @ beta, np.linalg.inv(full.T @ full)
    assert np.allclose(hc["se"], np.sqrt(np.diag(inner @ (full.T * e**2) @ full @ inner)))
    lasso = REGRESSIONS["REG_OLS"](df, Slot("REG_OLS", None, None, {"target": "y", "predictors": ["a", "b"], "penalty": "l1", "alpha": 10.0}))
    assert lasso["coefficients"]["a"] == lasso["coefficients"]["b"] == 0


def test_likelihood_fits(design):
    df, x, _, z = design
    full, beta = np.column_stack([np.ones(len(z)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ beta))
        beta += np.linalg.solve((full.T * (p * (1 - p))) @ full, full.T @ (z - p))
    fit = REGRESSIONS["REG_GLM"](df, Slot("REG_GLM", None, None, {"target": "z", "predictors": ["a", "b"]}))
    assert fit["converged"] and np.allclose(list(fit["coefficients"].values()), beta, atol=1e-6)
    multi = REGRESSIONS["REG_MULTINOMIAL"](df.withColumn("t", F.col("z").cast("string")), Slot("REG_MULTINOMIAL", None, None, {"target": "t", "predictors": ["a", "b"]}))
    assert np.allclose(list(multi["coefficients"]["1.0"].values()), beta, atol=1e-6)
    order = REGRESSIONS["REG_ORDINAL"](df, Slot("REG_ORDINAL", None, None, {"target": "o", "predictors": ["a", "b"], "levels": ["l", "m", "h"]}))
    assert order["converged"] and order["coefficients"]["a"] > 1


def test_matrices(spark):
    rng = np.random.default_rng(7)
    f = rng.normal(size=500)
    m = np.column_stack([0.8 * f + 0.6 * rng.normal(size=500) for _ in range(4)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double")
    slot = Slot("m", None, None, {"members": list("abcd")})
    assert np.allclose(MATRICES["MAT_CORRELATION"](df, slot)["primary"], np.corrcoef(m.T))
    cov = np.cov(m.T)
    assert math.isclose(MATRICES["MAT_RELIABILITY"](df, slot)["alpha"], 4 / 3 * (1 - np.trace(cov) / cov.sum()))
    exact = np.array([0.8, 0.7, 0.6, 0.5])
    r = np.outer(exact, exact) + np.diag(1 - exact**2)
    for how in ("minres", "pa", "ml"):
        assert np.allclose(factor_fit(r, 1, how)["loadings"][:, 0], exact, atol=1e-3)
    sem = MATRICES["MAT_SEM"](df, Slot("m", None, None, {"model": "g =~ a + b + c + d"}))
    assert sem["df"] == 2 and sem["rmsea"] < 0.15 and np.allclose(sem["primary"], cov, atol=0.1)


def test_overlays(spark):
    df = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 20.0), ("b", "y", 40.0)], "r string, c string, v double")
    slot = {"params": {"value": "v", "row": "r", "col": "c"}}
    got = overlay(df, {"type": "OVERLAY_CHISQ_MATRIX", "label": "o", **slot}).first()
    o = np.array([[10, 30], [20, 40.0]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert math.isclose(got["o"], ((o - e) ** 2 / e).sum()) and math.isclose(got["o_p"], dist.chisq_tail(got["o"], 1))
    moves = spark.createDataFrame([("a", "a", 8.0), ("a", "b", 2.0), ("b", "a", 5.0), ("b", "b", 5.0)], "r string, c string, v double")
    assert np.allclose(markov(moves, Slot("m", None, None, slot["params"]))["steady"], [5 / 7, 2 / 7])
    assert math.isclose(symmetry(moves, Slot("m", None, None, slot["params"]))["statistic"], 4 / 7)
    raked = rake_matrix(df, Slot("m", None, None, {**slot["params"], "row_targets": {"a": 50, "b": 50}, "col_targets": {"x": 40, "y": 60}}))
    assert np.allclose(raked["primary"].sum(1), 50) and np.allclose(raked["primary"].sum(0), [40, 60])


def test_rake_and_banner(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("s"), (F.col("id") % 5).cast("string").alias("t"))
    out, info = rake(df, {"s": {"0": 0.7, "1": 0.3}, "t": {str(k): 0.2 for k in range(5)}})
    shares = {r["s"]: r["w"] for r in out.groupBy("s").agg(F.sum("weight").alias("w")).collect()}
    assert math.isclose(shares["0"], 70, rel_tol=1e-6) and info["cells"] == 10
    table = banner(df, [{"type": "GROUP_CATEGORY", "field": "s"}], [{"type": "GROUP_CATEGORY", "field": "t"}], {"type": "AGG_COUNT", "label": "n"})
    assert table.where("block = 'Total'").agg(F.sum("n")).first()[0] == 100


def test_batches(spark, people):
    got = compose(people, {"a": {"filterers": [{"type": "FILTER_NULL", "field": "v", "params": {"values": ["not_null"]}}]}}, {"aggregations": [{"type": "AGG_COUNT", "label": "n"}]})
    assert got["a"].first()["n"] == 4
    assert chain(people, [{"groups": [{"type": "GROUP_CATEGORY", "field": "g"}], "aggregations": [{"type": "AGG_COUNT", "label": "n"}]}, {"aggregations": [{"type": "AGG_MAX", "field": "n", "label": "m"}]}]).first()["m"] == 2.0
    assert len(sweep({"x": [1, 2], "y": [3, 4]})) == 4 and len(sweep({"x": (0, 1)}, "lhs", 5)) == 5
    requests = for_each({"filterers": [{"type": "FILTER_INCLUDE", "field": "g", "params": {"values": [{"$param": "level"}]}}]}, "level", ["a", "b"])
    assert {n: process(people, r).rows.count() for n, r in requests.items()} == {"a": 2, "b": 2}
    best, value = adaptive(lambda p: (p["x"] - 2) ** 2, {"x": (0, 5)})
    assert abs(best["x"] - 2) < 1e-2 and value < 1e-3
    top = optimize(lambda x: -((x[0] - 3) ** 2) - (x[1] - 1) ** 2, [0, 0], [(0, 5), (0, 5)], budget=2)
    assert np.allclose(top["x"], [2, 0], atol=1e-3)
    assert request_hash({"a": 1, "b": 2}) == request_hash({"b": 2, "a": 1})
    assert explain({"groups": [{"type": "GROUP_CATEGORY", "field": "g"}]}) == ["groups by GROUP_CATEGORY of g"]


def test_sources(spark, people, tmp_path):
    flat = people.drop("tags")
    for fmt in ("csv", "tsv", "ndjson", "parquet"):
        path = f"{tmp_path}/t.{fmt}"
        write(flat, path)
        back = read(spark, path, schema="id long, g string, v double, ok boolean, d date")
        assert back.count() == 5 and back.where("id = 1").first()["g"] == "a"
    write(people, f"{tmp_path}/s.csv")
    assert read(spark, f"{tmp_path}/s.csv", sets={"tags": "|"}).where("id = 1").first()["tags"] == ["x", "y"]
    kept = [{"type": "FILTER_INCLUDE", "field": "g", "params": {"values": ["a"]}}]
    one, two = (filter_to_file(spark, f"{tmp_path}/t.parquet", kept, str(tmp_path)) for _ in range(2))
    assert one == two and spark.read.parquet(one).count() == 2
    assert {c["name"]: c["logical"] for c in inspect(people)}["tags"] == "set"


def test_generated_tables(spark):
    columns = [
        {"name": "k", "distribution": "monotonic_from", "params": {"start": 1}},
        {"name": "x", "distribution": "normal", "params": {"mean": 5, "std": 2}, "null_rate": 0.1},
        {"name": "c", "distribution": "weighted_categorical", "params": {"values": ["a", "b"], "weights": [3, 1]}},
        {"name": "p", "distribution": "poisson", "params": {"lambda": 3}},
        {"name": "r", "distribution": "regex", "params": {"pattern": "[0-9]{3}-(ab|c)"}},
    ]
    df = generate(spark, 4000, columns, 9)
    a, b = (sorted(map(str, generate(spark, 4000, columns, 9, n).collect())) for n in (1, 7))
    assert a == b
    m, s, n, share, lam = df.agg(F.avg("x"), F.stddev("x"), F.count("x"), F.avg((F.col("c") == "a").cast("int")), F.avg("p")).first()
    assert abs(m - 5) < 0.2 and abs(s - 2) < 0.15 and abs(n - 3600) < 100 and abs(share - 0.75) < 0.04 and abs(lam - 3) < 0.15
    assert df.where(~F.col("r").rlike("^[0-9]{3}-(ab|c)$")).count() == 0
    assert generate(spark, 100, profile(df, ["x", "c"]), 1).count() == 100


def test_exact_quantiles_beyond_the_sketch(spark, monkeypatch):
    """Intervals from the sketch hold the places, with ties, null keys, and several shares at once."""
    from tessella.functions import quantiles

    monkeypatch.setattr(quantiles, "SMALL", 0)
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 60_000), (None, 3_000), ("b", 1)) for v in np.round(rng.lognormal(0, 2, n), 2)]
    df = spark.createDataFrame([*rows, ("c", None)], "g string, v double")
    wanted = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.999, "hi": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df.where("g = 'a'"), ["g"], F.col("v"), wanted).collect()}
    values = [v for k, v in rows if k == "a"]
    assert all(math.isclose(got["a"][n], np.quantile(values, p), rel_tol=1e-12) for n, p in wanted.items())
    monkeypatch.setattr(quantiles, "SMALL", 50_000)
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], F.col("v"), wanted).collect()}
    assert set(got) == {"a", None, "b"}
    for key in got:
        values = [v for k, v in rows if k == key]
        assert all(math.isclose(got[key][n], np.quantile(values, p), rel_tol=1e-12) for n, p in wanted.items())
    whole = quantiles.exact_quantiles(df, [], F.col("v"), {"m": 0.5}).first()["m"]
    assert math.isclose(whole, np.median([v for _, v in rows])) and quantiles.exact_quantiles(df.where("false"), [], F.col("v"), {"m": 0.5}).first()["m"] is None


def test_concordance_by_ranges(spark, monkeypatch):
    from tessella.functions import concordance

    monkeypatch.setattr(concordance, "ROWS", 20)
    rng = np.random.default_rng(5)
    for x, y in ((rng.integers(0, 30, 400), rng.integers(0, 30, 400)), (np.where(rng.random(300) < 0.4, 7, rng.integers(0, 90, 300)), rng.random(300)), (np.ones(50), rng.random(50)), (np.arange(3), np.arange(3))):
        df = spark.createDataFrame([(float(a), float(b), int(n)) for a, b, n in zip(x, y, rng.integers(1, 4, len(x)))], "x double, y double, n long")
        rows = [tuple(r) for r in df.collect()]
        want = sum(n * m * np.sign(a - c) * np.sign(b - d) for i, (a, b, n) in enumerate(rows) for c, d, m in rows[:i])
        assert concordance.net_concordance(df) == want


def test_tests_without_caps(spark):
    """Beyond 5,000 values and 20,000 rows; the figures are those of the plain formulas."""
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=21_000), 3)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)], "i long, v double")
    got = TESTS.find("TEST_SHAPIRO_WILK")(df, Slot("TEST_SHAPIRO_WILK", "v"))
    m = np.array([dist.normal_quantile((i - 0.375) / (len(v) + 0.25)) for i in range(1, len(v) + 1)])
    assert math.isclose(got["statistic"], np.corrcoef(np.sort(v), m)[0, 1] ** 2, rel_tol=1e-9) and got["advisory"]
    trend = TESTS.find("TEST_TREND")(df, Slot("TEST_TREND", "v", None, {"order_by": "i"}))
    assert trend["statistic"] == sum(np.sign(v[i + 1 :] - v[i]).sum() for i in range(len(v) - 1)) and trend["n"] == len(v)


def test_ordinal_levels_are_never_dropped(spark):
    df = spark.createDataFrame([(str(i % 60), float(i)) for i in range(300)], "y string, x double")
    with pytest.raises(RequestError, match="more than 50 levels"):
        REGRESSIONS.find("REG_ORDINAL")(df, Slot("REG_ORDINAL", None, None, {"target": "y", "predictors": ["x"]}))
    with pytest.raises(RequestError, match="aren't listed"):
        REGRESSIONS.find("REG_ORDINAL")(df.where("y < '3'"), Slot("REG_ORDINAL", None, None, {"target": "y", "predictors": ["x"], "levels": ["0", "1"]}))


def test_chi_square_tail_as_a_column(spark):
    from tessella.operators.attributes import chisq_tail_column

    x = spark.createDataFrame([(v,) for v in (0.0, 0.3, 2.0, 9.5, 60.0)], "x double")
    for k in range(1, 9):
        for r in x.select("x", chisq_tail_column(F.col("x"), k).alias("p")).collect():
            assert math.isclose(r["p"], dist.chisq_tail(r["x"], k), rel_tol=1e-9, abs_tol=1e-12)


def test_no_value_buffers_in_plans(spark):
    """Medians, percentiles, areas under curves and temporal splits neither buffer a group's values nor order a whole key."""
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as string) as g", "id * 1.5 as v", "id % 2 as y")
    requests = [{"groups": [{"type": "GROUP_CATEGORY", "field": "g"}], "aggregations": [{"type": t, "field": "v", "label": "m", "params": p}]} for t, p in (("AGG_MEDIAN", {}), ("AGG_PERCENTILE", {"percentile": 90}), ("AGG_AUC", {"outcome": "y"}))]
    requests.append({"features": [{"type": "FEAT_TRAIN_TEST_SPLIT", "label": "p", "params": {"mode": "temporal", "order_by": "v"}}]})
    for request in requests:
        plan = process(df, request).rows._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan.lower()
        for line in plan.splitlines():
            # Windows stand on ranges' totals, inside ranges, and on the counts that a second pass leaves.
            assert "Window [" not in line or any(n in line for n in ("_range", "_upto", "_all")), line
