"""SQL for registered queries whose figures need more than plain aggregates: tails of distributions by Simpson's rule,
maximum likelihood by a recursive query, and draws by their ranges and moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import catalog
from tessella.catalog import CELLS_SQL, MONTHS_SQL, ORACLE_SQL, QUERIES, add
from tessella.sources.synth import generate

Q, P, D = "l_quantity", "l_extendedprice", "l_discount"


def integral(f: str, upper: str, n: int = 600) -> str:
    """SQL of the integral of f (of X) from 0 to ``upper``."""
    at = f.replace("X", f"(({upper}) * i / {float(n)})")
    return f"(({upper}) / {3.0 * n} * list_sum(list_transform(range(0, {n + 1}), lambda i: CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({at}))))"


#: Two-sided tails at z, and with v degrees of freedom; 600 steps hold five digits up to 12 and 30.
NORMAL = f"round(greatest(0, 1 - 2 * {integral('exp(-X * X / 2) / sqrt(2 * pi())', 'least(abs(z), 12.0)')}) + 0.0, 4)"
STUDENT = f"round(greatest(0, 1 - 2 * {integral('exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + X * X / v, -(v + 1) / 2)', 'least(abs(z), 30.0)', 2000)}) + 0.0, 4)"
WELCH = "(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS z, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS v"
POOLED = "(k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z"

_cell = "l_returnflag, l_shipmode_like"
_against = "SELECT {keys}, CAST(k AS DOUBLE) AS n1, mean AS m1, variance AS v1, CAST(k + x AS DOUBLE) AS n2, mean + 1 AS m2, variance AS v2, mean AS k1, mean + 1 AS k2 FROM c".format(keys=_cell)
_pairs = """SELECT a.l_returnflag, a.l_shipmode_like AS a, b.l_shipmode_like AS b, CAST(a.{n} AS DOUBLE) AS n1, a.mean AS m1, a.variance AS v1, CAST(b.{n} AS DOUBLE) AS n2, b.mean AS m2, b.variance AS v2, a.mean AS k1, b.mean AS k2
FROM c a JOIN c b ON a.l_returnflag = b.l_returnflag AND a.l_shipmode_like < b.l_shipmode_like"""
_months = """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus, CAST(count(o_totalprice) AS DOUBLE) AS n1, avg(o_totalprice) AS m1, var_samp(o_totalprice) AS v1, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS k1 FROM orders GROUP BY ALL),
 q AS (SELECT *, lag(n1) OVER w AS n2, lag(m1) OVER w AS m2, lag(v1) OVER w AS v2, lag(k1) OVER w AS k2 FROM m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY m)) """


def tail(source: str, statistic: str, p: str, keys: str) -> str:
    return f"SELECT {keys}, CASE WHEN isfinite(z) THEN {p} END AS o FROM (SELECT *, {statistic} FROM ({source}))"


for _op in ("t_cell", "t_vs_ref"):
    ORACLE_SQL[f"overlay_{_op}"] = CELLS_SQL + tail(_against, WELCH, STUDENT, _cell)
for _op in ("z_cell", "z_vs_ref"):
    ORACLE_SQL[f"overlay_{_op}"] = CELLS_SQL + tail(_against, WELCH, NORMAL, _cell)
ORACLE_SQL["overlay_prop_z_cell"] = CELLS_SQL + tail(_against.replace("CAST(k + x AS DOUBLE) AS n2", "CAST(k + x AS DOUBLE) AS n2"), POOLED, NORMAL, _cell)
_pair_keys = "l_returnflag, a, b"
ORACLE_SQL["overlay_pairwise_prop_z"] = CELLS_SQL + tail(_pairs.format(n="k"), POOLED, NORMAL, _pair_keys)
ORACLE_SQL["overlay_pairwise_two_means_z"] = CELLS_SQL + tail(_pairs.format(n="k"), WELCH, NORMAL, _pair_keys)
ORACLE_SQL["overlay_pairwise_welch_t"] = CELLS_SQL + tail(_pairs.format(n="k"), WELCH, STUDENT, _pair_keys)
ORACLE_SQL["overlay_pairwise_weighted_two_means_z"] = CELLS_SQL + tail(_pairs.format(n="x"), WELCH, NORMAL, _pair_keys)
ORACLE_SQL["overlay_t_vs_prior"] = _months + tail("SELECT * FROM q", WELCH, STUDENT, "m, o_orderstatus")
ORACLE_SQL["overlay_z_vs_prior"] = _months + tail("SELECT * FROM q", WELCH, NORMAL, "m, o_orderstatus")
ORACLE_SQL["overlay_prop_z_vs_prior"] = _months + tail("SELECT * FROM q", POOLED, NORMAL, "m, o_orderstatus")
ORACLE_SQL["overlay_prop_z_panel"] = CELLS_SQL + tail("SELECT *, 'reference' AS a, 'target' AS b, mean / 2 AS k1, CAST(k AS DOUBLE) AS n1, mean AS k2, CAST(k AS DOUBLE) AS n2 FROM c", POOLED, NORMAL, f"{_cell}, a, b")

# Fisher's exact test of each cell against the rest: all tables with these margins that are no likelier than the one seen.
_choose = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1)"
_table = f"({_choose.format('r', 'i')}) + ({_choose.format('(g - r)', '(cc - i)')}) - ({_choose.format('g', 'cc')})"
ORACLE_SQL["overlay_fisher_exact_cell"] = CELLS_SQL + f"""SELECT {_cell}, round(least(1.0, list_sum(list_filter(list_transform(range(CAST(greatest(0, r + cc - g) AS BIGINT), CAST(least(r, cc) AS BIGINT) + 1), lambda i: exp({_table})),
 lambda q: q <= exp({_table.replace('i)', 'k)').replace('i +', 'k +').replace('(i', '(k')}) * (1 + 1e-7)))), 4) AS o
FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS r, CAST(sum(k) OVER (PARTITION BY l_shipmode_like) AS DOUBLE) AS cc, CAST(sum(k) OVER () AS DOUBLE) AS g FROM c)"""


# ---- maximum likelihood: Newton's method, a step a recursion


def newton(source: str, mean: str, weight: str, start: str, steps: int = 12) -> str:
    """SQL of a fit on columns y and x with an intercept: term, estimate, se. ``mean`` and ``weight`` are of e = a + b x."""
    return f"""WITH RECURSIVE d AS ({source}),
 it AS (SELECT 0 AS k, {start} AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS sa, 0.0::DOUBLE AS sb
 UNION ALL SELECT k + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12), sqrt(h22 / (h11 * h22 - h12 * h12)), sqrt(h11 / (h11 * h22 - h12 * h12))
  FROM (SELECT k, a, b, sum(y - u) AS g1, sum((y - u) * x) AS g2, sum(w) AS h11, sum(w * x) AS h12, sum(w * x * x) AS h22
   FROM (SELECT it.k, it.a, it.b, d.x, d.y, {mean} AS u, {weight} AS w FROM it, d WHERE it.k < {steps}) GROUP BY k, a, b))
SELECT term, round(estimate, 4) AS estimate, round(se, 4) AS se FROM (SELECT '(intercept)' AS term, a AS estimate, sa AS se FROM it WHERE k = {steps} UNION ALL SELECT 'TERM', b, sb FROM it WHERE k = {steps})"""


ORACLE_SQL["reg_glm_poisson"] = newton(
    f"SELECT CAST(l_linenumber AS DOUBLE) AS y, {Q} AS x FROM lineitem", "exp(it.a + it.b * d.x)", "exp(it.a + it.b * d.x)", "ln((SELECT avg(y) FROM d))"
).replace("TERM", Q)
_p = "1 / (1 + exp(-(it.a + it.b * d.x)))"
catalog.regression("REG_GLM", {"target": "hit", "predictors": [Q], "family": "binomial"}, newton(
    f"SELECT CAST(l_returnflag = 'A' AS DOUBLE) AS y, {Q} AS x FROM lineitem", _p, f"({_p}) * (1 - {_p})", "0.0::DOUBLE"
).replace("TERM", Q), suffix="_logit", derive=lambda df: df.withColumn("hit", (F.col("l_returnflag") == "A").cast("int")))


# ---- statistics of two members in closed form

_two = f"""WITH s AS (SELECT l_returnflag AS g, CAST(count(*) AS DOUBLE) AS n, avg({Q}) AS mx, avg(l_linenumber) AS my, var_samp({Q}) AS a, covar_samp({Q}, l_linenumber) AS b, var_samp(l_linenumber) AS c FROM lineitem GROUP BY ALL),
 w AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum((n - 1) * a) AS a, sum((n - 1) * b) AS b, sum((n - 1) * c) AS c FROM s) """
ORACLE_SQL["test_box_m"] = _two + """, q AS (SELECT n - k AS f, (a * c - b * b) / pow(n - k, 2) AS det, k FROM w)
SELECT round((any_value(f) * ln(any_value(det)) - sum((n - 1) * ln(s.a * s.c - s.b * s.b))) * (1 - (sum(1 / (n - 1)) - 1 / any_value(f)) * 13.0 / (18 * (any_value(k) - 1))), 4) AS statistic FROM s, q"""
ORACLE_SQL["test_manova"] = _two + f""", t AS (SELECT var_pop({Q}) * count(*) AS a, covar_pop({Q}, l_linenumber) * count(*) AS b, var_pop(l_linenumber) * count(*) AS c FROM lineitem)
SELECT round(2 - (w.a * t.c - 2 * w.b * t.b + w.c * t.a) / (t.a * t.c - t.b * t.b), 4) AS statistic FROM w, t"""


# ---- draws: how many, whether all are in range, and whether the mean is within five standard errors of its own

_moments: dict[str, tuple[str, float, float]] = {
    # whether a draw v is possible, and mean and deviation of one as a number (v, its length for sets and texts, days for dates)
    "uniform": ("v >= 0 and v < 1", 0.5, 0.288675), "normal": ("v > -10 and v < 16", 3.0, 2.0), "lognormal": ("v > 0", 1.648721, 2.161197),
    "exponential": ("v >= 0", 0.5, 0.5), "pareto": ("v >= 1", 1.5, 0.866025), "poisson": ("v >= 0 and v = floor(v)", 4.0, 2.0),
    "bernoulli": ("v in (0, 1)", 0.3, 0.458258), "discrete": ("v in (1, 2, 5)", 2.5, 1.5), "mixture": ("v > -9 and v < 25", 6.75, 4.264680),
    "weighted_categorical": ("v in ('a', 'b')", 0.5, 0.5), "set_bernoulli": ("size(array_except(v, array('x', 'y'))) = 0", 0.6, 0.583095),
    "uniform_date": ("v between date'2024-01-01' and date'2024-12-31'", 182.5, 105.655), "uniform_datetime": ("v >= timestamp'2024-01-01' and v < timestamp'2024-02-01' and weekday(v) < 5", 14.8, 9.2),
    "regex": ("v rlike '^[A-C]{2}-[0-9]{3}(x|yz)?$'", 6.75, 0.9),
}
_number = {"weighted_categorical": "cast(v = 'b' as int)", "set_bernoulli": "size(v)", "uniform_date": "datediff(v, date'2024-01-01')", "uniform_datetime": "datediff(cast(v as date), date'2024-01-01')", "regex": "length(v)"}


def drawn(name: str) -> None:
    raw, (possible, mean, deviation) = QUERIES[f"synth_{name}"], _moments[name]

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = F.expr(_number.get(name, "v")).cast("double")
        near = F.abs(F.avg(x) - mean) < 5 * deviation / F.sqrt(F.count("*"))
        return raw(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.expr(possible)).alias("possible"), near.alias("mean_fits"), (F.count_distinct(F.col("v").cast("string")) > 1).alias("varies"))

    QUERIES[f"synth_{name}"] = make
    ORACLE_SQL[f"synth_{name}"] = "SELECT 1000 AS n, 1000 AS possible, true AS mean_fits, true AS varies"


for _name in _moments:
    drawn(_name)


def repeatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed gives one table, another seed another."""
    draw = lambda seed: generate(spark, 1000, [{"name": "v", "distribution": "normal", "params": {}}], seed).agg(F.sum(F.xxhash64("v").cast("decimal(38,0)"))).first()[0]
    one = draw(5)
    return spark.createDataFrame([(one == draw(5), one == draw(6))], "same boolean, other boolean")


add("synth_seed", repeatable, "SELECT true AS same, false AS other")


# ---- parts of a seeded split: whole, and near the ratios (0.8, 0, 0.2) within five standard errors

_split = QUERIES["feat_train_test_split"]


def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    label = next(c for c in rows.columns if c not in ("o_orderkey",))
    near = F.abs(F.avg((F.col(label) == 0).cast("double")) - 0.8) < 5 * 0.4 / F.sqrt(F.count("*"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(label).isin(0, 2)).alias("dealt"), near.alias("near"))


QUERIES["feat_train_test_split"] = split_shares
ORACLE_SQL["feat_train_test_split"] = "SELECT count(*) AS n, count(*) AS dealt, true AS near FROM orders"

_m3 = [Q, P, D]
_corr = f"(SELECT corr({Q}, {P}) AS ab, corr({Q}, {D}) AS ac, corr({P}, {D}) AS bc FROM lineitem)"
_det = "(1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc)"
ORACLE_SQL["mat_collinearity"] = " UNION ALL ".join(
    f"SELECT '1' AS row_key, '{n}' AS col_key, round((1 - {r} * {r}) / {_det}, 4) AS value FROM {_corr}" for n, r in zip(_m3, ("bc", "ac", "ab"))
)

_four = "(SELECT l_quantity + l_linenumber AS f1, l_quantity - 3 * l_linenumber AS f2, l_quantity + 40 * l_discount AS f3, l_linenumber + 30 * l_tax AS f4 FROM lineitem)"
ORACLE_SQL["mat_reliability"] = " UNION ALL ".join(
    f"SELECT '{a}' AS row_key, '{b}' AS col_key, round(corr({a}, {b}), 4) AS value FROM {_four}" for a in catalog.FOUR for b in catalog.FOUR
)
ORACLE_SQL["test_mardia"] = f"""WITH s AS (SELECT avg({Q}) AS mx, avg(l_linenumber) AS my, sqrt(var_pop({Q})) AS a, covar_pop({Q}, l_linenumber) / sqrt(var_pop({Q})) AS b, var_pop(l_linenumber) AS c FROM lineitem),
 x AS (SELECT ({Q} - mx) / a AS u, l_linenumber - my AS d, b, sqrt(c - b * b) AS e FROM lineitem, s), z AS (SELECT u, (d - b * u) / e AS v FROM x)
SELECT round(count(*) / 6.0 * (pow(avg(u * u * u), 2) + 3 * pow(avg(u * u * v), 2) + 3 * pow(avg(u * v * v), 2) + pow(avg(v * v * v), 2)), 4) AS statistic FROM z"""
_normal = integral("exp(-X * X / 2) / sqrt(2 * pi())", "least(sqrt(o), 12.0)")
ORACLE_SQL["overlay_symmetry"] = f"""WITH m AS (SELECT o_orderstatus AS a, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
 k AS (SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(count(*) FILTER (a < b) AS DOUBLE) AS x, CAST(count(*) FILTER (a > b) AS DOUBLE) AS y FROM m WHERE b IS NOT NULL AND a <> b GROUP BY ALL),
 s AS (SELECT sum((x - y) * (x - y) / (x + y)) AS o FROM k)
SELECT round(o, 4) AS o, round(greatest(0, 1 - 2 * {_normal}) + exp(-o / 2) * sqrt(2 * o / pi()), 4) AS p FROM s"""


# ---- fits whose likelihood no step can better: each parameter is moved a little both ways


def optimum(name: str, op: str, params: dict, likelihood, parameters: int) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = catalog.table(spark, sf_dir, "lineitem")
        fit = catalog.REGRESSIONS.find(op)(df, catalog.Slot(op, None, None, params))
        own, ways = likelihood(fit)
        got = df.agg(F.sum(own).alias("best"), *(F.sum(w).alias(f"w{k}") for k, w in enumerate(ways))).first()
        return spark.createDataFrame([(len(ways) // 2, sum(got[f"w{k}"] > got["best"] for k in range(len(ways))))], "parameters int, better int")

    add(name, make, f"SELECT {parameters} AS parameters, 0 AS better")


def _line(terms: dict):
    return sum((F.lit(float(v)) * (F.lit(1.0) if t == "(intercept)" else F.col(t)) for t, v in terms.items()), F.lit(0.0))


def _moved(flat: dict, steps=(-1e-2, 1e-2)):
    for key, value in flat.items():
        for step in steps:
            yield flat | {key: value + step * (abs(value) + 1e-2)}


def softmax_likelihood(fit: dict):
    flat = {(level, t): v for level, terms in fit["coefficients"].items() for t, v in terms.items()}

    def of(values: dict):
        eta = {level: _line({t: v for (l, t), v in values.items() if l == level}) for level in fit["coefficients"]}
        own = sum((F.when(F.col("l_returnflag") == level, e).otherwise(0.0) for level, e in eta.items()), F.lit(0.0))
        return own - F.log(F.lit(1.0) + sum((F.exp(e) for e in eta.values()), F.lit(0.0)))

    return of(flat), [of(v) for v in _moved(flat)]


def ordinal_likelihood(fit: dict):
    flat = {("cut", str(k)): v for k, v in enumerate(fit["thresholds"])} | {("term", t): v for t, v in fit["coefficients"].items()}
    sig = lambda e: 1 / (1 + F.exp(-e))

    def of(values: dict):
        lin, cuts = _line({t: v for (k, t), v in values.items() if k == "term"}), [v for (k, _), v in values.items() if k == "cut"]
        upto = [F.lit(0.0), *(sig(F.lit(float(c)) - lin) for c in cuts), F.lit(1.0)]
        chance = sum((F.when(F.col("l_returnflag") == level, upto[k + 1] - upto[k]).otherwise(0.0) for k, level in enumerate(fit["levels"])), F.lit(0.0))
        return F.log(chance)

    return of(flat), [of(v) for v in _moved(flat)]


optimum("reg_multinomial_optimum", "REG_MULTINOMIAL", {"target": "l_returnflag", "predictors": [Q, D]}, softmax_likelihood, 6)
optimum("reg_ordinal_optimum", "REG_ORDINAL", {"target": "l_returnflag", "predictors": [Q], "levels": ["A", "N", "R"]}, ordinal_likelihood, 3)
