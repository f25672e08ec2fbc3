"""Features: derived columns on the raw table, before any filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tessella.errors import RequestError
from tessella.functions.quantiles import exact_quantiles
from tessella.functions.running import running_totals
from tessella.operators.filters import FILTERS
from tessella.operators.slots import Registry, Slot, column, kind, local_time, number

FEATURES = Registry("feature")


@FEATURES.add("FEAT_LOG")
def log(df: DataFrame, slot: Slot) -> DataFrame:
    x = number(df, slot)
    return df.withColumn(slot.label or f"LOG_{slot.field}", F.when(x > -1, F.log1p(x)))


@FEATURES.add("FEAT_SQRT")
def sqrt(df: DataFrame, slot: Slot) -> DataFrame:
    x = number(df, slot)
    return df.withColumn(slot.label or f"SQRT_{slot.field}", F.when(x >= 0, F.sqrt(x)))


@FEATURES.add("FEAT_POLY")
def poly(df: DataFrame, slot: Slot) -> DataFrame:
    degree = int(slot.get("degree", 2))
    if degree < 2:
        raise RequestError("FEAT_POLY: degree must be 2 or more")
    x = power = number(df, slot)
    for k in range(2, degree + 1):
        power = power * x
        df = df.withColumn(f"{slot.label or slot.field + '_poly'}_{k}", power)
    return df


@FEATURES.add("FEAT_BUCKETIZE")
def bucketize(df: DataFrame, slot: Slot) -> DataFrame:
    """Bucket i holds boundaries[i-1] < v <= boundaries[i]; ``quantiles`` takes the boundaries from the table."""
    x, label = number(df, slot), slot.label or f"BUCKET_{slot.field}"
    if bounds := slot.get("boundaries"):
        if list(bounds) != sorted(set(bounds)):
            raise RequestError("FEAT_BUCKETIZE: boundaries must rise")
        index = sum(((x > float(b)).cast("int") for b in bounds), F.lit(0))
        return df.withColumn(label, F.when(x.isNotNull() & ~F.isnan(x), index.cast("double")))
    n = int(slot.need("quantiles"))
    cuts = exact_quantiles(df, [], x, {f"_c{k}": k / n for k in range(1, n)}).select(F.array(*(f"_c{k}" for k in range(1, n))).alias("_cuts"))
    index = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < x))
    return df.join(F.broadcast(cuts), how="left").withColumn(label, F.when(x.isNotNull(), index.cast("double"))).drop("_cuts")


@FEATURES.add("FEAT_DATE_FEATURES")
def date_features(df: DataFrame, slot: Slot) -> DataFrame:
    column(df, slot, "date")
    d, p = local_time(df, slot.field, slot.get("zone")), slot.label or slot.field
    parts = {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "dow": F.weekday(d) + 1, "quarter": F.quarter(d)}
    if not isinstance(kind(df, slot.field), DateType):
        parts["hour"] = F.hour(d)
    return df.withColumns({f"{p}_{k}": c.cast("double") for k, c in parts.items()})


@FEATURES.add("FEAT_ONE_HOT")
def one_hot(df: DataFrame, slot: Slot) -> DataFrame:
    """A column for each level; without ``levels`` they are read from the table. Null gives 0 everywhere."""
    c = column(df, slot).cast("string")
    levels = slot.get("levels")
    if levels is None:
        limit = int(slot.get("max_levels", 1000))
        levels = sorted(r[0] for r in df.select(c).where(c.isNotNull()).distinct().limit(limit + 1).collect())
        if len(levels) > limit:
            raise RequestError(f"FEAT_ONE_HOT: field {slot.field!r} has more than {limit} levels")
    prefix = slot.label or slot.field
    return df.withColumns({f"{prefix}_{v}": F.coalesce((c == v).cast("double"), F.lit(0.0)) for v in levels})


@FEATURES.add("FEAT_FREQUENCY_ENCODE")
def frequency_encode(df: DataFrame, slot: Slot) -> DataFrame:
    c, label = column(df, slot), slot.label or f"FREQ_{slot.field}"
    counts = df.where(c.isNotNull()).groupBy(c.alias("_level")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    rates = counts.join(F.broadcast(total)).select("_level", (F.col("_n") / F.col("_all")).alias(label))
    return df.join(rates, c == F.col("_level"), "left").drop("_level")


@FEATURES.add("FEAT_TARGET_ENCODE")
def target_encode(df: DataFrame, slot: Slot) -> DataFrame:
    """Smoothed mean of the target by level: (sum + s * global mean) / (n + s), over the rows of ``fit_on`` (a filter
    slot). With ``folds`` a row's own fold is left out. A level that was not seen gets the global mean; null stays."""
    c, label = column(df, slot), slot.label or f"TARGET_{slot.field}"
    target, s = F.col(f"`{slot.need('target')}`").cast("double"), float(slot.get("smoothing", 0.0))
    fit_on = FILTERS.find(slot.get("fit_on")["type"])(df, Slot.of(slot.get("fit_on"))) if slot.get("fit_on") else F.lit(True)
    folds = int(slot.get("folds", 0))
    fold = F.pmod(F.xxhash64(F.lit(int(slot.get("rng_seed", 0))), *(F.col(f"`{k}`") for k in slot.get("key", df.columns))), F.lit(folds)) if folds > 1 else F.lit(0)
    rows = df.withColumn("_fold", fold)
    train = rows.where(fit_on & target.isNotNull())
    by = train.where(c.isNotNull()).groupBy(c.alias("_level")).agg(F.sum(target).alias("_s"), F.count("*").alias("_n"))
    every = train.agg(F.sum(target).alias("_gs"), F.count("*").alias("_gn"))
    out = rows.join(by, c == F.col("_level"), "left").drop("_level").join(F.broadcast(every))
    own_s = own_n = F.lit(0)
    own_gs = own_gn = F.lit(0)
    if folds > 1:
        mine = train.where(c.isNotNull()).groupBy(c.alias("_level"), F.col("_fold").alias("_of")).agg(F.sum(target).alias("_fs"), F.count("*").alias("_fn"))
        whole = train.groupBy(F.col("_fold").alias("_of2")).agg(F.sum(target).alias("_fgs"), F.count("*").alias("_fgn"))
        out = out.join(mine, (c == F.col("_level")) & (F.col("_fold") == F.col("_of")), "left").join(F.broadcast(whole), F.col("_fold") == F.col("_of2"), "left")
        own_s, own_n, own_gs, own_gn = (F.coalesce(x, F.lit(0)) for x in ("_fs", "_fn", "_fgs", "_fgn"))
    mean = F.try_divide(F.col("_gs") - own_gs, F.col("_gn") - own_gn)
    total, n = F.coalesce("_s", F.lit(0.0)) - own_s, F.coalesce("_n", F.lit(0)) - own_n
    value = F.when(n > 0, F.try_divide(total + F.lit(s) * mean, n + F.lit(s))).otherwise(mean)
    return out.select(*(F.col(f"`{k}`") for k in df.columns), F.when(c.isNotNull(), value).alias(label))


@FEATURES.add("FEAT_TRAIN_TEST_SPLIT")
def split(df: DataFrame, slot: Slot) -> DataFrame:
    """0 train, 1 validation, 2 test. Seeded mode: by a hash of ``key`` (a unique column), so that a row's part does not
    hang on the others; ``stratify`` mixes the stratum in. Temporal mode: by the share of rows at or before a value of
    ``order_by``; rows that tie stay together."""
    ratios = [float(r) for r in slot.get("ratios", [0.8, 0.0, 0.2])]
    if len(ratios) != 3 or abs(sum(ratios) - 1) > 1e-9:
        raise RequestError("FEAT_TRAIN_TEST_SPLIT: ratios must be three numbers that add up to 1")
    label = slot.label or "split"
    part = lambda u: F.when(u < ratios[0], 0).when(u < ratios[0] + ratios[1], 1).otherwise(2)
    if slot.get("mode") == "temporal":
        by = slot.need("order_by")
        of = kind(df, by)
        t = F.col(f"`{by}`")
        t = F.unix_date(t) if isinstance(of, DateType) else F.unix_micros(t.cast("timestamp")) if isinstance(of, (TimestampType, TimestampNTZType)) else t
        # Two values of the order bound the parts: those at which the running share of rows reaches them.
        values = df.where(t.isNotNull()).select(t.alias("_v"))
        counts = values.groupBy("_v").agg(F.count("*").alias("_n"))
        seen = running_totals(counts, "_v", {"_before": F.col("_n")}, like=values).withColumn("_upto", F.col("_before") + F.col("_n"))
        total = values.agg(F.count("*").alias("_all"))
        share = F.col("_upto") / F.col("_all") - 1e-12
        ends = seen.join(F.broadcast(total)).agg(
            F.max(F.when(share < ratios[0], F.col("_v"))).alias("_a"), F.max(F.when(share < ratios[0] + ratios[1], F.col("_v"))).alias("_b")
        )
        which = F.when(t <= F.col("_a"), 0).when(t <= F.col("_b"), 1).otherwise(2)
        return df.join(F.broadcast(ends)).withColumn(label, F.when(t.isNotNull(), which)).drop("_a", "_b")
    keys = [F.col(f"`{k}`") for k in [slot.need("key"), *([slot.get("stratify")] if slot.get("stratify") else [])]]
    u = F.pmod(F.xxhash64(F.lit(int(slot.get("seed", 0))), *keys), F.lit(1 << 40)) / float(1 << 40)
    return df.withColumn(label, part(u))


def apply_features(df: DataFrame, slots: list[Slot]) -> DataFrame:
    for slot in slots:
        df = FEATURES.find(slot.type)(df, slot)
    return df
