"""Reading, writing and converting tables; schemas; materialised, filtered and sharded copies; rim weights."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, StringType, StructField, StructType

from tessella.errors import RequestError
from tessella.operators.filters import apply_filters
from tessella.operators.slots import Slot, valid_weight
from tessella.plans.request import request_hash

FORMATS = {
    "csv": "csv", "tsv": "tsv", "ndjson": "ndjson", "jsonl": "ndjson", "json": "json", "parquet": "parquet", "arrow": "arrow",
    "feather": "arrow", "orc": "orc", "avro": "avro", "txt": "text", "xlsx": "excel",
}
#: What a wall-clock time that a zone has twice or not at all becomes.
DST_POLICIES = ("earlier", "later", "null", "reject")


def format_of(path: str) -> str:
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension not in FORMATS:
        raise RequestError(f"no format for {path!r}; one of {sorted(set(FORMATS))}")
    return FORMATS[extension]


def read(
    spark: SparkSession, path: str, fmt: str | None = None, schema: str | StructType | None = None, zone: str | None = None,
    sets: Mapping[str, str] | None = None, vectors: Mapping[str, list[str]] | None = None, dst_policy: str = "earlier", sheet: str | None = None,
) -> DataFrame:
    """A table from a path Spark can read. Types are inferred unless ``schema`` names them (by column name); rows that
    don't fit it keep their text in ``_corrupt``. ``sets`` splits text columns at a separator into sorted sets;
    ``vectors`` folds number columns into one array column under a new name; ``zone`` reads times without a zone as that
    zone's, and ``dst_policy`` settles those that the zone has twice or not at all; ``sheet`` picks one of a workbook."""
    fmt = fmt or format_of(path)
    if fmt in ("csv", "tsv", "json", "ndjson"):
        reader = spark.read.option("mode", "PERMISSIVE")
        if schema is not None:
            full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            reader = reader.schema(StructType([*full.fields]).add("_corrupt", StringType())).option("columnNameOfCorruptRecord", "_corrupt")
        if fmt in ("csv", "tsv"):
            reader = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
            df = (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
        else:
            df = reader.option("multiLine", fmt == "json").json(path)
    elif fmt == "arrow":
        df = _read_arrow(spark, path)
    elif fmt == "excel":
        df = _read_excel(spark, path, sheet, schema)
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.format(fmt).load(path)
    for name, separator in (sets or {}).items():
        parts = F.transform(F.split(F.col(name), f"[{separator}]"), F.trim)
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))))
    if zone:
        df = df.select(*(zoned(F.col(f"`{c}`").cast("timestamp_ntz"), zone, dst_policy).alias(c) if t.startswith("timestamp") else F.col(f"`{c}`") for c, t in df.dtypes))
    for name, parts in (vectors or {}).items():
        if missing := [p for p in parts if p not in df.columns]:
            raise RequestError(f"vector {name!r}: no columns {missing}")
        df = df.withColumn(name, F.array(*(F.col(f"`{p}`").cast("double") for p in parts))).drop(*parts)
    return df


def zoned(wall: Column, zone: str, policy: str = "earlier") -> Column:
    """The instant, as UTC without a zone, of a wall-clock time. A time that clocks show twice is the earlier or later of
    both; one that they skip moves on by the gap, or with ``null`` is null and with ``reject`` an error (both alike)."""
    if policy not in DST_POLICIES:
        raise RequestError(f"dst_policy: one of {DST_POLICIES}")
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    shown = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    hour = F.expr("interval 1 hour")
    before, after = at - hour, at + hour
    first, last = F.when(shown(before) == wall, before).otherwise(at), F.when(shown(after) == wall, after).otherwise(at)
    if policy in ("earlier", "later"):
        return first if policy == "earlier" else last
    odd = (first != last) | (shown(at) != wall)
    bad = F.lit(None) if policy == "null" else F.raise_error(F.concat(F.lit(f"{zone}: not one instant at "), wall.cast("string")))
    return F.when(odd, bad.cast("timestamp_ntz")).otherwise(at)


def _read_excel(spark: SparkSession, path: str, sheet: str | None, schema: str | StructType | None) -> DataFrame:
    """Workbooks, a task for each file: the first row of a sheet (by name, else the first) names the columns. Cells are
    text unless ``schema`` casts them; dates are serial numbers as in the file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.first()
    if first is None:
        raise RequestError(f"no files at {path!r}")
    names = list(next(iter(sheet_rows(bytes(first[0]), sheet)), ()))
    if not names or len(set(names)) < len(names) or None in names:
        raise RequestError(f"{path!r}: the first row must name all columns, each once")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(0).to_pylist():
                rows = sheet_rows(content, sheet)
                next(rows)
                rows = [[*r, *[None] * (len(names) - len(r))][: len(names)] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    df = files.mapInArrow(run, StructType([StructField(n, StringType()) for n in names]))
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields if schema is not None else []
    kinds = {f.name: f.dataType for f in fields}
    return df.select(*(F.col(f"`{n}`").try_cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in names))


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a workbook's sheet as text, from the zipped XML parts that the format is made of."""
    import io
    import zipfile
    from xml.etree import ElementTree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = {e.get("name"): e.get(link) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet")}
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        name = sheet if sheet is not None else next(iter(sheets))
        if name not in sheets:
            raise RequestError(f"no sheet {name!r}; one of {sorted(sheets)}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{main}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{main}t")))
        part = targets[sheets[name]]
        root = ElementTree.fromstring(book.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
        for row in root.iter(f"{main}row"):
            out: list[str | None] = []
            for cell in row.iter(f"{main}c"):
                at = 0
                for c in cell.get("r", ""):
                    at = at * 26 + ord(c) - 64 if c.isalpha() else at
                out += [None] * (max(at, len(out) + 1) - len(out))
                value = cell.find(f"{main}v")
                kind, text = cell.get("t"), value.text if value is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{main}t"))
                out[(at or len(out)) - 1] = text
            yield out



def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow and Feather files, a task for each file: files are read as bytes by Spark and parsed where they are."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.first()
    if first is None:
        raise RequestError(f"no files at {path!r}")

    def tables(content: bytes) -> pa.Table:
        import pyarrow.feather as feather

        return feather.read_table(pa.BufferReader(content))

    schema = from_arrow_schema(tables(bytes(first[0])).schema)

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                yield from tables(content).to_batches(max_chunksize=10_000)

    return files.mapInArrow(run, schema)


def write(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists", partition_by: list[str] = ()) -> None:
    fmt = fmt or format_of(path)
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        flat = df.select(*(F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "|").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`") for f in df.schema))
        flat.write.mode(mode).partitionBy(*partition_by).option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt in ("json", "ndjson"):
        writer.json(path)
    elif fmt == "arrow":
        raise RequestError("arrow is read only; parquet keeps the same types")
    else:
        writer.format(fmt).save(path)


def export(df: DataFrame, path: str, fmt: str | None = None, overlays: Mapping[str, DataFrame] | None = None, mode: str = "errorifexists") -> None:
    """A finished table with its overlays: each overlay is a table of its own below ``<path>.overlays``, and the columns
    of all are described in ``<path>.schema``."""
    write(df, path, fmt, mode)
    described = {"rows": inspect(df), **{n: inspect(o) for n, o in (overlays or {}).items()}}
    for name, table in (overlays or {}).items():
        write(table, f"{path}.overlays/{name}", fmt or format_of(path), mode)
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.mode(mode).text(f"{path}.schema")


def convert(spark: SparkSession, source: str, target: str, **options) -> None:
    write(read(spark, source, **options), target)


def transfer(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A compact copy for moving."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def inspect(df: DataFrame) -> list[dict]:
    """Name, type, logical type and metadata of each column, from the schema alone."""
    out = []
    for f in df.schema:
        of = f.dataType
        logical = "set" if isinstance(of, ArrayType) and isinstance(of.elementType, StringType) else "vector" if isinstance(of, ArrayType) else "u64" if isinstance(of, DecimalType) and of.scale == 0 and of.precision == 20 else "categorical" if isinstance(of, StringType) else of.typeName()
        out.append({"name": f.name, "type": of.simpleString(), "logical": f.metadata.get("logical_type", logical), "nullable": f.nullable, "metadata": dict(f.metadata)})
    return out


def sample(df: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """The first rows, by ``order`` if it is given."""
    return (df.orderBy(order) if order else df).limit(n)


def _made(df: DataFrame, o: Mapping) -> Column:
    """One output column: the field, recoded, bucketed, cast, in this order."""
    c = F.col(f"`{o['field']}`")
    if recode := o.get("recode"):
        table = F.create_map(*(F.lit(x) for k, v in recode.items() for x in (str(k), v)))
        c = F.coalesce(F.try_element_at(table, c.cast("string")), F.lit(o["other"]) if "other" in o else c.cast("string"))
    if bounds := o.get("bucket"):
        index = sum(((c.cast("double") >= float(b)).cast("int") for b in bounds), F.lit(0))
        c = F.when(c.isNotNull(), index)
    return (c.cast(o["type"]) if o.get("type") else c).alias(o.get("as", o["field"]))


def materialize(df: DataFrame, path: str, output: list[Mapping] | None = None, mode: str = "errorifexists", shards: list[str] = ()) -> None:
    """Writes source and derived columns; ``output`` picks, renames, recodes (a mapping; ``other`` for the rest), buckets
    (rising bounds; bucket i holds bounds[i-1] <= v < bounds[i]) and casts: keys field, as, recode, bucket, type."""
    if output:
        df = df.select(*(_made(df, o) for o in output))
    write(df, path, "parquet", mode, list(shards))


def filter_to_file(spark: SparkSession, source: str, filters: list[Mapping], folder: str) -> str:
    """The path of a filtered copy whose name is a digest of source and filters: a copy that is complete is used again."""
    digest = request_hash({"source": source, "filters": filters})
    path = f"{folder.rstrip('/')}/{digest[:24]}.parquet"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write(apply_filters(read(spark, source), [Slot.of(f) for f in filters]), path, "parquet", "overwrite")
    return path


def shards(spark: SparkSession, path: str, label: str = "shard") -> DataFrame:
    """Rows of a sharded table with the shard's label: files below ``label=...`` folders."""
    return spark.read.parquet(path).withColumn(label, F.col(label).cast("string"))


def add_shard(df: DataFrame, path: str, name: str, label: str = "shard") -> None:
    """Adds or replaces one shard; its schema must be that of the others."""
    spark = df.sparkSession
    try:
        kinds = dict(t for t in spark.read.parquet(path).dtypes if t[0] != label)
    except Exception:  # nothing there yet
        kinds = dict(df.dtypes)
    if kinds != dict(df.dtypes):
        raise RequestError(f"shard {name!r}: its columns differ from the others'")
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{label}={name}")


def compact(spark: SparkSession, path: str, target: str, label: str = "shard", bytes_per_file: int = 256 << 20) -> None:
    """Rewrites a sharded table with files of about one size: rows move only between neighbours of a shard."""
    df = shards(spark, path, label)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(bytes_per_file))
    df.hint("rebalance", label).write.mode("errorifexists").partitionBy(label).parquet(target)


def _shard_tables(spark: SparkSession, path: str, label: str) -> dict[str, DataFrame]:
    """Shard name to its rows, as they are stored."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName().startswith(f"{label}="))
    return {n.partition("=")[2]: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def verify_shards(spark: SparkSession, path: str, label: str = "shard") -> list[dict]:
    """For each shard its rows and the columns that differ from the widest common schema: missing, extra or narrower."""
    tables = _shard_tables(spark, path, label)
    common = widest(tables.values())
    out = []
    for name, df in tables.items():
        own = dict(df.dtypes)
        differ = sorted(c for c, t in common.items() if own.get(c) != t)
        out.append({"shard": name, "rows": df.count(), "differs": differ})
    return out


def widest(tables: Iterable[DataFrame]) -> dict[str, str]:
    """Columns of all tables, each of the type that holds all of theirs; an error where there is none."""
    common: dict[str, str] = {}
    for df in tables:
        for c, t in df.dtypes:
            common[c] = _wider(c, common.get(c, t), t)
    return common


def _wider(name: str, a: str, b: str) -> str:
    order = ["tinyint", "smallint", "int", "bigint", "double"]
    if a == b:
        return a
    if a in (*order, "float") and b in (*order, "float"):
        return "double" if "float" in (a, b) else max(a, b, key=order.index)
    raise RequestError(f"column {name!r}: no type holds both {a} and {b}")


def widen_shards(spark: SparkSession, path: str, label: str = "shard") -> list[str]:
    """Rewrites the shards that lack columns or hold narrower types than others; returns their names. Missing columns are
    null. A shard is written beside its place and then moved, so that a failure leaves the old one."""
    tables, done = _shard_tables(spark, path, label), []
    common = widest(tables.values())
    for name, df in tables.items():
        own = dict(df.dtypes)
        if own == common:
            continue
        whole = df.select(*((F.col(f"`{c}`") if c in own else F.lit(None)).cast(t).alias(c) for c, t in common.items()))
        _replace(spark, whole, path, f"{label}={name}")
        done.append(name)
    return done


def _replace(spark: SparkSession, df: DataFrame, path: str, name: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda n: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{n}")
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_new_{name}")
    system = place(name).getFileSystem(conf)
    system.delete(place(name), True)
    if not system.rename(place(f"_new_{name}"), place(name)):
        raise RequestError(f"shard {name!r} could not be moved; it is at _new_{name}")


def repair_shards(spark: SparkSession, path: str, label: str = "shard") -> list[str]:
    """Finishes what was interrupted: shards that were written beside their place move there, and schemas are made one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system, moved = root.getFileSystem(conf), []
    for f in system.listStatus(root):
        name = f.getPath().getName()
        if name.startswith(f"_new_{label}="):
            target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name[len('_new_'):]}")
            if system.exists(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}/_SUCCESS")):
                system.delete(target, True)
                system.rename(f.getPath(), target)
                moved.append(name.partition("=")[2])
            else:
                system.delete(f.getPath(), True)
    return sorted({*moved, *widen_shards(spark, path, label)})


def dedup_advisory(df: DataFrame, parent: list[str]) -> dict:
    """What a rewrite of repeated parent blocks would save. Nothing is rewritten: Parquet's dictionaries hold a repeated
    value once in a column chunk already, so results and sizes stay as they are."""
    n, blocks = df.select(F.struct(*(F.col(f"`{c}`") for c in parent)).alias("b")).agg(F.count("*"), F.approx_count_distinct(F.xxhash64("b"))).first()
    return {"rows": n, "parent_blocks": min(n, blocks), "repeated_share": 1 - min(n, blocks) / n if n else 0.0, "rewrites": False}


def save_metadata(df: DataFrame) -> str:
    return json.dumps(inspect(df))


def rake(df: DataFrame, targets: Mapping[str, Mapping[str, float]], weight: str | None = None, label: str = "weight", max_iter: int = 100, tolerance: float = 1e-9, max_cells: int = 1_000_000) -> tuple[DataFrame, dict]:
    """Rim weights: a column such that weighted shares meet each margin's targets and weights average 1.

    Factors hang on a row's combination of margin levels only, so the rows collapse to a table of combinations, which
    is fitted on the driver (its size is checked), and factors join back. A level without a target is an error."""
    import numpy as np

    names = list(targets)
    keys = [F.col(f"`{n}`").cast("string") for n in names]
    base = valid_weight(df, weight) if weight else F.lit(1.0)
    cells = df.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(keys))).agg(F.sum(base).alias("w")).limit(max_cells + 1).collect()
    if len(cells) > max_cells:
        raise RequestError(f"rake: more than {max_cells} combinations of levels")
    for i, n in enumerate(names):
        if missing := {c[i] for c in cells} - set(targets[n]):
            raise RequestError(f"rake: {n!r} has levels without a target: {sorted(map(str, missing))}")
    w = np.array([c[-1] or 0.0 for c in cells])
    total, factor, step, gap = w.sum(), np.ones(len(cells)), 0, 0.0
    sides = [{v: np.array([c[i] == v for c in cells]) for v in targets[n]} for i, n in enumerate(names)]
    for step in range(1, max_iter + 1):
        gap = 0.0
        for side, n in zip(sides, names):
            whole = sum(targets[n].values())
            for v, at in side.items():
                now, want = (w * factor)[at].sum(), total * targets[n][v] / whole
                if now > 0:
                    gap = max(gap, abs(now - want) / total)
                    factor[at] *= want / now
        if gap < tolerance:
            break
    spark = df.sparkSession
    kinds = ", ".join(f"k{i} string" for i in range(len(names)))
    table = spark.createDataFrame([(*c[:-1], float(f)) for c, f in zip(cells, factor)], f"{kinds}, _factor double")
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & (k == F.col(f"k{i}"))
    out = df.join(table, match, "left").withColumn(label, base * F.col("_factor")).drop("_factor", *(f"k{i}" for i in range(len(names))))
    return out, {"iterations": step, "gap": float(gap), "cells": len(cells)}
