"""What the operators share: word splitting on bytes, shared scratch tables, and row keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in an Arrow batch at most: a batch of the longest documents must fit a worker.
BATCH_ROWS = 1000

#: Lower-cases A-Z and turns every byte outside [0-9a-z\x80-\xff] into a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def alnum_words(data: bytes | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of UTF-8 text after lower-casing A-Z."""
    return data.translate(ALNUM).split() if data else []


def space_words(data: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of UTF-8 text after lower-casing A-Z (``bytes.lower`` is ASCII only)."""
    return data.lower().split() if data else []


def as_text(data: bytes | None) -> str:
    return data.decode("utf-8", "replace") if data else ""


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches, so that memory follows the longest documents and not their number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))


_kept: list[tuple[str, Callable[[], None]]] = []
_entered: list[str] = [""]


def keeps(module: str, clear: Callable[[], None]) -> None:
    """Registers what a module keeps between the tasks of a worker."""
    _kept.append((module, clear))


def entering(module: str) -> None:
    """At the start of a task: workers live through many stages, so what other modules have kept goes when the stage
    changes, and memory that was freed returns to the system."""
    if _entered[0] != module:
        _entered[0] = module
        for owner, clear in _kept:
            if owner != module:
                clear()
        gc.set_threshold(700, 10, 10)
        gc.collect()
        leaving()


def leaving() -> None:
    """At the end of a task: memory that was freed returns to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Runs ``fn`` on each Arrow batch; it returns the output columns by name."""
    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))
    kinds = [(field.name, field.type) for field in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering(fn.__module__)
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], kind) for n, kind in kinds],
                    [n for n, _ in kinds],
                )
            del batch, out
        leaving()

    return df.mapInArrow(run, schema)


def row_key(id_col: str, text_col: str) -> Column:
    """One long for a row's id and text. Repeated rows (same id, same text) share it and count as one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


_own: dict[str, str] = {}
#: Owners of scratch tables, the innermost last. What no call owns goes when the interpreter ends.
_owners: threading.local = threading.local()
_rest: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine
    (tests) gets a temporary folder; a cluster is refused, as its executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own[app]


@contextlib.contextmanager
def owning(until_exit: bool = False) -> Iterator[list]:
    """Collects the scratch tables that ``written`` makes in this block, in this thread. They are deleted when the block
    ends, or with ``until_exit`` left to the caller, who passes the list to ``release``."""
    stack = _owners.__dict__.setdefault("stack", [])
    made: list = []
    stack.append(made)
    try:
        yield made
    except BaseException:
        until_exit = False
        raise
    finally:
        del stack[next(k for k, x in enumerate(stack) if x is made)]
        if not until_exit:
            release(made)


def written(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the reread table: cuts lineage, survives lost executors.

    The innermost ``owning`` block owns the table; with ``outlive`` the block around that one does."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    owners = [_rest, *_owners.__dict__.get("stack", [])]
    owners[-1 - (outlive and len(owners) > 1)].append((spark, path.rpartition("/")[0]))
    return spark.read.schema(df.schema).parquet(path)


def release(made: list[tuple[SparkSession, str]]) -> None:
    """Deletes scratch tables. Only call it once every result that reads them is stored."""
    while made:
        spark, path = made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder stays for the cluster's own cleaning
            pass


def reads(df: DataFrame, made: list[tuple[SparkSession, str]]) -> bool:
    """Whether a frame's plan scans any of these scratch tables."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for k in range(leaves.size()):
        try:
            roots.append(leaves.apply(k).relation().location().rootPaths().mkString("\n"))
        except Exception:  # a leaf that is no table of files
            continue
    return any(path.rpartition("/")[2] in root for _, path in made for root in roots)


def adopt(made: list[tuple[SparkSession, str]]) -> None:
    """Hands scratch tables to the block around this call, or to the interpreter's end."""
    (_owners.__dict__.get("stack") or [_rest])[-1].extend(made)
    made.clear()


atexit.register(release, _rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: rows (node, component), component the smallest node.

    Alternates large-star and small-star passes, each a group-by-minimum with map-side combine and a join that
    adaptive execution can split, until the edge set stands still; rounds grow with the logarithm of the diameter.
    """

    def stored(df: DataFrame, made: list) -> tuple[DataFrame, tuple, list]:
        seen = Observation()
        with owning(until_exit=True) as own:
            out = written(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        release(made)  # the edges that these came from
        return out, (seen.get["n"], seen.get["h"]), own

    now, state, made = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), [])
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before = state
        now, state, made = stored(small, made)
        if before == state:
            break
    adopt(made)
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    return found.select(F.col("u").alias("node"), "component").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
