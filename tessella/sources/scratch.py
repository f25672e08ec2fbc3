"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset, a session on
    one machine gets a temporary folder; a cluster is refused. What is there goes when the interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="tessella-files-")
        base = _local[app]
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            pass
