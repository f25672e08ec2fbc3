"""Results delivered in pieces, tables that are watched, and event-time aggregates (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.aggregates import AGGREGATES, windowed_quantile, with_levels
from tessella.operators.slots import Slot
from tessella.plans.request import process


def process_stream(df: DataFrame, request: Mapping, chunk: int = 1000) -> Iterator[dict]:
    """A header with the columns, chunks of rows, and a terminator with the number of rows. The driver holds one
    partition at a time."""
    rows = process(df, request).rows
    yield {"kind": "header", "columns": rows.columns}
    held, total = [], 0
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        total += 1
        if len(held) == chunk:
            yield {"kind": "rows", "rows": held}
            held = []
    if held:
        yield {"kind": "rows", "rows": held}
    yield {"kind": "end", "rows": total}


def watch(spark: SparkSession, path: str, schema, request: Mapping, deliver: Callable[[DataFrame, int], None], checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Runs a request over the whole folder each time files arrive in it: arrivals are told by a file stream, whose
    checkpoint remembers what was seen."""
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)

    def run(batch: DataFrame, number: int) -> None:
        deliver(process(spark.read.schema(schema).parquet(path), request).rows, number)

    return arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()


def event_windows(events: DataFrame, time: str, width: str, aggregations: list[Mapping], keys: list[str] = (), slide: str | None = None, late: str = "1 hour", session: bool = False) -> DataFrame:
    """Aggregates by event-time windows: tumbling, sliding by ``slide``, or sessions with a gap of ``width``. Events
    later than ``late`` are dropped on a stream; on a table none are."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    by = F.session_window(time, width) if session else F.window(time, width, slide or width)
    slots = [Slot.of(a) for a in aggregations]
    stamped = with_levels(stamped, slots)
    made = {"AGG_MEDIAN": windowed_quantile, "AGG_PERCENTILE": windowed_quantile}
    out = stamped.groupBy(by.alias("w"), *keys).agg(*((made.get(s.type) or AGGREGATES.find(s.type))(stamped, s).alias(s.name()) for s in slots))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *(f"`{s.name()}`" for s in slots))
