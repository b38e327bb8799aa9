"""A stream of file changes that keeps a graph up to date, and windowed counts over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import coalesced
from ..plans.durable import shared_dir

CHANGES = "path string, seq long, type string, at timestamp"


def change_stream(spark: SparkSession, folder: str, files_each: int | None = None) -> DataFrame:
    """Changes from Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(CHANGES)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(folder)


def apply_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Fold each batch's changes by path and hand them to ``apply``(changes, batch id).  A batch that is run again after a
    failure has the same id and rows, so an ``apply`` that writes under its batch id is exactly-once."""
    where = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-changes"
    return stream.writeStream.foreachBatch(lambda rows, batch: apply(coalesced(rows), batch)).option("checkpointLocation", where).trigger(**(trigger or {"availableNow": True})).start()


def change_rates(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """start, type, n: changes in event-time windows; rows later than ``late`` are dropped by the watermark."""
    rows = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "type", "n")
