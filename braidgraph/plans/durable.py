"""Written tables: how plans of many steps cut their lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of this machine only where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="braidgraph-"))
        where = _own[0]
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table of the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/graph-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df for joins that deal out both sides by key.  Broadcasts go through the driver, and Spark judges by compressed lengths what is
    small enough for one: 1.2 million paths come in under 10 MB of Parquet and are 144 MB there."""
    return df.hint("merge")


def numbered(ordered: DataFrame, number: str, tag: str) -> DataFrame:
    """The rows of a sorted table with their places from 0: it is written as sorted, and the sizes of its parts give where each begins."""
    rows = written(ordered.withColumn("__m", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__m", 33)
    first, offsets = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r["part"], first))
        first += r["n"]
    starts = ordered.sparkSession.createDataFrame(offsets, "__part long, __first long")
    place = F.col("__first") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*ordered.columns, place.alias(number))


def small_rows(df: DataFrame, most: int) -> list | None:
    """The rows of df if there are at most ``most``; None if there are more (which are not fetched)."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
