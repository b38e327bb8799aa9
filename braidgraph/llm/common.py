"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that all executors share: the one in
``spark.checkpoint.dir``.  Only where the session has none (tests, notebooks)
a temporary folder of this machine is taken.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seed of all keyed choices.
SEED = 20240607
#: White space of the text contracts, as a Java/RE2 class and as bytes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder in ``spark.checkpoint.dir``; a temporary one only if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="braid-"))
        where = _own[0]
    return where.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, tag: str, batch: int = 1000) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again (cuts the lineage).  Meanwhile ``batch`` rows at most go to
    a Python worker at once: rows here hold whole texts and sets."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braid-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/braid-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """From now on at most ``most`` rows go to a Python worker at once in this session: rows here hold whole texts, and the buffers
    of a batch stay with the executor."""
    if not 0 < int(spark.conf.get(_BATCH)) <= most:
        spark.conf.set(_BATCH, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark tells no case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Every text as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """Cut a batch into slices of about ``limit`` bytes of text, a row at least: what a worker holds at once, many times over."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def windows(text: str, between: re.Pattern, size: int = 1 << 20):
    """A text in parts of about ``size`` characters that end before a place where ``between`` matches."""
    at = 0
    while len(text) - at > size:
        cut = between.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def heavy_join(rows: DataFrame, of: DataFrame, keys: list[str], count, how: str = "inner", k: int = 1024) -> DataFrame:
    """rows joined with ``of`` on keys that are unique there, where ``count`` tells how many rows each key has.

    Keys of over 1 / k of all rows, k of them at most by arithmetic, are broadcast and never meet in a shuffle.  Keys are
    not null in ``of``; rows with none of its keys stay with ``how`` left."""
    total = of.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(of.where(count > max(total // k, 1000)).withColumn("__hot", F.lit(True)))
    given = [c for c in of.columns if c not in keys]
    marked = rows.join(hot.select(*keys, "__hot"), keys, "left")
    often = marked.where("__hot").drop("__hot").join(hot.drop("__hot"), keys)
    seldom = marked.where("__hot is null").drop("__hot").join(of, keys, how)
    return often.select(*rows.columns, *given).unionByName(seldom.select(*rows.columns, *given))


def connected(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, component), the smallest
    node that can be reached; nodes without an edge have no row.

    Alternating large-star and small-star steps; each keeps the number of edges within the
    number of rows it was given, so a hub of any size costs what its edges cost.  Each round is
    a written table; only a count and a checksum come to the driver.
    """
    edges = written(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), tag)
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, tag)
        discard(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
