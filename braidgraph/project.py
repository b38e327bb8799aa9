"""A repository graph made from order tables, so that every operator can run, and be checked, at any scale.

Parts are files, pairs of neighbouring order lines are imports, suppliers are packages and exported symbols.  All of it
is filters, one window within orders, and aggregations; joins deal out both sides by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .model import CONTAINS, DIRECTORY, DYNAMIC_IMPORTS, EXPORTS, EXTERNAL, FILE, IMPORTS, MODULE, RE_EXPORTS, RepoGraph, edge_metadata, node_metadata
from .plans.durable import dealt

KINDS = ("function", "class", "variable", "interface", "type", "component")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, path of one file for each part: seven folders, a twentieth of the files are tests."""
    k = F.col("p_partkey")
    folder = F.when(k % 50 == 1, "").otherwise(F.concat(F.lower("p_type"), F.lit("/")))
    name = F.when(k % 20 == 0, F.concat(F.lit("__tests__/p"), k, F.lit(".test.ts"))).otherwise(F.concat(F.lit("p"), k, F.lit(".ts")))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("src/"), folder, name).alias("path"))


def _ided(kind: str, path: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), path)


def _seq() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files: each line of 45 pieces or more imports the line before it in its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").withColumn("prev", F.lag("l_partkey").over(w)).where("l_quantity >= 45 and prev <> l_partkey")
    kind = F.when(F.col("l_returnflag") == "N", IMPORTS).when(F.col("l_returnflag") == "A", RE_EXPORTS).otherwise(DYNAMIC_IMPORTS)
    pairs = lines.select(F.col("l_partkey").alias("fk"), F.col("prev").alias("tk"), kind.alias("type"), "l_linestatus", _seq().alias("seq"))
    import_kind = F.when(F.col("type") != DYNAMIC_IMPORTS, F.when(F.col("l_linestatus") == "O", "value").otherwise("type-only"))
    pairs = pairs.withColumn("importKind", import_kind).groupBy("fk", "tk", "type", "importKind").agg(F.min("seq").alias("edge_seq"))
    files = dealt(file_paths(spark, sf_dir))
    pairs = pairs.join(files.select(F.col("k").alias("fk"), F.col("path").alias("src")), "fk").join(files.select(F.col("k").alias("tk"), F.col("path").alias("dst")), "tk")
    meta = edge_metadata(importKind=F.col("importKind"), isDynamic=F.when(F.col("type") == DYNAMIC_IMPORTS, F.lit(True)))
    return pairs.select(_ided(FILE, F.col("src")).alias("from"), _ided(FILE, F.col("dst")).alias("to"), "type", meta.alias("metadata"), "edge_seq")


def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").groupBy(F.col("l_partkey").alias("k"), "l_suppkey").agg(F.min(_seq()).alias("edge_seq"))
    lines = lines.join(dealt(file_paths(spark, sf_dir)), "k")
    to = _ided(EXTERNAL, F.concat(F.lit("s"), "l_suppkey"))
    return lines.select(_ided(FILE, F.col("path")).alias("from"), to.alias("to"), F.lit(IMPORTS).alias("type"), edge_metadata(importKind=F.lit("value")).alias("metadata"), "edge_seq")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MODULE nodes: a line of three pieces or fewer exports a symbol named after its supplier from its part."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity <= 3").groupBy(F.col("l_partkey").alias("k"), "l_suppkey")
    lines = lines.agg(F.max("l_linenumber").alias("most"), F.max(F.col("l_returnflag") == "R").alias("returned"), F.count("*").cast("int").alias("n"), F.max("l_orderkey").alias("last"))
    lines = lines.join(dealt(file_paths(spark, sf_dir)), "k")
    supp = F.col("l_suppkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (supp % 6 + 1).cast("int"))
    meta = node_metadata(
        kind=kind,
        isExported=F.lit(True),
        deprecated=F.when(F.col("returned"), F.lit(True)),
        complexity=F.when(kind.isin("function", "component"), F.col("most") * 3),
        testFile=F.when(supp % 97 == 5, F.concat(F.lit("tests/f"), supp, F.lit(".ts"))),
        lastModifiedCommit=F.when(supp % 4 == 0, F.concat(F.lit("c"), F.col("last"))),
        changeFrequency=F.when(supp % 3 == 0, F.col("n")),
    )
    name = F.concat(F.lit("f"), supp)
    return lines.select(F.concat(_ided(MODULE, F.col("path")), F.lit("#"), name).alias("id"), F.lit(MODULE).alias("type"), "path", name.alias("name"), meta.alias("metadata"), (F.col("k") * 1_000_000 + supp).cast("long").alias("node_seq"))


def _node(kind: str, path: Column, name: Column, seq: Column) -> list[Column]:
    return [_ided(kind, path).alias("id"), F.lit(kind).alias("type"), path.alias("path"), name.alias("name"), node_metadata().alias("metadata"), seq.cast("long").alias("node_seq")]


def folders(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DIRECTORY nodes above the files of ``paths`` (path), and the CONTAINS edges down to those files."""
    path = F.col("path")
    above = paths.select(F.explode(C.ancestors(path)).alias("path")).distinct()
    nodes = above.select(*_node(DIRECTORY, path, F.when(path == ".", F.lit(".")).otherwise(C.basename(path)), F.lit(0)))
    link = lambda kind: [_ided(DIRECTORY, C.parent(path)).alias("from"), _ided(kind, path).alias("to"), F.lit(CONTAINS).alias("type"), edge_metadata().alias("metadata"), F.lit(0).cast("long").alias("edge_seq")]
    return nodes, above.where("path <> '.'").select(*link(DIRECTORY)).unionByName(paths.select(*link(FILE)))


def repo_graph(spark: SparkSession, sf_dir: str) -> RepoGraph:
    """The whole graph of the tables in sf_dir, lazily."""
    paths = file_paths(spark, sf_dir)
    files = paths.select(*_node(FILE, F.col("path"), C.basename(F.col("path")), F.col("k")))
    dirs, contains = folders(paths)
    modules = symbols(spark, sf_dir)
    name = F.concat(F.lit("s"), "s_suppkey")
    packages = table(spark, sf_dir, "supplier").select(*_node(EXTERNAL, name, name, F.col("s_suppkey")))
    exports = modules.select(_ided(FILE, F.col("path")).alias("from"), F.col("id").alias("to"), F.lit(EXPORTS).alias("type"), edge_metadata().alias("metadata"), F.col("node_seq").alias("edge_seq"))
    nodes = dirs.unionByName(files).unionByName(modules).unionByName(packages)
    edges = contains.unionByName(import_edges(spark, sf_dir)).unionByName(package_edges(spark, sf_dir)).unionByName(exports)
    return RepoGraph(nodes, edges, {"commitHash": "0" * 40, "timestamp": 0, "schemaVersion": {"major": 1, "minor": 0, "patch": 0}})
