"""The compressed interchange format as relational operators: a path dictionary, ids taken apart, imports in batches.

Parquet keeps graphs without loss; this format is for exchange and loses what it loses by definition: metadata and
repetition of imports, names of symbols at the ends of edges, and the types of ends, which are guessed from paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import CONTAINS, EXPORTS, FILE, IMPORTS, MODULE, RepoGraph
from ..plans.durable import dealt, numbered


def path_references(graph: RepoGraph) -> DataFrame:
    """path, n: how often each path stands in a node or at an end of an edge."""
    ends = graph.edges.select(C.file_path(F.col("from")).alias("path")).unionAll(graph.edges.select(C.file_path(F.col("to")).alias("path")))
    return graph.nodes.select("path").unionAll(ends).groupBy("path").agg(F.count("*").alias("n"))


def path_table(graph: RepoGraph) -> DataFrame:
    """path, idx: the most referenced first, ties by path, from 0.

    The order is global but no task sorts it whole; the sorted paths are written, so what joins with them counts nothing again.
    """
    return numbered(path_references(graph).orderBy(F.desc("n"), "path").select("path"), "idx", "paths")


def _indexed(edges: DataFrame, table: DataFrame) -> DataFrame:
    """edges with fromIndex and toIndex; -1 for paths that the table lacks."""
    at = edges.withColumn("__f", C.file_path(F.col("from"))).withColumn("__t", C.file_path(F.col("to")))
    a, b = table.select(F.col("path").alias("__f"), F.col("idx").alias("fi")), table.select(F.col("path").alias("__t"), F.col("idx").alias("ti"))
    joined = at.join(dealt(a), "__f", "left").join(dealt(b), "__t", "left")
    return joined.withColumn("fromIndex", F.coalesce("fi", F.lit(-1)).cast("long")).withColumn("toIndex", F.coalesce("ti", F.lit(-1)).cast("long")).drop("__f", "__t", "fi", "ti")


def import_batches(graph: RepoGraph, table: DataFrame) -> DataFrame:
    """fromIndex, targetIndexes: the distinct targets of each importing file; edges with an unknown end are left out."""
    rows = _indexed(graph.linked(IMPORTS), table).where("fromIndex >= 0 and toIndex >= 0")
    return rows.groupBy("fromIndex").agg(F.sort_array(F.collect_set("toIndex")).alias("targetIndexes"))


def expanded_batches(batches: DataFrame, table: DataFrame) -> DataFrame:
    """from, to of batches: the source is taken for a file, a target for a package if its path looks like one."""
    rows = batches.select("fromIndex", F.explode("targetIndexes").alias("toIndex"))
    table = dealt(table)
    rows = rows.join(table.select(F.col("idx").alias("fromIndex"), F.col("path").alias("f")), "fromIndex").join(table.select(F.col("idx").alias("toIndex"), F.col("path").alias("t")), "toIndex")
    to = F.concat(F.when(C.looks_external(F.col("t")), "EXTERNAL:").otherwise("FILE:"), F.col("t"))
    return rows.select(F.concat(F.lit("FILE:"), "f").alias("from"), to.alias("to"))


def compressed_nodes(graph: RepoGraph, table: DataFrame, most: int = 100) -> DataFrame:
    """type, pathIndex, name, metadata (the fields that the format keeps), node_seq."""
    doc = C.truncated_doc(F.col("metadata.jsDoc"), most)
    kept = ("kind", "isExported", "jsDoc", "jsDocTruncated", "hasJSDoc", "deprecated", "complexity", "loc")
    m = F.when(F.col("type") == MODULE, F.col("metadata").withField("jsDoc", doc["jsDoc"]).withField("jsDocTruncated", F.when(doc["jsDoc"].isNotNull(), F.coalesce(doc["jsDocTruncated"], F.lit(False)))).withField("hasJSDoc", doc["hasJSDoc"])).otherwise(F.col("metadata"))
    nodes = graph.nodes.withColumn("metadata", m).join(dealt(table), "path", "left")
    return nodes.select("type", F.coalesce("idx", F.lit(-1)).cast("long").alias("pathIndex"), "name", F.struct(*[F.col(f"metadata.{k}").alias(k) for k in kept]).alias("metadata"), "node_seq")


def compressed_edges(graph: RepoGraph, table: DataFrame) -> DataFrame:
    """type, fromIndex, toIndex, metadata of all edges that are no imports."""
    return _indexed(graph.edges.where(F.col("type") != IMPORTS), table).select("type", "fromIndex", "toIndex", "metadata", "edge_seq")


def node_id(kind: Column, path: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), path, F.when((kind == MODULE) & name.isNotNull(), F.concat(F.lit("#"), name)).otherwise(F.lit("")))


def guessed_type(path: Column, edge_type: Column, at: str) -> Column:
    """The type of an edge's end in this format.  EXPORTS come back with a symbol before and a file behind them."""
    code = path.rlike(C.CODE_SUFFIX)
    bare = ~path.contains("/") & ~code
    by = {
        CONTAINS: F.when(code, "FILE").otherwise("DIRECTORY") if at == "from" else F.lit(FILE),
        IMPORTS: F.lit(FILE) if at == "from" else F.when(bare, "EXTERNAL").otherwise(FILE),
        EXPORTS: F.lit(MODULE) if at == "from" else F.lit(FILE),
    }
    out = F.when(path.contains("node_modules"), "EXTERNAL")
    for kind, value in by.items():
        out = out.when(edge_type == kind, value)
    return out.otherwise(F.when(code, "FILE").otherwise("DIRECTORY"))


def restored_nodes(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """id, type, path, name, metadata, node_seq from compressed nodes; an index outside the table fails."""
    rows = nodes.join(dealt(table.withColumnRenamed("idx", "pathIndex")), "pathIndex", "left")
    path = F.coalesce("path", F.raise_error(F.concat(F.lit("pathIndex out of bounds: "), F.col("pathIndex"))).cast("string"))
    rows = rows.withColumn("path", path)
    return rows.select(node_id(F.col("type"), F.col("path"), F.col("name")).alias("id"), "type", "path", F.coalesce("name", F.lit("")).alias("name"), "metadata", "node_seq")


def restored_edges(edges: DataFrame, table: DataFrame) -> DataFrame:
    """from, to, type, metadata of compressed edges that are no batches."""
    table = dealt(table)
    rows = edges.join(table.select(F.col("idx").alias("fromIndex"), F.col("path").alias("f")), "fromIndex").join(table.select(F.col("idx").alias("toIndex"), F.col("path").alias("t")), "toIndex")
    end = lambda c, at: F.concat(guessed_type(F.col(c), F.col("type"), at), F.lit(":"), F.col(c))
    return rows.select(end("f", "from").alias("from"), end("t", "to").alias("to"), "type", "metadata", "edge_seq")
