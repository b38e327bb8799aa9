"""Base-table operators: lookups, upserts, cascading deletes and counts, as joins over the two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import CONTAINS, DIRECTORY, EXPORTS, EXTERNAL, FILE, IMPORTS, MODULE, STATIC, RepoGraph
from ..plans.fixpoint import strong_components


def node(graph: RepoGraph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id)


def without_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that neither begin nor end at one of ``ids`` (id)."""
    gone = ids.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "from"), "from", "left_anti").join(gone.withColumnRenamed("id", "to"), "to", "left_anti").select(*edges.columns)


def upsert_nodes(graph: RepoGraph, new: DataFrame, keep_edges: bool = True) -> RepoGraph:
    """Add nodes; rows of an id that exists are replaced.  Its edges stay unless ``keep_edges`` is False."""
    nodes = graph.nodes.join(new.select("id").distinct(), "id", "left_anti").select(*graph.nodes.columns).unionByName(new)
    if keep_edges:
        return graph.with_(nodes=nodes)
    known = new.select("id").join(graph.nodes.select("id"), "id", "left_semi")
    return graph.with_(nodes=nodes, edges=without_edges_of(graph.edges, known))


def add_edges(graph: RepoGraph, new: DataFrame) -> RepoGraph:
    """Append edges: a bag, so nothing is compared, and ends may dangle."""
    return graph.with_(edges=graph.edges.unionByName(new))


def remove_nodes(graph: RepoGraph, ids: DataFrame) -> RepoGraph:
    """Delete nodes with all edges at either end."""
    nodes = graph.nodes.join(ids.select("id").distinct(), "id", "left_anti").select(*graph.nodes.columns)
    return graph.with_(nodes=nodes, edges=without_edges_of(graph.edges, ids))


def remove_edge(graph: RepoGraph, edge: dict) -> RepoGraph:
    """Delete the edges of one sequence number between two nodes."""
    same = F.lit(True)
    for k in ("from", "to", "type", "edge_seq"):
        same = same & F.col(k).eqNullSafe(F.lit(edge[k]))
    return graph.with_(edges=graph.edges.where(~same))


def nodes_of_files(graph: RepoGraph, paths: DataFrame) -> DataFrame:
    """FILE and MODULE nodes of ``paths`` (path)."""
    return graph.of_type(FILE, MODULE).join(paths.select("path").distinct(), "path", "left_semi")


def remove_file_edges(graph: RepoGraph, paths: DataFrame) -> RepoGraph:
    return graph.with_(edges=without_edges_of(graph.edges, nodes_of_files(graph, paths)))


def remove_files(graph: RepoGraph, paths: DataFrame) -> RepoGraph:
    """Delete files with their symbols and every edge at either."""
    return remove_nodes(graph, nodes_of_files(graph, paths))


def merge_parsed(graph: RepoGraph, parsed: RepoGraph, last_file_wins: bool = False) -> RepoGraph:
    """Add what a parser found.  Nodes are a set by id; all edges stay.

    last_file_wins: each package keeps only the edges of the file that was parsed last, which is what replacing a
    node together with its edges comes to when every importing file names the package again.
    """
    merged = add_edges(upsert_nodes(graph, parsed.nodes.dropDuplicates(["id"])), parsed.edges)
    if not last_file_wins:
        return merged
    order = graph.of_type(FILE).select(F.col("id").alias("from"), F.col("node_seq").alias("file_seq"))
    outward = merged.edges.join(order, "from", "left")
    last = outward.where(F.col("to").startswith(f"{EXTERNAL}:")).groupBy("to").agg(F.max("file_seq").alias("last"))
    kept = outward.join(last, "to", "left").where("last is null or file_seq is null or file_seq = last").select(*merged.edges.columns)
    return merged.with_(edges=kept)


def edge_counts(graph: RepoGraph) -> DataFrame:
    """One row: imports, exports, contains and all edges."""
    count = lambda kind: F.count_if(F.col("type") == kind).alias(kind.lower())
    return graph.edges.agg(count(IMPORTS), count(EXPORTS), count(CONTAINS), F.count("*").alias("edges"))


def edge_type_counts(graph: RepoGraph) -> DataFrame:
    return graph.edges.groupBy("type").agg(F.count("*").alias("n"))


def edge_rollup(graph: RepoGraph, root: str = "src") -> DataFrame:
    """Edges by type and group of the importing file, with subtotals."""
    own = graph.linked(IMPORTS, "RE_EXPORTS", "DYNAMIC_IMPORTS").withColumn("group", C.group_of(C.file_path(F.col("from")), root))
    return own.rollup("type", "group").agg(F.count("*").alias("n"))


def folders_and_files(graph: RepoGraph) -> DataFrame:
    return graph.of_type(DIRECTORY, FILE)


def file_sccs(graph: RepoGraph) -> DataFrame:
    """path, scc: files of static edges between files that import each other in a circle; the smallest path names each."""
    edges = graph.linked(*STATIC).where(F.col("from").startswith("FILE:") & F.col("to").startswith("FILE:"))
    found = strong_components(edges.select(C.file_path(F.col("from")).alias("from"), C.file_path(F.col("to")).alias("to")))
    return found.select(F.col("node").alias("path"), "scc")
