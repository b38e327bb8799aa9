"""What a change reaches: reverse transitive closure over static edges, with distances, paths and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import FILE, STATIC, TARGET_NOT_FOUND, QueryError, RepoGraph
from ..plans.fixpoint import LOCAL_EDGES, reach, reach_counts

#: The defaults of the query.
MAX_DEPTH, MAX_FILES = 10, 20


def normalize(targets: list[str]) -> list[str]:
    """Distinct FILE ids of targets in order: a symbol stands for its file, packages and blanks fall out."""
    out = []
    for t in targets:
        t = t.strip()
        if not t or t.startswith("EXTERNAL:"):
            continue
        out.append(f"{FILE}:" + t.removeprefix("FILE:").removeprefix("MODULE:").split("#", 1)[0])
    return list(dict.fromkeys(out))


def dependency_edges(graph: RepoGraph, include_tests: bool = False) -> DataFrame:
    """The edges that carry a change.  Importing tests are left out here, before the walk: they prune it."""
    edges = graph.linked(*STATIC).select("from", "to")
    return edges if include_tests else edges.where(~C.test_node(F.col("from")))


def dependents(graph: RepoGraph, targets: DataFrame, max_depth: int = MAX_DEPTH, include_tests: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """target, path, distance, via for each target (target: FILE id); depths 0 and 1 both mean direct ones only."""
    found = reach(dependency_edges(graph, include_tests), targets, max(1, max_depth), local_edges)
    return found.select("target", C.file_path(F.col("id")).alias("path"), "distance", F.transform("via", C.file_path).alias("via"))


def merged(found: DataFrame) -> DataFrame:
    """path, distance, via over all targets: the least distance, and everything on the way at that distance."""
    least = found.groupBy("path").agg(F.min("distance").alias("least"))
    near = found.join(least, "path").where("distance = least")
    return near.groupBy("path", "distance").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via"))


def summary(found: DataFrame) -> DataFrame:
    """One row: direct, indirect, total, blast_radius of a result of merged()."""
    counts = found.agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("indirect"), F.count("*").alias("total"))
    return counts.withColumn("blast_radius", C.blast_radius(F.col("total")))


def nearest(found: DataFrame, k: int = MAX_FILES) -> DataFrame:
    """The k nearest files (the report's limit), ties by path."""
    return found.orderBy("distance", "path").limit(k)


def blast_radii(graph: RepoGraph, max_depth: int = MAX_DEPTH, include_tests: bool = False) -> DataFrame:
    """path, total, blast_radius for every file of the graph."""
    files = graph.of_type(FILE).select(F.col("id").alias("target"), "path")
    counts = reach_counts(dependency_edges(graph, include_tests), files.select("target"), max(1, max_depth))
    total = F.coalesce("n", F.lit(0)).cast("long")
    return files.join(counts, "target", "left").select("path", total.alias("total"), C.blast_radius(total).alias("blast_radius"))


def get_impact(graph: RepoGraph, targets: list[str], max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES, include_tests: bool = False) -> dict:
    """Files that a change of the targets reaches; at most ``max_files`` are listed, all are counted."""
    wanted = normalize(targets)
    known = {r["id"] for r in graph.nodes.where(F.col("id").isin(wanted)).select("id").collect()} if wanted else set()
    valid = [t for t in wanted if t in known]
    if not valid and targets:
        raise QueryError(TARGET_NOT_FOUND, f"Target not found: {targets[0]}", "Run `braidgraph analyze` to build graph first")
    base = {"success": True, "targets": targets}
    if not valid:
        facts, files = {"direct": 0, "indirect": 0, "total": 0, "blast_radius": "unknown"}, []
    else:
        rows = graph.spark.createDataFrame([(t,) for t in valid], "target string")
        found = merged(dependents(graph, rows, max_depth, include_tests))
        facts = summary(found).first().asDict()
        files = [r.asDict() for r in nearest(found, max_files).collect()]
    return base | {
        "affectedFiles": files,
        "summary": {k: facts[k] for k in ("direct", "indirect", "total")},
        "blastRadius": facts["blast_radius"],
        "truncated": facts["total"] > len(files),
        "warnings": [] if facts["total"] else ["No dependents found - file may be isolated or entry point"],
        "nextSuggested": [*([f"braidgraph scope FILE:{files[0]['path']}"] if files else []), "braidgraph layers"],
    }
