"""Integrity of a graph as queries: duplicates, ids that don't fit their node, dangling edges, bad headers."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_TYPES, NODE_TYPES, RepoGraph
from ..plans.durable import dealt
from .codec import node_id

#: How far ahead a time stamp may lie, and what a commit looks like.
FUTURE_MS, COMMIT = 60_000, r"^[a-f0-9]{7,40}$"


def duplicate_nodes(graph: RepoGraph) -> DataFrame:
    """id, n of ids that stand on several nodes."""
    return graph.nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def mismatched_ids(graph: RepoGraph) -> DataFrame:
    """id, expected of nodes whose id is not made of their type, path and name."""
    want = node_id(F.col("type"), F.col("path"), F.col("name"))
    return graph.nodes.select("id", want.alias("expected")).where("not (id <=> expected)")


def dangling_edges(graph: RepoGraph) -> DataFrame:
    """from, to, type, missing ('from' or 'to') of ends without a node; an edge may come twice."""
    ids = graph.nodes.select("id").distinct()
    lost = lambda end: graph.edges.join(dealt(ids.withColumnRenamed("id", end)), end, "left_anti").select("from", "to", "type", F.lit(end).alias("missing"))
    return lost("from").unionByName(lost("to"))


def invalid_nodes(graph: RepoGraph) -> DataFrame:
    return graph.nodes.where(F.col("id").isNull() | F.col("path").isNull() | ~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False)))


def invalid_edges(graph: RepoGraph) -> DataFrame:
    return graph.edges.where(F.col("from").isNull() | F.col("to").isNull() | ~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False)))


def header_errors(meta: dict, now_ms: int | None = None) -> list[str]:
    now = int(time.time() * 1000) if now_ms is None else now_ms
    out = []
    if meta.get("timestamp") is not None and meta["timestamp"] > now + FUTURE_MS:
        out.append(f"Timestamp is in the future: {meta['timestamp']}")
    if meta.get("commitHash") and not re.match(COMMIT, meta["commitHash"]):
        out.append(f"Invalid commit hash format: {meta['commitHash']}")
    return out


def integrity_counts(graph: RepoGraph) -> DataFrame:
    """check, n of every check over the tables."""
    checks = {"duplicate_nodes": duplicate_nodes, "mismatched_ids": mismatched_ids, "dangling_edges": dangling_edges, "invalid_nodes": invalid_nodes, "invalid_edges": invalid_edges}
    out = None
    for name, check in checks.items():
        one = check(graph).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def verify(graph: RepoGraph, examples: int = 10) -> dict:
    """Counts of all checks, with some examples of each (a report's limit)."""
    counts = {r["check"]: r["n"] for r in integrity_counts(graph).collect()}
    errors = header_errors(graph.meta)
    shown = {}
    for name, check in (("duplicate_nodes", duplicate_nodes), ("dangling_edges", dangling_edges), ("mismatched_ids", mismatched_ids)):
        if counts[name]:
            shown[name] = [r.asDict() for r in check(graph).limit(examples).collect()]
    return {"valid": not errors and not any(counts.values()), "counts": counts, "errors": errors, "examples": shown}
