"""Impact of changing the most imported files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import STATIC, RepoGraph
from ..operators import impact as I
from .files import flagship_graph
from .sql import NO_TESTS, reach, reach_by_levels, top_roots



def top_targets(graph: RepoGraph, k: int) -> DataFrame:
    """target: the k files with most static edges into them, ties by id."""
    files = graph.linked(*STATIC).where(F.col("to").startswith("FILE:")).groupBy(F.col("to").alias("target")).agg(F.count("*").alias("n"))
    return files.orderBy(F.desc("n"), "target").limit(k).select("target")


def _found(spark: SparkSession, sf_dir: str, k: int = 1, **options) -> DataFrame:
    graph = flagship_graph(spark, sf_dir)
    return I.dependents(graph, top_targets(graph, k), **options)


def via_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("path", "distance", F.explode("via").alias("via"))


_flat = lambda df: df.select("path", "distance")
QUERIES = {
    "impact_direct": lambda s, d: _flat(_found(s, d, max_depth=1)),
    "impact_transitive": lambda s, d: _flat(_found(s, d)),
    "impact_with_tests": lambda s, d: _flat(_found(s, d, include_tests=True)),
    "impact_depth2": lambda s, d: _flat(_found(s, d, max_depth=2)),
    "impact_via": via_rows,
    "impact_distributed": lambda s, d: _flat(_found(s, d, local_edges=0)),
    "impact_multi_target": lambda s, d: I.merged(_found(s, d, 3)).withColumn("via", F.array_join("via", ",")),
    "impact_summary": lambda s, d: I.summary(I.merged(_found(s, d, 3))),
    "impact_topk": lambda s, d: _flat(I.nearest(I.merged(_found(s, d, 3)))),
    "blast_radius_all_files": lambda s, d: I.blast_radii(flagship_graph(s, d)),
}
_ONE = " SELECT p AS path, d::INTEGER AS distance FROM reached"
_LEAST = ", least AS (SELECT p, min(d) AS d FROM reached GROUP BY p)"
_BAND = "CASE WHEN total = 0 THEN 'unknown' WHEN total <= 3 THEN 'low' WHEN total <= 10 THEN 'medium' ELSE 'high' END"
ORACLES = {
    "impact_direct": reach(top_roots(1), 1) + _ONE,
    "impact_transitive": reach(top_roots(1)) + _ONE,
    "impact_with_tests": reach(top_roots(1), tests="") + _ONE,
    "impact_depth2": reach(top_roots(1), 2) + _ONE,
    "impact_distributed": reach(top_roots(1)) + _ONE,
    "impact_via": reach(top_roots(1))
    + """ SELECT r.p AS path, r.d::INTEGER AS distance, dep.b AS via FROM reached r JOIN dep ON dep.a = r.p
    WHERE (r.d = 1 AND dep.b = r.t) OR dep.b IN (SELECT q.p FROM reached q WHERE q.t = r.t AND q.d = r.d - 1)""",
    "impact_multi_target": reach(top_roots(3))
    + """, least AS (SELECT p, min(d) AS d FROM reached GROUP BY p),
    pairs AS (SELECT DISTINCT r.p, r.d, dep.b FROM reached r JOIN least USING (p, d) JOIN dep ON dep.a = r.p WHERE (r.d = 1 AND dep.b = r.t) OR EXISTS (SELECT 1 FROM reached q WHERE q.t = r.t AND q.p = dep.b AND q.d = r.d - 1))
    SELECT p AS path, d::INTEGER AS distance, string_agg(b, ',' ORDER BY b) AS via FROM pairs GROUP BY p, d""",
    "impact_summary": reach(top_roots(3)) + _LEAST + f" SELECT *, {_BAND} AS blast_radius FROM (SELECT count(*) FILTER (d = 1) AS direct, count(*) FILTER (d > 1) AS indirect, count(*) AS total FROM least)",
    "impact_topk": reach(top_roots(3)) + _LEAST + " SELECT p AS path, d::INTEGER AS distance FROM least ORDER BY d, p LIMIT 20",
    "blast_radius_all_files": reach_by_levels("SELECT path AS t FROM files", 10, NO_TESTS) + f" SELECT path, total, {_BAND} AS blast_radius FROM (SELECT path, count(p) AS total FROM files LEFT JOIN reached ON t = path GROUP BY path)",
}
