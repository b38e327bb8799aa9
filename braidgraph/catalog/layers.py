"""Architecture layers of the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FILE, RepoGraph
from ..operators import layers as L
from .files import flagship_graph
from .sql import MATRIX


def _on_graph(operator, **options):
    return lambda spark, sf_dir: operator(flagship_graph(spark, sf_dir), **options)


def _layers(spark: SparkSession, sf_dir: str) -> tuple[RepoGraph, DataFrame]:
    graph = flagship_graph(spark, sf_dir)
    return graph, L.assignments(graph)


def assignment_with_roles(graph: RepoGraph) -> DataFrame:
    rows = L.assignments(graph)
    return rows.join(L.layer_roles(rows).select("layer", "role"), "layer").select("group", "files", "imported_by", "imports_from", "net_score", "layer", "role")


def _violations(s, d):
    return L.violations(*_layers(s, d))


def graph_confidence(graph: RepoGraph) -> DataFrame:
    """The confidence of the layering under src, with the score of that folder and the group cycles of the graph."""
    src = L.root_scores(graph.of_type(FILE).select("path")).where("folder = 'src'").first()
    return L.confidence(L.net_scores(graph), root_score=src["score"] if src else 0, cycles=L.cycles(L.import_matrix(graph)).count())


def confidence_inputs(graph: RepoGraph) -> DataFrame:
    """One row: what confidence rests on, group cycles aside: the score of src, the spread of the groups and the ambiguous pairs."""
    nets, src = L.net_scores(graph), L.root_scores(graph.of_type(FILE).select("path")).where("folder = 'src'")
    spread = nets.agg((F.var_pop("net_score") * F.count("*") < 20).alias("even"))
    return spread.join(L.ambiguous_pairs(nets).select(F.col("n").alias("ambiguous"))).join(src.select(F.col("score").alias("root_score")))


QUERIES = {
    "group_assignment": _on_graph(L.groups),
    "group_import_matrix": _on_graph(L.import_matrix),
    "group_net_scores": _on_graph(L.net_scores),
    "layer_assignment": lambda s, d: assignment_with_roles(flagship_graph(s, d)),
    "ambiguous_pairs": lambda s, d: L.ambiguous_pairs(L.net_scores(flagship_graph(s, d))),
    "layer_confidence": lambda s, d: graph_confidence(flagship_graph(s, d)),
    "layer_roles": lambda s, d: L.layer_roles(_layers(s, d)[1], [*L.NAMING_RULES, ("^med", "Medium Layer", 3), ("^(medium)$", "Exact Medium Layer", 3)]),
    "layer_violations": _violations,
    "violation_file_pairs": lambda s, d: L.violation_pairs(*_layers(s, d)),
    "layer_health": lambda s, d: L.health(_violations(s, d)),
    "mutual_imports": lambda s, d: L.mutual_imports(L.import_matrix(flagship_graph(s, d)), _layers(s, d)[1]),
    "dependency_score": _on_graph(L.dependency_scores),
    "dependency_parts": lambda s, d: L.dependency_scores(flagship_graph(s, d), with_cycles=False).select("group", "imported_by", "imports_from", "type_only", "dynamic"),
    "confidence_inputs": lambda s, d: confidence_inputs(flagship_graph(s, d)),
    "group_scc": lambda s, d: L.group_sccs(L.import_matrix(flagship_graph(s, d))),
    "group_cycles": lambda s, d: L.cycles(L.import_matrix(flagship_graph(s, d))),
}
_ROLE = "CASE layer WHEN 1 THEN 'Foundation' WHEN 2 THEN 'Core' WHEN 3 THEN 'Application' WHEN 4 THEN 'Presentation' ELSE coalesce(ruled, 'Layer ' || layer) END"
_RULES = """, rules(seq, pattern, ruled, priority) AS (VALUES (0, '^(api|routes|endpoints)$', 'API Layer', 10), (1, '^(persistence|data|storage|db)$', 'Data Layer', 10), (2, '^(cli|commands|bin)$', 'CLI Layer', 10),
  (3, '^(infrastructure|infra|platform)$', 'Infrastructure Layer', 9), (4, '^(config|configuration|settings)$', 'Configuration Layer', 9), (5, '^(models|entities|domain)$', 'Domain Layer', 9), (6, '^(types|typings|interfaces)$', 'Type Layer', 9),
  (7, '^(services|workers|jobs)$', 'Service Layer', 8), (8, '^(hooks|middlewares|middleware)$', 'Middleware Layer', 8), (9, '^(utils|helpers|lib|common)$', 'Utility Layer', 5), (10, '^(test|tests|spec|specs|__tests__)$', 'Test Layer', 5){more}),
matched AS (SELECT layer, ruled, pattern, priority + CASE WHEN pattern LIKE '^%$' THEN 10 ELSE 0 END AS final, count(*) OVER (PARTITION BY layer) AS many,
  row_number() OVER (PARTITION BY layer ORDER BY priority + CASE WHEN pattern LIKE '^%$' THEN 10 ELSE 0 END DESC, net_score DESC, g, seq) AS rn FROM lay JOIN rules ON regexp_matches(g, '(?i)' || pattern)),
roles AS (SELECT l.layer, ruled, pattern, final, many FROM (SELECT DISTINCT layer FROM lay) l LEFT JOIN (SELECT * FROM matched WHERE rn = 1) m ON m.layer = l.layer)"""
_BROKEN = ", broken AS (SELECT b.*, f.layer AS fl, t.layer AS tl FROM between b JOIN lay f ON f.g = fg JOIN lay t ON t.g = tg WHERE type <> 'DYNAMIC_IMPORTS' AND fg <> tg AND f.layer < t.layer), v AS (SELECT fg AS from_group, tg AS to_group, count(*) AS n, count(DISTINCT (src, dst)) AS file_pairs, tl - fl AS gap FROM broken GROUP BY fg, tg, tl - fl)"
_SEVERITY = "CASE WHEN gap >= 3 THEN 'critical' WHEN gap = 2 THEN 'moderate' ELSE 'minor' END"
ORACLES = {
    "group_assignment": MATRIX + ' SELECT path, g AS "group" FROM grouped',
    "group_import_matrix": MATRIX + " SELECT fg AS from_group, tg AS to_group, n FROM matrix",
    "group_net_scores": MATRIX + ' SELECT g AS "group", files, imported_by, imports_from, net_score FROM net',
    "layer_assignment": MATRIX + _RULES.format(more="") + f' SELECT g AS "group", files, imported_by, imports_from, net_score, layer, {_ROLE} AS role FROM lay JOIN roles USING (layer)',
    "ambiguous_pairs": MATRIX + " SELECT count(*) FILTER (gap < 2) AS n FROM lagged",
    "confidence_inputs": MATRIX + " SELECT (SELECT var_pop(net_score) * count(*) FROM net) < 20 AS even, (SELECT count(*) FILTER (gap < 2) FROM lagged) AS ambiguous, 15::INTEGER AS root_score",
    "layer_roles": MATRIX
    + _RULES.format(more=", (11, '^med', 'Medium Layer', 3), (12, '^(medium)$', 'Exact Medium Layer', 3)")
    + f" SELECT layer, {_ROLE} AS role, CASE WHEN layer > 4 THEN pattern END AS pattern, CASE WHEN layer > 4 THEN final END::INTEGER AS priority, CASE WHEN layer > 4 THEN CASE WHEN pattern IS NULL THEN 0 WHEN pattern LIKE '^%$' THEN 100 WHEN many = 1 THEN 80 ELSE 50 END END::INTEGER AS naming_confidence FROM roles",
    "layer_violations": MATRIX
    + _BROKEN
    + f""" SELECT *, {_SEVERITY} AS severity, CASE WHEN gap >= 3 THEN 'Critical violation: ' || from_group || ' (lower layer) imports ' || to_group || ' (higher layer). Consider restructuring architecture'
    WHEN gap = 2 THEN 'Move shared logic from ' || to_group || ' to ' || from_group || ', or create a shared middle layer' ELSE 'Consider moving the importing file to ' || to_group || ' directory' END AS suggestion FROM v""",
    "violation_file_pairs": MATRIX + _BROKEN + " SELECT DISTINCT fg AS from_group, tg AS to_group, src AS from_path, dst AS to_path FROM broken",
    "layer_health": MATRIX + _BROKEN + " SELECT greatest(0, 100 - coalesce(sum(CASE WHEN gap >= 3 THEN 15 WHEN gap = 2 THEN 10 ELSE 5 END), 0))::INTEGER AS health FROM v",
    "mutual_imports": MATRIX + " SELECT a.fg AS group_a, a.tg AS group_b, x.layer FROM matrix a JOIN matrix b ON a.fg = b.tg AND a.tg = b.fg JOIN lay x ON x.g = a.fg JOIN lay y ON y.g = a.tg AND x.layer = y.layer WHERE a.fg < a.tg",
    "dependency_parts": MATRIX
    + """, extra AS (SELECT fg AS g, count(*) FILTER (type = 'IMPORTS' AND kind = 'type-only') AS t, count(*) FILTER (type = 'DYNAMIC_IMPORTS') AS d FROM between SEMI JOIN matrix USING (fg, tg) WHERE type <> 'RE_EXPORTS' GROUP BY fg)
    SELECT g AS "group", imported_by, imports_from - coalesce(t, 0) AS imports_from, coalesce(t, 0) AS type_only, coalesce(d, 0) AS dynamic FROM net LEFT JOIN extra USING (g)""",
    "group_scc": MATRIX
    + """, closure AS (SELECT fg AS a, tg AS b FROM matrix UNION SELECT c.a, m.tg FROM closure c JOIN matrix m ON m.fg = c.b)
    SELECT g AS "group", least(g, coalesce(m, g)) AS scc FROM (SELECT fg AS g FROM matrix UNION SELECT tg FROM matrix) LEFT JOIN (SELECT x.a AS g, min(x.b) AS m FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a GROUP BY x.a) USING (g)""",
}
