"""One-hop context of every file."""

from __future__ import annotations

from ..operators import scope as Q
from .files import flagship_graph
from .sql import GRAPH


def _on_graph(operator, **options):
    return lambda spark, sf_dir: operator(flagship_graph(spark, sf_dir), **options)


QUERIES = {
    "scope_exports": _on_graph(Q.exports),
    "scope_imports": _on_graph(Q.imports),
    "scope_imports_with_kind": _on_graph(Q.imports_with_kind),
    "scope_imported_by": _on_graph(Q.imported_by),
    "external_importers": _on_graph(Q.external_importers),
    "import_count": _on_graph(Q.import_counts),
    "imported_by_count": _on_graph(Q.imported_by_counts),
    "test_file_lookup": _on_graph(Q.test_files),
    "test_file_lookup_compat": _on_graph(Q.test_files, compat=True),
    "file_metrics": _on_graph(Q.file_metrics),
    "quick_brief": _on_graph(Q.quick_briefs),
    "hotspots": _on_graph(Q.hotspots),
    "ranked_symbols": _on_graph(Q.ranked_symbols),
    "keyword_files": lambda s, d: Q.top_files(flagship_graph(s, d), ["small", "f7", "test"]),
}

_LEVEL = "CASE WHEN {0} = 0 THEN 'unknown' WHEN {0} <= 5 THEN 'low' WHEN {0} <= 15 THEN 'medium' WHEN {0} <= 25 THEN 'high' ELSE 'critical' END"
_OUT = "type IN ('IMPORTS', 'RE_EXPORTS', 'DYNAMIC_IMPORTS')"
_STATIC = "type IN ('IMPORTS', 'RE_EXPORTS')"
METRICS = (
    GRAPH
    + f""", sums AS (SELECT path, sum(complexity) AS c, bool_or(deprecated) AS deprecated, max_by(last_commit, CASE WHEN last_commit IS NOT NULL THEN seq END) AS last_commit, max(freq) AS f FROM mods GROUP BY path),
  metrics AS (SELECT path, coalesce(c, 0)::BIGINT AS complexity, {_LEVEL.format("coalesce(c, 0)")} AS level, coalesce(deprecated, false) AS deprecated, last_commit, coalesce(f, 0)::BIGINT AS change_frequency FROM files LEFT JOIN sums USING (path)),
  outs AS (SELECT path, count(e."to") AS imports FROM files LEFT JOIN edges e ON e."from" = 'FILE:' || path AND {_OUT} GROUP BY path),
  ins AS (SELECT path, count(e."to") AS imported_by FROM files LEFT JOIN edges e ON e."to" = 'FILE:' || path AND {_STATIC} GROUP BY path)"""
)


def _tests(compat: bool) -> str:
    tries = [r"regexp_replace(path, '\.ts$', '.test.ts')", r"regexp_replace(path, '\.tsx$', '.test.tsx')", "regexp_replace(path, '^src/', 'src/__tests__/')", "regexp_replace(path, '^src/', 'tests/')", r"regexp_replace(path, '\.ts$', '.spec.ts')"]
    probes = " UNION ALL ".join(f"SELECT path, {i} AS pos, {t} AS probe FROM files" for i, t in enumerate(tries))
    return f""", probes AS ({probes}), hits AS (SELECT path, min_by(probe, pos) AS probed FROM probes WHERE probe IN (SELECT path FROM files) {"" if compat else "AND probe <> path"} GROUP BY path),
  named AS (SELECT path, min_by(test_file, seq) AS named FROM mods WHERE test_file IS NOT NULL GROUP BY path),
  tested AS (SELECT path, coalesce(named, probed) AS test_file FROM files LEFT JOIN hits USING (path) LEFT JOIN named USING (path) WHERE coalesce(named, probed) IS NOT NULL)"""


ORACLES = {
    "scope_exports": GRAPH + " SELECT path, kind, name FROM mods",
    "scope_imports": GRAPH + f' SELECT DISTINCT e."from" AS file, n.path AS target FROM edges e JOIN nodes n ON n.id = e."to" WHERE e.{_OUT}',
    "scope_imports_with_kind": GRAPH
    + f""", found AS (SELECT e."from" AS file, n.path AS target, CASE e.type WHEN 'DYNAMIC_IMPORTS' THEN 'dynamic' WHEN 'RE_EXPORTS' THEN 're-export' ELSE 'static' END AS import_type,
      CASE WHEN n.type = 'EXTERNAL' THEN 'value' ELSE coalesce(e.kind, 'value') END AS kind, seq FROM edges e JOIN nodes n ON n.id = e."to" WHERE e.{_OUT})
    SELECT file, target, import_type, kind FROM (SELECT *, row_number() OVER (PARTITION BY file, target, kind ORDER BY seq, import_type) AS rn FROM found) WHERE rn = 1""",
    "scope_imported_by": GRAPH + f""" SELECT DISTINCT "to" AS target, substr("from", 6) AS file FROM edges WHERE {_STATIC}""",
    "external_importers": GRAPH + """ SELECT n.name, count(DISTINCT e."from") AS importers FROM nodes n LEFT JOIN edges e ON e."to" = n.id AND e.type IN ('IMPORTS', 'RE_EXPORTS') WHERE n.type = 'EXTERNAL' GROUP BY n.name""",
    "import_count": METRICS + " SELECT * FROM outs",
    "imported_by_count": METRICS + " SELECT * FROM ins",
    "test_file_lookup": GRAPH + _tests(False) + " SELECT * FROM tested",
    "test_file_lookup_compat": GRAPH + _tests(True) + " SELECT * FROM tested",
    "file_metrics": METRICS + " SELECT * FROM metrics",
    "quick_brief": METRICS + _tests(False) + " SELECT path, imports, imported_by, test_file IS NOT NULL AS has_test, deprecated, level FROM metrics JOIN outs USING (path) JOIN ins USING (path) LEFT JOIN tested USING (path)",
    "hotspots": METRICS + " SELECT path, complexity * change_frequency AS hotspot FROM metrics WHERE complexity * change_frequency > 0",
    "ranked_symbols": GRAPH + " SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY complexity DESC NULLS LAST, name) AS rank FROM mods",
    "keyword_files": GRAPH
    + f""", texts AS (SELECT path, lower(path || ' ' || name) AS t FROM nodes WHERE type IN ('FILE', 'MODULE')),
    hit AS (SELECT path, (max(contains(t, 'small')::INT) + max(contains(t, 'f7')::INT) + max(contains(t, 'test')::INT))::BIGINT AS hits FROM texts GROUP BY path),
    deg AS (SELECT replace(id, 'FILE:', '') AS path, count(*) AS degree FROM (SELECT "from" AS id FROM edges WHERE {_OUT} UNION ALL SELECT "to" FROM edges WHERE {_OUT}) GROUP BY 1)
    SELECT path, hits, coalesce(degree, 0)::BIGINT AS degree FROM hit LEFT JOIN deg USING (path) WHERE hits > 0 ORDER BY hits DESC, degree DESC, path LIMIT 20""",
}
