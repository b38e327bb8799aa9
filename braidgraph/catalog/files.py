"""Scans, texts and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import project
from ..functions import columns as C
from ..model import CONTAINS, DIRECTORY, FILE, RepoGraph
from ..operators import graph as G
from ..operators import layers as L
from ..operators import quality as Q
from ..plans.durable import shared_dir
from ..sources import baseline
from ..sources import scan as S
from .sql import FILES, GRAPH


_stored: dict[tuple, str] = {}


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, length and time of the files of the tables behind the graph."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in ("part", "lineitem", "supplier"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in path.getFileSystem(conf).listStatus(path)]
    return tuple(out)


def flagship_graph(spark: SparkSession, sf_dir: str) -> RepoGraph:
    """The graph of the tables in sf_dir.  It is built once for a session and a state of the tables and stored as Parquet in
    the shared folder: queries read a stored graph, as they would in use."""
    key = (spark.sparkContext.applicationId, _fingerprint(spark, sf_dir))
    if key not in _stored:
        where = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        baseline.save(project.repo_graph(spark, sf_dir), where)
        _stored[key] = where
    return baseline.load(spark, _stored[key])


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.file_paths(spark, sf_dir).select("path")


def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with ignored, hidden and unparseable files, from parts."""
    k, own = F.col("p_partkey"), F.lower("p_type")
    head = F.when(k % 7 == 0, "node_modules/").when(k % 11 == 0, ".hidden/").when(k % 13 == 0, "dist/").otherwise("src/")
    tail = F.when(k % 5 == 0, ".md").when(k % 3 == 0, ".tsx").when(k % 17 == 0, ".spec.js").otherwise(".ts")
    return project.table(spark, sf_dir, "part").select(F.concat(head, own, F.lit("/p"), k, tail).alias("path"))


ODD = """WITH paths AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'node_modules/' WHEN p_partkey % 11 = 0 THEN '.hidden/' WHEN p_partkey % 13 = 0 THEN 'dist/' ELSE 'src/' END
  || lower(p_type) || '/p' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.md' WHEN p_partkey % 3 = 0 THEN '.tsx' WHEN p_partkey % 17 = 0 THEN '.spec.js' ELSE '.ts' END AS path FROM part)"""


def _nodes(kind: str):
    return lambda s, d: flagship_graph(s, d).of_type(kind).select("id", "path", "name")


def broken_graph(spark: SparkSession, sf_dir: str) -> RepoGraph:
    """The graph with some nodes gone and some twice."""
    graph = flagship_graph(spark, sf_dir)
    files, rest = graph.of_type(FILE), graph.nodes.where(F.col("type") != FILE)
    return graph.with_(nodes=rest.unionByName(files.where("node_seq % 10 <> 3")).unionByName(files.where("node_seq % 100 = 7")))


BROKEN = (
    GRAPH
    + """, bad AS (SELECT id FROM nodes WHERE type <> 'FILE' UNION ALL SELECT 'FILE:' || path FROM files WHERE k % 10 <> 3
  UNION ALL SELECT 'FILE:' || path FROM files WHERE k % 100 = 7)"""
)


def specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import specifiers of all shapes, from parts."""
    k, own = F.col("p_partkey"), F.lower("p_type")
    spec = F.when(k % 6 == 0, F.concat(F.lit("@scope/"), own, F.lit("/sub"))).when(k % 6 == 1, "node:fs").when(k % 6 == 2, F.concat(own, F.lit("/deep/x"))).when(k % 6 == 3, "path").otherwise(own)
    path = F.when(k % 4 == 0, F.concat(F.lit("/r/node_modules/@s/"), own, F.lit("/i.js"))).when(k % 4 == 1, F.concat(F.lit("src/"), own, F.lit(".ts"))).when(k % 4 == 2, F.concat(F.lit("node_modules/"), own, F.lit("/i.js")))
    return project.table(spark, sf_dir, "part").select(k.alias("k"), spec.alias("spec"), path.alias("resolved"))


SPECS = """WITH s AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '@scope/' || lower(p_type) || '/sub' WHEN 1 THEN 'node:fs' WHEN 2 THEN lower(p_type) || '/deep/x' WHEN 3 THEN 'path' ELSE lower(p_type) END AS spec,
  CASE p_partkey % 4 WHEN 0 THEN '/r/node_modules/@s/' || lower(p_type) || '/i.js' WHEN 1 THEN 'src/' || lower(p_type) || '.ts' WHEN 2 THEN 'node_modules/' || lower(p_type) || '/i.js' END AS resolved FROM part),
named AS (SELECT *, CASE WHEN spec LIKE '@%' THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) ELSE split_part(replace(spec, 'node:', ''), '/', 1) END AS package FROM s)"""


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = specifiers(spark, sf_dir)
    return rows.select("k", C.package_name(F.col("spec")).alias("package"), C.is_builtin(F.col("spec")).alias("builtin"), C.target_id(F.col("spec"), F.col("resolved")).alias("target"))


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with comments in them, from documents: sentences become lines, some of them comments."""
    body = F.regexp_replace(F.regexp_replace(F.col("text"), r"\. ", "\n"), r"(?m)^(A)", r"// $1")
    return project.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(body, r"(?m)^(T)", r"/** $1"), r"(?m)(e)$", r"$1 */").alias("text"))


TEXTS = r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\. ', chr(10), 'g'), '(?m)^(A)', '// \1', 'g'), '(?m)^(T)', '/** \1', 'g'), '(?m)(e)$', '\1 */', 'g') AS text FROM documents)"""


def loc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_texts(spark, sf_dir).select("doc_id", C.lines_of_code(F.col("text")).cast("long").alias("loc"))


def deprecated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.col("text"), r"\*/", " @deprecated */")
    return source_texts(spark, sf_dir).select("doc_id", C.deprecated_text(text).alias("deprecated"))


def truncated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.table(spark, sf_dir, "documents").select("doc_id", C.truncated_doc(F.col("text")).alias("d")).select("doc_id", "d.jsDoc", "d.jsDocTruncated", "d.hasJSDoc")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, target: import extraction in its simple form, the references of pages."""
    found = project.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("pos", "target"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "target")


QUERIES = {
    "file_nodes": _nodes(FILE),
    "directory_nodes": _nodes(DIRECTORY),
    "contains_edges": lambda s, d: flagship_graph(s, d).linked(CONTAINS).select("from", "to"),
    "parseable_files": lambda s, d: odd_paths(s, d).where(C.extension(F.col("path")).isin(*C.SCANNED)),
    "ignored_paths": lambda s, d: odd_paths(s, d).where(C.ignored(F.col("path"))),
    "scanned_paths": lambda s, d: S.kept(odd_paths(s, d)),
    "test_file_split": lambda s, d: S.split_tests(odd_paths(s, d)),
    "special_case_kind": lambda s, d: S.project_kind(odd_paths(s, d)),
    "project_scale_threshold": lambda s, d: S.project_scale(odd_paths(s, d)),
    "edge_type_counts": lambda s, d: G.edge_type_counts(flagship_graph(s, d)),
    "edge_counts": lambda s, d: G.edge_counts(flagship_graph(s, d)),
    "edge_rollup": lambda s, d: G.edge_rollup(flagship_graph(s, d)),
    "file_scc": lambda s, d: G.file_sccs(flagship_graph(s, d)),
    "package_names": package_names,
    "loc_counts": loc_counts,
    "deprecated_scan": deprecated_scan,
    "jsdoc_truncate": truncated_docs,
    "import_extract": links,
    "duplicate_nodes": lambda s, d: Q.duplicate_nodes(broken_graph(s, d)),
    "dangling_edges": lambda s, d: Q.dangling_edges(broken_graph(s, d)),
    "integrity_counts": lambda s, d: Q.integrity_counts(broken_graph(s, d)),
    "source_root_scores": lambda s, d: L.root_scores(listing_with_markers(s, d)),
}


def listing_with_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with package.json, tsconfig.json and node_modules in some folders."""
    paths = _paths(spark, sf_dir)
    tops = paths.select(C.parent(F.col("path")).alias("at")).distinct().where("at not like '%\\_\\_tests\\_\\_%'")
    extra = tops.select(F.concat("at", F.lit("/package.json")).alias("path")).unionAll(tops.where("at like '%s%l%'").select(F.concat("at", F.lit("/tsconfig.json")).alias("path")))
    return paths.unionAll(extra).unionAll(tops.where("at like '%e%'").select(F.concat("at", F.lit("/node_modules/a/index.js")).alias("path")))


_KEPT = "path NOT LIKE 'node_modules/%' AND path NOT LIKE 'dist/%'"
_TEST = r"regexp_matches(path, '\.(test|spec)\.(ts|tsx|js|jsx)$|_test\.(ts|js)$|^(tests|__tests__|test|spec)/')"
_SRC = r"regexp_matches(path, '\.(ts|tsx|js|jsx|vue)$')"
_FOLD = r"""list_reduce(list_concat([{'n': 0, 's': false, 'l': ''}], list_transform(string_split(text, chr(10)), lambda x: {'n': 0, 's': false, 'l': regexp_replace(x, '^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$', '', 'g')})),
  lambda a, x: {'n': a.n + CASE WHEN x.l = '' THEN 0 WHEN contains(x.l, '/*') AND contains(x.l, '*/') THEN (trim(regexp_replace(x.l, '/\*.*?\*/', '', 'g')) <> '')::INT WHEN starts_with(x.l, '/*') OR a.s OR starts_with(x.l, '//') THEN 0 ELSE 1 END,
    's': CASE WHEN x.l = '' OR (contains(x.l, '/*') AND contains(x.l, '*/')) THEN a.s WHEN starts_with(x.l, '/*') THEN true WHEN a.s AND ends_with(x.l, '*/') THEN false ELSE a.s END, 'l': x.l}).n::BIGINT"""
_WHITE = r"regexp_replace(text, '^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$', '', 'g')"

ORACLES = {
    "file_nodes": FILES + " SELECT 'FILE:' || path AS id, path, regexp_extract(path, '[^/]*$') AS name FROM files",
    "directory_nodes": GRAPH + " SELECT id, path, name FROM nodes WHERE type = 'DIRECTORY'",
    "contains_edges": GRAPH + ' SELECT "from", "to" FROM contains',
    "parseable_files": ODD + r" SELECT path FROM paths WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|mjs)$')",
    "ignored_paths": ODD + f" SELECT path FROM paths WHERE NOT ({_KEPT})",
    "scanned_paths": ODD + f" SELECT path FROM paths WHERE {_KEPT} AND path NOT LIKE '.%'",
    "test_file_split": ODD + f" SELECT path, {_TEST} AS is_test FROM paths",
    "special_case_kind": ODD + f" SELECT *, CASE WHEN sources = 0 AND tests > 0 THEN 'test-only' WHEN sources = 0 THEN 'empty' WHEN sources = 1 THEN 'single-file' ELSE 'normal' END AS kind FROM (SELECT count(*) FILTER ({_SRC} AND NOT {_TEST}) AS sources, count(*) FILTER ({_SRC} AND {_TEST}) AS tests FROM paths)",
    "project_scale_threshold": ODD + f" SELECT files, CASE WHEN files <= 50 THEN 5 WHEN files <= 200 THEN 3 WHEN files <= 500 THEN 2 ELSE 1 END AS threshold FROM (SELECT count(*) AS files FROM paths WHERE path LIKE 'src/%' AND {_SRC} AND NOT {_TEST})",
    "edge_type_counts": GRAPH + " SELECT type, count(*) AS n FROM edges GROUP BY type",
    "edge_counts": GRAPH + " SELECT count(*) FILTER (type = 'IMPORTS') AS imports, count(*) FILTER (type = 'EXPORTS') AS exports, count(*) FILTER (type = 'CONTAINS') AS contains, count(*) AS edges FROM edges",
    "edge_rollup": GRAPH + " SELECT type, \"group\", count(*) AS n FROM (SELECT type, CASE WHEN substr(\"from\", 10) LIKE '%/%' THEN split_part(substr(\"from\", 10), '/', 1) ELSE '__root__' END AS \"group\" FROM edges WHERE type IN ('IMPORTS', 'RE_EXPORTS', 'DYNAMIC_IMPORTS')) GROUP BY ROLLUP (type, \"group\")",
    "file_scc": GRAPH
    + """, dep AS (SELECT DISTINCT src AS a, dst AS b FROM fe WHERE type <> 'DYNAMIC_IMPORTS'), reach AS (SELECT a, b FROM dep UNION SELECT r.a, dep.b FROM reach r JOIN dep ON dep.a = r.b)
  SELECT path, least(path, coalesce(m, path)) AS scc FROM (SELECT a AS path FROM dep UNION SELECT b FROM dep) LEFT JOIN (SELECT x.a AS path, min(x.b) AS m FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a) USING (path)""",
    "package_names": SPECS
    + r""" SELECT k, package, spec IN ('node:fs', 'path') AS builtin, CASE WHEN resolved IS NULL THEN 'EXTERNAL:' || package WHEN resolved LIKE '%node_modules%' THEN 'EXTERNAL:' || regexp_extract(resolved, 'node_modules/(@[^/]+/[^/]+|[^/]+)', 1) ELSE 'FILE:' || resolved END AS target FROM named""",
    "loc_counts": TEXTS + f" SELECT doc_id, {_FOLD} AS loc FROM t",
    "deprecated_scan": TEXTS + r" SELECT doc_id, regexp_matches(replace(text, '*/', ' @deprecated */'), '(?is)/\*\*(?:[^*]|\*+[^*/])*@deprecated') AS deprecated FROM t",
    "jsdoc_truncate": f"WITH d AS (SELECT doc_id, nullif({_WHITE}, '') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS jsDoc, CASE WHEN length(t) > 100 THEN true END AS jsDocTruncated, CASE WHEN t IS NOT NULL THEN true END AS hasJSDoc FROM d",
    "import_extract": """SELECT page_id, (generate_subscripts(h, 1) - 1)::BIGINT AS pos, unnest(h) AS target FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""",
    "duplicate_nodes": BROKEN + " SELECT id, count(*) AS n FROM bad GROUP BY id HAVING count(*) > 1",
    "dangling_edges": BROKEN + """ SELECT "from", "to", type, 'from' AS missing FROM edges WHERE "from" NOT IN (SELECT id FROM bad) UNION ALL SELECT "from", "to", type, 'to' FROM edges WHERE "to" NOT IN (SELECT id FROM bad)""",
    "integrity_counts": BROKEN
    + """ SELECT 'duplicate_nodes' AS "check", (SELECT count(*) FROM (SELECT id FROM bad GROUP BY id HAVING count(*) > 1)) AS n UNION ALL SELECT 'mismatched_ids', 0
  UNION ALL SELECT 'dangling_edges', (SELECT count(*) FILTER ("from" NOT IN (SELECT id FROM bad)) + count(*) FILTER ("to" NOT IN (SELECT id FROM bad)) FROM edges) UNION ALL SELECT 'invalid_nodes', 0 UNION ALL SELECT 'invalid_edges', 0""",
    "source_root_scores": GRAPH
    + r""", tops AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS top FROM files WHERE path NOT LIKE '%__tests__%'),
  listed AS (SELECT path FROM files UNION ALL SELECT top || '/package.json' FROM tops UNION ALL SELECT top || '/tsconfig.json' FROM tops WHERE top LIKE '%s%l%' UNION ALL SELECT top || '/node_modules/a/index.js' FROM tops WHERE top LIKE '%e%'),
  folders AS (SELECT DISTINCT CASE WHEN n = 0 THEN '.' ELSE array_to_string(string_split(path, '/')[1:n], '/') END AS folder FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS n FROM listed))
  SELECT folder, (CASE WHEN regexp_extract(folder, '[^/]*$') IN ('src', 'lib', 'app') THEN 15 ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM listed WHERE path = CASE WHEN folder = '.' THEN '' ELSE folder || '/' END || 'package.json') THEN 10 ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM listed WHERE path = CASE WHEN folder = '.' THEN '' ELSE folder || '/' END || 'tsconfig.json') THEN 8 ELSE 0 END
    - CASE WHEN EXISTS (SELECT 1 FROM listed WHERE starts_with(path, CASE WHEN folder = '.' THEN '' ELSE folder || '/' END || 'node_modules/')) THEN 20 ELSE 0 END)::INTEGER AS score
  FROM folders WHERE regexp_extract(folder, '[^/]*$') NOT IN ('node_modules', 'dist', 'build', 'test', 'tests', '__tests__', '.git', '.github', 'docs', 'coverage', 'scripts')""",
}
