"""The parser over sources made from parts, and whole documents written and read back."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import project
from ..parse import analyze as A
from ..plans.durable import dealt, written
from ..sources import baseline
from .files import flagship_graph
from .sql import FILES, GRAPH


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a source text for each part, with imports and exports of all forms."""
    k = F.col("k").cast("string")
    when = lambda n, text: F.when(F.col("k") % n == 0, text)
    put = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    lines = [
        put("import d", k, " from './p", k, "a'"),
        when(2, put("import { a, b as c } from '../x/p", k, "'")),
        when(3, put("import type { T } from 'lodash'")),
        when(5, put("export * from './q", k, "'")),
        when(7, put("const z", k, " = () => import('./lazy", k, "')")),
        when(4, put("// import nothing from 'comment", k, "'")),
        put("export function f", k, "(a, b) { if (a && b) { return 1 } return 2 }"),
        when(2, put("/** Old. @deprecated */\nexport class C", k, " { m() { return 1 } }")),
        when(3, put("export interface I", k, " { x: string }")),
        when(5, put("export const v", k, " = 1")),
        when(7, put("export enum E", k, " { A, B }")),
    ]
    return A.spread(project.file_paths(spark, sf_dir), A.TEXTS_A_TASK).select("path", F.concat_ws("\n", *lines).alias("content"))


def parse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.parsed_files(sources(spark, sf_dir)).select("path", F.posexplode("imports").alias("pos", "i"))
    return found.select("path", F.col("pos").cast("long").alias("pos"), "i.specifier", F.col("i.line").cast("long").alias("line"), "i.type", "i.importSpecifier", "i.kind")


def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.parsed_files(sources(spark, sf_dir)).select("path", F.explode("modules").alias("m")).select("path", "m.name", F.col("m.metadata").alias("x"))
    return found.select("path", "name", "x.kind", F.col("x.complexity").cast("long").alias("complexity"), F.coalesce("x.deprecated", F.lit(False)).alias("deprecated"), F.col("x.jsDoc").alias("doc"))


def resolve_specifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the seventh part after each, named as a neighbour, resolves to; those without one are left unresolved."""
    files = project.file_paths(spark, sf_dir)
    spec = F.concat(F.lit("./p"), (F.col("k") + 7).cast("string"))
    texts = A.spread(files, A.TEXTS_A_TASK).select("path", F.concat(F.lit("import x from '"), spec, F.lit("'")).alias("content"))
    rows = written(A.parsed_files(texts), "parsed").select("path", F.posexplode("imports").alias("pos", "i")).select("path", "pos", "i.*")
    return A.resolved(rows, files).select("path", "specifier", "resolved")


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="document-"), "graph.json")
    baseline.save_json(flagship_graph(spark, sf_dir), path, compress=False)
    return path


def baseline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and the number of edges out of each, of a document of format 1.0 that was written, checked and loaded."""
    graph = baseline.load_json(spark, _written(spark, sf_dir))["graph"]
    out = graph.edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("n"))
    return graph.nodes.join(dealt(out), "id", "left").select("id", "type", "path", "name", F.coalesce("n", F.lit(0)).cast("long").alias("edges"))


def migrate_1_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of a document of format 1.0 that was migrated to 1.1 and loaded."""
    source = _written(spark, sf_dir)
    target = f"{source}.new"
    baseline.migrate_file(spark, source, target)
    return baseline.load_json(spark, target)["graph"].linked("IMPORTS").select("from", "to")


QUERIES = {"parse_imports": parse_imports, "parse_symbols": parse_symbols, "resolve_specifier": resolve_specifier, "baseline_roundtrip": baseline_roundtrip, "migrate_1_0": migrate_1_0}
_LINES = """, m AS (SELECT *, (k % 2 = 0)::INT AS m2, (k % 3 = 0)::INT AS m3, (k % 5 = 0)::INT AS m5, (k % 7 = 0)::INT AS m7 FROM files)"""
ORACLES = {
    "parse_imports": FILES
    + _LINES
    + """ SELECT path, 0::BIGINT AS pos, './p' || k || 'a' AS specifier, 1::BIGINT AS line, 'import' AS type, 'default' AS importSpecifier, 'value' AS kind FROM m
  UNION ALL SELECT path, 1, '../x/p' || k, 2, 'import', 'named:a,c', 'value' FROM m WHERE m2 = 1
  UNION ALL SELECT path, 1 + m2, 'lodash', 2 + m2, 'import', 'named:T', 'type-only' FROM m WHERE m3 = 1
  UNION ALL SELECT path, 1 + m2 + m3, './q' || k, 2 + m2 + m3, 're-export', 'wildcard', 'value' FROM m WHERE m5 = 1
  UNION ALL SELECT path, 1 + m2 + m3 + m5, './lazy' || k, 2 + m2 + m3 + m5, 'dynamic', 'dynamic', 'value' FROM m WHERE m7 = 1""",
    "parse_symbols": FILES
    + _LINES
    + """ SELECT path, 'f' || k AS name, 'function' AS kind, 3::BIGINT AS complexity, false AS deprecated, NULL::VARCHAR AS doc FROM m
  UNION ALL SELECT path, 'C' || k, 'class', NULL, true, 'Old. @deprecated' FROM m WHERE m2 = 1
  UNION ALL SELECT path, 'I' || k, 'interface', NULL, false, NULL FROM m WHERE m3 = 1
  UNION ALL SELECT path, 'v' || k, 'variable', NULL, false, NULL FROM m WHERE m5 = 1
  UNION ALL SELECT path, 'E' || k, 'type', NULL, false, NULL FROM m WHERE m7 = 1""",
    "resolve_specifier": FILES
    + """ SELECT a.path, './p' || (a.k + 7) AS specifier, b.path AS resolved FROM files a LEFT JOIN files b ON b.k = a.k + 7 AND b.path = regexp_replace(a.path, '[^/]*$', '') || 'p' || b.k || '.ts'""",
    "baseline_roundtrip": GRAPH + """ SELECT id, type, path, name, coalesce(n, 0)::BIGINT AS edges FROM nodes LEFT JOIN (SELECT "from" AS id, count(*) AS n FROM edges GROUP BY 1) USING (id)""",
    "migrate_1_0": GRAPH + """ SELECT DISTINCT "from", "to" FROM edges WHERE type = 'IMPORTS'""",
}
