"""The compressed interchange format."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import IMPORTS
from ..operators import codec as X
from .files import flagship_graph
from .sql import GRAPH


def _table(s, d):
    graph = flagship_graph(s, d)
    return graph, X.path_table(graph)


def batches(s, d):
    return X.import_batches(*_table(s, d)).select("fromIndex", F.concat_ws(",", F.transform("targetIndexes", lambda x: x.cast("string"))).alias("targetIndexes"))


def expanded(s, d):
    graph, table = _table(s, d)
    return X.expanded_batches(X.import_batches(graph, table), table)


def roundtrip(s, d):
    """One row: imports before and after the format, and how many of them it loses or adds: none, repetitions aside."""
    graph, table = _table(s, d)
    back = X.expanded_batches(X.import_batches(graph, table), table).withColumn("back", F.lit(1))
    own = graph.linked(IMPORTS).select("from", "to").distinct().withColumn("own", F.lit(1))
    both = own.join(back, ["from", "to"], "full_outer")
    return both.agg(F.count("own").alias("before"), F.count("back").alias("after"), F.count_if(F.col("back").isNull()).alias("lost"), F.count_if(F.col("own").isNull()).alias("added"))


def restored(s, d):
    graph, table = _table(s, d)
    return X.restored_edges(X.compressed_edges(graph, table), table).select("from", "to", "type")


def nodes(s, d):
    graph, table = _table(s, d)
    return X.compressed_nodes(graph, table).select("type", "pathIndex", "name", "metadata.kind", "metadata.complexity")


QUERIES = {"path_dictionary": lambda s, d: _table(s, d)[1], "imports_batch": batches, "imports_batch_expand": expanded, "codec_roundtrip": roundtrip, "codec_edges": restored, "codec_nodes": nodes}
_TABLE = (
    GRAPH
    + r""", refs AS (SELECT path FROM nodes UNION ALL SELECT split_part(regexp_replace("from", '^(FILE|MODULE|EXTERNAL|DIRECTORY):', ''), '#', 1) FROM edges UNION ALL SELECT split_part(regexp_replace("to", '^(FILE|MODULE|EXTERNAL|DIRECTORY):', ''), '#', 1) FROM edges),
dict AS (SELECT path, row_number() OVER (ORDER BY count(*) DESC, path) - 1 AS idx FROM refs GROUP BY path),
ends AS (SELECT type, split_part(regexp_replace("from", '^(FILE|MODULE|EXTERNAL|DIRECTORY):', ''), '#', 1) AS f, split_part(regexp_replace("to", '^(FILE|MODULE|EXTERNAL|DIRECTORY):', ''), '#', 1) AS t FROM edges)"""
)
_CODE = r"regexp_matches({0}, '\.(ts|js|tsx|jsx|json|mjs|cjs)$')"
ORACLES = {
    "path_dictionary": _TABLE + " SELECT path, idx FROM dict",
    "imports_batch_expand": GRAPH + """ SELECT DISTINCT "from", "to" FROM edges WHERE type = 'IMPORTS'""",
    "codec_roundtrip": GRAPH + """ SELECT count(*) AS before, count(*) AS after, 0::BIGINT AS lost, 0::BIGINT AS added FROM (SELECT DISTINCT "from", "to" FROM edges WHERE type = 'IMPORTS')""",
    "codec_edges": _TABLE
    + f""" SELECT CASE type WHEN 'CONTAINS' THEN CASE WHEN {_CODE.format("f")} THEN 'FILE:' ELSE 'DIRECTORY:' END WHEN 'EXPORTS' THEN 'MODULE:' ELSE CASE WHEN {_CODE.format("f")} THEN 'FILE:' ELSE 'DIRECTORY:' END END || f AS "from",
    CASE WHEN type IN ('CONTAINS', 'EXPORTS') OR {_CODE.format("t")} THEN 'FILE:' ELSE 'DIRECTORY:' END || t AS "to", type FROM ends WHERE type <> 'IMPORTS'""",
    "codec_nodes": _TABLE + " SELECT n.type, idx AS pathIndex, n.name, m.kind, m.complexity FROM nodes n JOIN dict USING (path) LEFT JOIN mods m ON n.type = 'MODULE' AND m.path = n.path AND m.name = n.name",
}
ORACLES["imports_batch"] = _TABLE + " SELECT fromIndex, array_to_string(list_sort(list(DISTINCT toIndex)), ',') AS targetIndexes FROM (SELECT a.idx AS fromIndex, b.idx AS toIndex FROM ends JOIN dict a ON a.path = f JOIN dict b ON b.path = t WHERE type = 'IMPORTS') GROUP BY 1"
