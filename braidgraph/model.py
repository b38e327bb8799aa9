"""Tables of a repository graph: nodes and edges, with the fixed schema of their metadata.

A graph is a bag of edges over nodes named by ids (``DIRECTORY:p``, ``FILE:p``, ``MODULE:p#name``,
``EXTERNAL:package``).  Edges may dangle and may repeat.  ``node_seq`` and ``edge_seq`` keep the order of
insertion where a result depends on it; a Spark table has none of its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIRECTORY, FILE, MODULE, EXTERNAL = "DIRECTORY", "FILE", "MODULE", "EXTERNAL"
NODE_TYPES = (DIRECTORY, FILE, MODULE, EXTERNAL)
CONTAINS, IMPORTS, EXPORTS, RE_EXPORTS, DYNAMIC_IMPORTS = "CONTAINS", "IMPORTS", "EXPORTS", "RE_EXPORTS", "DYNAMIC_IMPORTS"
EDGE_TYPES = (CONTAINS, IMPORTS, EXPORTS, "CALLS", "EXTENDS", "IMPLEMENTS", RE_EXPORTS, DYNAMIC_IMPORTS)
#: Edges that bind a file when it is built, and all edges that name another file.
STATIC = (IMPORTS, RE_EXPORTS)
OUTGOING = (IMPORTS, RE_EXPORTS, DYNAMIC_IMPORTS)

NODE_METADATA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("isExported", T.BooleanType()),
        T.StructField("jsDoc", T.StringType()),
        T.StructField("jsDocTruncated", T.BooleanType()),
        T.StructField("hasJSDoc", T.BooleanType()),
        T.StructField("deprecated", T.BooleanType()),
        T.StructField("complexity", T.IntegerType()),
        T.StructField("loc", T.IntegerType()),
        T.StructField("testFile", T.StringType()),
        T.StructField("lastModifiedCommit", T.StringType()),
        T.StructField("changeFrequency", T.IntegerType()),
        T.StructField("namedDefault", T.BooleanType()),
        T.StructField("originalName", T.StringType()),
        T.StructField("enumMembers", T.ArrayType(T.StringType())),
        T.StructField("exports", T.ArrayType(T.StringType())),
    ]
)
EDGE_METADATA = T.StructType(
    [
        T.StructField("line", T.IntegerType()),
        T.StructField("isDynamic", T.BooleanType()),
        T.StructField("importSpecifier", T.StringType()),
        T.StructField("importKind", T.StringType()),
        T.StructField("coChangeCount", T.IntegerType()),
    ]
)
NODES = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("metadata", NODE_METADATA), T.StructField("node_seq", T.LongType())]
)
EDGES = T.StructType(
    [T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("type", T.StringType()), T.StructField("metadata", EDGE_METADATA), T.StructField("edge_seq", T.LongType())]
)


class QueryError(Exception):
    """A query that has no answer, with its code and a hint."""

    def __init__(self, code: str, message: str, suggestion: str | None = None):
        super().__init__(message)
        self.code, self.message, self.suggestion = code, message, suggestion

    def to_dict(self) -> dict:
        error = {"code": self.code, "message": self.message}
        return {"success": False, "error": error | ({"suggestion": self.suggestion} if self.suggestion else {})}


# Error codes of the query interface.
TARGET_NOT_FOUND = "E001_TARGET_NOT_FOUND"
PARSE_ERROR = "E002_PARSE_ERROR"
NO_IMPACT = "E003_NO_IMPACT"
NO_LAYERS = "E004_NO_LAYERS"
EMPTY_GRAPH = "E005_EMPTY_GRAPH"


@dataclass(frozen=True)
class RepoGraph:
    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)

    def with_(self, **changes) -> RepoGraph:
        return replace(self, **changes)

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types))

    def linked(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def graph_of(spark: SparkSession, nodes: Iterable[dict], edges: Iterable[dict], meta: dict | None = None) -> RepoGraph:
    """A graph from plain dictionaries; ids, names and sequence numbers may be left out."""

    def meta_row(given: dict | None, kind: T.StructType):
        return tuple(given.get(f) for f in kind.fieldNames()) if given else None

    node_rows = []
    for i, n in enumerate(nodes):
        kind, path = n["type"], n["path"]
        name = n.get("name") or path.rsplit("/", 1)[-1]
        node_rows.append((n.get("id") or f"{kind}:{path}" + (f"#{name}" if kind == MODULE else ""), kind, path, name, meta_row(n.get("metadata"), NODE_METADATA), n.get("node_seq", i)))
    edge_rows = [(e["from"], e["to"], e["type"], meta_row(e.get("metadata"), EDGE_METADATA), e.get("edge_seq", i)) for i, e in enumerate(edges)]
    return RepoGraph(spark.createDataFrame(node_rows, NODES), spark.createDataFrame(edge_rows, EDGES), meta or {})


def node_metadata(**given) -> F.Column:
    """A metadata struct of a node from the given columns, the others null."""
    return _struct(NODE_METADATA, given)


def edge_metadata(**given) -> F.Column:
    return _struct(EDGE_METADATA, given)


def _struct(kind: T.StructType, given: dict) -> F.Column:
    return F.struct(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
