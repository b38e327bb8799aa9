"""One-hop context of files, symbols and packages, for one target or for every file of the graph at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import EDGES, EXTERNAL, FILE, MODULE, NODES, OUTGOING, STATIC, TARGET_NOT_FOUND, QueryError, RepoGraph


def exports(graph: RepoGraph) -> DataFrame:
    """path, kind, name: the symbols of each file."""
    return graph.of_type(MODULE).select("path", F.coalesce("metadata.kind", F.lit("unknown")).alias("kind"), "name")


def imports(graph: RepoGraph) -> DataFrame:
    """file, target: distinct paths that a file's edges point at; edges without a target node are left out."""
    to = graph.nodes.select(F.col("id").alias("to"), F.col("path").alias("target"))
    return graph.linked(*OUTGOING).join(to, "to").select(F.col("from").alias("file"), "target").distinct()


def imports_with_kind(graph: RepoGraph) -> DataFrame:
    """file, target, import_type, kind: the first edge of each file to a path in a kind."""
    to = graph.nodes.select(F.col("id").alias("to"), F.col("path").alias("target"), F.col("type").alias("target_type"))
    found = graph.linked(*OUTGOING).join(to, "to")
    kind = C.import_kind(F.col("metadata.importKind"), F.col("target_type"))
    found = found.select(F.col("from").alias("file"), "target", kind.alias("kind"), F.struct("edge_seq", C.import_type(F.col("type")).alias("import_type")).alias("first"))
    return found.groupBy("file", "target", "kind").agg(F.min("first")["import_type"].alias("import_type")).select("file", "target", "import_type", "kind")


def imported_by(graph: RepoGraph) -> DataFrame:
    """target, file: distinct files with a static edge to a node."""
    files = graph.of_type(FILE).select(F.col("id").alias("from"), F.col("path").alias("file"))
    return graph.linked(*STATIC).join(files, "from").select(F.col("to").alias("target"), "file").distinct()


def external_importers(graph: RepoGraph) -> DataFrame:
    """name, importers: how many files import each package."""
    packages = graph.of_type(EXTERNAL).select(F.col("id").alias("target"), "name")
    return packages.join(imported_by(graph), "target", "left").groupBy("name").agg(F.count("file").alias("importers"))


def import_counts(graph: RepoGraph) -> DataFrame:
    """path, imports: edges out of each file."""
    out = graph.linked(*OUTGOING).groupBy(F.col("from").alias("id")).agg(F.count("*").alias("n"))
    return graph.of_type(FILE).join(out, "id", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("imports"))


def imported_by_counts(graph: RepoGraph) -> DataFrame:
    """path, imported_by: static edges into each file, from whatever node."""
    into = graph.linked(*STATIC).groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n"))
    return graph.of_type(FILE).join(into, "id", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("imported_by"))


# Rewritings of a path that name its test, in order.
TEST_NAMES = [(r"\.ts$", ".test.ts"), (r"\.tsx$", ".test.tsx"), (r"^src/", "src/__tests__/"), (r"^src/", "tests/"), (r"\.ts$", ".spec.ts")]


def test_files(graph: RepoGraph, compat: bool = False) -> DataFrame:
    """path, test_file: the test of each file that has one.

    A symbol's own ``testFile`` comes first; then five rewritings of the path are probed in order.  A rewriting that
    changes nothing names the file itself and is ignored, unless ``compat``.
    """
    path = F.col("path")
    files = graph.of_type(FILE).select("path")
    probes = files.select("path", F.posexplode(F.array(*[F.regexp_replace(path, a, b) for a, b in TEST_NAMES])).alias("pos", "probe"))
    if not compat:
        probes = probes.where("probe <> path")
    hits = probes.join(files.select(path.alias("probe")), "probe", "left_semi").groupBy("path").agg(F.min_by("probe", "pos").alias("probed"))
    named = graph.of_type(MODULE).where("metadata.testFile is not null").groupBy("path").agg(F.min_by("metadata.testFile", "node_seq").alias("named"))
    both = files.join(named, "path", "left").join(hits, "path", "left")
    return both.select("path", F.coalesce("named", "probed").alias("test_file")).where("test_file is not null")


def file_metrics(graph: RepoGraph) -> DataFrame:
    """path, complexity, level, deprecated, last_commit, change_frequency of every file, from its symbols."""
    m = F.col("metadata")
    rows = graph.of_type(MODULE).groupBy("path").agg(
        F.sum(m["complexity"]).alias("c"),
        F.bool_or(F.coalesce(m["deprecated"], F.lit(False))).alias("deprecated"),
        F.max_by(m["lastModifiedCommit"], F.when(m["lastModifiedCommit"] != "", F.col("node_seq"))).alias("last_commit"),
        F.max(m["changeFrequency"]).alias("f"),
    )
    value = F.coalesce("c", F.lit(0)).cast("long")
    files = graph.of_type(FILE).select("path").join(rows, "path", "left")
    return files.select("path", value.alias("complexity"), C.complexity_level(value).alias("level"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"), "last_commit", F.coalesce("f", F.lit(0)).cast("long").alias("change_frequency"))


def quick_briefs(graph: RepoGraph, compat: bool = False) -> DataFrame:
    """path, imports, imported_by, has_test, deprecated, level of every file."""
    out = import_counts(graph).join(imported_by_counts(graph), "path").join(file_metrics(graph).select("path", "deprecated", "level"), "path")
    return out.join(test_files(graph, compat), "path", "left").select("path", "imports", "imported_by", F.col("test_file").isNotNull().alias("has_test"), "deprecated", "level")


def hotspots(graph: RepoGraph) -> DataFrame:
    """path, hotspot: change frequency times complexity, files with either only."""
    return file_metrics(graph).select("path", (F.col("complexity") * F.col("change_frequency")).alias("hotspot")).where("hotspot > 0")


#: Ids up to which nodes are fetched by a pushed-down list of them.
LISTED = 2000


def _only(graph: RepoGraph, file_id: str, path: str) -> RepoGraph:
    """What queries about one file read, fetched once: its edges, by filters that are pushed down, and the nodes at their ends.  As
    many rows as the answer lists."""
    spark = graph.spark
    edges = graph.edges.where((F.col("from") == file_id) | (F.col("to") == file_id)).collect()
    ids = {file_id, *(f"{FILE}:{re.sub(a, b, path)}" for a, b in TEST_NAMES), *(e["from"] for e in edges), *(e["to"] for e in edges)}
    own, node_id = (F.col("path") == path) & F.col("type").isin(FILE, MODULE, EXTERNAL), F.col("id")
    if len(ids) <= LISTED:
        nodes = graph.nodes.where(own | node_id.isin(sorted(ids))).collect()
    else:
        wanted = spark.createDataFrame([(i,) for i in sorted(ids)], "id string")
        nodes = graph.nodes.join(wanted, "id", "left_semi").select(*NODES.fieldNames()).unionByName(graph.nodes.where(own)).distinct().collect()
    return graph.with_(nodes=spark.createDataFrame(nodes, NODES).coalesce(1), edges=spark.createDataFrame(edges, EDGES).coalesce(1))


def resolve(graph: RepoGraph, target: str) -> dict:
    """The rows that a target names: {"type", "file", "module"}; a plain path is a file."""
    if not target or not target.strip():
        raise ValueError("Target must be a non-empty string")
    kind = next((t for t in (FILE, MODULE, EXTERNAL) if target.startswith(f"{t}:")), None)
    rows = [r.asDict(True) for r in graph.nodes.where(F.col("id").isin(target, f"{FILE}:{target}")).limit(4).collect()]
    if kind == MODULE:
        module = next((r for r in rows if r["id"] == target), None)
        if module is None:
            raise QueryError(TARGET_NOT_FOUND, f"MODULE node not found: {target}", "Check if the export name exists in the file")
        owner = graph.nodes.where((F.col("id") == f"{FILE}:{module['path']}")).limit(1).collect()
        if not owner:
            raise QueryError(TARGET_NOT_FOUND, f"Target not found: {target}", "Run `braidgraph analyze` to build graph first")
        return {"type": MODULE, "file": owner[0].asDict(True), "module": module}
    found = next((r for r in rows if r["id"] == (target if kind else f"{FILE}:{target}")), None)
    if found is None:
        raise QueryError(TARGET_NOT_FOUND, f"Target not found: {target}", "Run `braidgraph analyze` to build graph first")
    return {"type": found["type"], "file": found, "module": None}


def get_scope(graph: RepoGraph, target: str, compat: bool = False) -> dict:
    """Everything one hop from a target.  Raises QueryError if it is not there."""
    found = resolve(graph, target)
    file, module = found["file"], found["module"]
    near = _only(graph, file["id"], file["path"])
    importers = [r["file"] for r in imported_by(near).where(F.col("target") == file["id"]).select("file").orderBy("file").collect()]
    base = {"success": True, "target": target, "type": found["type"], "importedBy": [{"file": f, "specifiers": []} for f in importers], "warnings": [], "nextSuggested": [f"braidgraph impact {target}"], "upstreamCalls": [], "downstreamCalls": []}
    if file["type"] == EXTERNAL:
        return base | {"name": file["name"], "exports": [], "imports": [], "testFile": None, "complexity": {"level": "unknown", "value": 0}, "lastModified": {}, "metadata": {"hasTest": False, "deprecated": False}, "nextSuggested": []}
    # code-unit order of "kind:name", and the locale's order of paths with type-only imports first
    listed = sorted(f"{r['kind']}:{r['name']}" for r in exports(near).where(F.col("path") == file["path"]).collect())
    made = [{"name": x.split(":", 1)[1], "kind": x.split(":", 1)[0], "id": f"MODULE:{file['path']}#{x.split(':', 1)[1]}"} for x in listed]
    order = [F.collate("target", "UNICODE"), F.when(F.col("kind") == "type-only", 0).otherwise(1)]
    brought = [{"from": r["target"], "specifiers": [], "type": r["import_type"], "kind": r["kind"]} for r in imports_with_kind(near).where(F.col("file") == file["id"]).orderBy(*order).collect()]
    one = near.with_(nodes=near.nodes.where((F.col("path") == file["path"]) & F.col("type").isin(FILE, MODULE)))
    facts = file_metrics(one).first().asDict()
    test = test_files(near, compat).where(F.col("path") == file["path"]).first()
    value = module["metadata"]["complexity"] if module and module["metadata"] and module["metadata"]["complexity"] is not None else facts["complexity"]
    level = graph.spark.range(1).select(C.complexity_level(F.lit(value))).first()[0] if value != facts["complexity"] else facts["level"]
    modified = ({"commit": facts["last_commit"]} if facts["last_commit"] else {}) | ({"relativeTime": f"{facts['change_frequency']} commits in last 30 days"} if facts["change_frequency"] else {})
    return base | {
        "path": file["path"], "module": module, "exports": made, "imports": brought, "testFile": test["test_file"] if test else None,
        "complexity": {"level": level, "value": value}, "lastModified": modified, "metadata": {"hasTest": test is not None, "deprecated": facts["deprecated"]},
    }


def get_brief(graph: RepoGraph, path: str, compat: bool = False) -> dict:
    """Counts and flags of one file."""
    file_id = path if path.startswith(f"{FILE}:") else f"{FILE}:{path}"
    own = file_id.removeprefix(f"{FILE}:")
    row = quick_briefs(_only(graph, file_id, own), compat).where(F.col("path") == own).first()
    if row is None:
        raise QueryError(TARGET_NOT_FOUND, f"File not found: {path}", "Run `braidgraph analyze` to build graph first")
    facts = [f"{row['imports']} imports, {row['imported_by']} dependents", *["Has test file"] * row["has_test"], *["Marked @deprecated"] * row["deprecated"]]
    return {"success": True, "file": path, "imports": row["imports"], "importedBy": row["imported_by"], "hasTest": row["has_test"], "deprecated": row["deprecated"], "complexityLevel": row["level"], "quickFacts": facts}


def top_files(graph: RepoGraph, words: list[str], k: int = 20) -> DataFrame:
    """Keyword search (a top-k report): path, hits, degree of the files whose path or symbols hold most of the words."""
    text = graph.of_type(FILE, MODULE).select("path", F.lower(F.concat_ws(" ", "path", "name")).alias("t"))
    hits = sum((F.max(F.col("t").contains(w.lower()).cast("int")) for w in words), F.lit(0))
    found = text.groupBy("path").agg(hits.cast("long").alias("hits")).where("hits > 0")
    both = graph.linked(*OUTGOING)
    degree = both.select(F.col("from").alias("id")).union(both.select("to")).groupBy("id").agg(F.count("*").alias("degree"))
    degree = degree.select(F.regexp_replace("id", "^FILE:", "").alias("path"), "degree")
    found = found.join(degree, "path", "left").select("path", "hits", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return found.orderBy(F.desc("hits"), F.desc("degree"), "path").limit(k)


def ranked_symbols(graph: RepoGraph) -> DataFrame:
    """path, name, rank: a file's symbols by complexity, ties by name."""
    w = Window.partitionBy("path").orderBy(F.desc_nulls_last("metadata.complexity"), "name")
    return graph.of_type(MODULE).select("path", "name", F.row_number().over(w).cast("long").alias("rank"))
