"""Stored graphs: Parquet for use, JSON of both interchange formats for exchange.

Parquet tables are written beside the current ones and swapped in by one small pointer file, so a reader sees an old graph or a
new one.  JSON documents are one object for a whole graph; document.py writes and reads the long ones with tasks.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import EDGE_METADATA, EDGE_TYPES, EDGES, NODE_METADATA, NODE_TYPES, NODES, RepoGraph, graph_of
from ..operators import codec, quality
from . import document as D
from ..versions import CURRENT, Migration, Migrations, Version, action, compatibility, on_failure, version_errors

FORMAT_1_1 = {"major": 1, "minor": 1, "patch": 0}


class CorruptedBaseline(Exception):
    code = "E004_CORRUPTED_DATA"


# --- Parquet store -------------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(graph: RepoGraph, folder: str) -> str:
    """Write both tables, sorted by type within files, so that filters on it skip row groups; returns the version."""
    version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    spark = graph.spark
    graph.nodes.sortWithinPartitions("type", "path").write.parquet(f"{folder}/{version}/nodes")
    graph.edges.sortWithinPartitions("type", "to").write.parquet(f"{folder}/{version}/edges")
    spark.createDataFrame([(version, json.dumps(graph.meta))], "version string, meta string").coalesce(1).write.mode("overwrite").json(f"{folder}/{version}/meta")
    pointer, fs = _fs(spark, f"{folder}/CURRENT")
    fresh, _ = _fs(spark, f"{folder}/CURRENT.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(fresh, pointer)
    return version


def current(spark: SparkSession, folder: str) -> str:
    pointer, fs = _fs(spark, f"{folder}/CURRENT")
    if not fs.exists(pointer):
        raise FileNotFoundError(f"no graph in {folder}")
    return spark.read.text(f"{folder}/CURRENT").first()[0]


def load(spark: SparkSession, folder: str) -> RepoGraph:
    version = current(spark, folder)
    meta = json.loads(spark.read.schema("version string, meta string").json(f"{folder}/{version}/meta").first()["meta"])
    return RepoGraph(spark.read.schema(NODES).parquet(f"{folder}/{version}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/{version}/edges"), meta)


def load_meta(spark: SparkSession, folder: str) -> dict:
    """Commit, time and schema only; the tables are not touched."""
    return json.loads(spark.read.schema("version string, meta string").json(f"{folder}/{current(spark, folder)}/meta").first()["meta"])


# --- JSON documents ------------------------------------------------------------------------------------------------------


def _line(**fields: Column) -> Column:
    """The JSON text of a row; fields that are null are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("value")


def plain_pieces(graph: RepoGraph) -> list[str | DataFrame]:
    """The 1.0 document of a graph, to be written."""
    m = graph.meta
    text = lambda data: json.dumps(data, ensure_ascii=False)
    node = _line(id=F.col("id"), type=F.col("type"), path=F.col("path"), name=F.col("name"), metadata=D.bare(F.col("metadata"), NODE_METADATA.fieldNames()))
    edge = _line(**{k: F.col(k) for k in ("from", "to", "type")}, metadata=D.bare(F.col("metadata"), EDGE_METADATA.fieldNames()))
    head = {
        "schemaVersion": m.get("schemaVersion") or dict(zip(("major", "minor", "patch"), CURRENT, strict=True)),
        "generatorVersion": m.get("generatorVersion", "1.0.0"),
        "timestamp": m.get("timestamp", 0),
        "commitHash": m.get("commitHash", ""),
    }
    return [
        text(head)[:-1] + ', "graph": {"nodes": [\n',
        graph.nodes.orderBy("node_seq", "id").select(F.concat(F.lit("["), D.quoted(F.col("id")), F.lit(","), node, F.lit("]")).alias("value")),
        '\n], "edges": [\n',
        graph.edges.orderBy("edge_seq", "from", "to", "type").select(edge),
        f'\n], "commitHash": {text(m.get("commitHash", ""))}, "timestamp": {text(m.get("timestamp", 0))}}}}}\n',
    ]


def compressed_pieces(graph: RepoGraph, table: DataFrame, most: int = 100, extra: dict | None = None) -> list[str | DataFrame]:
    """The 1.1 document of a graph, to be written, made of the operators of the codec; table: its paths."""
    nodes, edges = codec.compressed_nodes(graph, table, most), codec.compressed_edges(graph, table)
    kept = lambda df: D.bare(F.col("metadata"), df.schema["metadata"].dataType.fieldNames())
    batches = codec.import_batches(graph, table).orderBy("fromIndex").select(_line(type=F.lit("IMPORTS_BATCH"), fromIndex=F.col("fromIndex"), targetIndexes=F.col("targetIndexes")))
    rest = edges.orderBy("edge_seq", "fromIndex", "toIndex", "type").select(_line(type=F.col("type"), fromIndex=F.col("fromIndex"), toIndex=F.col("toIndex"), metadata=kept(edges)))
    tail = {"commitHash": graph.meta.get("commitHash", ""), "timestamp": graph.meta.get("timestamp", 0)} | (extra or {})
    return [
        f'{{"schemaVersion": {json.dumps(FORMAT_1_1)}, "pathTable": [\n',
        table.orderBy("idx").select(D.quoted(F.col("path")).alias("value")),
        '\n], "nodes": [\n',
        nodes.orderBy("node_seq", "pathIndex", "name").select(_line(type=F.col("type"), pathIndex=F.col("pathIndex"), name=F.col("name"), metadata=kept(nodes))),
        '\n], "edges": [\n',
        batches,
        rest,
        "\n], " + json.dumps(tail, ensure_ascii=False)[1:] + "\n",
    ]


def detect_format(data) -> str:
    if isinstance(data, dict):
        if isinstance(data.get("pathTable"), list):
            return "1.1"
        g = data.get("graph")
        if isinstance(g, dict) and isinstance(g.get("nodes"), list) and isinstance(g.get("edges"), list):
            return "1.0"
    return "legacy"


def structure_errors(data) -> list[str]:
    """What a document lacks to be read."""
    if not isinstance(data, dict):
        return ["Baseline must be an object"]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    compressed = detect_format(data) == "1.1" or "pathTable" in data
    out = [f"Missing required field: {f}" for f in (("pathTable", "nodes", "edges") if compressed else ("graph",)) + ("commitHash", "timestamp") if f not in data]
    if "timestamp" in data and not number(data["timestamp"]):
        out.append("timestamp must be a number")
    if "commitHash" in data and not isinstance(data["commitHash"], str):
        out.append("commitHash must be a string")
    if data.get("schemaVersion") is not None:
        out += version_errors(data["schemaVersion"])
    if not compressed:
        g = data.get("graph")
        if g is not None and not isinstance(g, dict):
            out.append("graph must be an object")
        elif g is not None:
            out += [f"graph.{k} must be an array" for k in ("nodes", "edges") if not isinstance(g.get(k), list)]
        return out
    for k in ("pathTable", "nodes", "edges"):
        if k in data and not isinstance(data[k], list):
            out.append(f"{k} must be an array")
    if any(isinstance(data.get(k, []), list) is False for k in ("pathTable", "nodes", "edges")):
        return out
    out += [f"pathTable[{i}] must be a string" for i, p in enumerate(data.get("pathTable", [])) if not isinstance(p, str)]
    for i, n in enumerate(data.get("nodes", [])):
        if not isinstance(n, dict):
            out.append(f"nodes[{i}] must be an object")
            continue
        if n.get("type") not in NODE_TYPES:
            out.append(f"nodes[{i}].type must be a valid NodeType")
        if not number(n.get("pathIndex")):
            out.append(f"nodes[{i}].pathIndex must be a number")
    for i, e in enumerate(data.get("edges", [])):
        if not isinstance(e, dict):
            out.append(f"edges[{i}] must be an object")
        elif e.get("type") == "IMPORTS_BATCH":
            if not number(e.get("fromIndex")) or not isinstance(e.get("targetIndexes"), list):
                out.append(f"edges[{i}] (IMPORTS_BATCH) missing or invalid fields")
        elif e.get("type") not in EDGE_TYPES:
            out.append(f"edges[{i}].type must be a valid EdgeType")
        elif not (number(e.get("fromIndex")) and number(e.get("toIndex"))):
            out.append(f"edges[{i}] missing or invalid index")
    return out


def _meta_of(data: dict) -> dict:
    return {k: data.get(k) for k in ("commitHash", "timestamp", "schemaVersion", "generatorVersion") if data.get(k) is not None}


def from_plain(spark: SparkSession, data: dict) -> RepoGraph:
    g = data["graph"]
    nodes = [{"metadata": None} | n | {"id": i} for i, n in g["nodes"]]
    return graph_of(spark, nodes, g["edges"], _meta_of(g | data))


_NODE_1_1 = f"type string, pathIndex long, name string, metadata {NODE_METADATA.simpleString()}, node_seq long"
_BATCH = "fromIndex long, targetIndexes array<long>, seq long"
_EDGE_1_1 = f"type string, fromIndex long, toIndex long, metadata {EDGE_METADATA.simpleString()}, edge_seq long"


def _restored(nodes: DataFrame, batches: DataFrame, others: DataFrame, table: DataFrame, meta: dict) -> RepoGraph:
    imported = codec.expanded_batches(batches, table)
    imported = imported.select("from", "to", F.lit("IMPORTS").alias("type"), F.lit(None).cast(EDGE_METADATA).alias("metadata"), F.lit(0).cast("long").alias("edge_seq"))
    return RepoGraph(codec.restored_nodes(nodes, table), imported.unionByName(codec.restored_edges(others, table)), meta)


def from_compressed(spark: SparkSession, data: dict) -> RepoGraph:
    n = len(data["pathTable"])
    for node in data["nodes"]:
        if not 0 <= node["pathIndex"] < n:
            raise CorruptedBaseline(f"Node pathIndex {node['pathIndex']} out of bounds")
    table = spark.createDataFrame(list(enumerate(data["pathTable"])), "idx long, path string").select("path", "idx")
    struct = lambda given, kind: tuple(given.get(f) for f in kind.fieldNames()) if given else None
    rows = [(x["type"], x["pathIndex"], x.get("name"), struct(x.get("metadata"), NODE_METADATA), i) for i, x in enumerate(data["nodes"])]
    batches = [(x["fromIndex"], x["targetIndexes"], i) for i, x in enumerate(data["edges"]) if x["type"] == "IMPORTS_BATCH"]
    others = [(x["type"], x["fromIndex"], x["toIndex"], struct(x.get("metadata"), EDGE_METADATA), i) for i, x in enumerate(data["edges"]) if x["type"] != "IMPORTS_BATCH"]
    return _restored(spark.createDataFrame(rows, _NODE_1_1), spark.createDataFrame(batches, _BATCH), spark.createDataFrame(others, _EDGE_1_1), table, _meta_of(data))


def from_json(spark: SparkSession, data: dict) -> RepoGraph:
    return from_compressed(spark, data) if detect_format(data) == "1.1" else from_plain(spark, data)


def _put(tmp: str, path: str, version: dict, backup: bool, version_file: bool) -> None:
    """Give a file that was written beside another its name."""
    if backup and os.path.exists(path):
        os.replace(path, f"{path}.bak")
    os.replace(tmp, path)
    if version_file:
        with open(os.path.join(os.path.dirname(os.path.abspath(path)), ".version"), "w", encoding="utf-8") as f:
            f.write(".".join(str(version.get(k, 0)) for k in ("major", "minor", "patch")))


def write_json(data: dict, path: str, backup: bool = False, version_file: bool = False) -> None:
    """Write beside the file, then rename; the folder must exist."""
    tmp = D.beside(path)
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, ensure_ascii=False)
    _put(tmp, path, data.get("schemaVersion") or {}, backup, version_file)


def save_json(graph: RepoGraph, path: str, compress: bool = True, most: int = 100, backup: bool = False, version_file: bool = False) -> None:
    """Write a document of a graph; tasks make it, part by part."""
    tmp = D.beside(path)
    pieces = compressed_pieces(graph, codec.path_table(graph), most) if compress else plain_pieces(graph)
    D.write(graph.spark, pieces, tmp)
    _put(tmp, path, FORMAT_1_1 if compress else graph.meta.get("schemaVersion") or dict(zip(("major", "minor", "patch"), CURRENT, strict=True)), backup, version_file)


#: Bytes of a document up to which the driver reads it whole.
SMALL = 8 << 20


def _plain_nodes(elements: list, first: int) -> list[dict]:
    out = []
    for i, (given, n) in enumerate(elements, first):
        kind, path = n["type"], n["path"]
        name = n.get("name") or path.rsplit("/", 1)[-1]
        out.append({"id": given or f"{kind}:{path}" + (f"#{name}" if kind == "MODULE" else ""), "type": kind, "path": path, "name": name, "metadata": n.get("metadata") or None, "node_seq": n.get("node_seq", i)})
    return out


def _plain_edges(elements: list, first: int) -> list[dict]:
    return [{"from": e["from"], "to": e["to"], "type": e["type"], "metadata": e.get("metadata") or None, "edge_seq": e.get("edge_seq", i)} for i, e in enumerate(elements, first)]


def _checked(key: str, rows):
    """rows() behind the checks of structure_errors() for elements of this array of a 1.1 document."""

    def run(elements: list, first: int) -> list[dict]:
        errors = structure_errors({"pathTable": [], "nodes": [], "edges": [], "commitHash": "", "timestamp": 0} | {key: elements})
        if errors:
            raise D.BadElement("invalid_structure", f"{errors[0]} (counted from {first})")
        return rows(elements, first)

    return run


def _compressed_nodes(most: int):
    def rows(elements: list, first: int) -> list[dict]:
        for x in elements:
            if not 0 <= x["pathIndex"] < most:
                raise CorruptedBaseline(f"Node pathIndex {x['pathIndex']} out of bounds")
        return [{"type": x["type"], "pathIndex": x["pathIndex"], "name": x.get("name"), "metadata": x.get("metadata") or None, "node_seq": i} for i, x in enumerate(elements, first)]

    return rows


def _compressed_edges(elements: list, first: int) -> list[dict]:
    return [{"type": x["type"], "fromIndex": x["fromIndex"], "toIndex": x.get("toIndex"), "metadata": x.get("metadata") or None, "edge_seq": i, "targetIndexes": x["targetIndexes"] if x["type"] == "IMPORTS_BATCH" else None} for i, x in enumerate(elements, first)]


def from_split(spark: SparkSession, found: D.Split) -> RepoGraph:
    """The graph of a document that was taken apart; a BadElement tells what is wrong with it."""

    faults: list[D.BadElement] = []

    def table(keys: tuple[str, ...], kind, rows) -> DataFrame:
        kind = kind if isinstance(kind, T.StructType) else T.StructType.fromDDL(kind)
        try:
            return D.table(spark, found.parts.get(keys), found.counts.get(keys, 0), to_arrow_schema(kind), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), rows)
        except D.BadElement as e:
            faults.append(e)
            return spark.createDataFrame([], kind)

    def sound(graph: RepoGraph) -> RepoGraph:
        if faults:
            raise min(faults, key=lambda e: D.FAULTS.index(e.reason))
        return graph

    if detect_format(found.rest) != "1.1":
        meta = _meta_of(found.rest["graph"] | found.rest)
        return sound(RepoGraph(table(("graph", "nodes"), NODES, _plain_nodes), table(("graph", "edges"), EDGES, _plain_edges), meta))
    paths = table(("pathTable",), "path string, idx long", _checked("pathTable", lambda elements, first: [{"path": p, "idx": i} for i, p in enumerate(elements, first)]))
    nodes = table(("nodes",), _NODE_1_1, _checked("nodes", _compressed_nodes(found.counts.get(("pathTable",), 0))))
    edges = table(("edges",), f"{_EDGE_1_1}, targetIndexes array<long>", _checked("edges", _compressed_edges))
    batches = edges.where("type = 'IMPORTS_BATCH'").select("fromIndex", "targetIndexes", F.col("edge_seq").alias("seq"))
    return sound(_restored(nodes, batches, edges.where("type <> 'IMPORTS_BATCH'").drop("targetIndexes"), paths, _meta_of(found.rest)))


def load_json(spark: SparkSession, path: str, rebuild=None, strict: bool = False, force: str | None = None, auto_migrate: bool = False, check_integrity: bool = True, handler=None, migrations: Migrations | None = None, small: int = SMALL) -> dict:
    """A graph from a JSON document, or what becomes of it: {"success", "graph", "action", "migrated"} or "failure".

    Tasks read documents of more than ``small`` bytes.  Migrations are functions of a whole document, so one that needs them is
    read by the driver whatever its length."""
    fail = lambda reason, details=None: on_failure(reason, rebuild, strict, force, handler, details)
    if not os.path.exists(path):
        return fail("file_not_found", path)
    found = None
    try:
        if os.path.getsize(path) > small:
            found = D.split(spark, path)
            data = found.rest
        else:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
    except PermissionError as e:
        return fail("permission_error", e)
    except ValueError as e:
        return fail("parse_error", e)
    errors = structure_errors(data)
    if errors:
        return fail("invalid_structure", errors)
    graph, bad = None, None
    if found is not None:
        try:
            graph = from_split(spark, found)
        except D.BadElement as e:
            if e.reason != "corrupted_data":
                return fail(e.reason, e)
            bad = e

    def made() -> RepoGraph:
        if bad:
            raise CorruptedBaseline(str(bad))
        return from_json(spark, data) if graph is None else graph

    todo = action(compatibility(data.get("schemaVersion")), force, auto_migrate)
    if todo == "error":
        return fail("schema_incompatible", data.get("schemaVersion"))
    if todo == "rebuild":
        return fail("corrupted_data", "no schema version") if rebuild else {"success": True, "graph": made(), "action": "proceed", "migrated": False} if data.get("schemaVersion") else fail("corrupted_data", "no schema version")
    migrated = todo == "migrate"
    if migrated:
        try:
            if found is not None:
                graph, bad = None, None
                with open(path, encoding="utf-8") as f:
                    data = json.load(f)
            data = (migrations or MIGRATIONS).migrate(data)
        except Exception as e:
            return fail("schema_incompatible", e)
    try:
        graph = made()
    except (CorruptedBaseline, KeyError, TypeError) as e:
        return fail("corrupted_data", e)
    if check_integrity and detect_format(data) == "1.0":
        found = quality.verify(graph)
        if not found["valid"]:
            return fail("corrupted_data", found)
    return {"success": True, "graph": graph, "action": todo, "migrated": migrated}


def json_meta(path: str) -> dict:
    """commitHash, timestamp, schemaVersion of one 1.0 or 1.1 document without its graph: only the top level is read on."""
    found: dict = {}
    for key, value in _top_level(path):
        if key in ("commitHash", "timestamp", "schemaVersion"):
            found[key] = value
    return found


def _top_level(path: str, chunk: int = 1 << 16):
    """(key, value) of the short values at the top of a JSON object; long ones are skipped by their brackets."""
    key, depth, text, start, quoted, escaped = None, 0, [], False, False, False
    with open(path, encoding="utf-8") as f:
        while part := f.read(chunk):
            for c in part:
                keep = depth == 1 or (depth == 2 and key == "schemaVersion")
                if quoted:
                    if keep:
                        text.append(c)
                    escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
                    continue
                if c in "}]":
                    depth -= 1
                    if depth == 0 or (depth == 1 and key == "schemaVersion"):
                        text += [c] * (depth == 1)
                        if depth == 0:
                            yield from _pair(key, text)
                            return
                    elif keep:
                        text.append(c)
                    continue
                if c in "{[":
                    depth += 1
                    if depth == 2 and key == "schemaVersion":
                        text.append(c)
                    continue
                if c == '"':
                    quoted = True
                if depth == 1 and c == ":" and key is None:
                    key, text = json.loads("".join(text)), []
                elif depth == 1 and c == ",":
                    yield from _pair(key, text)
                    key, text = None, []
                elif keep:
                    text.append(c)


def _pair(key: str | None, text: list[str]):
    try:
        yield key, json.loads("".join(text))
    except ValueError:
        return


def migrate_file(spark: SparkSession, source: str, target: str, most: int = 100, small: int = SMALL) -> dict:
    """A 1.0 document as 1.1, or a 1.1 document copied, with sizes.  Tasks read documents of more than ``small`` bytes."""
    a = os.path.getsize(source)
    found = D.split(spark, source) if a > small else None
    if found is None:
        with open(source, encoding="utf-8") as f:
            data = json.load(f)
    else:
        data = found.rest
    kind = detect_format(data)
    if kind == "legacy":
        raise CorruptedBaseline("Legacy baseline cannot be migrated")
    tmp = D.beside(target)
    if kind == "1.1":
        shutil.copyfile(source, tmp)
        entries = len(data["pathTable"]) if found is None else found.counts.get(("pathTable",), 0)
    else:
        try:
            graph = from_plain(spark, data) if found is None else from_split(spark, found)
        except D.BadElement as e:
            raise CorruptedBaseline(str(e)) from e
        table = codec.path_table(graph)
        entries = table.count()
        D.write(spark, compressed_pieces(graph, table, most, {k: data[k] for k in ("generatorVersion", "architectureConstraints", "healthScore", "skillDemand") if k in data}), tmp)
    os.replace(tmp, target)
    b = os.path.getsize(target)
    return {"success": True, "inputPath": source, "outputPath": target, "stats": {"inputSizeBytes": a, "outputSizeBytes": b, "savingsPercent": savings(a, b), "pathTableEntries": entries}}


def savings(before: int, after: int) -> int:
    return max(0, round((before - after) / before * 100)) if before else 0


MIGRATIONS = Migrations()
MIGRATIONS.register(Migration("legacy", Version(*CURRENT), lambda data: data, "stamp a version"))


def read_many(spark: SparkSession, pattern: str) -> DataFrame:
    """commitHash, timestamp, schemaVersion and file of many 1.0/1.1 documents at once: a pruned JSON scan."""
    schema = "commitHash string, timestamp long, schemaVersion struct<major: int, minor: int, patch: int>"
    return spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.input_file_name().alias("file"))
