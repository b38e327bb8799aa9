"""Source trees as tables: listings, ignore rules, special cases, and reading files on the executors."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import EDGES, NODES, RepoGraph, edge_metadata, graph_of, node_metadata
from ..plans.durable import written
from ..project import _node, folders

MAX_DEPTH = 20


@dataclass
class ScanResult:
    graph: RepoGraph
    files_to_parse: DataFrame
    stats: dict
    warnings: list[str] = field(default_factory=list)
    parseable: int | None = None


#: Folders that the driver lists before it hands the rest of the tree to tasks, and bytes of text in a batch.
SPREAD, BATCH_BYTES = 256, 8 << 20
_ROW = "kind string, path string, above string, length long, message string"
_KINDS = {"kind": pa.string(), "path": pa.string(), "above": pa.string(), "length": pa.int64(), "message": pa.string()}


def _store(folder: str):
    """(file system, path) of a folder in any store that pyarrow reads; None for one of this machine or mounted by all."""
    if "://" not in folder:
        return None, folder
    if folder.startswith("file:"):
        return None, "/" + folder.split(":", 1)[1].lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _entries(root: str, at: str) -> list[tuple[str, str, int]]:
    """(name, kind, length) of what lies in a folder, by name; kinds are D, F and L for links."""
    store, base = _store(root)
    if store is None:
        with os.scandir(os.path.join(base, at)) as found:
            rows = [(e.name, "L" if e.is_symlink() else "D" if e.is_dir() else "F", 0 if e.is_symlink() or e.is_dir() else e.stat().st_size) for e in found]
    else:
        from pyarrow import fs

        rows = [(i.base_name, "D" if i.type == fs.FileType.Directory else "F", i.size or 0) for i in store.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/")))]
    return sorted(rows)


@dataclass(frozen=True)
class Rules:
    """What a walk leaves out."""

    rules: tuple[str, ...] = ()
    hidden: bool = True
    max_depth: int = 1 << 30

    def skips(self, name: str, path: str) -> bool:
        folders, names = {r[:-1] for r in self.rules if r.endswith("/")}, {r for r in self.rules if not r.endswith("/")}
        return (name.startswith(".") and not self.hidden) or name in folders or name in names or path in names


def _walked(root: str, todo: list[tuple[str, int]], rules: Rules, rows: list[tuple], most: int = 0) -> Iterator[list[tuple]]:
    """Lists folders until none is left in ``todo``, or over ``most`` wait there; rows come in lists, the last one may be short."""
    while todo and (not most or len(todo) <= most):
        at, depth = todo.pop(0) if most else todo.pop()
        own = at or "."
        rows.append(("D", own, None, None, None))
        try:
            entries = _entries(root, at)
        except OSError as e:
            rows.append(("W", own, None, None, f"Cannot read {own}: {e}"))
            continue
        for name, kind, length in entries:
            path = f"{at}/{name}" if at else name
            if kind == "L" or rules.skips(name, path):
                rows.append(("S", path, own, None, None))
            elif kind == "D" and depth + 1 > rules.max_depth:
                rows.append(("W", path, own, None, f"Maximum depth {rules.max_depth} reached: {path}"))
            elif kind == "D":
                rows.append(("E", path, own, None, None))
                todo.append((path, depth + 1))
            else:
                rows.append(("F", path, own, length, None))
        if len(rows) >= 10_000 and not most:
            yield rows
            rows = []
    yield rows


def walk(spark: SparkSession, root: str, rules: Rules = Rules()) -> DataFrame:
    """kind, path, above, length, message of everything below a folder, whatever its name: D a folder, E its place in another, F a
    file, S what the rules leave out, W a warning.

    The driver lists folders until ``SPREAD`` wait; each of these is the work of a task that lists all below it.  Folders must be
    reached by all machines under the same path or URL.
    """
    todo, rows = [("", 0)], []
    for rows in _walked(root, todo, rules, rows, SPREAD):
        pass
    made = spark.createDataFrame(pa.Table.from_pydict({n: pa.array(c, t) for (n, t), c in zip(_KINDS.items(), zip(*rows, strict=True), strict=True)}))
    made = made.select([F.col(n).cast(t) for n, t in (x.split(" ") for x in _ROW.split(", "))])
    if not todo:
        return made

    def below(batches):
        for batch in batches:
            for at, depth in zip(batch.column("at").to_pylist(), batch.column("depth").to_pylist(), strict=True):
                for found in _walked(root, [(at, depth)], rules, []):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS)) if found else pa.RecordBatch.from_pydict({n: pa.array([], t) for n, t in _KINDS.items()})

    rest = spark.createDataFrame(todo, "at string, depth int").repartition(min(len(todo), 4096))
    return made.unionByName(written(rest.mapInArrow(below, _ROW), "walk"))


def listing(spark: SparkSession, folder: str, rules: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """path, length of all files under a folder that the rules don't leave out; no content is fetched."""
    return walk(spark, folder, Rules(tuple(rules), hidden)).where("kind = 'F'").select("path", "length")


def contents(spark: SparkSession, folder: str, paths: DataFrame | None = None) -> DataFrame:
    """path, content of the files of a listing (path), by default all, as text, read on the executors.  A file that can't be read
    has a null content."""
    paths = listing(spark, folder) if paths is None else paths

    def run(batches):
        store, base = _store(folder)

        def text(path: str) -> str | None:
            try:
                with open(os.path.join(base, path), "rb") if store is None else store.open_input_stream(f"{base}/{path}") as f:
                    return f.read().decode("utf-8", "replace")
            except OSError:
                return None

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["path", "content"])

        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows.append((path, text(path)))
                size += len(rows[-1][1] or "") + 100
                if size > BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return paths.select("path").mapInArrow(run, "path string, content string")


def kept(paths: DataFrame, rules: tuple[str, ...] = C.IGNORED, hidden: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of a listing (path) that a scan keeps: no hidden part, no ignored part, not too deep."""
    parts = F.split("path", "/")
    out = paths.where(~C.ignored(F.col("path"), rules)).where(F.size(parts) - 1 <= max_depth)
    return out if hidden else out.where(~F.exists(parts, lambda p: p.startswith(".")))


def tree(paths: DataFrame, extensions: tuple[str, ...] = C.SCANNED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files to parse) of a listing (path)."""
    path = F.col("path")
    files = paths.select("path").distinct()
    dirs, contains = folders(files)
    nodes = dirs.unionByName(files.select(*_node("FILE", path, C.basename(path), F.lit(0))))
    return nodes, contains, files.where(C.extension(path).isin(*extensions))


def scan(spark: SparkSession, root: str, rules: tuple[str, ...] = C.IGNORED, extensions: tuple[str, ...] = C.SCANNED, hidden: bool = False, max_depth: int = MAX_DEPTH) -> ScanResult:
    """A folder with its empty folders.  Links are skipped; a root that is missing or no folder gives an empty result with a
    warning."""
    stats = {"directories": 0, "files": 0, "skipped": 0}
    local = _store(root)[0] is None
    if local and (not os.path.isdir(root) or os.path.basename(os.path.abspath(root)).startswith(".") and not hidden):
        why = "does not exist" if not os.path.exists(root) else "is not a directory" if not os.path.isdir(root) else "is hidden"
        return ScanResult(graph_of(spark, [], []), spark.createDataFrame([], "path string"), stats, [f"Root {why}: {root}"])
    rows = walk(spark, root, Rules(tuple(rules), hidden, max_depth))
    wanted = (F.col("kind") == "F") & C.extension(F.col("path")).isin(*extensions)
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    counts = rows.agg(count("D"), count("F"), count("S"), F.count_if(wanted).alias("parse"), F.collect_list(F.when(F.col("kind") == "W", F.col("message"))).alias("W")).first()
    path, kind, named = F.col("path"), F.when(F.col("kind") == "F", "FILE").otherwise("DIRECTORY"), C.basename(F.col("path"))
    nodes = rows.where("kind in ('D', 'F')").select(F.concat(kind, F.lit(":"), path).alias("id"), kind.alias("type"), "path", named.alias("name"), node_metadata().alias("metadata"), F.lit(0).cast("long").alias("node_seq"))
    ends = [F.concat(F.lit("DIRECTORY:"), "above").alias("from"), F.concat(kind, F.lit(":"), path).alias("to"), F.lit("CONTAINS").alias("type"), edge_metadata().alias("metadata"), F.lit(0).cast("long").alias("edge_seq")]
    files = rows.where("kind = 'F'").select("path")
    stats = {"directories": counts["D"], "files": counts["F"], "skipped": counts["S"]}
    return ScanResult(RepoGraph(nodes, rows.where("kind in ('E', 'F')").select(*ends)), files.where(C.extension(path).isin(*extensions)), stats, list(counts["W"]), counts["parse"])


def split_tests(paths: DataFrame, globs: tuple[str, ...] | None = None, extra: tuple[str, ...] = (), case_insensitive: bool = False) -> DataFrame:
    """path, is_test by globs: the given ones, those in the environment's TEST_PATTERNS, or the defaults, and extra ones."""
    env = patterns_of(os.environ.get("TEST_PATTERNS", ""))
    return paths.select("path", C.test_path(F.col("path"), tuple(globs or env or C.TEST_GLOBS) + tuple(extra), case_insensitive).alias("is_test"))


def patterns_of(text: str) -> tuple[str, ...]:
    """Globs of a JSON array, or of a list with commas."""
    try:
        found = json.loads(text)
    except ValueError:
        found = text.split(",")
    return tuple(g.strip() for g in (found if isinstance(found, list) else [found]) if isinstance(g, str) and g.strip())


def project_kind(paths: DataFrame) -> DataFrame:
    """One row: sources, tests, kind (empty, test-only, single-file, normal) of a listing (path)."""
    path = F.col("path")
    src = C.extension(path).isin(*C.SOURCES)
    counts = paths.select(src.alias("s"), C.test_path(path).alias("t")).agg(F.count_if(F.col("s") & ~F.col("t")).alias("sources"), F.count_if(F.col("s") & F.col("t")).alias("tests"))
    kind = F.when((F.col("sources") == 0) & (F.col("tests") > 0), "test-only").when(F.col("sources") == 0, "empty").when(F.col("sources") == 1, "single-file").otherwise("normal")
    return counts.withColumn("kind", kind)


def project_scale(paths: DataFrame) -> DataFrame:
    """One row: files (sources that are no tests, under src if there is one), threshold."""
    path = F.col("path")
    rows = paths.where(C.extension(path).isin(*C.SOURCES)).where(~C.test_path(path)).agg(F.count("*").alias("a"), F.count_if(path.startswith("src/")).alias("s"))
    has_src = paths.agg(F.coalesce(F.bool_or(path.startswith("src/")), F.lit(False)).alias("h"))
    files = F.when(F.col("h"), F.col("s")).otherwise(F.col("a"))
    return rows.crossJoin(has_src).select(files.alias("files"), C.layer_threshold(files).cast("int").alias("threshold"))


def source_file_count(root: str) -> int:
    """The same count over a folder of this machine; 0 if it is missing."""
    import re

    base = os.path.join(root, "src") if os.path.isdir(os.path.join(root, "src")) else root
    tests = [re.compile(C.glob_regex(g)) for g in C.TEST_GLOBS]
    n = 0
    for at, dirs, names in os.walk(base):
        dirs[:] = [d for d in dirs if d != "node_modules" and not d.startswith(".")]
        for name in names:
            path = os.path.relpath(os.path.join(at, name), root)
            n += os.path.splitext(name)[1] in C.SOURCES and not any(t.match(path) for t in tests)
    return n


__all__ = ["EDGES", "NODES", "Rules", "ScanResult", "contents", "kept", "listing", "patterns_of", "project_kind", "project_scale", "scan", "source_file_count", "split_tests", "tree", "walk"]
