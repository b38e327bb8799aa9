"""From source text to graph tables: parsing on the executors, resolution of specifiers as a join with the listing."""

from __future__ import annotations

import json
import os
import posixpath
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import DYNAMIC_IMPORTS, EXPORTS, IMPORTS, MODULE, NODE_METADATA, RE_EXPORTS, RepoGraph, edge_metadata
from ..operators import graph as G
from ..plans.durable import written
from ..project import _node
from ..sources import scan as S
from .extract import Parsed, parse

Parser = Callable[[str, str], Parsed]


class Registry:
    """Parsers by extension; the last one registered for an extension wins."""

    def __init__(self):
        self._by: dict[str, tuple[str, Parser]] = {}
        self.warnings: list[str] = []

    def register(self, name: str, extensions: tuple[str, ...], parser: Parser) -> None:
        if not name or not callable(parser) or not extensions:
            raise ValueError("a parser needs a name, extensions and a function")
        for e in extensions:
            if not re.fullmatch(r"\.\w+", e):
                raise ValueError(f"Invalid extension: {e}")
            if e in self._by:
                self.warnings.append(f"Extension {e} of parser {self._by[e][0]} is now served by {name}")
            self._by[e] = (name, parser)

    def get(self, extension: str) -> Parser | None:
        return self._by[extension][1] if extension in self._by else None

    def extensions(self) -> tuple[str, ...]:
        return tuple(self._by)

    def names(self) -> list[str]:
        return list(dict.fromkeys(n for n, _ in self._by.values()))


REGISTRY = Registry()
#: Files that a parsing task reads, and texts of a table that it parses.
FILES_A_TASK, TEXTS_A_TASK = 100, 2_000
REGISTRY.register("typescript", C.PARSED, parse)

_TRIES = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json")
_SWAPS = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


def candidates(specifier: str, path: str, aliases: dict | None = None) -> list[str]:
    """Paths that a specifier may mean in a file, best first; none for packages."""
    bases = []
    if specifier.startswith("."):
        bases.append(posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier)))
    elif specifier.startswith("/"):
        return []
    else:
        for pattern, targets in (aliases or {}).get("paths", {}).items():
            head, star, tail = pattern.partition("*")
            if specifier == pattern or star and specifier.startswith(head) and specifier.endswith(tail):
                middle = specifier[len(head) : len(specifier) - len(tail)] if star else ""
                bases += [posixpath.normpath(posixpath.join((aliases or {}).get("base", "."), t.replace("*", middle))) for t in targets]
        if (aliases or {}).get("has_base"):
            bases.append(posixpath.normpath(posixpath.join(aliases["base"], specifier)))
    out = []
    for b in bases:
        if b.startswith(".."):
            continue
        stem, ext = posixpath.splitext(b)
        out += [stem + e for e in _SWAPS.get(ext, ())]
        out += [b + e for e in _TRIES if e or ext]
        out += [f"{b}/index{e}" if b != "." else f"index{e}" for e in _TRIES[1:]]
    return list(dict.fromkeys(out))


def _config(path: str, seen: tuple[str, ...] = ()) -> tuple[dict, list[str]]:
    """Compiler options of a tsconfig file (comments allowed) over those it extends, with the folder of each that holds paths."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
        own = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
        options, above = dict(own.get("compilerOptions") or {}), own.get("extends") or []
    except (OSError, ValueError, AttributeError, TypeError) as e:
        return {}, [f"{os.path.basename(path)} parsing errors: {e}"]
    folder, out, warnings = os.path.dirname(path), {}, []
    for name in [above] if isinstance(above, str) else above:
        found = _extended(folder, name)
        if found is None or found in seen or found == path:
            warnings.append(f"{os.path.basename(path)} parsing errors: cannot extend {name}")
            continue
        options_above, said = _config(found, (*seen, path))
        out |= options_above
        warnings += said
    if "baseUrl" in options:
        out |= {"baseUrl": os.path.normpath(os.path.join(folder, options["baseUrl"]))}
    if "paths" in options:
        out |= {"paths": options["paths"] or {}, "folder": folder}
    return out, warnings


def _extended(folder: str, name: str) -> str | None:
    """The file that a config extends: a path, or a package in the nearest node_modules upward."""
    if name.startswith((".", "/")):
        tries = [os.path.join(folder, name)]
    else:
        tries, at = [], folder
        while True:
            tries.append(os.path.join(at, "node_modules", name))
            if at == os.path.dirname(at):
                break
            at = os.path.dirname(at)
    for t in tries:
        for path in (t, f"{t}.json", os.path.join(t, "tsconfig.json")):
            if os.path.isfile(path):
                return os.path.normpath(path)
    return None


def aliases_of(root: str) -> tuple[dict, list[str]]:
    """Path aliases of a tsconfig.json and of all it extends, relative to the root, with warnings."""
    root = os.path.abspath(root)
    path = os.path.join(root, "tsconfig.json")
    if not os.path.exists(path):
        return {}, []
    options, warnings = _config(path)
    if not options and warnings:
        return {}, warnings
    base = options.get("baseUrl") or options.get("folder") or root
    own = lambda p: os.path.relpath(p, root).replace(os.sep, "/")
    return {"base": own(base), "has_base": "baseUrl" in options, "paths": options.get("paths", {})}, warnings


_ROW = (
    "path string, warnings array<string>,"
    " imports array<struct<specifier: string, line: int, type: string, importSpecifier: string, kind: string, candidates: array<string>>>,"
    f" modules array<struct<name: string, metadata: {NODE_METADATA.simpleString()}>>"
)
_KIND = pa.struct([("kind", pa.string()), ("isExported", pa.bool_()), ("jsDoc", pa.string()), ("jsDocTruncated", pa.bool_()), ("hasJSDoc", pa.bool_()), ("deprecated", pa.bool_()), ("complexity", pa.int32()), ("loc", pa.int32()), ("testFile", pa.string()), ("lastModifiedCommit", pa.string()), ("changeFrequency", pa.int32()), ("namedDefault", pa.bool_()), ("originalName", pa.string()), ("enumMembers", pa.list_(pa.string())), ("exports", pa.list_(pa.string()))])
_IMPORT = pa.struct([("specifier", pa.string()), ("line", pa.int32()), ("type", pa.string()), ("importSpecifier", pa.string()), ("kind", pa.string()), ("candidates", pa.list_(pa.string()))])
_MODULE = pa.struct([("name", pa.string()), ("metadata", _KIND)])


def spread(files: DataFrame, a_task: int = FILES_A_TASK, n: int | None = None) -> DataFrame:
    """Files (path) dealt to tasks by their number: a short table of them may be long work."""
    n = files.count() if n is None else n
    return files.repartition(max(1, min(-(-n // a_task), 100_000)), "path")


def parsed_files(files: DataFrame, aliases: dict | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """path, warnings, imports, modules of each file (path, content).  A file that can't be parsed gives a warning."""
    parsers = {e: registry.get(e) for e in registry.extensions()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            warnings, imports, modules = [], [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    if text is None:
                        raise OSError("cannot be read")
                    found = parsers[posixpath.splitext(path)[1]](path, text)
                    warnings.append(found.warnings)
                    imports.append([vars(x) | {"candidates": candidates(x.specifier, path, aliases)} for x in found.imports])
                    modules.append([{"name": m.name, "metadata": m.metadata} for m in found.modules])
                except Exception as e:  # noqa: BLE001  one odd file must not end the job
                    warnings.append([f"Failed to parse {path}: {e}"])
                    imports.append([])
                    modules.append([])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(warnings, pa.list_(pa.string())), pa.array(imports, pa.list_(_IMPORT)), pa.array(modules, pa.list_(_MODULE))], names=["path", "warnings", "imports", "modules"])

    return files.select("path", "content").where(C.extension(F.col("path")).isin(*parsers)).mapInArrow(run, _ROW)


def resolved(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (path, pos, specifier, candidates, ...) with ``resolved``: the first candidate that is in the listing."""
    tries = imports.select("path", "pos", F.posexplode("candidates").alias("rank", "candidate"))
    hits = tries.join(paths.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi").groupBy("path", "pos").agg(F.min_by("candidate", "rank").alias("resolved"))
    return imports.join(hits, ["path", "pos"], "left")


def parsed_graph(parsed: DataFrame, paths: DataFrame) -> RepoGraph:
    """Symbols, packages and all their edges from parsed files, with specifiers resolved against a listing (path)."""
    order = F.row_number().over(Window.partitionBy("path").orderBy("pos")).cast("long")
    rows = resolved(parsed.select("path", F.posexplode("imports").alias("pos", "i")).select("path", "pos", "i.*"), paths)
    rows = rows.withColumn("to", C.target_id(F.col("specifier"), F.col("resolved"))).withColumn("edge_seq", order)
    kind = F.when(F.col("type") == "import", IMPORTS).when(F.col("type") == "re-export", RE_EXPORTS).otherwise(DYNAMIC_IMPORTS)
    static = F.col("type") != "dynamic"
    meta = edge_metadata(line=F.col("line"), importSpecifier=F.col("importSpecifier"), importKind=F.when(static, F.col("kind")), isDynamic=F.when(~static, F.lit(True)))
    edges = rows.select(F.concat(F.lit("FILE:"), "path").alias("from"), "to", kind.alias("type"), meta.alias("metadata"), "edge_seq")
    package = C.file_path(F.col("to"))
    packages = rows.where(F.col("to").startswith("EXTERNAL:") & (F.col("specifier") != "__dynamic__")).select("to").distinct().select(*_node("EXTERNAL", package, package, F.lit(0)))
    made = parsed.select("path", F.posexplode("modules").alias("pos", "m"))
    modules = made.select(F.concat(F.lit("MODULE:"), "path", F.lit("#"), "m.name").alias("id"), F.lit(MODULE).alias("type"), "path", F.col("m.name").alias("name"), F.col("m.metadata").alias("metadata"), F.col("pos").cast("long").alias("node_seq"))
    exports = modules.select(F.concat(F.lit("FILE:"), "path").alias("from"), F.col("id").alias("to"), F.lit(EXPORTS).alias("type"), edge_metadata().alias("metadata"), F.col("node_seq").alias("edge_seq"))
    return RepoGraph(modules.unionByName(packages), edges.unionByName(exports))


def analyze(spark: SparkSession, root: str, registry: Registry = REGISTRY, on_progress: Callable[[dict], None] | None = None, only: DataFrame | None = None, **scan_options) -> dict:
    """The graph of a source folder with counts and warnings: {"graph", "stats", "warnings"}.

    only: a listing (path) of the files to read and parse; the others are nodes without contents."""
    tell = on_progress or (lambda event: None)
    began = time.time()
    tell({"phase": "scan", "current": 0, "total": 0})
    found = S.scan(spark, root, extensions=registry.extensions(), **scan_options)
    listed = found.graph.of_type("FILE").select("path")
    scanned = time.time()
    todo = found.files_to_parse if only is None else found.files_to_parse.join(only.select("path").distinct(), "path", "left_semi")
    n = found.parseable if only is None and found.parseable is not None else todo.count()
    tell({"phase": "parse", "current": 0, "total": n})
    aliases, warnings = aliases_of(root)
    if n:
        parsed = written(parsed_files(S.contents(spark, root, spread(todo, n=n)), aliases, registry), "parsed")
        tell({"phase": "merge", "current": n, "total": n})
        graph = G.merge_parsed(found.graph, parsed_graph(parsed, listed))
        graph = RepoGraph(written(graph.nodes, "nodes"), written(graph.edges, "edges"), {"timestamp": int(time.time() * 1000)})
        came, said = parsed.agg(F.count("*"), F.flatten(F.collect_list(F.when(F.size("warnings") > 0, F.col("warnings"))))).first()
        failed = list(said)
        if came != n:
            failed.append(f"{n - came} of {n} files did not come back from parsing")
    else:
        graph, failed = found.graph, []
    counts = G.edge_counts(graph).first().asDict()
    stats = {**found.stats, "filesParsed": n - len(failed), "parseErrors": len(failed), "modules": counts["exports"] if n else graph.of_type(MODULE).count(), **counts, "scanTimeMs": int(1000 * (scanned - began)), "totalTimeMs": int(1000 * (time.time() - began))}
    tell({"phase": "complete", "current": n, "total": n})
    return {"graph": graph, "stats": stats, "warnings": [*found.warnings, *warnings, *failed]}
