"""Command line: analyze, update, scope, impact, layers, brief, migrate.  Payloads go to stdout, warnings and errors to stderr."""

from __future__ import annotations

import argparse
import errno
import os
import re
import sys
import time

from . import render
from .functions.columns import SOURCES
from .model import TARGET_NOT_FOUND, QueryError

FOLDER = ".braidgraph"
COMMANDS = ("analyze", "update", "scope", "impact", "layers", "brief", "migrate")
# Marker files of project roots in order of priority.
MARKERS = ("Cargo.toml", "Cargo.lock", "go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pyproject.toml", "setup.py", "requirements.txt", "Pipfile")
MAX_UP = 10


class CliError(Exception):
    def __init__(self, code: str, message: str, suggestion: str | None = None):
        super().__init__(message)
        self.code, self.message, self.suggestion = code, message, suggestion

    def to_dict(self) -> dict:
        error = {"code": self.code, "message": self.message}
        return {"success": False, "error": error | ({"suggestion": self.suggestion} if self.suggestion else {})}


def marker_in(folder: str) -> str | None:
    return next((m for m in MARKERS if os.path.isfile(os.path.join(folder, m))), ".git" if os.path.isdir(os.path.join(folder, ".git")) else None)


def find_root(start: str) -> str | None:
    """The nearest folder upward with a marker file."""
    at = os.path.realpath(start)
    for _ in range(MAX_UP + 1):
        if marker_in(at):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up
    return None


def similar_command(given: str, known: tuple[str, ...] = COMMANDS) -> str | None:
    """A command that begins with the word (2 letters or more) or holds it (3 or more)."""
    g = given.lower()
    for rule in (lambda c: len(g) >= 2 and (c.startswith(g) or g.startswith(c)), lambda c: len(g) >= 3 and (g in c or c in g)):
        for c in known:
            if rule(c):
                return c
    return None


def similar_flag(given: str, known: list[str]) -> str | None:
    """A flag that begins with the letters given (3 or more)."""
    return next((f for f in known if len(given) >= 3 and f.lower().startswith(given.lower())), None)


def path_hint(root: str, target: str) -> str | None:
    """How targets of a monorepo are written, if this one isn't."""
    if os.path.isdir(os.path.join(root, "packages")) and not re.match(r"packages/[a-z-]+/src/.+\.(ts|tsx|js|jsx)$", target):
        return "In a monorepo a target is the whole path: packages/<package>/src/<file>.ts"
    return None


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        if "unrecognized arguments" in message:
            flag = next((w for w in message.split(": ", 1)[1].split() if w.startswith("-")), "")
            known = sorted({f for a in (*self._actions, *(x for s in self._actions if isinstance(s, argparse._SubParsersAction) for p in s.choices.values() for x in p._actions)) for f in a.option_strings if f.startswith("--")})
            hint = similar_flag(flag.split("=")[0], known)
            raise CliError("E_CLI_UNKNOWN_FLAG", f"Unknown flag: {flag or message}", f"Did you mean '{hint}'?" if hint else None)
        words = [w for w in sys.argv[1:] if not w.startswith("-")]
        if "invalid choice" in message and words:
            hint = similar_command(words[0])
            raise CliError("E_CLI_UNKNOWN_COMMAND", f"Unknown command: {words[0]}", f"Did you mean '{hint}'?" if hint else f"Available commands: {', '.join(COMMANDS)}")
        code = "E_CLI_MISSING_ARG" if "required" in message else "E_CLI_UNKNOWN_FLAG" if "unrecognized" in message else "E_CLI_INTERNAL"
        raise CliError(code, message)


def _arguments() -> argparse.ArgumentParser:
    top = _Parser(prog="braidgraph")
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("--json", action="store_true")
        p.add_argument("--silent", action="store_true")
        p.add_argument("--root", default=None)
        if name in ("scope", "impact", "brief"):
            p.add_argument("target")
        if name == "impact":
            p.add_argument("--depth", type=int, default=10)
            p.add_argument("--max-files", type=int, default=20)
            p.add_argument("--include-tests", action="store_true")
        if name == "layers":
            p.add_argument("--source-root", default="src")
            p.add_argument("--threshold", type=int)
            p.add_argument("--verbose", action="store_true")
        if name == "migrate":
            p.add_argument("input")
            p.add_argument("output")
        if name == "analyze":
            p.add_argument("--export", help="also write the graph as JSON here")
    return top


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("braidgraph").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def real_path(path: str) -> str:
    """A path without links; its error says whether it is missing, closed or a circle of links."""
    try:
        return os.path.realpath(path, strict=True)
    except FileNotFoundError as e:
        raise CliError("E_INVALID_PATH", f"Not a directory: {path} does not exist") from e
    except PermissionError as e:
        raise CliError("E_PERMISSION_DENIED", f"Permission denied: {path}") from e
    except OSError as e:
        circle = e.errno == errno.ELOOP
        raise CliError("E_INVALID_PATH", f"Links form a circle at {path}" if circle else f"Cannot resolve {path}: {e}", "Use --root with the folder itself" if circle else None) from e


def _root(given: str | None) -> str:
    root = real_path(given) if given else find_root(os.getcwd())
    if root is None:
        raise CliError("E_SOURCE_ROOT_NOT_FOUND", "No project root found above the current folder", "Use --root")
    if not os.path.isdir(root):
        raise CliError("E_INVALID_PATH", f"Not a directory: {root}")
    return root


def _store(root: str) -> str:
    return os.path.join(root, FOLDER, "store")


def _analyze(spark, root: str, args) -> dict:
    from .parse.analyze import analyze
    from .sources import baseline, gitlog
    from .functions.columns import IGNORED
    from .sources.scan import listing, project_kind

    if not gitlog.is_repo(root):
        raise CliError("E_NO_GIT_REPO", f"Not a git repository: {root}", "Run git init first")
    kind = project_kind(listing(spark, root, IGNORED, hidden=False)).first()["kind"]
    if kind == "empty":
        return {"success": True, "kind": "empty", "message": "No source files found", "suggestions": ["Add source files"]}
    done = analyze(spark, root)
    extra = {}
    if kind == "single-file":
        kind, extra = single_file(done["graph"])
    elif kind == "test-only":
        done["warnings"].append("Only test files found; they are treated as a normal project")
    commit = ""
    try:
        commit = gitlog.head(root)
    except gitlog.GitError:
        done["warnings"].append("repository has no commits")
    graph = done["graph"].with_(meta=done["graph"].meta | {"commitHash": commit})
    os.makedirs(os.path.join(root, FOLDER), exist_ok=True)
    version = baseline.save(graph, _store(root))
    if getattr(args, "export", None):
        baseline.save_json(graph, args.export)
    s = done["stats"]
    return {"success": True, "kind": kind, "stats": {"filesScanned": s["files"], "modulesExtracted": s["modules"], "edgesCreated": {k: s[k] for k in ("imports", "exports", "contains")}}, "baseline": {"path": _store(root), "version": version, "commitHash": commit}, "warnings": done["warnings"], "nextSuggested": [] if kind == "single-file" else ["braidgraph layers"]} | extra


def single_file(graph) -> tuple[str, dict]:
    """Kind of a project with one source file, and what is said of it: its imports make it a normal one if they lead to files."""
    edges = [tuple(r) for r in graph.linked("IMPORTS", "RE_EXPORTS", "DYNAMIC_IMPORTS").select("from", "to").distinct().collect()]
    inner = [(a, b) for a, b in edges if b.startswith("FILE:") and a != b]
    if inner:
        return "normal", {"reclassified": True}
    file = next((r["path"] for r in graph.of_type("FILE").select("path").collect() if os.path.splitext(r["path"])[1] in SOURCES), None)
    deps = sorted({b.removeprefix("EXTERNAL:") for _, b in edges if b.startswith("EXTERNAL:")})
    return "single-file", {"reclassified": False, "file": file, "externalDeps": deps, "message": f"One source file, {file}: it has no layers"}


def _update(spark, root: str) -> dict:
    from .operators.changes import applied, delta
    from .parse.analyze import analyze
    from .sources import baseline, gitlog

    graph = _graph(spark, root)
    diff = gitlog.changes(spark, root, graph.meta.get("commitHash") or None)
    rows = [tuple(r) for r in diff.collect()]
    by = {k: sorted(p for p, t in rows if t == k) for k in ("ADD", "DELETE", "MODIFY")}
    out = {"success": True, "changes": {"added": by["ADD"], "removed": by["DELETE"], "modified": by["MODIFY"]}, "delta": {"newNodes": 0, "removedNodes": 0}, "warnings": []}
    if rows:
        fresh = analyze(spark, root, only=to_parse(graph, spark.createDataFrame(rows, "path string, type string")))["graph"]
        new = applied(graph, fresh, spark.createDataFrame(rows, "path string, type string"))
        baseline.save(new.with_(meta=graph.meta | {"commitHash": gitlog.head(root), "timestamp": int(time.time() * 1000)}), _store(root))
        counts = {r["change"]: r["n"] for r in delta(graph, baseline.load(spark, _store(root))).groupBy("change").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
        out["delta"] = {"newNodes": counts.get("ADDED", 0), "removedNodes": counts.get("REMOVED", 0)}
    return out


def to_parse(graph, changes):
    """Paths of the files that changes (path, type) make worth parsing: those added or modified, those that import them, and those
    with relative imports that led nowhere, as an added file may be what they mean."""
    from pyspark.sql import functions as F

    from .functions import columns as C

    fresh = changes.where("type in ('ADD', 'MODIFY')").select("path")
    edges = graph.linked("IMPORTS", "RE_EXPORTS", "DYNAMIC_IMPORTS").select(C.file_path(F.col("from")).alias("path"), F.col("to"))
    lost = edges.where(F.col("to").isin("EXTERNAL:.", "EXTERNAL:..")).select("path")
    importers = edges.withColumn("target", C.file_path(F.col("to"))).join(fresh.withColumnRenamed("path", "target"), "target", "left_semi").select("path")
    return fresh.unionByName(importers).unionByName(lost).distinct()


def _graph(spark, root: str):
    from .sources import baseline

    try:
        return baseline.load(spark, _store(root))
    except FileNotFoundError as e:
        raise CliError("E_BASELINE_NOT_FOUND", f"No stored graph: {e}", "Run `braidgraph analyze` first") from e


def run(argv: list[str], spark=None) -> tuple[int, str, list[str]]:
    """(exit code, payload, lines for stderr)."""
    began, wants_json = time.time(), "--json" in argv
    ms = lambda: round(1000 * (time.time() - began))
    try:
        args = _arguments().parse_args(argv)
        if args.command == "migrate":
            from .sources.baseline import migrate_file

            if not os.path.exists(args.input):
                raise CliError("E_BASELINE_NOT_FOUND", f"File not found: {args.input}")
            out = migrate_file(spark or _session(), args.input, args.output)
            s = out["stats"]
            text = f"Migrated {args.input} to {args.output}\n- Original size: {render.size(s['inputSizeBytes'])}\n- Compressed size: {render.size(s['outputSizeBytes'])}\n- Savings: {s['savingsPercent']}%"
        else:
            root, spark = _root(args.root), spark or _session()
            if args.command == "analyze":
                out = _analyze(spark, root, args)
                text = "\n".join([f"Files scanned: {out['stats']['filesScanned']}", f"Modules extracted: {out['stats']['modulesExtracted']}", *[f"- {k}: {n}" for k, n in out["stats"]["edgesCreated"].items()]]) if "stats" in out else out["message"]
            elif args.command == "update":
                out = _update(spark, root)
                c = out["changes"]
                text = f"Added: {len(c['added'])}\nRemoved: {len(c['removed'])}\nModified: {len(c['modified'])}"
            elif args.command == "scope":
                from .operators.scope import get_scope

                out = get_scope(_graph(spark, root), args.target)
                text = render.scope_text(out, ms())
            elif args.command == "brief":
                from .operators.scope import get_brief

                out = get_brief(_graph(spark, root), args.target)
                text = render.brief_markdown(out)
            elif args.command == "impact":
                from .operators.impact import get_impact

                out = get_impact(_graph(spark, root), [args.target], args.depth, args.max_files, args.include_tests)
                text = render.impact_text(out, ms())
            else:
                from .operators.layers import get_layers
                from .sources.config import load

                out = get_layers(_graph(spark, root), args.source_root, root, args.threshold, load(root)["rules"])
                text = render.layers_text(out, ms(), args.verbose)
        out["durationMs"] = ms()
        quiet = args.silent
        return 0, "" if quiet else render.as_json(out) if wants_json else text, [] if quiet else list(out.get("warnings", []))
    except (QueryError, CliError) as e:
        if e.code == TARGET_NOT_FOUND and (hint := path_hint(root, args.target)):
            e.suggestion = hint
        failed = e.to_dict() | {"durationMs": ms()}
        return 1, render.as_json(failed) if wants_json else "", [] if wants_json else [render.error_text(failed, ms())]


def main() -> int:
    code, payload, said = run(sys.argv[1:])
    if payload:
        print(payload)
    for line in said:
        print(line, file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
