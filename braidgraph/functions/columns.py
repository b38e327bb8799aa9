"""Native column expressions: paths, names, bands and texts.  None of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DYNAMIC_IMPORTS, EXTERNAL, RE_EXPORTS

# Folders and files that a scan ignores, and the extensions of its parsers.
IGNORED = (".git/", "node_modules/", "dist/", "build/", ".next/", ".cache/", ".braidgraph/", "coverage/", "__pycache__/", ".DS_Store")
SCANNED = (".ts", ".tsx", ".js", ".jsx", ".mjs")
PARSED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
TRACKED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
SOURCES = (".ts", ".tsx", ".js", ".jsx", ".vue")
TEST_GLOBS = (
    "*.test.ts", "*.test.tsx", "*.test.js", "*.test.jsx", "*.spec.ts", "*.spec.tsx", "*.spec.js", "*.spec.jsx",
    "*_test.ts", "*_test.js", "tests/**", "__tests__/**", "test/**", "spec/**",
)
BUILTINS = (
    "fs", "path", "os", "crypto", "util", "stream", "events", "buffer", "http", "https", "url", "net", "dns", "child_process", "cluster",
    "readline", "repl", "vm", "module", "assert", "console", "process", "timers", "zlib", "punycode", "string_decoder", "querystring",
    "dgram", "tls", "v8", "worker_threads", "perf_hooks", "async_hooks", "inspector", "http2", "trace_events", "diagnostics_channel",
)

CODE_SUFFIX = r"\.(ts|js|tsx|jsx|json|mjs|cjs)$"
IMPACT_TEST = r"/(__tests__|tests)/|\.(test|spec)\.tsx?$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path; ``.`` at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """From the last dot of the name on; empty for none and for names that begin with their only dot."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """All folders above a path from ``.`` down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def ignored(path: Column, rules: tuple[str, ...] = IGNORED) -> Column:
    """A rule that ends in / matches any part of a path, another the whole path or its last part."""
    parts = F.split(path, r"[/\\]")
    folders, names = [r[:-1] for r in rules if r.endswith("/")], [r for r in rules if not r.endswith("/")]
    hit = F.lit(False)
    if folders:
        hit = hit | F.arrays_overlap(parts, F.array(*map(F.lit, folders)))
    if names:
        hit = hit | path.isin(*names) | F.element_at(parts, -1).isin(*names)
    return hit


def glob_regex(glob: str, case_insensitive: bool = False) -> str:
    """The regular expression of a test glob.  A star crosses folders, so ``tests/**`` is a prefix of the path
    and ``*.test.ts`` fits in any folder."""
    out = "".join(".*" if c == "*" else re.escape(c) for c in glob.replace("\\", "/"))
    return ("(?i)" if case_insensitive else "") + f"^{out}" + ("" if glob.endswith("/**") else "$")


def test_path(path: Column, globs: tuple[str, ...] = TEST_GLOBS, case_insensitive: bool = False) -> Column:
    """Whether any glob fits the path; never for an empty one."""
    clean = F.regexp_replace(path, r"\\", "/")
    hit = F.lit(False)
    for g in globs:
        hit = hit | clean.rlike(glob_regex(g, case_insensitive))
    return hit & (F.length(path) > 0)


def test_node(node_id: Column) -> Column:
    """The narrower test rule of traversals."""
    return node_id.rlike(IMPACT_TEST)


def group_of(path: Column, root: str = "src") -> Column:
    """First folder under ``root``; ``__root__`` for its own files, ``__external__`` for paths that don't begin with it."""
    rest = F.regexp_replace(F.substr(path, F.lit(len(root) + 1)), "^/", "")
    return F.when(~path.startswith(root), F.lit("__external__")).when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise(F.lit("__root__"))


def group_lenient(path: Column, root: str = "src") -> Column:
    """As group_of(), but paths elsewhere count by their own first folder."""
    rest = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    return F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise(F.lit("__root__"))


def file_path(node_id: Column) -> Column:
    """The path in an id, without its type and its export's name."""
    return F.substring_index(F.regexp_replace(node_id, "^(FILE|MODULE|EXTERNAL|DIRECTORY):", ""), "#", 1)


def import_type(edge_type: Column) -> Column:
    return F.when(edge_type == DYNAMIC_IMPORTS, "dynamic").when(edge_type == RE_EXPORTS, "re-export").otherwise("static")


def import_kind(kind: Column, target_type: Column) -> Column:
    return F.when(target_type == EXTERNAL, F.lit("value")).otherwise(F.coalesce(kind, F.lit("value")))


def complexity_level(value: Column) -> Column:
    return F.when(value == 0, "unknown").when(value <= 5, "low").when(value <= 15, "medium").when(value <= 25, "high").otherwise("critical")


def blast_radius(total: Column) -> Column:
    return F.when(total == 0, "unknown").when(total <= 3, "low").when(total <= 10, "medium").otherwise("high")


def layer_threshold(files: Column) -> Column:
    return F.when(files <= 50, 5).when(files <= 200, 3).when(files <= 500, 2).otherwise(1)


def severity(gap: Column) -> Column:
    return F.when(gap >= 3, "critical").when(gap == 2, "moderate").otherwise("minor")


def violation_hint(low: Column, high: Column, gap: Column) -> Column:
    return (
        F.when(gap >= 3, F.concat(F.lit("Critical violation: "), low, F.lit(" (lower layer) imports "), high, F.lit(" (higher layer). Consider restructuring architecture")))
        .when(gap == 2, F.concat(F.lit("Move shared logic from "), high, F.lit(" to "), low, F.lit(", or create a shared middle layer")))
        .otherwise(F.concat(F.lit("Consider moving the importing file to "), high, F.lit(" directory")))
    )


def is_builtin(specifier: Column) -> Column:
    return specifier.startswith("node:") | specifier.isin(*BUILTINS)


def package_name(specifier: Column) -> Column:
    """The package of a specifier: two parts if it is scoped, else one; without ``node:``."""
    bare = F.regexp_replace(specifier, "^node:", "")
    return F.when(bare.startswith("@"), F.substring_index(bare, "/", 2)).otherwise(F.substring_index(bare, "/", 1))


def package_of_path(path: Column) -> Column:
    """The package that a path inside node_modules belongs to; ``unknown`` for others."""
    found = F.regexp_extract(path, r"node_modules/(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(found == "", F.lit("unknown")).otherwise(found)


def target_id(specifier: Column, resolved: Column) -> Column:
    """The node that an import points at."""
    return (
        F.when(resolved.isNull(), F.concat(F.lit("EXTERNAL:"), package_name(specifier)))
        .when(resolved.contains("node_modules"), F.concat(F.lit("EXTERNAL:"), package_of_path(resolved)))
        .otherwise(F.concat(F.lit("FILE:"), resolved))
    )


def looks_external(path: Column) -> Column:
    """What the compressed format takes for a package: inside node_modules, or a bare name without an extension."""
    return path.contains("node_modules/") | path.startswith("node_modules") | (~path.contains("/") & ~path.rlike(CODE_SUFFIX))


def truncated_doc(doc: Column, most: int = 100) -> Column:
    """struct<jsDoc, jsDocTruncated, hasJSDoc>: trimmed, cut at ``most`` characters with an ellipsis; null if blank."""
    text = F.regexp_replace(doc, r"^\s+|\s+$", "")
    blank = doc.isNull() | (text == "")
    long = F.length(text) > most
    return F.struct(
        F.when(~blank, F.when(long, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)).alias("jsDoc"),
        F.when(~blank & long, F.lit(True)).alias("jsDocTruncated"),
        F.when(~blank, F.lit(True)).alias("hasJSDoc"),
    )


def lines_of_code(text: Column) -> Column:
    """Lines that are neither blank nor comment, by one fold over the lines.  A line that opens and closes a comment counts
    if something else stands on it; a line that begins with an open comment starts a block up to a line that ends it."""

    def step(acc, raw):
        line = F.regexp_replace(raw, r"^\s+|\s+$", "")
        inline = line.contains("/*") & line.contains("*/")
        begins = line.startswith("/*")
        rest = F.trim(F.regexp_replace(line, r"/\*.*?\*/", ""))
        one = F.when(line == "", 0).when(inline, F.when(rest != "", 1).otherwise(0)).when(begins | acc["inside"] | line.startswith("//"), 0).otherwise(1)
        inside = F.when((line == "") | inline, acc["inside"]).when(begins, True).when(acc["inside"] & line.endswith("*/"), False).otherwise(acc["inside"])
        return F.struct((acc["n"] + one).alias("n"), inside.alias("inside"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step)["n"]


def deprecated_text(text: Column) -> Column:
    """Whether a documentation comment marks what follows as deprecated."""
    return text.rlike(r"(?is)/\*\*((?!\*/).)*@deprecated")
