"""The lexer, the extractor, resolution and a whole analysis."""

import os
import textwrap

import pytest

from braidgraph.parse.analyze import REGISTRY, Registry, aliases_of, analyze, candidates
from braidgraph.parse.extract import parse
from braidgraph.sources import scan as S


def found(text, path="src/a.ts"):
    return parse(path, textwrap.dedent(text))


def test_imports():
    p = found("""\
        import fs from 'fs';
        import type { A, B as C } from './types.js';
        import D, { e } from "../d";
        import * as ns from '@scope/pkg/sub';
        import './setup';
        import x = require('y');
        import type from './t';
        export * from './all';
        export * as all from './all2'
        export { q as r, s } from './q';
        export type { T } from './t';
        const lazy = () => import('./lazy'); const m = import(name);
        // import z from 'commented'
        const s = "import q from 'quoted'"; const t = `import ${1} from 'x'`
        """)
    assert [(i.specifier, i.line, i.type, i.importSpecifier, i.kind) for i in p.imports] == [
        ("fs", 1, "import", "default", "value"),
        ("./types.js", 2, "import", "named:A,C", "type-only"),
        ("../d", 3, "import", "default", "value"),
        ("@scope/pkg/sub", 4, "import", "namespace", "value"),
        ("./setup", 5, "import", "empty", "value"),
        ("./t", 7, "import", "default", "value"),
        ("./all", 8, "re-export", "wildcard", "value"),
        ("./all2", 9, "re-export", "wildcard", "value"),
        ("./q", 10, "re-export", "named:r,s", "value"),
        ("./t", 11, "re-export", "named:T", "type-only"),
        ("./lazy", 12, "dynamic", "dynamic", "value"),
        ("__dynamic__", 12, "dynamic", "dynamic", "value"),
    ]


def test_symbols():
    p = found("""\
        /** Adds. @deprecated */
        export function add() { return 1 }
        export const one = 1, two = (x: string): void => { if (x) return }
        const hidden = 3
        export default class Foo extends Bar<Baz> { m() { return 1 } }
        export interface I { a: string }
        export type U = { a: string } | { b: number }
        export enum E { A = 1, B, C = 'x' }
        function later() { return 1 }
        export { later as renamed }
        export { x as y } from './x'
        export function add() {}
        """)
    got = {m.name: m.metadata for m in p.modules}
    assert list(got) == ["add", "one", "two", "Foo", "I", "U", "E", "renamed", "add_1", "y"]
    assert got["add"]["deprecated"] and got["add"]["jsDoc"] == "Adds. @deprecated"
    assert [got[n]["kind"] for n in ("add", "one", "two", "Foo", "I", "U", "E", "renamed")] == ["function", "variable", "function", "class", "interface", "type", "type", "function"]
    assert got["Foo"]["namedDefault"] and got["renamed"]["originalName"] == "later" and got["y"]["originalName"] == "x" and got["E"]["enumMembers"] == ["A", "B", "C"]


@pytest.mark.parametrize(
    ("body", "n"),
    [
        ("return 1", 1),
        ("if (a) {}", 2),
        ("if (a) {} else {}", 3),
        ("if (a) {} else if (b) {} else {}", 3),
        ("for (;;) {} for (const x of y) {} while (a) {} do {} while (b)", 5),
        ("switch (a) { case 1: break; case 2: default: }", 3),
        ("try {} catch {} ; p.catch(() => 1)", 2),
        ("return a && b || c ?? d", 4),
        ("return a ? b : c", 2),
        ("const f = (x?: string) => x?.y; const o = { if: 1 }; o.if", 1),
        ("const s = `${a && b}`; const t = 'if (a) && b'; const r = /a && b/", 2),
        ("const g = () => { if (a) {} }", 2),
    ],
)
def test_complexity(body, n):
    assert found(f"export function f(a) {{ {body} }}").modules[0].metadata["complexity"] == n


def test_components_and_lines():
    p = found(
        """\
        export const App = () => {
          // note
          return <div className="x">Don't {a && <b>it's</b>} </div>
        }
        export function Page(): JSX.Element { return null }
        export const useX = function useX() { return <p/> }
        const n = <T,>(x: T) => x
        export default App
        export const g = n < 3, h = 4
        """,
        "src/a.tsx",
    )
    got = {m.name: m.metadata for m in p.modules}
    assert {k: v["kind"] for k, v in got.items()} == {"App": "component", "Page": "component", "useX": "function", "g": "variable", "h": "variable"}
    assert got["App"]["loc"] == 3 and got["App"]["complexity"] == 2


def test_odd_texts():
    for text in ("", "'", "`${", "/*", "export {", "import", "import {", "export default", "}" * 5, "((((", "export const", "<div", "export function", "\x00", "a" * 100_000, "export const { a, b: [c] } = d"):
        for path in ("a.ts", "a.tsx"):
            parse(path, text)


def test_candidates():
    assert candidates("./b", "src/a.ts")[:3] == ["src/b.ts", "src/b.tsx", "src/b.d.ts"]
    assert candidates("./b.js", "src/a.ts")[0] == "src/b.ts" and "src/b.js" in candidates("./b.js", "src/a.ts")
    assert candidates("lodash", "src/a.ts") == [] and candidates("../../x", "src/a.ts") == []
    assert "src/lib/x.ts" in candidates("@/lib/x", "a.ts", {"base": ".", "paths": {"@/*": ["src/*"]}})


@pytest.fixture
def project(tmp_path):
    tree = {
        "src/index.ts": "import { a } from './util/a'\nimport _ from 'lodash'\nimport fs from 'node:fs'\nexport * from '@/types'\nexport const main = () => a",
        "src/util/a.ts": "import type { T } from '../types'\nimport _ from 'lodash'\nexport function a(x: T) { return x ? 1 : 2 }",
        "src/types/index.ts": "export interface T { x: string }",
        "src/broken.ts": "export const \x00 '",
        "tsconfig.json": '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}}',
        "package.json": "{}",
        "node_modules/lodash/index.js": "x",
        ".hidden/x.ts": "x",
        "README.md": "x",
    }
    for path, text in tree.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def test_analyze(spark, project):
    done = analyze(spark, project)
    g = done["graph"]
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"DIRECTORY:.", "DIRECTORY:empty", "FILE:src/index.ts", "MODULE:src/index.ts#main", "EXTERNAL:lodash", "EXTERNAL:fs", "FILE:README.md"} <= ids
    assert not any("node_modules" in i or "hidden" in i for i in ids)
    edges = {(r["from"], r["to"], r["type"]) for r in g.edges.collect()}
    assert ("FILE:src/index.ts", "FILE:src/util/a.ts", "IMPORTS") in edges and ("FILE:src/index.ts", "FILE:src/types/index.ts", "RE_EXPORTS") in edges
    assert sum(e[1] == "EXTERNAL:lodash" for e in edges) == 2
    meta = {r["to"]: r["metadata"] for r in g.edges.where("`from` = 'FILE:src/util/a.ts'").collect()}
    assert meta["FILE:src/types/index.ts"]["importKind"] == "type-only" and meta["FILE:src/types/index.ts"]["line"] == 1
    assert done["stats"]["filesParsed"] == 4 and done["stats"]["exports"] == 3 + sum(i.startswith("MODULE:src/broken") for i in ids)


def test_scan(spark, project, tmp_path):
    r = S.scan(spark, project)
    assert r.stats["files"] == 7 and r.stats["skipped"] == 2
    assert S.scan(spark, str(tmp_path / "none")).warnings and S.scan(spark, project, max_depth=1).warnings
    assert S.scan(spark, project, hidden=True).stats["files"] == 8
    listed = S.listing(spark, project)
    assert {x["path"] for x in S.kept(listed).collect()} >= {"src/index.ts", "README.md"}
    assert S.project_kind(S.kept(listed)).first()["kind"] == "normal" and S.source_file_count(project) == 4 and S.source_file_count("/nowhere") == 0
    rows = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [S.project_kind(x).first()["kind"] for x in (rows("a.md"), rows("a.test.ts"), rows("a.ts"), rows("a.ts", "b.js"))] == ["empty", "test-only", "single-file", "normal"]
    split = {x["path"]: x["is_test"] for x in S.split_tests(rows("src/a.test.ts", "tests/x/y.ts", "src/tests/y.ts", "a_test.js", "")).collect()}
    assert split == {"src/a.test.ts": True, "tests/x/y.ts": True, "src/tests/y.ts": False, "a_test.js": True, "": False}


def test_registry():
    r = Registry()
    r.register("one", (".x",), parse)
    r.register("two", (".x", ".y"), parse)
    assert r.names() == ["two"] and r.warnings and r.get(".z") is None and REGISTRY.get(".tsx") is parse
    for bad in (("", (".x",), parse), ("a", ("x",), parse), ("a", (), parse)):
        with pytest.raises(ValueError):
            r.register(*bad)


def test_names_that_file_sources_hide(spark, tmp_path, monkeypatch):
    """Folders and files that begin with an underscore are read like all others, however the tree is listed."""
    tree = {
        "src/a.ts": "export const a = 1",
        "src/__tests__/a.test.ts": "import { a } from '../a'\nexport const t = a",
        "src/_app.tsx": "import { a } from './a'\nexport default function App() { return <p>{a}</p> }",
        "src/_x/_y/_layout.ts": "export * from '../../_app'",
        "src/deep/b.js": "import '../a'",
    }
    for path, text in tree.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src/deep/empty/_none").mkdir(parents=True)
    (tmp_path / "src/link.ts").symlink_to(tmp_path / "src/a.ts")
    graphs = []
    for most in (256, 1):  # listed by the driver alone; handed on to tasks
        monkeypatch.setattr(S, "SPREAD", most)
        done = analyze(spark, str(tmp_path))
        assert done["stats"]["filesParsed"] == len(tree) and done["stats"]["parseErrors"] == 0 and not done["warnings"]
        assert done["stats"]["skipped"] == 1 and done["stats"]["directories"] == 8
        edges = {(r["from"], r["to"], r["type"]) for r in done["graph"].edges.collect()}
        graphs.append((edges, {r["id"] for r in done["graph"].nodes.collect()}))
        for a, b in (("__tests__/a.test.ts", "a.ts"), ("_app.tsx", "a.ts"), ("deep/b.js", "a.ts")):
            assert (f"FILE:src/{a}", f"FILE:src/{b}", "IMPORTS") in edges
        assert ("FILE:src/_x/_y/_layout.ts", "FILE:src/_app.tsx", "RE_EXPORTS") in edges and ("DIRECTORY:src/deep/empty", "DIRECTORY:src/deep/empty/_none", "CONTAINS") in edges
    assert graphs[0] == graphs[1]
    assert {r["path"] for r in S.listing(spark, str(tmp_path)).collect()} == set(tree)
    (tmp_path / "src/gone.ts").write_text("x")
    paths = spark.createDataFrame([("src/gone.ts",), ("src/never.ts",)], "path string")
    assert {r["path"]: r["content"] for r in S.contents(spark, str(tmp_path), paths).collect()} == {"src/gone.ts": "x", "src/never.ts": None}


def test_configs_that_extend_others(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("config/base.json", '{"compilerOptions": {"baseUrl": "..", "paths": {"@base/*": ["packages/*/src"]}}} // end')
    put("config/mid.json", '{"extends": "./base"}')
    put("tsconfig.json", '{"extends": "./config/mid.json", "compilerOptions": {"strict": true}}')
    assert aliases_of(str(tmp_path)) == ({"base": ".", "has_base": True, "paths": {"@base/*": ["packages/*/src"]}}, [])
    put("tsconfig.json", '{"extends": ["./config/mid.json", "shared/tsconfig"], "compilerOptions": {"baseUrl": "lib"}}')
    put("node_modules/shared/tsconfig.json", '{"compilerOptions": {"paths": {"~/*": ["*"]}}}')
    assert aliases_of(str(tmp_path)) == ({"base": "lib", "has_base": True, "paths": {"~/*": ["*"]}}, [])
    put("tsconfig.json", '{"extends": "./config/only.json"}')
    put("config/only.json", '{"extends": "../tsconfig.json", "compilerOptions": {"paths": {"#/*": ["./src/*"]}}}')
    found, said = aliases_of(str(tmp_path))
    assert found == {"base": "config", "has_base": False, "paths": {"#/*": ["./src/*"]}} and len(said) == 1
    assert "config/src/x.ts" in candidates("#/x", "a.ts", found)
    put("tsconfig.json", '{"extends": "./none"}')
    assert aliases_of(str(tmp_path))[1]


def test_patterns_of_the_environment(spark, monkeypatch):
    assert S.patterns_of('["*.test.ts","__tests__/**"]') == ("*.test.ts", "__tests__/**") == S.patterns_of("*.test.ts, __tests__/**")
    assert S.patterns_of("") == () == S.patterns_of("[]")
    monkeypatch.setenv("TEST_PATTERNS", '["checks/**"]')
    rows = spark.createDataFrame([("checks/a.ts",), ("a.test.ts",)], "path string")
    assert {r["path"]: r["is_test"] for r in S.split_tests(rows).collect()} == {"checks/a.ts": True, "a.test.ts": False}


def test_texts_are_dealt_to_tasks(spark, sf_dir, monkeypatch):
    """Texts made from a short table are parsed by as many tasks as their number asks for, whatever the table's bytes."""
    from braidgraph import project
    from braidgraph.catalog import parsed
    from braidgraph.parse import analyze as A

    monkeypatch.setattr(A, "TEXTS_A_TASK", 10)
    n = project.table(spark, sf_dir, "part").count()
    assert A.parsed_files(parsed.sources(spark, sf_dir)).rdd.getNumPartitions() == -(-n // 10)
    seen = []
    real = A.parsed_files
    monkeypatch.setattr(A, "parsed_files", lambda files: seen.append(files.rdd.getNumPartitions()) or real(files))
    parsed.resolve_specifier(spark, sf_dir)
    assert seen == [-(-n // 10)]
