"""Changes in batch, by stream and through the command line."""

import json
import random
import subprocess

import pytest

from braidgraph import cli
from braidgraph.model import graph_of
from braidgraph.operators import changes as X
from braidgraph.streaming import changes as stream


def _fold(types):
    state = ""
    for t in types:
        state = "" if (state, t) == ("ADD", "DELETE") else "MODIFY" if (state, t) == ("DELETE", "ADD") else t
    return state


@pytest.mark.parametrize("newest_first", [False, True])
def test_coalesced(spark, newest_first):
    rng = random.Random(3)
    rows = [(f"p{i}", s, rng.choice(["ADD", "MODIFY", "DELETE", "ADD", "DELETE"])) for i in range(60) for s in range(rng.randrange(1, 9))]
    want = {p: _fold([t for q, _, t in sorted(rows, reverse=newest_first) if q == p]) for p in {r[0] for r in rows}}
    got = {r["path"]: r["type"] for r in X.coalesced(spark.createDataFrame(rows, "path string, seq long, type string"), newest_first).collect()}
    assert got == {p: t for p, t in want.items() if t}


def test_tree_diff(spark):
    rows = lambda d: spark.createDataFrame(list(d.items()), "path string, oid string")
    got = {r["path"]: r["type"] for r in X.tree_diff(rows({"a.ts": "1", "b.ts": "1", "c.ts": "1", "x.md": "1"}), rows({"b.ts": "1", "c.ts": "2", "d.ts": "1", "x.md": "2"})).collect()}
    assert got == {"a.ts": "DELETE", "c.ts": "MODIFY", "d.ts": "ADD"}


def test_applied(spark):
    def graph(files, edges, packages=()):
        nodes = [{"type": "DIRECTORY", "path": "."}] + [{"type": "FILE", "path": f} for f in files] + [{"type": "MODULE", "path": f, "name": "m"} for f in files] + [{"type": "EXTERNAL", "path": p} for p in packages]
        rows = [{"from": f"FILE:{f}", "to": f"MODULE:{f}#m", "type": "EXPORTS"} for f in files] + [{"from": f"FILE:{a}", "to": b, "type": "IMPORTS"} for a, b in edges]
        return graph_of(spark, nodes, rows)

    old = graph(["a.ts", "b.ts", "c.ts"], [("a.ts", "FILE:b.ts"), ("c.ts", "FILE:b.ts")])
    new = graph(["a.ts", "b.ts", "d.ts"], [("a.ts", "FILE:b.ts"), ("d.ts", "FILE:a.ts"), ("d.ts", "EXTERNAL:p")], ["p"])
    todo = spark.createDataFrame([("c.ts", "DELETE"), ("b.ts", "MODIFY"), ("d.ts", "ADD")], "path string, type string")
    got = X.applied(old, new, todo)
    key = lambda g: (sorted(r["id"] for r in g.nodes.collect()), sorted((r["from"], r["to"], r["type"]) for r in g.edges.collect()))
    assert key(got) == key(new)
    assert "EXTERNAL:p" not in key(X.applied(old, new, todo, new_parents=False))[0]
    assert {r["id"]: r["change"] for r in X.delta(old, new).collect()} == {"FILE:c.ts": "REMOVED", "MODULE:c.ts#m": "REMOVED", "FILE:d.ts": "ADDED", "MODULE:d.ts#m": "ADDED", "EXTERNAL:p": "ADDED"}


def test_stream(spark, tmp_path):
    source, got = str(tmp_path / "in"), {}
    for i, rows in enumerate([[("a", 1, "ADD"), ("a", 2, "DELETE"), ("b", 3, "ADD")], [("b", 4, "MODIFY")]]):
        spark.createDataFrame(rows, "path string, seq long, type string").selectExpr("*", "timestamp '2024-01-01 00:00:00' at").coalesce(1).write.mode("append" if i else "overwrite").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        query = stream.apply_stream(stream.change_stream(spark, source, 1), lambda df, batch: got.update({(batch, r["path"]): r["type"] for r in df.collect()}), str(tmp_path / "check"))
        query.awaitTermination()
    assert sorted(got.values()) in (["ADD", "MODIFY"], ["MODIFY"])
    rates = stream.change_rates(stream.change_stream(spark, source)).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    rates.awaitTermination()
    assert sum(r["n"] for r in spark.sql("select n from rates").collect()) == 4


@pytest.fixture
def repo(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "src/util").mkdir(parents=True)
    (tmp_path / "src/index.ts").write_text("import { a } from './util/a'\nexport const main = a")
    (tmp_path / "src/util/a.ts").write_text("export const a = 1")
    git("add", "-A")
    git("commit", "-qm", "one")
    return tmp_path, git


def test_command_line(spark, repo):
    root, git = repo
    run = lambda *a: cli.run([a[0], "--json", "--root", str(root), *a[1:]], spark)
    code, out, _ = run("scope", "src/index.ts")
    assert code == 1 and json.loads(out)["error"]["code"] == "E_BASELINE_NOT_FOUND"
    code, out, said = run("analyze")
    assert code == 0, said
    assert json.loads(out)["stats"]["edgesCreated"]["imports"] == 1
    assert json.loads(run("scope", "src/index.ts")[1])["imports"][0]["from"] == "src/util/a.ts"
    assert json.loads(run("impact", "src/util/a.ts")[1])["summary"]["total"] == 1
    assert json.loads(run("layers")[1])["healthScore"] == 100
    assert json.loads(run("brief", "src/util/a.ts")[1])["importedBy"] == 1
    assert json.loads(run("impact", "src/none.ts")[1])["error"]["code"] == "E001_TARGET_NOT_FOUND"
    (root / "src/b.ts").write_text("import { a } from './util/a'\nexport const b = a")
    git("add", "-A")
    git("commit", "-qm", "two")
    out = json.loads(run("update")[1])
    assert out["changes"] == {"added": ["src/b.ts"], "removed": [], "modified": []} and out["delta"]["newNodes"] == 2
    assert json.loads(run("impact", "src/util/a.ts")[1])["summary"]["total"] == 2
    assert json.loads(run("update")[1])["changes"]["added"] == []
    for text in ("scope", "layers", "impact"):
        code, out, _ = cli.run([text, "--root", str(root), *([] if text == "layers" else ["src/util/a.ts"])], spark)
        assert code == 0 and "Duration:" in out


def test_update_parses_what_changes_touch(spark, repo):
    """After changes of all kinds the stored graph is that of a new analysis, though only some files were parsed."""
    root, git = repo
    run = lambda *a: json.loads(cli.run([a[0], "--json", "--root", str(root), *a[1:]], spark)[1])
    for name, text in {"c": "import { z } from './late'\nexport const c = z", "d": "import { c } from './c'\nexport const d = c", "old": "export const old = 1", "far": "export const far = 1"}.items():
        (root / f"src/{name}.ts").write_text(text)
    git("add", "-A")
    git("commit", "-qm", "more")
    assert run("analyze")["success"]
    (root / "src/late.ts").write_text("export const z = 1")
    (root / "src/util/a.ts").write_text("import { far } from '../far'\nexport const a = far")
    (root / "src/old.ts").unlink()
    git("add", "-A")
    git("commit", "-qm", "changes")
    from braidgraph.sources import baseline
    from braidgraph.sources.scan import listing

    before = cli._graph(spark, str(root))
    diff = spark.createDataFrame([("src/late.ts", "ADD"), ("src/util/a.ts", "MODIFY"), ("src/old.ts", "DELETE")], "path string, type string")
    assert {r["path"] for r in cli.to_parse(before, diff).collect()} == {"src/late.ts", "src/util/a.ts", "src/index.ts", "src/c.ts"}
    out = run("update")
    assert out["changes"] == {"added": ["src/late.ts"], "removed": ["src/old.ts"], "modified": ["src/util/a.ts"]}
    now = {(r["from"], r["to"]) for r in baseline.load(spark, cli._store(str(root))).linked("IMPORTS").collect()}
    assert {("FILE:src/index.ts", "FILE:src/util/a.ts"), ("FILE:src/util/a.ts", "FILE:src/far.ts"), ("FILE:src/c.ts", "FILE:src/late.ts"), ("FILE:src/d.ts", "FILE:src/c.ts")} <= now
    assert listing(spark, str(root), (".git/", ".braidgraph/")).count() == 6


def test_special_projects_and_hints(spark, tmp_path):
    def project(name, **files):
        root = tmp_path / name
        for path, text in files.items():
            (root / path.replace("__", "/")).with_suffix("").parent.mkdir(parents=True, exist_ok=True)
            (root / f"{path.replace('__', '/')}.ts").write_text(text)
        subprocess.run(["git", "-C", str(root), "init", "-q"], check=True)
        return str(root)

    run = lambda root, *a: (lambda r: (r[0], json.loads(r[1])))(cli.run([a[0], "--json", "--root", root, *a[1:]], spark))
    alone = project("alone", src__a="import _ from 'lodash'\nexport const a = 1")
    code, out = run(alone, "analyze")
    assert code == 0 and out["kind"] == "single-file" and out["file"] == "src/a.ts" and out["externalDeps"] == ["lodash"] and not out["reclassified"]
    more = project("more", src__a="import './b.d'\nexport const a = 1", tests__b="export const b = 1")
    (tmp_path / "more/src/b.d.json").write_text("{}")
    code, out = run(more, "analyze")
    assert code == 0 and out["kind"] == "normal" and out["reclassified"]
    tests = project("tests-only", tests__a="export const a = 1")
    code, out = run(tests, "analyze")
    assert code == 0 and out["kind"] == "test-only" and out["warnings"]
    (tmp_path / "alone/packages").mkdir()
    assert "packages/<package>" in run(alone, "scope", "src/none.ts")[1]["error"]["suggestion"]
    assert "packages/<package>" not in run(alone, "scope", "packages/x/src/none.ts")[1]["error"]["suggestion"]
    error = json.loads(cli.run(["layers", "--json", "--thres"], spark)[1])["error"]
    assert error["code"] in ("E_CLI_UNKNOWN_FLAG", "E_CLI_INTERNAL")
    error = json.loads(cli.run(["scope", "a", "--json", "--verb"], spark)[1])["error"]
    assert error == {"code": "E_CLI_UNKNOWN_FLAG", "message": "Unknown flag: --verb", "suggestion": "Did you mean '--verbose'?"}
    assert cli.similar_flag("--de", ["--depth", "--json"]) == "--depth" and cli.similar_flag("--", ["--json"]) is None and cli.similar_flag("--x", ["--json"]) is None
    (tmp_path / "one").symlink_to(tmp_path / "two")
    (tmp_path / "two").symlink_to(tmp_path / "one")
    assert "circle" in run(str(tmp_path / "one"), "layers")[1]["error"]["message"]
    assert run(str(tmp_path / "nowhere"), "layers")[1]["error"]["code"] == "E_INVALID_PATH"


def test_log_where_the_commit_is_gone(spark, repo):
    from braidgraph.sources import gitlog

    root, git = repo
    (root / "src/b.ts").write_text("x")
    git("add", "-A")
    git("commit", "-qm", "two")
    got = {r["path"]: r["type"] for r in gitlog.changes(spark, str(root), "0" * 40).collect()}
    assert got == {"src/index.ts": "ADD", "src/util/a.ts": "ADD", "src/b.ts": "ADD"}
    with pytest.raises(gitlog.GitError):
        gitlog.changes(spark, str(root), None)


def test_command_errors(tmp_path):
    assert cli.similar_command("anal") == "analyze" and cli.similar_command("zzz") is None
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "package.json").write_text("{}")
    assert cli.find_root(str(tmp_path / "a/b")) == str(tmp_path.resolve()) and cli.marker_in(str(tmp_path)) == "package.json"
    code, _, said = cli.run(["scope"])
    assert code == 1 and "E_CLI_MISSING_ARG" in said[0]


def test_co_changes_by_tasks(spark, monkeypatch):
    """As many tasks as the pairs ask for, and the same counts."""
    from itertools import combinations

    from braidgraph.operators import changes as X

    commits = {c: [f"p{i}" for i in range(c % 7 + 1)] for c in range(40)}
    df = spark.createDataFrame([(c, p) for c, ps in commits.items() for p in ps], "commit long, path string")
    want = {}
    for ps in commits.values():
        for pair in combinations(sorted(ps), 2):
            want[pair] = want.get(pair, 0) + 1
    made = sum(len(ps) * (len(ps) - 1) // 2 for ps in commits.values())
    for each in (10, 1_000_000):
        monkeypatch.setattr(X, "PAIRS_A_TASK", each)
        got = X.co_changes(df)
        assert "RepartitionByExpression" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and f"], {-(-made // each)}" in plan
        assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == want
