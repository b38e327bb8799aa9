"""Stored graphs, both JSON formats, versions and configuration."""

import json

import pytest

from braidgraph.model import graph_of
from braidgraph.sources import baseline as B
from braidgraph.sources import config
from braidgraph.versions import Migration, Migrations, Version, action, compatibility, on_failure


@pytest.fixture
def graph(spark):
    nodes = [
        {"type": "DIRECTORY", "path": "src"},
        {"type": "FILE", "path": "src/a.ts"},
        {"type": "FILE", "path": "src/b.ts"},
        {"type": "MODULE", "path": "src/a.ts", "name": "f", "metadata": {"kind": "function", "jsDoc": "x" * 150, "complexity": 2, "originalName": "g"}},
        {"type": "EXTERNAL", "path": "lodash"},
        {"type": "EXTERNAL", "path": "@s/p", "name": "@s/p"},
    ]
    edge = lambda a, b, t, **m: {"from": a, "to": b, "type": t, "metadata": m or None}
    edges = [
        edge("DIRECTORY:src", "FILE:src/a.ts", "CONTAINS"),
        edge("FILE:src/a.ts", "MODULE:src/a.ts#f", "EXPORTS"),
        edge("FILE:src/b.ts", "FILE:src/a.ts", "IMPORTS", line=3, importKind="value"),
        edge("FILE:src/b.ts", "FILE:src/a.ts", "IMPORTS", line=4),
        edge("FILE:src/b.ts", "EXTERNAL:lodash", "IMPORTS"),
        edge("FILE:src/b.ts", "EXTERNAL:@s/p", "IMPORTS"),
        edge("FILE:src/b.ts", "FILE:src/a.ts", "RE_EXPORTS", line=5),
    ]
    return graph_of(spark, nodes, edges, {"commitHash": "abcdef1", "timestamp": 5})


def _edges(g):
    return sorted((r["from"], r["to"], r["type"]) for r in g.edges.collect())


def test_parquet(spark, graph, tmp_path):
    where = f"file://{tmp_path}/store"
    B.save(graph, where)
    B.save(graph, where)
    back = B.load(spark, where)
    assert _edges(back) == _edges(graph) and back.nodes.exceptAll(graph.nodes).isEmpty() and back.meta == graph.meta == B.load_meta(spark, where)
    with pytest.raises(FileNotFoundError):
        B.load(spark, f"file://{tmp_path}/none")


def test_plain_json(spark, graph, tmp_path):
    path = str(tmp_path / "g.json")
    B.save_json(graph, path, compress=False, version_file=True)
    B.save_json(graph, path, compress=False, backup=True)
    assert (tmp_path / ".version").read_text() == "1.0.0" and (tmp_path / "g.json.bak").exists()
    back = B.load_json(spark, path)
    assert back["success"] and back["action"] == "proceed" and _edges(back["graph"]) == _edges(graph)
    assert "null" not in (tmp_path / "g.json").read_text()
    with pytest.raises(FileNotFoundError):
        B.save_json(graph, str(tmp_path / "no" / "g.json"))


def test_compressed_json(spark, graph, tmp_path):
    path = str(tmp_path / "g.json")
    B.save_json(graph, path)
    data = json.loads((tmp_path / "g.json").read_text())
    assert data["pathTable"][0] == "src/a.ts" and data["edges"][0]["type"] == "IMPORTS_BATCH"
    module = next(n for n in data["nodes"] if n["type"] == "MODULE")
    assert module["metadata"] == {"kind": "function", "jsDoc": "x" * 100 + "...", "jsDocTruncated": True, "hasJSDoc": True, "complexity": 2}
    back = B.load_json(spark, path)["graph"]
    # what the format loses: repeated imports, symbols at ends of edges, scoped packages
    assert _edges(back) == [
        ("DIRECTORY:src", "FILE:src/a.ts", "CONTAINS"),
        ("FILE:src/b.ts", "EXTERNAL:lodash", "IMPORTS"),
        ("FILE:src/b.ts", "FILE:@s/p", "IMPORTS"),
        ("FILE:src/b.ts", "FILE:src/a.ts", "IMPORTS"),
        ("FILE:src/b.ts", "FILE:src/a.ts", "RE_EXPORTS"),
        ("MODULE:src/a.ts", "FILE:src/a.ts", "EXPORTS"),
    ]
    assert {r["id"] for r in back.nodes.collect()} == {r["id"] for r in graph.nodes.collect()}


def test_json_meta(spark, graph, tmp_path):
    """The top level alone, whatever lies inside and in which order."""
    path = str(tmp_path / "g.json")
    for compress in (True, False):
        B.save_json(graph.with_(meta={"commitHash": 'c"\\{1', "timestamp": 7}), path, compress=compress)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        assert B.json_meta(path) == {k: data[k] for k in ("commitHash", "timestamp", "schemaVersion")}
    (tmp_path / "g.json").write_text('{"graph": {"a": [1, {"commitHash": "no"}], "b": "}]"}, "timestamp": 3}')
    assert B.json_meta(path) == {"timestamp": 3}


def test_migrate_file(spark, graph, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.json", "b.json", "c.json"))
    B.save_json(graph, a, compress=False)
    done = B.migrate_file(spark, a, b)
    assert done["stats"]["outputSizeBytes"] < done["stats"]["inputSizeBytes"] and done["stats"]["savingsPercent"] > 0
    B.migrate_file(spark, b, c)
    assert json.load(open(b)) == json.load(open(c))
    (tmp_path / "d.json").write_text('{"nodes": []}')
    with pytest.raises(B.CorruptedBaseline):
        B.migrate_file(spark, str(tmp_path / "d.json"), c)


def test_bad_documents(spark, tmp_path):
    def load(text, **options):
        (tmp_path / "x.json").write_text(text)
        r = B.load_json(spark, str(tmp_path / "x.json"), **options)
        return r.get("action") if r["success"] else r["failure"]["reason"]

    ok = {"schemaVersion": {"major": 1, "minor": 0, "patch": 0}, "graph": {"nodes": [], "edges": []}, "commitHash": "abcdef1", "timestamp": 1}
    rebuild = lambda: "graph"
    assert load(json.dumps(ok)) == "proceed"
    assert load("{") == "parse_error" and load("{", rebuild=rebuild) == "parse_error"
    assert load("[]") == "invalid_structure" and load("{}", rebuild=rebuild) == "rebuild" and load("{}", rebuild=rebuild, strict=True) == "invalid_structure"
    assert load(json.dumps(ok | {"schemaVersion": {"major": 2, "minor": 0, "patch": 0}})) == "schema_incompatible"
    bad = ok | {"graph": {"nodes": [["FILE:b", {"id": "FILE:a", "type": "FILE", "path": "a", "name": "a"}]], "edges": []}}
    assert load(json.dumps(bad)) == "corrupted_data" and load(json.dumps(bad), rebuild=rebuild) == "rebuild"
    legacy = {k: v for k, v in ok.items() if k != "schemaVersion"}
    assert load(json.dumps(legacy)) == "corrupted_data" and load(json.dumps(legacy), rebuild=rebuild) == "rebuild"
    small = {"schemaVersion": B.FORMAT_1_1, "pathTable": ["a"], "nodes": [{"type": "FILE", "pathIndex": 7, "name": "a"}], "edges": [], "commitHash": "", "timestamp": 1}
    assert load(json.dumps(small)) == "corrupted_data"
    assert B.load_json(spark, str(tmp_path / "none.json"))["failure"]["reason"] == "file_not_found"
    assert B.structure_errors({"pathTable": [1], "nodes": [{"type": "X"}], "edges": [{"type": "IMPORTS_BATCH"}, {"type": "?"}, {"type": "IMPORTS"}], "commitHash": 1, "timestamp": "x"}).__len__() == 8


def test_versions():
    v = Version.parse("1.2.3")
    assert str(v) == "1.2.3" and Version(1, 10, 0) > v and v.fits("1.x.x") and v.fits("1.2") and not v.fits("2.x") and Version(0, 0, 0).fits("legacy")
    for bad in ("1.2", "a.b.c", "-1.0.0", ""):
        with pytest.raises(ValueError):
            Version.parse(bad)
    of = lambda *p: dict(zip(("major", "minor", "patch"), p, strict=True))
    reasons = [compatibility(g, (1, 1, 1))["reason"] for g in (None, of(2, 0, 0), of(0, 9, 0), of(1, 0, 9), of(1, 1, 0), of(1, 1, 1), of(1, 9, 1))]
    assert reasons == ["legacy_baseline", "major_version_mismatch", "major_version_mismatch", "minor_version_old", "patch_version_old", "version_match", "version_match"]
    assert action(compatibility(of(1, 0, 0), (1, 1, 0))) == "proceed" and action(compatibility(of(1, 0, 0), (1, 1, 0)), auto_migrate=True) == "migrate" and action({}, "rebuild") == "rebuild"
    m = Migrations()
    m.register(Migration("1.0.x", Version(1, 1, 0), lambda d: d | {"a": 1}))
    m.register(Migration("1.1.x", Version(2, 0, 0), lambda d: d | {"b": 2}))
    assert len(m.path(Version(1, 0, 5), Version(2, 0, 0))) == 2 and m.path(v, v) is None and m.path(Version(3, 0, 0), v) is None
    out = m.migrate({"schemaVersion": of(1, 0, 0)}, Version(2, 0, 0))
    assert (out["a"], out["b"], len(out["migrationHistory"])) == (1, 2, 2) and all(h["strategy"] == "migrate" and h["migratedAt"] > 0 for h in out["migrationHistory"]) and out["schemaVersion"] == of(2, 0, 0)
    assert m.migrate_or_rebuild({}, lambda: "new", Version(9, 0, 0)) == "new"
    assert on_failure("file_not_found")["failure"]["details"] == "Rebuild handler not provided" and on_failure("parse_error", lambda: 1)["success"] is False
    assert on_failure("schema_incompatible", lambda: 1, force="rebuild")["success"] and on_failure("x", handler=lambda r, d: r) == "x"


def test_config(tmp_path):
    assert config.load(str(tmp_path))["compression"] == {"enabled": True, "jsDocMaxLength": 100}
    (tmp_path / config.FOLDER).mkdir()
    file = tmp_path / config.FOLDER / config.NAME
    file.write_text(json.dumps({"compression": {"jsDocMaxLength": 7}, "layerNaming": {"rules": [{"pattern": "^x$", "role": "X", "priority": 3}, {"pattern": "(", "role": "", "priority": 300}]}}))
    got = config.load(str(tmp_path))
    assert got["compression"] == {"enabled": True, "jsDocMaxLength": 7} and got["rules"][-1] == ("^x$", "X", 3) and len(got["warnings"]) == 1
    for bad in ("{", '{"compression": 3}', '{"compression": {"enabled": 1}}', '{"compression": {"jsDocMaxLength": 0}}', "[]"):
        file.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(tmp_path))
    assert config.naming_rules("x")[1] and len(config.rule_errors(3)) == 1


def test_long_documents(spark, graph, tmp_path, monkeypatch):
    """Documents that tasks read, in pieces of any length and however they are laid out, give what the driver makes of them."""
    from braidgraph.sources import document as D

    odd = graph_of(spark, [{"type": "FILE", "path": 'src/\\"],[{\n\u00e9\U0001f600.ts'}, {"type": "FILE", "path": "src/" + "\\" * 9}], [{"from": "a]", "to": 'b"', "type": "IMPORTS"}], {})
    both = graph.with_(nodes=graph.nodes.unionByName(odd.nodes), edges=graph.edges.unionByName(odd.edges))
    rows = lambda g: sorted(map(str, (*g.nodes.collect(), *g.edges.collect())))
    real = D.split
    for compress in (False, True):
        path = str(tmp_path / f"{compress}.json")
        B.save_json(both, path, compress=compress)
        data = json.loads((tmp_path / f"{compress}.json").read_text())
        want = rows(B.from_json(spark, data))
        for indent, piece in ((None, 7), (2, 64), (2, 1 << 20)):
            (tmp_path / "x.json").write_text(json.dumps(data, indent=indent, ensure_ascii=indent is None))
            monkeypatch.setattr(D, "split", lambda s, p, piece=piece: real(s, p, piece))
            got = B.load_json(spark, str(tmp_path / "x.json"), small=0, check_integrity=False)
            assert got["success"] and rows(got["graph"]) == want
        assert B.migrate_file(spark, path, str(tmp_path / "m.json"), small=0)["stats"] == B.migrate_file(spark, path, str(tmp_path / "n.json"))["stats"]
        assert (tmp_path / "m.json").read_text() == (tmp_path / "n.json").read_text()
    ok = json.loads((tmp_path / "False.json").read_text())
    for text, reason in (
        (json.dumps(ok)[:-40], "parse_error"),
        (json.dumps(ok).replace('"type"', '"type', 1), "parse_error"),
        (json.dumps(ok).replace("]]", "],]").replace("}], ", "},], "), "parse_error"),
        (json.dumps(ok).replace('"src/a.ts"', "5"), "corrupted_data"),
        (json.dumps(data).replace('"pathIndex": 0', '"pathIndex": null'), "invalid_structure"),
        (json.dumps(data).replace('"pathIndex": 0', '"pathIndex": 900'), "corrupted_data"),
        ('{"graph": {"nodes": [], "edges": 3}, "commitHash": "", "timestamp": 0}', "invalid_structure"),
    ):
        (tmp_path / "x.json").write_text(text)
        assert B.load_json(spark, str(tmp_path / "x.json"), small=0)["failure"]["reason"] == reason


def test_migrate_long(spark, graph, tmp_path, monkeypatch):
    """No long document is read whole, neither to migrate it nor to load what comes of it."""
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    B.save_json(graph, a, compress=False)
    B.migrate_file(spark, a, b)
    want = _edges(B.load_json(spark, b)["graph"])
    monkeypatch.setattr(B.json, "load", lambda f: pytest.fail("read whole"))
    assert B.migrate_file(spark, a, b, small=0)["stats"]["pathTableEntries"] == 5
    assert _edges(B.load_json(spark, b, small=0)["graph"]) == want


def test_nothing_large_is_broadcast(spark, graph, sf_dir, tmp_path):
    """No join that makes a graph, checks it, compresses it or restores it sends a table of paths through the driver, however short it is."""
    from braidgraph import project
    from braidgraph.operators import codec, quality
    from braidgraph.plans.durable import written

    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    B.save_json(graph, a, compress=False)
    B.migrate_file(spark, a, b, small=0)
    got = B.load_json(spark, b, small=0)["graph"]
    whole = project.repo_graph(spark, sf_dir)
    paths = written(codec.path_table(graph), "paths")
    made = [codec.compressed_nodes(graph, paths), codec.compressed_edges(graph, paths), codec.import_batches(graph, paths)]
    for table in (got.nodes, got.edges, whole.nodes, whole.edges, quality.dangling_edges(graph), *made):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "CartesianProduct" not in plan
