"""Scope, impact, layers and base-table operators on small graphs."""

import random

import pytest

from braidgraph.model import QueryError, graph_of
from braidgraph.operators import graph as G
from braidgraph.operators import impact as I
from braidgraph.operators import layers as L
from braidgraph.operators import quality
from braidgraph.operators import scope as Q
from braidgraph.plans.fixpoint import components, reach
from braidgraph.render import impact_markdown, layers_markdown, scope_markdown


def files(*paths):
    return [{"type": "FILE", "path": p} for p in paths]


def imports(pairs, kind="IMPORTS", **meta):
    return [{"from": f"FILE:{a}", "to": f"FILE:{b}", "type": kind, "metadata": meta or None} for a, b in pairs]


@pytest.fixture(scope="module")
def chain(spark):
    """A utility imported by services and pages, with a test and a dynamic importer."""
    u, a, p, m = "src/utils/format.ts", "src/services/auth.ts", "src/services/api.ts", "src/components/Modal.tsx"
    test, dyn = "src/__tests__/format.test.ts", "src/dynamic.ts"
    nodes = files(u, a, p, m, "src/pages/Home.tsx", "src/pages/Dashboard.tsx", "src/pages/Login.tsx", "src/index.ts", test, dyn, "src/types/api.ts")
    nodes.append({"type": "MODULE", "path": u, "name": "format", "metadata": {"kind": "function", "complexity": 7, "jsDoc": "Formats.", "deprecated": True, "changeFrequency": 3, "lastModifiedCommit": "abc"}})
    nodes.append({"type": "EXTERNAL", "path": "lodash", "name": "lodash"})
    edges = imports([(a, u), (p, u), (m, u), (test, u), ("src/pages/Home.tsx", a), ("src/pages/Home.tsx", m), ("src/pages/Dashboard.tsx", p), ("src/pages/Login.tsx", a), ("src/index.ts", "src/pages/Home.tsx")])
    edges += imports([(dyn, u)], "DYNAMIC_IMPORTS") + imports([(p, "src/types/api.ts")], "RE_EXPORTS")
    edges.append({"from": f"FILE:{u}", "to": "EXTERNAL:lodash", "type": "IMPORTS", "metadata": {"importKind": "type-only"}})
    return graph_of(spark, nodes, [e | {"edge_seq": i} for i, e in enumerate(edges)])


def test_impact(chain):
    r = I.get_impact(chain, ["FILE:src/utils/format.ts"])
    assert r["summary"] == {"direct": 3, "indirect": 4, "total": 7} and r["blastRadius"] == "medium" and not r["truncated"]
    by = {f["path"]: (f["distance"], f["via"]) for f in r["affectedFiles"]}
    assert by["src/pages/Home.tsx"] == (2, ["src/components/Modal.tsx", "src/services/auth.ts"])
    assert by["src/index.ts"] == (3, ["src/pages/Home.tsx"]) and "src/dynamic.ts" not in by
    assert "### Direct Dependents (3 files)" in impact_markdown(r)
    assert r["nextSuggested"][0] == f"braidgraph scope FILE:{r['affectedFiles'][0]['path']}"


def test_impact_options(chain):
    target = "src/utils/format.ts"
    assert I.get_impact(chain, [target], max_depth=0)["summary"]["total"] == 3
    assert "src/__tests__/format.test.ts" in {f["path"] for f in I.get_impact(chain, [target], include_tests=True)["affectedFiles"]}
    assert I.get_impact(chain, ["MODULE:src/services/auth.ts#x"])["summary"]["total"] == 3
    few = I.get_impact(chain, [target], max_files=2)
    assert few["truncated"] and len(few["affectedFiles"]) == 2 and few["summary"]["total"] == 7
    both = I.get_impact(chain, [target, "src/services/auth.ts"])
    assert {f["path"]: f["distance"] for f in both["affectedFiles"]}["src/pages/Home.tsx"] == 1
    assert I.get_impact(chain, [])["summary"]["total"] == 0
    for bad in (["FILE:nowhere.ts"], ["EXTERNAL:lodash"]):
        with pytest.raises(QueryError) as e:
            I.get_impact(chain, bad)
        assert e.value.code == "E001_TARGET_NOT_FOUND"
    assert I.get_impact(chain, ["src/index.ts"])["warnings"]


def _walk(edges, target, depth):
    seen, level = {}, {target}
    for d in range(1, depth + 1):
        new = {}
        for a, b in edges:
            if b in level and a not in seen:
                new.setdefault(a, set()).add(b)
        for a, via in new.items():
            seen[a] = (d, sorted(via))
        level = set(new)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_both_ways(spark, seed):
    """The walk in the driver and the one over tables agree with a plain walk, cycles, self-loops and repeats included."""
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)]
    edges += edges[:5]
    rows, targets = spark.createDataFrame(edges, "`from` string, `to` string"), spark.createDataFrame([("n1",), ("n2",), ("zz",)], "target string")
    want = {(t, a): v for t in ("n1", "n2", "zz") for a, v in _walk(edges, t, 4).items()}
    for limit in (0, 1000):
        got = {(r["target"], r["id"]): (r["distance"], r["via"]) for r in reach(rows, targets, 4, limit).collect()}
        assert got == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"v{rng.randrange(60):02}", f"v{rng.randrange(60):02}") for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "`from` string, `to` string")).collect()}
    assert all(find(n) == c for n, c in got.items())
    assert {n for n in parent if find(n) != n} <= set(got)


def test_scope(chain):
    r = Q.get_scope(chain, "src/utils/format.ts")
    assert [e["name"] for e in r["exports"]] == ["format"]
    assert r["imports"] == [{"from": "lodash", "specifiers": [], "type": "static", "kind": "value"}]
    assert [i["file"] for i in r["importedBy"]] == ["src/__tests__/format.test.ts", "src/components/Modal.tsx", "src/services/api.ts", "src/services/auth.ts"]
    assert r["complexity"] == {"level": "medium", "value": 7} and r["metadata"] == {"hasTest": False, "deprecated": True}
    assert r["lastModified"] == {"commit": "abc", "relativeTime": "3 commits in last 30 days"}
    assert "- Deprecated: yes (WARNING)" in scope_markdown(r)
    m = Q.get_scope(chain, "MODULE:src/utils/format.ts#format")
    assert m["complexity"]["value"] == 7 and "Formats...." in scope_markdown(m)
    x = Q.get_scope(chain, "EXTERNAL:lodash")
    assert [i["file"] for i in x["importedBy"]] == ["src/utils/format.ts"] and "External package" in scope_markdown(x)
    assert Q.get_scope(chain, "src/utils/format.ts", compat=True)["testFile"] == "src/utils/format.ts"
    for bad in ("FILE:none.ts", "MODULE:src/utils/format.ts#none", "none"):
        with pytest.raises(QueryError):
            Q.get_scope(chain, bad)
    with pytest.raises(ValueError):
        Q.get_scope(chain, "  ")


def test_brief(chain):
    r = Q.get_brief(chain, "src/utils/format.ts")
    assert (r["imports"], r["importedBy"], r["hasTest"], r["deprecated"], r["complexityLevel"]) == (1, 4, False, True, "medium")
    with pytest.raises(QueryError):
        Q.get_brief(chain, "none.ts")


@pytest.fixture(scope="module")
def layered(spark):
    """utils is imported by services, services by pages; utils reaches up to pages once."""
    names = [f"src/utils/{c}.ts" for c in "ab"] + [f"src/services/{c}.ts" for c in "cd"] + [f"src/pages/{c}.ts" for c in "efg"] + ["src/main.ts"]
    u, s, p = names[:2], names[2:4], names[4:7]
    pairs = [(a, b) for a in s for b in u] + [(a, b) for a in p for b in s] + [(p[0], u[0]), (u[0], p[0]), (names[7], p[1])]
    return graph_of(spark, files(*names), imports(pairs))


def test_layers(layered):
    r = L.get_layers(layered)
    nets = {g["name"]: g["netScore"] for g in r["groups"]}
    assert nets == {"utils": 4, "services": 2, "__root__": -1, "pages": -5}
    assert {g["name"]: g["assignedLayer"] for g in r["groups"]} == {"utils": 1, "services": 1, "__root__": 2, "pages": 3}
    assert [layer["role"] for layer in r["layers"]] == ["Foundation", "Core", "Application"]
    assert {(v["fromGroup"], v["toGroup"], v["layerGap"], v["severity"]) for v in r["violations"]} == {("utils", "pages", 2, "moderate"), ("__root__", "pages", 1, "minor")}
    assert r["healthScore"] == 85 and r["violations"][0]["affectedFiles"] == [{"from": "src/utils/a.ts", "to": "src/pages/e.ts"}]
    text = layers_markdown(r)
    assert "## Layer Health Score: 85/100" in text and "### Layer 1 (Foundation)" in text
    flat = L.get_layers(layered, threshold=100)
    assert len(flat["layers"]) == 1 and not flat["violations"] and flat["warnings"]
    with pytest.raises(QueryError):
        L.get_layers(graph_of(layered.spark, [{"type": "EXTERNAL", "path": "x"}], []))


def test_layer_parts(spark, layered):
    assert L.threshold_for(50) == 5 and L.threshold_for(51) == 3 and L.threshold_for(201) == 2 and L.threshold_for(501) == 1
    assert L.find_cycles([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b")], ["c", "b", "a"]) == [["b", "c"], ["a", "b", "c"]] or L.find_cycles([("a", "b"), ("b", "a")], ["b", "a"]) == [["a", "b"]]
    assert L.normal_cycle(["c", "a", "b"]) == ["a", "b", "c"] and [L.cycle_penalty(["x"] * n) for n in (0, 1, 2, 3, 4, 5)] == [0, 1, 1, 2, 2, 3]
    assert L.confidence_of(30, 0, 0, 0) == 100 and L.confidence_of(0, 50, 9, 0) == 0
    assert [L.root_confidence(s) for s in (-1, 0, 3, 8, 15, 25)] == [0, 0, 0.3, 0.5, 0.7, 0.9]
    assert L.root_score("src", {"package.json", "tsconfig.json"}) == 33 and L.root_score("dist", set()) == float("-inf") and L.root_score("x", None) == 0
    rows = spark.createDataFrame([(5, "services", 1), (5, "zz", 2), (6, "misc", 0), (1, "api", 9)], "layer int, group string, net_score int")
    named = {r["layer"]: (r["role"], r["naming_confidence"]) for r in L.layer_roles(rows).collect()}
    assert named == {5: ("Service Layer", 100), 6: ("Layer 6", 0), 1: ("Foundation", None)}
    deps = {r["group"]: r["cycle_penalty"] for r in L.dependency_scores(layered).collect()}
    assert deps["utils"] >= 1 and deps["__root__"] == 0
    assert {x["type"] for x in L.suggestions(10, 0, [["a", "b"]], 3, 6)} == {"config", "manual-review", "structure"} and L.suggestions(50, 0, [], 9, 9) == []


def test_base_tables(spark, chain):
    gone = G.remove_files(chain, spark.createDataFrame([("src/utils/format.ts",)], "path string"))
    assert gone.nodes.count() == chain.nodes.count() - 2 and gone.edges.where("`to` = 'FILE:src/utils/format.ts'").count() == 0
    again = G.upsert_nodes(chain, chain.of_type("EXTERNAL"), keep_edges=False)
    assert again.nodes.count() == chain.nodes.count() and again.edges.where("`to` like 'EXTERNAL:%'").count() == 0
    first = chain.edges.first().asDict()
    assert G.remove_edge(chain, first).edges.count() == chain.edges.count() - 1
    bare = G.remove_file_edges(chain, spark.createDataFrame([("src/index.ts",)], "path string"))
    assert bare.nodes.count() == chain.nodes.count() and bare.edges.count() == chain.edges.count() - 1
    fresh = graph_of(spark, [{"type": "EXTERNAL", "path": "lodash"}], [{"from": "FILE:src/index.ts", "to": "EXTERNAL:lodash", "type": "IMPORTS"}])
    assert G.merge_parsed(chain, fresh).edges.where("`to` = 'EXTERNAL:lodash'").count() == 2
    assert G.merge_parsed(chain, fresh, last_file_wins=True).edges.where("`to` = 'EXTERNAL:lodash'").count() == 1


def test_integrity(spark, chain):
    assert quality.verify(chain.with_(meta={"commitHash": "abcdef1", "timestamp": 5}))["valid"]
    bad = graph_of(spark, [*files("a.ts", "a.ts"), {"id": "FILE:x", "type": "FILE", "path": "y"}], imports([("a.ts", "gone.ts")]), {"commitHash": "XYZ", "timestamp": 10**15})
    r = quality.verify(bad)
    assert not r["valid"] and len(r["errors"]) == 2
    assert r["counts"] == {"duplicate_nodes": 1, "mismatched_ids": 1, "dangling_edges": 1, "invalid_nodes": 0, "invalid_edges": 0}


def test_strong_components(spark):
    """Against a closure in plain Python, on random graphs, chains into circles and self loops."""
    import random

    from braidgraph.plans.fixpoint import reach, reach_counts, strong_components

    rng = random.Random(8)
    for edges in ([(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(22)], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), (None, "q")], []):
        out = {}
        for a, b in edges:
            if a and b:
                out.setdefault(a, set()).add(b)
        nodes = sorted(set(out) | {b for bs in out.values() for b in bs})

        def from_(a, depth=99):
            seen, level = set(), {a}
            for _ in range(depth):
                level = {y for x in level for y in out.get(x, ())} - seen
                seen |= level
            return seen

        far = {a: from_(a) | {a} for a in nodes}
        df = spark.createDataFrame(edges, "from string, to string")
        got = {r["node"]: r["scc"] for r in strong_components(df).collect()}
        assert got == {a: min(b for b in nodes if b in far[a] and a in far[b]) for a in nodes}
        targets = spark.createDataFrame([(a,) for a in [*nodes[:5], "nobody"]], "target string")
        counts = {r["target"]: r["n"] for r in reach_counts(df, targets, 3).collect()}
        back = {a: sum(a in from_(b, 3) for b in nodes) for a in nodes[:5]}
        assert counts == {a: n for a, n in back.items() if n}
        assert counts == {r["target"]: r["n"] for r in reach(df, targets, 3, 0).groupBy("target").count().withColumnRenamed("count", "n").collect()}


def test_walks_over_arrays(spark):
    """Walks over arrays of numbers give what joins give, and need no table of pairs."""
    import random

    from braidgraph.plans import fixpoint as P

    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(90):02}", f"n{rnd.randrange(90):02}") for _ in range(130)] + [("x", "x"), ("y", "z"), (None, "y"), ("y", "z")]
    df = spark.createDataFrame(pairs, "from string, to string")
    targets = spark.createDataFrame([(f"n{i:02}",) for i in range(90)] + [("x",), ("z",), ("none",), ("z",)], "target string")
    for depth in (1, 3, 200):
        assert sorted(P.reach_counts(df, targets, depth).collect()) == sorted(P.reach_counts(df, targets, depth, array_edges=0).collect())
    assert sorted(P.strong_components(df).collect()) == sorted(P.strong_components(df, array_edges=0).collect())
    written = []
    real, P.written = P.written, lambda table, tag: written.append(tag) or real(table, tag)
    try:
        P.reach_counts(df, targets, 3).collect(), P.strong_components(df).collect()
    finally:
        P.written = real
    assert set(written) == {"names", "edges"}
    # one circle through all nodes, walked without recursion; many lanes and few give the same
    import numpy as np

    starts, near = np.arange(5001, dtype=np.int32), ((np.arange(5000) + 1) % 5000).astype(np.int32)
    assert set(P._circles(starts, near)) == {0} and set(P._walked(starts, near, np.arange(5000), 7)) == {7}


def test_circles_with_many_names(spark, monkeypatch):
    """Names of components come by a broadcast or, where they are many, by a join."""
    from braidgraph.plans import fixpoint as P

    df = spark.createDataFrame([(f"n{i:03}", f"n{i // 3 * 3 + (i + 1) % 3:03}") for i in range(60)], "from string, to string")
    want = sorted((f"n{i:03}", f"n{i // 3 * 3:03}") for i in range(60))
    for named in (100_000, 0):
        monkeypatch.setattr(P, "NAMED", named)
        assert sorted(tuple(r) for r in P.strong_components(df).collect()) == want
    assert P.strong_components(df.limit(0)).collect() == []


def test_paths_are_counted_once(spark, sf_dir):
    """The path table is written in its order: no window over a part of it, no count again for each join."""
    from braidgraph.catalog import codec
    from braidgraph.operators import codec as X

    graph, table = codec._table(spark, sf_dir)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    want = sorted(((-r["n"], r["path"]) for r in X.path_references(graph).collect()))
    assert [(i, p) for i, (_, p) in enumerate(want)] == sorted((r["idx"], r["path"]) for r in table.collect())
