"""Registered queries do the whole job: no row, level or commit is left out."""

import itertools
from collections import Counter

from braidgraph import catalog
from braidgraph.catalog import impact as catalog_impact
from braidgraph.catalog import layers as catalog_layers
from braidgraph.model import graph_of
from braidgraph.operators import changes as X
from braidgraph.operators import layers as L


def test_deprecated_scan_has_all_documents(spark, tmp_path):
    rows = [(i, "One. Two." if i == 4 else "One. This is old */ here. Two.") for i in (1, 2, 3, 4, 6)] + [(None, "One. This is old */ here.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["deprecated"] for r in catalog.QUERIES["deprecated_scan"](spark, str(tmp_path)).collect()}
    assert found == {i: i != 4 for i in (1, 2, 3, 4, 6, None)}


def test_co_changes_of_large_commits(spark, tmp_path):
    commits = {1: range(60), 2: range(50, 55), 3: [7], 4: range(40, 110)}
    rows = [(c, f"p{i}") for c, files in commits.items() for i in files]
    wanted = Counter(pair for files in commits.values() for pair in itertools.combinations(sorted(f"p{i}" for i in files), 2))
    changes = spark.createDataFrame([*rows, *rows[:9]], "commit long, path string")
    for block in (1000, 7, 1):
        assert {(r["a"], r["b"]): r["n"] for r in X.co_changes(changes, block=block).collect()} == wanted
    changes.selectExpr("commit as l_orderkey", "cast(substr(path, 2) as long) as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r["a"], r["b"]): r["n"] for r in catalog.QUERIES["co_changes"](spark, str(tmp_path)).collect()} == wanted


def test_impact_queries_walk_to_full_depth(spark, monkeypatch):
    paths = [f"src/f{i:02}.ts" for i in range(14)]
    edges = [{"from": f"FILE:{b}", "to": f"FILE:{a}", "type": "IMPORTS", "metadata": None, "edge_seq": i} for i, (a, b) in enumerate(itertools.pairwise(paths))]
    edges += [edges[0] | {"from": f"FILE:{paths[13]}", "edge_seq": 20}]
    graph = graph_of(spark, [{"type": "FILE", "path": p} for p in paths], edges)
    monkeypatch.setattr(catalog_impact, "flagship_graph", lambda s, d: graph)

    def walk(target):
        level, seen, depth = {target}, {}, 0
        while level and depth < 10:
            depth += 1
            level = {e["from"][5:] for e in edges if e["to"][5:] in level} - seen.keys()
            seen |= dict.fromkeys(level, depth)
        return seen

    got = {r["path"]: (r["total"], r["blast_radius"]) for r in catalog.QUERIES["blast_radius_all_files"](spark, "").collect()}
    band = lambda n: "unknown" if n == 0 else "low" if n <= 3 else "medium" if n <= 10 else "high"
    assert got == {p: (len(walk(p)), band(len(walk(p)))) for p in paths} and got[paths[0]][0] == 11
    far = {r["path"]: r["distance"] for r in catalog.QUERIES["impact_distributed"](spark, "").collect()}
    assert far == walk(paths[0]) and max(far.values()) == 10


def test_layer_queries_count_group_cycles(spark, monkeypatch):
    groups = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("e", "a")]
    names = sorted({g for pair in groups for g in pair})
    edges = [{"from": f"FILE:src/{x}/{x}.ts", "to": f"FILE:src/{y}/{y}.ts", "type": "IMPORTS", "metadata": None, "edge_seq": i} for i, (x, y) in enumerate(groups)]
    extra = [{"type": "FILE", "path": p} for p in ("src/package.json", "src/tsconfig.json")]
    graph = graph_of(spark, [{"type": "FILE", "path": f"src/{g}/{g}.ts"} for g in names] + extra, edges)
    monkeypatch.setattr(catalog_layers, "flagship_graph", lambda s, d: graph)
    simple = [c for n in range(2, 6) for c in itertools.permutations(names, n) if c[0] == min(c) and all(p in groups for p in zip(c, c[1:] + c[:1], strict=True))]
    assert len(simple) == 2
    wanted = {g: sum(-(-len(c) // 2) for c in simple if g in c) for g in names}
    rows = {r["group"]: r for r in catalog.QUERIES["dependency_score"](spark, "").collect()}
    assert {g: rows[g]["cycle_penalty"] for g in names} == wanted
    for g in names:
        into, out = sum(y == g for _, y in groups), sum(x == g for x, _ in groups)
        assert rows[g]["net_score"] == into - out - wanted[g]
    scores = [r["net_score"] for r in L.net_scores(graph).collect()]
    spread = sum((x - sum(scores) / len(scores)) ** 2 for x in scores)
    sure = L.confidence_of(33, spread, len(simple), L.ambiguous_pairs(L.net_scores(graph)).first()["n"])
    assert catalog.QUERIES["layer_confidence"](spark, "").first()["confidence"] == sure
