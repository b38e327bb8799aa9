"""Operators 1 and 2 against brute force, and a planted group."""

import hashlib
import random
import re

from braidgraph.llm import exact, minhash
from braidgraph.llm.common import connected
from braidgraph.llm.shingles import shingle_sets


def _shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def _components(rows, k, percent):
    sets = [(i, _shingles(t, k)) for i, t in rows]
    low = {i: i for i, _ in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                low[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_brute_force(spark):
    rng, words = random.Random(4), [f"w{i}" for i in range(50)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 40, 90]))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
        base.append(str(g))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"k": 4}, {"k": 5}, {"k": 3, "percent": 60, "block": 3}):
        want = _components(rows, options["k"], options.get("percent", 80))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, **options).collect()}
        assert got == want


def test_near_duplicates_edges(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13 and [by[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (5, 6, 7)) and by[8]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[10]["n_shingles"] == 29_996
    assert minhash.near_duplicates(no_docs).count() == 0
    left = minhash.survivors(odd_docs, minhash.near_duplicates(odd_docs))
    assert left.columns == odd_docs.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == {1, 5, 6, 7, 8, 9, 10, 11, None}


def test_hot_group(spark):
    """A third of all rows are copies, another third near copies of one text."""
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join(base[:-1] + [f"z{i}"])) for i in range(300)] + [(600 + i, " ".join(f"u{i}_{j}" for j in range(20))) for i in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 600} == {0} and sum(r["kept"] for r in got) == 301


def test_shingles_are_words():
    sets = shingle_sets([b"A b C d e", b"a B c D e", "é É".encode(), b""], 4)
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2 and [len(s) for s in sets[2:]] == [1, 0]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(5, 5), (100, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(c == (0 if n < 20 or n == 100 else n // 20 * 20) for n, c in got.items()) and 100 in got and 59 in got


def test_misra_gries():
    rng = random.Random(1)
    xs = [str(rng.randrange(1000)) for _ in range(3000)] + ["hot"] * 500
    rng.shuffle(xs)
    found = exact.misra_gries(iter(xs), 8)
    assert len(found) <= 8 and 500 - len(xs) / 9 <= found["hot"] <= 500


def test_exact_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", " a b", "c", "", None]) if i % 3 else f"own {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    for least in (2, 10**9):  # all groups frequent, none
        for r in exact.exact_duplicates(df, k=4, least=least).collect():
            g = groups[key(rows[r["doc_id"]][1])]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g), len(g), r["doc_id"] == min(g))
            assert r["text_sha256"] == hashlib.sha256(key(rows[r["doc_id"]][1]).encode()).hexdigest()
    by = [r for r in exact.exact_duplicates(odd_docs).collect()]
    assert len(by) == 13 and {r["doc_id"] for r in by if r["kept"]} == {1, 4, 5, 7, 8, 9, 10, 11, None}
    assert exact.exact_duplicates(no_docs).count() == 0
    left = exact.survivors(odd_docs, exact.exact_duplicates(odd_docs))
    assert left.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in left.select("doc_id").collect()) == sorted(map(str, [1, 4, 5, 7, 8, 9, 10, 11, None]))
