"""Operators 3, 4, 5, 6, 7 and 10."""

import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

from braidgraph.llm import pages, pieces, pii, quality, secrets, toxicity
from braidgraph.llm.common import windows
from braidgraph.llm.pii import normal


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


# --- 3 -------------------------------------------------------------------------------------------------------------------


def test_label_model_recovers_accuracies():
    rng, true, counts = random.Random(1), [0.95, 0.9, 0.8, 0.6], {}
    for _ in range(6000):
        y = rng.random() < 0.25
        p = "".join("0" if rng.random() < 0.2 else "+-"[(rng.random() < a) != y] for a in true)
        counts[p] = counts.get(p, 0) + 1
    post, accuracy, share = quality.label_model(counts)
    assert abs(share - 0.25) < 0.08 and accuracy[0] > accuracy[2] > accuracy[3] and post["+++0"] > 0.9 > 0.1 > post["---0"]
    assert quality.label_model({}) == ({}, [], 0.0)


def test_quality_on_labels(tables):
    docs = tables("documents")
    model = quality.trained(docs)
    assert all(0 <= a <= 1 for a in model["accuracy"].values())
    rows = quality.quality(docs, model).withColumnRenamed("quality", "q").join(tables("labels"), "doc_id").collect()
    right = np.mean([r["keep"] == bool(r["quality"]) for r in rows])
    clean = [r["keep"] for r in rows if r["quality"]]
    assert right > 0.9 and np.mean(clean) > 0.97


def test_quality_edges(odd_docs, no_docs):
    model = quality.trained(odd_docs)
    rows = {r["doc_id"]: r for r in quality.quality(odd_docs, model).collect()}
    assert all(rows[i]["quality"] == 0 and not rows[i]["keep"] for i in (5, 6, 7)) and len(rows) == 12
    assert quality.quality(no_docs, quality.trained(no_docs)).count() == 0


# --- 4 -------------------------------------------------------------------------------------------------------------------


def test_pages_article():
    page = """<html><head><title>t</title><style>x</style></head><body><nav>menu</nav><header>top</header>
    <article class="post"><h1>Head &amp; line</h1><p>One   <b>two</b>
    three<p>Four &#233;<div class="share-buttons">tweet</div><script>1<2</script></article><footer>foot</footer></body></html>"""
    assert pages.blocks(page) == (["Head & line", "One two three", "Four é"], True)
    assert pages.blocks(None) == ([], False) and pages.blocks("") == ([], False)
    for odd in ("<", "<p", "</", "<!--", "<p>a</b></p>", "<article>", "&#xZZ;", "<a href='>'>x</a>"):
        pages.blocks(odd)


def test_pages_differencing(spark):
    own = ["alpha text of the story", "more of the story"]
    page = lambda i: f"<html><body><div>Site name</div><div><p>{own[0]} {i}</p><p>{own[1]} {i}</p></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h/a/{i}", page(i)) for i in range(6)] + [(6, None, None), (7, "http://other/x", page(7)), (7, "http://other/x", page(7))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "'x' as host", "2 as lines")
    for n in (1, 5):
        got = {r["page_id"]: r["text"] for r in pages.main_text(df.repartition(n)).collect()}
        assert all(got[i] == f"{own[0]} {i}\n{own[1]} {i}" for i in range(6)) and got[6] == "" and got[7].startswith("Site name")
    assert pages.main_text(df.limit(0)).count() == 0 and pages.main_text(df).count() == 9


def test_common_lines():
    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        at = pages.common_lines(a, b)
        assert len(at) == longest(a, b) and at == sorted(set(at))
        it = iter(b)
        assert all(a[i] in it for i in at)


# --- 5 -------------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, tables, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    own = pieces.Pieces(pieces.load(pieces.model_path()))
    rng, texts = random.Random(7), [r["text"] for r in tables("documents").limit(150).collect()] + [r["text"] for r in odd_docs.collect()]
    signs = list("aeiost nr▁  \n\t.,'-éüß漢字\u0000�👍<s></s>0123") + ["the", "ing", " ", "  ", "   "]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)] + ["a" * 300, "ab" * 3000, " " * 40, "▁▁", "x  " * 50]
    for t in texts:
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        assert own.encode(t).tolist() == ids
        assert own.decode(ids) == sp.decode(ids)
    rows = {r["doc_id"]: r for r in pieces.tokenized(odd_docs, pieces.model_path(), keep_ids=True).collect()}
    assert rows[5]["ids"] == [1, 2] and rows[5]["decoded"] == "" and rows[6]["n_tokens"] == 2
    assert rows[8]["ids_sha256"] == hashlib.sha256(np.array(rows[8]["ids"], "<u4").tobytes()).hexdigest()
    assert pieces.tokenized(no_docs, pieces.model_path()).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------------------


def test_factorization_machine_learns_pairs():
    """Label 1 only where both terms stand: no sum of single weights tells it from one of them."""
    rng, rows, y = np.random.default_rng(1), [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted(({1} if a else set()) | ({2} if b else set()) | {10 + int(rng.integers(30))}), np.int32))
        y.append(float(a and b))
    m = toxicity.FactorizationMachine(64).fit(rows, np.array(y))
    got = [m.score(r) >= 0.5 for r in rows]
    assert np.mean([g == bool(t) for g, t in zip(got, y, strict=True)]) > 0.97
    x, v = m.x, m.v * m.x[:, None]
    idx = rows[0]
    pairs = sum(float(v[i] @ v[j]) for k, i in enumerate(idx) for j in idx[k + 1 :])
    assert abs(m.raw(idx) - (m.w0 + float(m.w[idx] @ x[idx]) + pairs)) < 1e-3


def test_factorization_machine_learns_terms_that_tell_in_company_only():
    """Exclusive or: each term alone says nothing; rows of 80 other terms each, or of one."""
    rng = np.random.default_rng(1)
    for others, noise in ((30, 1), (3000, 80)):
        rows, y = [], []
        for _ in range(4000):
            a, b = rng.random() < 0.5, rng.random() < 0.4
            rows.append(np.unique(np.array([*[1] * a, *[2] * b, *(10 + rng.integers(0, others, noise))], np.int32)))
            y.append(float(a != b))
        m = toxicity.FactorizationMachine(4096).fit(rows[:3000], np.array(y[:3000]))
        assert m.x[1] and m.x[2] and np.mean([(m.score(r) >= 0.5) == bool(t) for r, t in zip(rows[3000:], y[3000:], strict=True)]) > 0.95


def test_toxicity_scores_are_the_sum_over_pairs(tables):
    """Scores of all documents by the definition, pair by pair."""
    docs = tables("documents").limit(200)
    m = toxicity.trained(tables("documents"), tables("labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.toxicity(docs, m).collect():
        words = {w for w in re.findall(r"[^\W_]+", (text[r["doc_id"]] or "").lower())}
        idx = sorted({zlib.crc32(n.encode()) >> (32 - toxicity.BITS) for w in words for n in [w, *(f"{w[:k]}*" for k in (3, 4, 5, 6) if len(w) > k)]})
        idx = [i for i in idx if m.x[i]]
        v = m.v[idx].astype(float) * m.x[idx, None]
        raw = m.w0 + float(m.w[idx] @ m.x[idx]) + np.triu(v @ v.T, 1).sum()
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-3 and r["predicted"] == int(r["score"] >= 0.5)


def test_windows_change_nothing():
    text = "ab cd_ef  gh" * 50 + "x" * 90
    for size in (1, 7, 1000):
        parts = list(windows(text, toxicity._BREAK, size))
        assert "".join(parts) == text and {w for p in parts for w in toxicity._TERM.findall(p)} == set(toxicity._TERM.findall(text))


def test_toxicity_held_out(tables, odd_docs, no_docs):
    docs, labels = tables("documents"), tables("labels")
    m = toxicity.trained(docs, labels)
    rows = toxicity.toxicity(docs, m).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    own = {r["doc_id"]: r for r in toxicity.toxicity(odd_docs, m).collect()}
    assert len(own) == 12 and all(0 <= r["score"] <= 1 for r in own.values()) and own[5]["score"] == own[6]["score"]
    blank = toxicity.trained(docs, labels.limit(0))
    assert toxicity.toxicity(no_docs, blank).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------------------


def test_surrogates():
    text = "Mail Anna Schmidt at anna.s@example.com or +49 30 1234567; IP 192.168.7.13. Again: ANNA.S@example.com, card 4111 1111 1111 1111."
    new, found = pii.replaced(text)
    again, _ = pii.replaced(text)
    assert new == again and new != text
    by = {}
    for a, b, kind, s in found:
        by.setdefault(kind, []).append((text[a:b], s))
    assert set(by) == {"name", "email", "phone", "ip", "card"}
    assert all(old not in new and normal(kind, old) != normal(kind, s) for kind, xs in by.items() for old, s in xs)
    one, two = by["email"]
    assert one[1].lower() == two[1].lower() and one[0].lower() not in new.lower() and two[1].isupper() is two[0].isupper()
    assert pii.replaced("") == ("", []) and pii.replaced("nothing here")[0] == "nothing here"


def test_surrogates_are_one_to_one():
    new = {pii.surrogate("email", f"user{i}@example.com") for i in range(2000)}
    assert len(new) == 2000 and not new & {f"user{i}@example.com" for i in range(2000)}


def test_surrogate_tables(odd_docs, no_docs, tables):
    out = pii.surrogates(odd_docs)
    assert out.count() == 13 and pii.surrogates(no_docs).count() == 0
    assert pii.collisions(tables("documents")).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------------


def _by_contract(text):
    """Base findings (start, end, kind) as the contract words them."""
    spans, text = [], text or ""
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), m.end(), "assign"))
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def test_secrets_base_and_model(spark, tables, odd_docs, no_docs):
    net = secrets.trained()
    items, y = secrets.labelled(3000, 99)
    windows_ = [secrets.window(*x) for x in items]
    p = net.probability(windows_)
    hit = p >= net.threshold
    assert hit[y == 1].mean() >= secrets.RECALL and hit[y == 0].mean() < 0.1
    assert all(net.probability([w])[0] == q for w, q in zip(windows_[:300], p, strict=False))  # in any company
    texts = [r["text"] for r in tables("documents").limit(300).collect()] + ["é AKIA" + "A1" * 9 + ' API-key "x" Password: "Ab3' + "dE5g" * 4 + '" 0123456789abcdef0', None, ""]
    texts += ["key Zx81kQpL0vTr2 ghp_" + "aB3dE5gH7j" * 4 + " and plain-words-only here", "SHOUTEDWORDSONLY token=abc", "a" * 40 + " T0ken: q8Zr55Lm21"]
    for t, found in zip(texts, secrets.scan(texts, net), strict=True):
        base = _by_contract(t)
        assert [f[:3] for f in found if f[2] != "model"] == base
        added = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", t or ""):
            letters = [c for c in m[0] if c.isalpha()]
            shaped = any(c.isdigit() for c in m[0]) or (sum(c.isupper() for c in letters) > 1 and any(c.islower() for c in letters))
            if shaped and all(b <= m.start() or a >= m.end() for a, b, _ in base) and net.probability([secrets.window(t, *m.span())])[0] >= net.threshold:
                added.append(m.span())
        assert [f[:2] for f in found if f[2] == "model"] == added
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{(folder := tempfile.mkdtemp())}/documents.parquet")
    spell = lambda xs: ",".join(f"{k}:{a}:{b}" for a, b, k in xs)
    for r in secrets.op10_secrets(spark, folder).collect():
        base, whole = _by_contract(texts[r["doc_id"]]), [f[:3] for f in secrets.scan([texts[r["doc_id"]]], net)[0]]
        assert r["base_sha256"] == hashlib.sha256(spell(base).encode()).hexdigest() and r["spans"] == spell(whole)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for *_, k in base) for x in ("assign", "access", "hex")]
    rows = {r["doc_id"]: r for r in secrets.secrets(odd_docs, net).collect()}
    assert len(rows) == 12 and rows[5]["findings"] == [] and secrets.secrets(no_docs, net).count() == 0


def test_long_candidates_are_read_in_chunks(monkeypatch):
    net = secrets.trained()
    rng = random.Random(3)
    items = [secrets.window(t := "key " + "".join(rng.choice("aB3_xY9") for _ in range(n)) + " end", 4, len(t) - 4) for n in (60, 200, 333)]
    whole = net.raw(items)
    monkeypatch.setattr(secrets, "LONG", 37)
    assert abs(net.raw(items) - whole).max() < 1e-6
