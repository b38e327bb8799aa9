"""Operator 4: the whole query against a plain version, alignment under repeated lines, and furniture by name."""

import random
import re

import pytest

from braidgraph.llm import pages


def _longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_of_repeated_lines():
    rng = random.Random(5)
    for most in (1 << 28, 8, 1):
        for _ in range(150):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
            at = pages.common_lines(a, b, most)
            assert len(at) == _longest(a, b) and at == sorted(set(at))
            it = iter(b)
            assert all(a[i] in it for i in at)
    assert len(pages.common_lines([1] * 30_000, [1] * 20_000 + [2] * 9)) == 20_000


def plain_texts(rows):
    """The rule of main_text over (page_id, url, html), one page after another: {page_id: (text, shared lines)}."""
    parsed = []
    for n, (page_id, url, page) in enumerate(rows):
        lines, plain, marked = pages.all_lines(page)
        parsed.append((*pages._place(url), marked, page_id, n, lines, plain))
    parsed.sort(key=lambda r: (r[0], r[2], r[1], r[3] is not None, r[3] or 0, r[4]))
    out = {}
    for k, (host, path, marked, page_id, _, lines, plain) in enumerate(parsed):
        others = []
        for step in (-1, 1):
            at = k + step
            while 0 <= at < len(parsed) and (parsed[at][0], parsed[at][2]) == (host, marked) and parsed[at][5:] == (lines, plain):
                at += step
            if 0 <= at < len(parsed) and (parsed[at][0], parsed[at][2]) == (host, marked):
                others.append((parsed[at][1], parsed[at][5]))
        common = lambda x, y: next((n for n in range(min(len(x), len(y))) if x[n] != y[n]), min(len(x), len(y)))
        others = [o for o in sorted(others, key=lambda o: -common(path, o[0])) if o[1] != lines]
        shared = [pages.common_lines(lines, o[1]) for o in others]
        assert all(len(x) == _longest(lines, o[1]) for x, o in zip(shared, others, strict=True))
        good = [x for x in shared if set(x) & set(plain)] or [x for x in shared if x]
        gone = set(good[0]) if good else set()
        if len(good) > 1 and len(gone & set(plain)) > pages.COPY * len(plain):
            gone &= set(good[1])
        out.setdefault(page_id, []).append(("\n".join(lines[i] for i in plain if marked or i not in gone), len(gone)))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("marked", [True, False])
def test_query_is_the_plain_version(spark, marked):
    """All pages of a table, with their articles marked and not."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    if not marked:
        rows = [(i, u, re.sub(r"</?article>", "", h or "")) for i, u, h in rows]
    rows += [(1000 + i, f"http://copies/{i // 9}", f"<div>top</div><p>same {i // 9}</p><div>low</div>") for i in range(40)] + [(None, None, None), (7, "", "x"), (7, "", "x")]
    got = {}
    for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_shared"]))
    assert {i: sorted(x) for i, x in got.items()} == plain_texts(rows)


def test_names_of_furniture():
    page = lambda name: f'<article><p>first</p><div class="{name}"><p>inner</p></div><p>last</p></article>'
    for name in ("search-engine-history", "legal", "status-of-talks", "adding", "widgetry", "comment-on-the-law"):
        assert pages.blocks(page(name))[0] == ["first", "inner", "last"], name
    for name in ("ad", "ad-slot-3", "shareButtons", "post comment-list", "newsletter_signup", "cookie-notice"):
        assert pages.blocks(page(name))[0] == ["first", "last"], name


def test_every_article_block_stays():
    page = "<body><p>teaser</p><article>one</article><div>between</div><article>two</article><section id='comments'><article>said</article></section></body>"
    assert pages.blocks(page) == (["one", "two"], True)
    assert pages.blocks("<aside><article>alone</article></aside>") == (["alone"], True)
