"""Operator 4: main text of web pages by nearest-URL page differencing.

1. *Lines.*  A tolerant tokenizer cuts a page into blocks of text (one line each, white space collapsed, character
   references decoded).  Scripts, styles and other raw elements have none.
2. *Furniture that a page names.*  Lines in forms, menus, asides, hidden parts and elements that their tag, role, class or id
   names as furniture (adverts, notices, comments, share bars ...) are marked, unless they hold the article itself.  A class or
   id counts if all of its parts do: ``ad-slot-3``, not ``search-engine-history``.  Where a page marks its articles (``article``,
   else ``main`` or its role), everything outside them is furniture.
3. *Differencing.*  All pages are ordered by (host, marked, path, id); a run of equal line lists stands for one page: copies say
   nothing about furniture.  Each page is paired with the last page before its run or the first one after it on the same host,
   that with the longer common prefix of the URL path first; where this one shares nothing, the other.  All lines of both,
   furniture too, are aligned by their longest common subsequence, and shared lines are deleted; but a marked article keeps
   its lines, for licences and quotations that two articles share are part of both.  A neighbour that shares over ``COPY`` of the
   page's own lines may be a near copy: then lines stay that the other neighbour, if it shares any, does not have.
   ``n_shared`` counts the aligned lines of each page.

The order comes from a range partitioning of (host, marked, path, id) with line hashes, so a host with a third of all pages is
spread over many tasks, and a page is aligned where its neighbours lie.  Only the first and last runs of partitions wait for a
second pass; of these, one row each meets in one small task.  The outcome, a few numbers a page, is joined with the lines by
the SHA-256 of the whole row; pages are tokenized twice, so that no copy of their text is stored.

The alignment is bit-parallel (a row of the table is one integer) and halved where its table would be large, so repeated lines
cost no more than others: ``len(a) * len(b) / 64`` steps.

Cases: null or empty html gives an empty text.  A null or odd URL has the empty host.  Repeated rows repeat their result.
A page alone on its host keeps its lines.  Unclosed and stray tags are tolerated.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, pieces, table, written

COPY = 0.8
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr td th".split())
_FURNITURE = set("nav footer aside form button select option menu dialog svg canvas object audio video fieldset datalist map head".split())
_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar status".split())
#: Words that name furniture in a class or id, and words that may stand beside them there.
_NAMED = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification newsletter"
    " subscribe subscription signup sidebar sidenav widget widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond"
    " breadcrumb breadcrumbs nav navbar navigation navi menu menubar toolbar topbar pagination pager footer masthead copyright disclaimer popup modal overlay login search"
    " skip hidden sr offscreen tags tagcloud teaser teasers outbrain taboola paywall announcement alert".split()
)
_BESIDE = set(
    "area bar block body bottom box btn button buttons col column container content d dialog div element entry form group holder icon icons id inner item items js label left"
    " link links list main message middle only outer page panel post posts primary right row s secondary section site slot space subscribe tab text title to top unit view wrap wrapper".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure".split())
_SPACE = re.compile(r"\s+")
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(raw)}


def _is_furniture(tag: str, raw: str, in_article: bool) -> bool:
    if tag in _FURNITURE or (tag == "header" and not in_article):
        return True
    if not raw or raw.isspace() or tag in ("html", "body", "article", "main"):
        if tag not in ("article",) or not raw:
            return False
    a = _attributes(raw)
    if a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    named = f"{a.get('class', '')} {a.get('id', '')}"
    if named == " ":
        return False
    for name in named.split():
        words = {w.lower() for w in _PARTS.findall(name) if not w.isdigit()}
        if words and words <= _NAMED | _BESIDE and words & _NAMED:
            return True
        if not in_article and "header" in words and words <= _NAMED | _BESIDE | {"header"}:
            return True
    return False


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The lines of a page outside its named furniture, and whether they are those of marked articles."""
    lines, plain, marked = all_lines(page)
    return [lines[i] for i in plain], marked


def all_lines(page: str | None) -> tuple[list[str], list[int], bool]:
    """The lines of a page, the indices of those outside named furniture, and whether these are those of marked articles."""
    page = page or ""
    found: list[tuple[str, int]] = []  # (line, open element)
    parent, tags, bad, within, kind = [-1], [""], [False], [False], [0]
    marks: list[tuple[int, int]] = []
    at, pos, text = 0, 0, []

    def end_line() -> None:
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                found.append((line, at))
            text.clear()

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        if m is None:
            text.append(page[pos:])
            break
        if m.start() > pos:
            text.append(page[pos : m.start()])
        pos = m.end()
        if m[1] is not None:
            text.append(entities.escape(m[1]))
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag not in _INLINE and tag not in ("script", "style", "noscript", "template"):
            end_line()
        elif tag in ("br", "td", "th", "img"):
            text.append(" ")
        if m[2]:
            up = at
            while up > 0 and tags[up] != tag:
                if tags[up] in ("article", "main", "body") and tag in _INLINE | {"p", "li"}:
                    up = 0
                    break
                up = parent[up]
            if up > 0:
                if tag in _INLINE and any(tags[x] not in _INLINE for x in _chain(at, up, parent)):
                    continue
                at = parent[up]
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag in _VOID or m[4].rstrip().endswith("/") and tag in ("path", "g", "use"):
            continue
        if tag in _CLOSES_P:
            up = at
            while up > 0 and (tags[up] in _INLINE):
                up = parent[up]
            if tags[up] == "p":
                at = parent[up]
        elif tag in ("li", "dt", "dd", "tr", "option"):
            up = at
            while up > 0 and tags[up] in _INLINE | {"p"}:
                up = parent[up]
            if tags[up] == tag:
                at = parent[up]
        inside = kind[at]
        new = len(parent)
        parent.append(at)
        tags.append(tag)
        is_bad = _is_furniture(tag, m[4], bool(inside))
        mark = 0
        if not is_bad:
            if tag == "article" or 'articleBody' in m[4]:
                mark = 2
            elif tag == "main" or "main" in m[4] and _attributes(m[4]).get("role", "").lower() == "main":
                mark = 1
        if mark:
            marks.append((new, mark))
        bad.append(is_bad)
        within.append(within[at] or is_bad)
        kind.append(max(inside, mark))
        at = new
    end_line()
    # articles in furniture (teasers, comments) count only where there is no other
    marks = [x for x in marks if not within[x[0]]] or marks
    articles = max((m for _, m in marks), default=0)
    tops, holds = {i for i, m in marks if m == articles}, [False] * len(parent)
    for up in tops:
        while up > 0 and not holds[up]:
            holds[up], up = True, parent[up]
    lost, inside = [False] * len(parent), [False] * len(parent)
    for i in range(1, len(parent)):
        lost[i] = lost[parent[i]] or (bad[i] and not holds[i])
        inside[i] = inside[parent[i]] or i in tops
    plain = [i for i, (_, e) in enumerate(found) if not lost[e]]
    marked = [i for i in plain if inside[found[i][1]]]
    return [line for line, _ in found], marked or plain, bool(marked)


def _chain(at: int, up: int, parent: list[int]):
    while at != up:
        yield at
        at = parent[at]


def _rows(a: list, b: list) -> list[int]:
    """Row i of the table of longest common subsequences, for a[:i] and all prefixes of b: bit j is 0 where b[j] adds one."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _gains(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of a with all prefixes of b."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: list[int], b: list[int], most: int = 1 << 28) -> list[int]:
    """Indices of a that lie on one longest common subsequence of a and b; a table of over ``most`` bits is split in halves."""
    both = set(a) & set(b)
    at, b = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    out: list[int] = []
    todo = [(at, b)]
    while todo:
        at, b = todo.pop()
        if not at or not b:
            continue
        own = [a[i] for i in at]
        if len(own) * len(b) > most and len(own) > 1:
            half = len(own) // 2
            cut = int(np.argmax(_gains(own[:half], b) + _gains(own[half:][::-1], b[::-1])[::-1]))
            todo += [(at[half:], b[cut:]), (at[:half], b[:cut])]
            continue
        rows, i, j, found = _rows(own, b), len(own), len(b), []
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    found.append(at[i])
                    j -= 1
        out += found[::-1]
    return out


def shared_lines(own: list[int], path: str, others: list[tuple[str, list[int]]], copy: float = COPY, plain: list[int] | None = None) -> list[int]:
    """Indices of the lines that a page shares with the nearest of its neighbours that shares any (of the lines ``plain``)."""

    def near(other: str) -> int:
        n = 0
        for x, y in zip(path, other, strict=False):
            if x != y:
                break
            n += 1
        return n

    mine = set(range(len(own)) if plain is None else plain)
    ordered = sorted((o for o in others if o[1] != own), key=lambda o: -near(o[0]))
    aligned = [common_lines(own, lines) for _, lines in ordered]
    found = [x for x in aligned if mine.intersection(x)] or [x for x in aligned if x]
    if not found:
        return []
    if len(mine.intersection(found[0])) > copy * len(mine) and len(found) > 1:
        both = set(found[1])
        return [i for i in found[0] if i in both]
    return found[0]


def _place(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2] + (m[3] or "")) if m else ("", url or "")


def _hashed(lines: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]


def _outlined(batches):
    """Line hashes of pages."""
    for batch in batches:
        for part in pieces(batch, "html"):
            rows = []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                lines, plain, marked = all_lines(page)
                rows.append((*_place(url), marked, _hashed(lines), plain))
            c = list(zip(*rows, strict=True))
            types = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("page_id"), *(pa.array(x, t) for x, t in zip(c, types, strict=True))], names=["key", "page_id", "host", "path", "marked", "hashes", "plain"])


def _plain_lines(batches):
    """Lines of pages outside named furniture."""
    for batch in batches:
        for part in pieces(batch, "html"):
            found = [blocks(x)[0] for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("page_id"), part.column("url"), pa.array(found, pa.list_(pa.string()))], names=["key", "page_id", "url", "lines"])


_SIDE = "struct<path: string, hashes: array<long>>"
_SIDE_ARROW = pa.struct([("path", pa.string()), ("hashes", pa.list_(pa.int64()))])
#: Aligned pages have ``n_shared`` and ``drops``; the others, and one row for each ``whole`` run of them, have their hashes.
_NEAR = f"key binary, n_shared int, drops array<int>, host string, marked boolean, path string, last string, hashes array<long>, plain array<int>, part int, edge int, whole boolean, side {_SIDE}"
_NEAR_ARROW = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_(), _SIDE_ARROW]
_NEAR_NAMES = ["key", "n_shared", "drops", "host", "marked", "path", "last", "hashes", "plain", "part", "edge", "whole", "side"]
_ENDS = f"part int, edge int, p {_SIDE}, n {_SIDE}"


def _aligned(marked: bool, path: str, hashes: list[int], plain: list[int], before: dict | None, after: dict | None) -> tuple[int, list[int]]:
    """How many lines of a page a neighbour shares, and which of the lines ``plain`` go for it."""
    shared = shared_lines(hashes, path, [(x["path"], x["hashes"]) for x in (before, after) if x], plain=plain)
    gone = set() if marked else set(shared)
    return len(shared), [k for k, i in enumerate(plain) if i in gone]


def _neighbours(batches):
    """Rows in order -> aligned pages.  The first run of equal pages of a partition lacks the side before it (edge 1), the last
    the side after it (edge 2); their pages wait with the ``side`` they have, and each has a row for the ``whole`` run."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def members():
        run, before, first = None, None, True

        def closed(after, edge):
            (host, marked), same, rows = run
            sides: dict = {}
            for key, path in rows:
                if edge:
                    yield (key, None, None, host, marked, path, None, *same, part, edge, False, before or after)
                    continue
                if path not in sides:
                    sides[path] = _aligned(marked, path, *same, before, after)
                yield (key, *sides[path], *[None] * 6, part, 0, False, None)
            if edge:
                yield (None, None, None, host, marked, rows[0][1], rows[-1][1], same[0], None, part, edge, True, None)

        def side(other, path, hashes):
            return {"path": path, "hashes": hashes} if run[0] == other else None

        for batch in batches:
            for key, host, marked, path, hashes, plain in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "marked", "path", "hashes", "plain")), strict=True):
                where, same = (host, marked), (hashes, plain)
                if run is not None and run[0] == where and run[1] == same:
                    run[2].append((key, path))
                    continue
                if run is not None:
                    yield from closed(side(where, path, hashes), int(first))
                    before, first = side(where, run[2][-1][1], run[1][0]), False
                run = (where, same, [(key, path)])
        if run is not None:
            yield from closed(None, 2 + first)

    def built(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _NEAR_ARROW, strict=True)], names=_NEAR_NAMES)

    out = []
    for row in members():
        out.append(row)
        if len(out) >= 2000:
            yield built(out)
            out = []
    if out:
        yield built(out)


def _joined_ends(batches):
    """The end runs of all partitions in order, two a partition at most -> what lies before and after each."""
    runs = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["part"], r["edge"]))
    for order, bit, mine, seen in ((runs, 1, "before", "last"), (runs[::-1], 2, "after", "path")):
        other = None
        for r in order:
            r.setdefault(mine, None)
            if r["edge"] & bit and other and (other["host"], other.get("marked")) == (r["host"], r.get("marked")):
                r[mine] = other[mine] if other["hashes"] == r["hashes"] else {"path": other[seen], "hashes": other["hashes"]}
            other = r
    if runs:
        columns = [pa.array([r[n] for r in runs], t) for n, t in (("part", pa.int32()), ("edge", pa.int32()), ("before", _SIDE_ARROW), ("after", _SIDE_ARROW))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "edge", "p", "n"])


def _completed(batches):
    """Pages of end runs with the sides that lay in other partitions."""
    names = ("edge", "marked", "path", "hashes", "plain", "side", "p", "n")
    for b in batches:
        done = []
        for edge, marked, path, hashes, plain, side, p, n in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            done.append(_aligned(marked, path, hashes, plain, p if edge & 1 else side, n if edge & 2 else side))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.list_(pa.int32()))], names=["key", "n_shared", "drops"])


def aligned(pages: DataFrame) -> DataFrame:
    """key, n_shared, drops: one row for each distinct row (key, page_id, url, html)."""
    light = written(pages.mapInArrow(_outlined, "key binary, page_id long, host string, path string, marked boolean, hashes array<long>, plain array<int>"), "outlines")
    order = ["host", "marked", "path", "page_id", "key"]
    near = written(light.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _NEAR), "near")
    discard(light)
    ends = near.where("whole").select("host", "marked", "path", "last", "hashes", "part", "edge").repartition(1).mapInArrow(_joined_ends, _ENDS)
    waiting = near.where("not whole and edge > 0").join(ends, ["part", "edge"]).mapInArrow(_completed, "key binary, n_shared int, drops array<int>")
    return near.where("edge = 0").select("key", "n_shared", "drops").unionByName(waiting).dropDuplicates(["key"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_shared: one row for each row of ``pages``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    whole = F.to_json(F.struct("page_id", "url"))
    pages = pages.withColumn("key", F.unhex(F.sha2(F.concat(whole, F.lit("\n"), F.coalesce("html", F.lit(""))), 256)))
    lines = pages.mapInArrow(_plain_lines, "key binary, page_id long, url string, lines array<string>")
    kept = F.filter("lines", lambda x, i: ~F.array_contains("drops", i))
    text = F.array_join(F.when(F.size("drops") > 0, kept).otherwise(F.col("lines")), "\n")
    return lines.join(aligned(pages), "key", "left").select("page_id", "url", text.alias("text"), "n_shared")


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.col("n_shared").cast("long").alias("n_shared"))
