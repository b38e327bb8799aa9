"""Operator 3 by its definition: votes, EM and scores of whole tables in plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from braidgraph.llm import quality


def plain_votes(text):
    """The pattern of the twelve labellers, measured word by word and character by character."""
    words = (text or "").split()
    bare = [w[:-1] if w[-1] in ".," and w[:-1].isalpha() and w.islower() else w if w.isalpha() and (w.islower() or w[1:].islower()) else w.strip(".,;:!?\"'()") for w in words]
    n, pairs = max(1, len(words)), max(1, len(bare) - 1)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    ascii_ = [c for c in text or "" if ord(c) < 128]
    letters_a = sum(c.isalpha() for c in ascii_)
    letters = letters_a + sum(ord(c) >= 128 for c in "".join(chr(b) for b in (text or "").encode()) if ord(c) >= 0xC3)
    whole = max(1, letters + len(ascii_) - letters_a)
    tails = sum(bool(re.search(r"[#$%&*@^~=_+<>\\|{}\[\]]{2}$", w)) for w in words) / n
    symbols = sum(c in "#$%&*@^~=_+<>\\|{}[]" for c in ascii_) / whole
    bangs = sum(w.endswith("!!") for w in words) / n
    upper = sum(c.isupper() for c in ascii_) / max(1, letters_a)
    bars = sum(w in "|•·–—>»" for w in words) / n
    alone = sum(not any(c.isalnum() for c in w) for w in words) / n
    again = sum(a == b for a, b in zip(bare, bare[1:])) / pairs
    distinct = len(set(zip(bare, bare[1:]))) / pairs
    variety = len(set(bare)) / n
    same = 1 - len(set(lines)) / max(1, len(lines))
    ended = sum(bool(re.search(r"[.!?…:;][\"')\]]*\s*$", x)) for x in lines) / max(1, len(lines))
    share = letters / whole
    votes = [
        tails > 0.15, symbols > 0.05, upper > 0.4 and len(words) > 10, bangs > 0.15, bars > 0.15, alone > 0.15, again > 0.25,
        1 if len(words) > 30 and distinct < 0.4 else -1 if distinct > 0.6 else 0,
        len(words) > 30 and variety < min(0.25, 12 / len(words) ** 0.75), same > 0.6,
        -(ended > 0.5 and max(again, alone, tails, bangs) < 0.1),
        1 if share < 0.5 else -1 if share > 0.75 and tails < 0.1 and again < 0.1 and upper < 0.3 else 0,
    ]
    return "".join("-0+"[int(v) + 1] for v in votes)


def plain_score(text, weights):
    """The linear score from shapes of words, told one by one: one less the chance of junk."""
    words = (text or "").split()
    if not words:
        return 0.0
    kind = lambda c: "d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
    counts, bare = Counter(), []
    for w in words:
        simple = w.isalpha() and (w.islower() or w[1:].islower())
        comma = not w.isalpha() and w[-1] in ".," and w[:-1].isalpha() and w.islower()
        bare.append(w if simple else w[:-1] if comma else w.strip(".,;:!?\"'()"))
        shape = "".join(map(kind, w))
        if simple:
            shapes, ends = ["a" if w.islower() else "Aa"], []
        elif comma:
            shapes, ends = ["a" + w[-1]], [w[-1], "a" + w[-1]]
        else:
            short = re.sub("a+", "a", re.sub(r"(?s)(.)\1{2,}", r"\1\1", shape))
            shapes, ends = [short[i : i + 12] for i in range(0, len(short), 12)], sorted({t for t in (shape[-1:], shape[-2:]) if not t.isalpha()})
        for s in shapes:
            counts[s] += 1 / len(shapes)
        for t in ends:
            counts[f"..{t}"] += 1
    counts["=echo"] = sum(a == b for a, b in zip(bare, bare[1:]))
    counts["=pairs"] = max(0, len(bare) - 1 - len(set(zip(bare, bare[1:]))))
    slots = Counter()
    for s, c in counts.items():
        slots[zlib.crc32(s.encode()) >> (32 - quality.BITS)] += c / len(words)
    raw = weights[-1] + sum(weights[i] * math.sqrt(x) for i, x in slots.items())
    return 1 / (1 + math.exp(max(-30, min(30, raw))))


def plain_em(counts, rounds=200):
    """Posterior of each pattern, one pattern and labeller after another."""
    total, k = sum(counts.values()), len(next(iter(counts)))
    start = [[[0.0] * 3 for _ in range(k)] for _ in range(2)]
    for j in range(k):
        share = [sum(n for p, n in counts.items() if p[j] == s) / total for s in "-0+"]
        still = min(0.95, max(0.05, share[1]))
        spread = min(0.95, max(0.05, 1 - share[1]))
        start[0][j], start[1][j] = [0.85 * spread, still, 0.15 * spread], [0.15 * spread, still, 0.85 * spread]
        if share[2] > 0:
            start[1][j][2] = max(start[1][j][2], 0.2)
        for c in (0, 1):
            start[c][j] = [x / sum(start[c][j]) for x in start[c][j]]
    prob, prior, pseudo = start, 0.1, max(2.0, 0.002 * total)
    for _ in range(rounds):
        post = {}
        for p in counts:
            like = [math.prod(prob[c][j]["-0+".index(v)] for j, v in enumerate(p)) for c in (0, 1)]
            post[p] = like[1] * prior / (like[1] * prior + like[0] * (1 - prior))
        new = sum(n * post[p] for p, n in counts.items()) / total
        fresh = [[None] * k for _ in range(2)]
        for c in (0, 1):
            for j in range(k):
                seen = [sum(n * (post[p] if c else 1 - post[p]) for p, n in counts.items() if p[j] == s) + pseudo * start[c][j][i] for i, s in enumerate("-0+")]
                fresh[c][j] = [x / sum(seen) for x in seen]
        done, prob, prior = abs(new - prior) < 1e-9, fresh, min(max(new, 1e-4), 0.9)
        if done:
            break
    return post


def test_votes_and_scores_by_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = [None, "", " \n ", "A" * 300 + "##", "x, y. z! 12 | | !!", "漢字、 漢字、" * 20, "word " * 50, "Ünï céd? (\"quoted\")."]
    for t in [*texts.values(), *odd]:
        assert quality.votes(t) == plain_votes(t), repr((t or "")[:80])
    counts = Counter(plain_votes(t) for t in texts.values() if t is not None)
    post, _, _ = quality.label_model(dict(counts))
    want = plain_em(counts)
    assert all(abs(post[p] - want[p]) < 1e-6 for p in counts)
    model = quality.trained(docs)
    for r in quality.quality(docs, model).collect():
        q = plain_score(texts[r["doc_id"]], model["weights"])
        assert abs(r["quality"] - q) < 1e-4 and (r["keep"] == (q >= 0.5) or abs(q - 0.5) < 1e-4)
    # the scorer has learned from exactly these posteriors
    rows = [quality.features(t) for t in texts.values() if t is not None]
    ids = [i for i, t in texts.items() if t is not None]
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    again = quality.fit_linear([rows[i] for i in order], np.array([want[plain_votes(texts[ids[i]])] for i in order]))
    assert np.abs(again - model["weights"]).max() < 1e-3
