"""Operator 3: quality by a weak-label model.

1. *Labellers.*  Overlapping heuristics look at a whole text and vote junk (1), clean (-1) or nothing (0):
   symbols stuck to words, shouting, lists of cells, repetition, line shape, vocabulary and so on.
2. *Accuracies by expectation-maximisation.*  No labels are used.  All documents are counted by their vote
   pattern; there are at most ``3 ** len(LABELLERS)`` patterns and far fewer in practice, each a row for
   the driver whatever the corpus.  EM over them estimates the share of junk and each labeller's
   accuracy when it votes (and how often it votes), and gives every pattern a posterior.
3. *Hashed linear scorer.*  A logistic regression on hashed word shapes, the ends of words and echoes is
   trained on the posteriors of at most ``SAMPLE`` documents, those with the smallest hash of the doc_id
   (a documented bound), and scores every document.

``quality`` is 0 to 1, higher is cleaner; ``keep`` is ``quality >= 0.5``.

Cases: null, empty and blank texts are junk by definition (quality 0, keep false).  Repeated rows repeat
their verdict.  A null doc_id is scored.  Empty table: no row.  Other columns are ignored.
"""

from __future__ import annotations

import operator
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEED, discard, pieces, table, written

SAMPLE, BITS, PIECE = 20_000, 12, 12
_REPEATS, _LETTERS = re.compile(r"(.)\1{2,}", re.S), re.compile(r"a+")
_TAIL = re.compile(r"[#$%&*@^~=_+<>\\|{}\[\]]{2,}$")
_END = re.compile(r"[.!?…:;][\"')\]]*\s*$")
_UPPER, _LETTER, _DIGIT = (np.array([ord(c) for c in cs]) for cs in (string.ascii_uppercase, string.ascii_letters, string.digits))
_SYMBOL = np.array([ord(c) for c in "#$%&*@^~=_+<>\\|{}[]"])
_words: dict[str, tuple] = {}


def _shapes(word: str) -> tuple[str, ...]:
    """The shape of the whole word in pieces of up to ``PIECE`` characters: runs of one class shrink to one or two."""
    s = "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    s = _LETTERS.sub("a", _REPEATS.sub(r"\1\1", s))
    return tuple(s[i : i + PIECE] for i in range(0, len(s), PIECE))


def _tails(word: str) -> set[str]:
    """The last one and two signs of the whole word, as shapes, unless letters and digits alone."""
    s = "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word[-2:])
    return {t for t in (s[-1:], s[-2:]) if not t.isalpha()}


def _word(word: str) -> tuple:
    """(shapes, ends, word without punctuation, ends in symbols, shouted, a bar, no letter or digit)"""
    if word.isalpha():
        if word.islower():
            return (("a",), (), word, False, False, False, False)
        if word[1:].islower():
            return (("Aa",), (), word, False, False, False, False)
    elif word[-1] in ".," and word[:-1].isalpha() and word.islower():
        return (("a" + word[-1],), (word[-1], "a" + word[-1]), word[:-1], False, False, False, False)
    found = _words.get(word)
    if found is None:
        found = (_shapes(word), tuple(sorted(_tails(word))), word.strip(".,;:!?\"'()"), bool(_TAIL.search(word[-2:])), word.endswith("!!"), word in "|•·–—>»", not any(map(str.isalnum, word)))
        if len(_words) > 50_000:
            _words.clear()
        if len(word) <= 40:
            _words[word] = found
    return found


def _tokens(text: str):
    """Distinct words with their properties and counts; the words stripped, in order."""
    words = text.split()
    counts = Counter(words)
    infos = {w: _word(w) for w in counts}
    return words, [(infos[w], c) for w, c in counts.items()], [infos[w][2] for w in words]


def measures(text: str | None) -> dict[str, float]:
    """What the labellers look at, over the whole text."""
    text = text or ""
    words, infos, low = _tokens(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    n, pairs = max(1, len(words)), max(1, len(low) - 1)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    ascii_letters = int(raw[_LETTER].sum())
    letters = ascii_letters + int(raw[0xC3:].sum())
    whole = letters + int(raw[:128].sum()) - ascii_letters
    return {
        "words": len(words),
        "tails": sum(c for i, c in infos if i[3]) / n,
        "symbols": int(raw[_SYMBOL].sum()) / max(1, whole),
        "bangs": sum(c for i, c in infos if i[4]) / n,
        "upper": int(raw[_UPPER].sum()) / max(1, ascii_letters),
        "bars": sum(c for i, c in infos if i[5]) / n,
        "alone": sum(c for i, c in infos if i[6]) / n,
        "again": sum(map(operator.eq, low, low[1:])) / pairs,
        "pairs": len(set(zip(low, low[1:], strict=False))) / pairs,
        "variety": len(set(low)) / n,
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "ended": sum(1 for x in lines if _END.search(x[-8:])) / max(1, len(lines)),
        "letters": letters / max(1, whole),
    }


#: name -> vote of one labeller; 1 junk, -1 clean, 0 nothing.
LABELLERS = {
    "tails": lambda m: 1 if m["tails"] > 0.15 else 0,
    "symbols": lambda m: 1 if m["symbols"] > 0.05 else 0,
    "shout": lambda m: 1 if m["upper"] > 0.4 and m["words"] > 10 else 0,
    "bangs": lambda m: 1 if m["bangs"] > 0.15 else 0,
    "cells": lambda m: 1 if m["bars"] > 0.15 else 0,
    "marks": lambda m: 1 if m["alone"] > 0.15 else 0,
    "echo": lambda m: 1 if m["again"] > 0.25 else 0,
    "pairs": lambda m: 1 if m["words"] > 30 and m["pairs"] < 0.4 else -1 if m["pairs"] > 0.6 else 0,
    "variety": lambda m: 1 if m["words"] > 30 and m["variety"] < min(0.25, 12 / m["words"] ** 0.75) else 0,
    "lines": lambda m: 1 if m["same_lines"] > 0.6 else 0,
    "sentences": lambda m: -1 if m["ended"] > 0.5 and max(m["again"], m["alone"], m["tails"], m["bangs"]) < 0.1 else 0,
    "letters": lambda m: 1 if m["letters"] < 0.5 else -1 if m["letters"] > 0.75 and m["tails"] < 0.1 and m["again"] < 0.1 and m["upper"] < 0.3 else 0,
}


def votes(text: str | None) -> str:
    m = measures(text)
    return "".join("-0+"[f(m) + 1] for f in LABELLERS.values())


def label_model(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], list[float], float]:
    """(probability of junk for each pattern, accuracy of each labeller, share of junk) by EM.

    Given the class, a labeller that votes is right with its accuracy, independently of the others; how
    often it votes depends on the class too.  Counts act as weights, and a few pseudo-votes keep
    labellers that hardly vote near their start.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, [], 0.0
    v = np.array([["-0+".index(c) - 1 for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], dtype=float)
    k = v.shape[1]
    # table[class, labeller, vote]: class 1 is junk; the start says that votes are right at 0.85
    start = np.zeros((2, k, 3))
    voted = np.array([[(n * (v[:, j] == s)).sum() for s in (-1, 0, 1)] for j in range(k)]) / n.sum()
    for c in (0, 1):
        for s, right in ((0, c == 0), (1, None), (2, c == 1)):
            start[c, :, s] = np.clip(voted[:, 1], 0.05, 0.95) if right is None else (0.85 if right else 0.15) * np.clip(1 - voted[:, 1], 0.05, 0.95)
    start[1, :, 2] = np.where(voted[:, 2] > 0, np.maximum(start[1, :, 2], 0.2), start[1, :, 2])
    start /= start.sum(axis=2, keepdims=True)
    share, prob, pseudo = 0.1, start.copy(), max(2.0, 0.002 * n.sum())
    for _ in range(rounds):
        log = np.stack([np.log(prob[c][np.arange(k), v + 1]).sum(axis=1) for c in (0, 1)])
        log += np.log([[1 - share], [share]])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        new = (n * post).sum() / n.sum()
        for c, weight in ((0, n * (1 - post)), (1, n * post)):
            seen = np.stack([(weight[:, None] * (v == s)).sum(axis=0) for s in (-1, 0, 1)], axis=1) + pseudo * start[c]
            prob[c] = seen / seen.sum(axis=1, keepdims=True)
        done, share = abs(new - share) < 1e-9, min(max(new, 1e-4), 0.9)
        if done:
            break
    right = (1 - share) * prob[0, :, 0] + share * prob[1, :, 2]
    wrong = (1 - share) * prob[0, :, 2] + share * prob[1, :, 0]
    return dict(zip(patterns, post.tolist(), strict=True)), (right / (right + wrong)).tolist(), float(share)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: square roots of the shares of word shapes, their ends, and echoes."""
    words, infos, low = _tokens(text or "")
    n = max(1, len(words))
    counts: dict[str, float] = {}
    for info, c in infos:
        shapes = info[0]
        for shape in shapes:
            counts[shape] = counts.get(shape, 0) + c / len(shapes)
        for tail in info[1]:
            counts[f"..{tail}"] = counts.get(f"..{tail}", 0) + c
    counts["=echo"] = sum(map(operator.eq, low, low[1:]))
    counts["=pairs"] = len(low) - 1 - len(set(zip(low, low[1:], strict=False))) if len(low) > 1 else 0
    found: dict[int, float] = {}
    for s, c in counts.items():
        if c:
            slot = zlib.crc32(s.encode()) >> (32 - BITS)
            found[slot] = found.get(slot, 0.0) + c / n
    slots = sorted(found)
    return np.array(slots, np.int32), np.sqrt(np.array([found[s] for s in slots], np.float32))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 300, rate: float = 0.2, l2: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the last one its bias (full-batch Adam)."""
    w = np.zeros((1 << BITS) + 1)
    if not rows:
        return w
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    m, s = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean()))
    balance = np.minimum(balance, 5.0)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[idx] * val, len(rows)) + w[-1], -30, 30)))
        err = balance * (p - y) / len(rows)
        g = np.append(np.bincount(idx, err[row] * val, len(w) - 1), err.sum()) + l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def _voting(batches):
    for b in (part for batch in batches for part in pieces(batch)):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([votes(t) for t in b.column("text").to_pylist()])], names=["doc_id", "pattern"])


def trained(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights of the scorer with the labellers' accuracies and the share of junk."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    voted = written(docs.where("text is not null").mapInArrow(_voting, "doc_id long, pattern string"), "votes")
    posterior, accuracy, share = label_model({r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()})
    some = voted.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "pattern").limit(sample)

    def run(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            found = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("pattern"), pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].tobytes() for x in found], pa.binary())], names=["doc_id", "pattern", "slots", "vals"])

    rows = docs.join(F.broadcast(some.dropDuplicates(["doc_id"])), "doc_id").select("doc_id", "pattern", "text").mapInArrow(run, "doc_id long, pattern string, slots binary, vals binary").collect()
    discard(voted)
    rows = sorted((r["doc_id"], r["pattern"], bytes(r["slots"]), bytes(r["vals"])) for r in rows)
    weights = fit_linear([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], np.array([posterior[r[1]] for r in rows]))
    return {"weights": weights, "accuracy": dict(zip(LABELLERS, accuracy, strict=False)), "share": share}


def score(text: str | None, weights: np.ndarray) -> float:
    """Quality of a text, 0 to 1."""
    if not (text or "").strip():
        return 0.0
    idx, val = features(text)
    return float(1 / (1 + np.exp(np.clip(weights[idx] @ val + weights[-1], -30, 30))))


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, quality, keep for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def run(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            q = pa.array([score(t, shared.value) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), q], names=["doc_id", "quality"])
        _words.clear()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality double")
    return out.withColumn("keep", F.col("quality") >= 0.5)


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"])
    docs_text = next(c for c in docs.columns if c.lower() == "text")

    def run(batches):
        for batch in batches:
            for b in pieces(batch, docs_text):
                yield b.filter(pa.array([score(t, shared.value) >= 0.5 for t in b.column(docs_text).to_pylist()], pa.bool_()))
        _words.clear()

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, quality, keep."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, trained(docs))
