"""Operator 6: toxicity by a factorization machine over hashed terms.

A text is the set of its lower-case words and their beginnings (stems carry many endings), each hashed to
one of ``2 ** BITS`` slots.  The score is the logistic of ``w0 + sum w_i + sum_{i<j} <v_i, v_j>``: the
pairwise part lets a pair of terms count more, or less, than the two apart (an insult beside a mention of
a group), which no sum of single weights does.  It is computed in linear time as
``(|sum v_i|^2 - sum |v_i|^2) / 2``.

Hundreds of common terms of a long text would drown a few telling ones, so terms are screened:

* a term that tells by itself enters with its smoothed log odds ratio between toxic and other texts, if
  that is at least ``Z`` standard errors from 0;
* a term that tells in company enters with 1: of the ``PAIRED`` terms whose presence varies most, those of
  pairs whose rows are toxic more or less often than both single terms foretell, by ``Z_PAIR`` standard errors, or
  twice as many where one of the two tells by itself (terms that lie in long texts often look like its company).
  The counts of all these pairs are two matrix products.

Training: AdaGrad on logistic loss over at most ``SAMPLE`` labelled rows, those with the smallest hash
of the doc_id (a documented bound; every row is scored).  Rows whose crc32(doc_id) mod 5 is 0 are never
learned from; labels, language, source and id are no inputs.  Model and broadcast have a fixed size.

Cases: null and empty texts have no term and score the logistic of w0.  Without any label the score is
0.5 less a trifle for all.  A null doc_id is scored and not held out.  Labels without a document, null
labels and repeated labels (the largest counts) do no harm.  Repeated rows repeat their score.  Texts are
read in windows that end between words, so a text of any length holds one window and its set of slots.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEED, pieces, table, windows

BITS, FACTORS, SAMPLE, EPOCHS, Z, Z_PAIR, PAIRED = 18, 4, 12_000, 12, 3.0, 6.0, 2048
_TERM, _BREAK = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")
_cache: dict[str, tuple[int, ...]] = {}


def _slots(word: str) -> tuple[int, ...]:
    found = _cache.get(word)
    if found is None:
        names = [word, *(f"{word[:n]}*" for n in (3, 4, 5, 6) if len(word) > n)]
        found = tuple(zlib.crc32(n.encode()) >> (32 - BITS) for n in names)
        if len(_cache) > 100_000:
            _cache.clear()
        if len(word) <= 40:
            _cache[word] = found
    return found


def terms(text: str | None) -> np.ndarray:
    """The sorted distinct slots of a whole text."""
    found: set[int] = set()
    for part in windows((text or "").lower(), _BREAK):
        for word in set(_TERM.findall(part)):
            found.update(_slots(word))
    return np.array(sorted(found), dtype=np.int32)


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, alone: np.ndarray, most: int = PAIRED, z: float = Z_PAIR) -> np.ndarray:
    """Slots of pairs, one of the two at least not telling ``alone``, with another share of toxic rows than both apart foretell.

    Terms in fewer than 10 rows, or missing in fewer, are left out."""
    seen = np.bincount(np.concatenate(rows), minlength=len(alone))
    varies = np.minimum(seen, len(rows) - seen)
    terms = np.argsort(-varies, kind="stable")[:most]
    terms = terms[varies[terms] >= 10]
    if not len(terms):
        return terms
    place = np.full(len(alone), -1)
    place[terms] = np.arange(len(terms))
    both = np.zeros((2, len(terms), len(terms)), np.float32)
    for label in (0, 1):
        own = [r for r, t in zip(rows, y, strict=True) if int(t) == label]
        for at in range(0, len(own), 512):
            x = np.zeros((min(512, len(own) - at), len(terms)), np.float32)
            for k, r in enumerate(own[at : at + 512]):
                i = place[r]
                x[k, i[i >= 0]] = 1
            both[label] += x.T @ x
    n1, n0 = y.sum(), len(y) - y.sum()
    single = np.log((np.diag(both[1]) + 0.5) / (n1 + 1)) - np.log((np.diag(both[0]) + 0.5) / (n0 + 1))
    p = 1 / (1 + np.exp(-np.clip(np.log(n1 / n0) + single[:, None] + single[None, :], -30, 30)))
    n = both[0] + both[1]
    told = alone[terms]
    least = z * np.where(told[:, None] & told[None, :], np.inf, np.where(told[:, None] | told[None, :], 2, 1))
    strong = np.abs(both[1] - n * p) >= least * np.sqrt(np.maximum(1, n * p * (1 - p)))
    np.fill_diagonal(strong, False)
    return terms[strong.any(axis=1)]


class FactorizationMachine:
    def __init__(self, slots: int = 1 << BITS, factors: int = FACTORS, seed: int = SEED):
        self.w0 = -1e-6
        self.x = np.zeros(slots, dtype=np.float32)
        self.w = np.zeros(slots, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (slots, factors)).astype(np.float32)

    def raw(self, idx: np.ndarray) -> float:
        idx = idx[self.x[idx] != 0]
        v = self.v[idx] * self.x[idx, None]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[idx] @ self.x[idx] + 0.5 * (s @ s - (v * v).sum()))

    def score(self, idx: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(idx), -30, 30))))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-3, batch: int = 128, seed: int = SEED):
        """Learn from rows of slots and labels of 0 and 1; the same rows give the same machine."""
        if not rows or len(set(y.tolist())) < 2:
            if len(rows):
                self.w0 = 4.0 if y[0] else -4.0
            return self
        slots, n1, n0 = len(self.x), y.sum(), len(y) - y.sum()
        a = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=slots) + 0.5
        b = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if not t]), minlength=slots) + 0.5
        odds = np.log(a / (n1 + 1 - a)) - np.log(b / (n0 + 1 - b))
        alone = np.abs(odds) >= Z * np.sqrt(1 / a + 1 / b)
        self.x = np.where(alone, odds, 0).astype(np.float32)
        paired = telling_pairs(rows, y, alone)
        paired = paired[~alone[paired]]
        self.x[paired] = 1
        self.v[paired] *= 30
        rows = [r[self.x[r] != 0] for r in rows]
        rng, gw, gv, g0 = np.random.default_rng(seed), np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8), 1e-8
        self.w0 = float(np.log(n1 / n0))
        epochs = max(epochs, 600 * batch // len(rows))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                idx = np.concatenate([rows[i] for i in pick])
                n, row = len(pick), np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
                x = self.x[idx]
                v = self.v[idx] * x[:, None]
                s = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], axis=1)
                raw = self.w0 + np.bincount(row, self.w[idx] * x, n) + 0.5 * ((s * s).sum(1) - np.bincount(row, (v * v).sum(1), n))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / n
                g0 += err.sum() ** 2
                self.w0 -= rate * float(err.sum()) / np.sqrt(g0)
                if not len(idx):
                    continue
                used, where = np.unique(idx, return_inverse=True)
                dw = np.bincount(where, err[row] * x) + l2 * self.w[used] / 10
                each = (err[row] * x)[:, None] * (s[row] - v)
                dv = np.stack([np.bincount(where, each[:, f]) for f in range(v.shape[1])], axis=1) + l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= (rate * dw / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (0.2 * rate * dv / np.sqrt(gv[used])).astype(np.float32)
        return self


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """A machine fitted to at most ``sample`` labelled rows outside the held-out fifth."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    y = y.where("crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)

    def run(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([terms(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "toxic", "slots"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = named.join(F.broadcast(y), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, slots binary").collect()
    rows = sorted((r["doc_id"], bytes(r["slots"]), r["toxic"]) for r in rows)
    return FactorizationMachine().fit([np.frombuffer(r[1], np.int32) for r in rows], np.array([float(r[2] > 0) for r in rows]))


def toxicity(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = shared.value
        for b in (part for batch in batches for part in pieces(batch)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(terms(t)) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])
        _cache.clear()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, learned from the labels beside them."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, trained(docs, table(spark, sf_dir, "labels")))
