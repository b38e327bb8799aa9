"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch of documents."""

from __future__ import annotations

import numpy as np

from .common import SEED, mixed

_rng = np.random.default_rng(SEED)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _power(base: int, n: int, slot: int) -> np.ndarray:
    if len(_powers[slot]) < n:
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        _powers[slot] = np.multiply.accumulate(a)
    return _powers[slot]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after another, words of each text).

    A word is a run of bytes other than ASCII white space; A-Z count as a-z.
    """
    joined = b" ".join(texts) + b" "
    b = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    n = len(b)
    h = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[b] * _power(_BASE, n, 0)[:n], out=h[1:])
    w = (h[ends] - h[starts]) * _power(_INVERSE, n, 1)[starts]
    w = mixed(w + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return w, counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text.

    A text of fewer words has its whole word sequence as its only shingle; one without words
    has none.  Two different shingles share a 64-bit hash with a chance of about 1e-19.
    """
    if not texts:
        return []
    w, counts = words(texts)
    total = len(w)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, total - k + 1), dtype=np.uint64)
        for j in range(k):
            roll = mixed(roll + w[j : total - k + 1 + j] + np.uint64(j + 1)) if len(roll) else roll
        out, at = [], 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(roll[at : at + n - k + 1]))
            elif n:
                one = np.zeros(1, dtype=np.uint64)
                for j in range(n):
                    one = mixed(one + w[at + j] + np.uint64(1000 * n + j))
                out.append(one)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += n
    return out
