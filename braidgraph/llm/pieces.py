"""Operator 5: SentencePiece BPE encoding and decoding by a merge-type prefix table.

For byte-pair merges in the order of their scores, the encoding of every prefix of a text has one
last token, and the encoding of the text is found by walking the last tokens backwards:

* an Aho-Corasick automaton over the vocabulary yields, for every position, all tokens that end there;
* of those, exactly one fits: the one that is compatible with the last token of the prefix before it.
  Two neighbours are compatible if undoing their merges, latest first, never meets a merge across
  their border that would have come earlier;
* the table keeps that token for every prefix; the ids are read off from the end.

Two characters that stand side by side in no piece are never merged, so a text is cut there into
segments (about a word each, without its punctuation), in numpy over a whole slice of texts.  New
segments of a slice go through the automaton together; known ones come from a bounded cache.
Characters outside the vocabulary are segments of byte tokens.

Pieces of space marks alone share the lowest score, so marks are merged last, and among equals the
leftmost pair goes first.  The last tokens of runs of marks are a table made by that rule; a run's last
mark belongs to the word behind it unless the word's own encoding leaves it alone.

Decoding gathers the bytes of the ids' pieces in numpy.

Cases: null or empty text gives the begin and end ids only.  Repeated rows repeat their result.  Other
columns are ignored.  A text of any length is worked on in windows of segments.  The model is read on
the driver and broadcast: its size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces as slices
from .common import table

MARK = "▁"
CACHED_SEGMENTS, CACHED_LENGTH, CACHED_PAIRS, WINDOW = 200_000, 64, 400_000, 1 << 20


def load(model: str) -> dict:
    """The vocabulary of a SentencePiece BPE model with byte fallback and identity normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "special" if sp.is_control(i) or sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal" for i in range(n)]
    return {"pieces": [sp.id_to_piece(i) for i in range(n)], "scores": [sp.get_score(i) for i in range(n)], "kinds": kinds, "bos": sp.bos_id(), "eos": sp.eos_id(), "unk": sp.unk_id()}


def run_lengths(lengths: set[int], n: int) -> list[int]:
    """Sizes of the tokens of n marks when the leftmost pair that makes a piece is merged first."""
    tokens = [1] * n
    while True:
        at = next((i for i in range(len(tokens) - 1) if tokens[i] + tokens[i + 1] in lengths), None)
        if at is None:
            return tokens
        tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]


class Pieces:
    """Encoder and decoder over a vocabulary of load()."""

    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.bos, self.eos = vocabulary["bos"], vocabulary["eos"]
        self.pieces, scores, kinds = vocabulary["pieces"], vocabulary["scores"], vocabulary["kinds"]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == "byte"}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == "normal"}
        self.when = [-1 if len(p) == 1 else i for i, p in enumerate(self.pieces)]
        self.length = [len(p) for p in self.pieces]
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self._marks(scores)
        automaton = ahocorasick.Automaton()
        known = sorted(p for p in self.ids if len(p) == 1)
        for p in known:
            automaton.add_word(p, self.ids[p])
        for i in sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-scores[i], i)):
            p = self.pieces[i]
            if MARK * 2 in p:
                continue
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is None or b is None or not (self._made(a) and self._made(b)) or max(self.when[a], self.when[b]) > i:
                    continue
                if self._compatible(a, b):
                    self.parts[i], self.merged[a, b] = (a, b), i
                    automaton.add_word(p, i)
                    break
        automaton.make_automaton()
        self.automaton = automaton
        self.cache: dict[str, bytes] = {}
        self._sides(known)
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "special" else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])

    def _marks(self, scores: list[float]) -> None:
        """Check what cutting and merging of space marks rest on, and make the table of runs."""
        runs = {len(p): i for p, i in self.ids.items() if set(p) == {MARK}}
        if any(MARK in p[1:] and set(p) != {MARK} for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        last = {scores[i] for n, i in runs.items() if n > 1}
        if 1 not in runs or len(last) > 1 or (last and min(last) >= min((scores[i] for p, i in self.ids.items() if len(p) > 1 and MARK * 2 not in p), default=0.0)):
            raise ValueError("pieces of space marks alone must share the lowest score")
        self.run_ids, self.run_most = runs, max(runs)
        lengths = set(runs)
        self.run_last = [0, *(run_lengths(lengths, n)[-1] for n in range(1, 4 * self.run_most + 1))]

    def _sides(self, known: list[str]) -> None:
        """Which known characters stand side by side in a piece."""
        self.index = np.zeros(0x110000, np.int16)
        self.index[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.kinds = len(known) + 1
        beside = np.zeros((self.kinds, self.kinds), bool)
        for p in self.ids:
            if len(p) > 1:
                i = self.index[[ord(c) for c in p]]
                beside[i[:-1], i[1:]] = True
        self.beside = beside.ravel()
        self.gap = next(chr(i) for i in range(0x110000) if not self.index[i])

    def _made(self, i: int) -> bool:
        return len(self.pieces[i]) == 1 or i in self.parts

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the border between tokens a and b survives all merges."""
        limit, when, parts, merged = 1 << 60, self.when, self.parts, self.merged
        while True:
            joint = merged.get((a, b))
            if joint is not None and joint < limit:
                return False
            if when[a] < 0 and when[b] < 0:
                return True
            if when[a] > when[b]:
                limit, a = when[a], parts[a][1]
            else:
                limit, b = when[b] + 1, parts[b][0]

    def _run(self, n: int) -> list[int]:
        """Ids of n marks: full ones while the rest has two more, then back along the table of last tokens."""
        full = max(0, n // self.run_most - 2)
        n -= full * self.run_most
        out = []
        while n:
            out.append(self.run_ids[self.run_last[n]])
            n -= self.run_last[n]
        return [self.run_ids[self.run_most]] * full + out[::-1]

    def _prefixes(self, cores: list[str]) -> list[list[int]]:
        """Ids of strings of known characters with at most one space mark, at their start."""
        joined = self.gap.join(cores)
        last, fits, length, compatible = [0] * (len(joined) + 1), self.fits, self.length, self._compatible
        if len(fits) > CACHED_PAIRS:
            self.fits = fits = dict(islice(fits.items(), len(fits) // 2, None))
        ends, at = [], 0
        for c in cores:
            last[at] = -1
            at += len(c)
            ends.append(at)
            at += 1
        for end, t in self.automaton.iter(joined):
            before = last[end + 1 - length[t]]
            if before > 0:
                pair = before << 20 | t
                ok = fits.get(pair)
                if ok is None:
                    ok = fits[pair] = compatible(before, t)
                if ok:
                    last[end + 1] = t
            elif before:
                last[end + 1] = t
        out = []
        for end, c in zip(ends, cores, strict=True):
            ids, begin = [], end - len(c)
            while end > begin:
                ids.append(last[end])
                end -= length[last[end]]
            out.append(ids[::-1])
        return out

    def _encoded(self, segments: list[str]) -> list[bytes]:
        """Packed ids of segments."""
        cores, runs, out = [], [], []
        for s in segments:
            core = s.lstrip(MARK)
            marks = len(s) - len(core)
            runs.append(marks)
            if core and self.index[ord(core[0])]:
                cores.append((MARK if marks else "") + core)
        found, mark = iter(self._prefixes(cores)), self.run_ids[1]
        for s, marks in zip(segments, runs, strict=True):
            if marks == len(s):
                ids = self._run(marks)
            elif not self.index[ord(s[marks])]:
                ids = self._run(marks) + [self.byte_ids[b] for b in s[marks:].encode("utf-8", "surrogatepass")]
            else:
                ids = next(found)
                if marks > 1:
                    alone = ids[0] == mark
                    ids = self._run(marks - (not alone)) + ids[alone:]
            out.append(ids)
        sizes = np.cumsum([len(x) for x in out]) * 4
        flat = np.array([i for x in out for i in x], "<u4").tobytes()
        return [flat[b - 4 * len(x) : b] for x, b in zip(out, sizes.tolist(), strict=True)]

    def _known(self, segments: list[str]) -> dict[str, bytes]:
        """A table that holds all these segments."""
        cache = self.cache
        new = [s for s in set(segments) if s not in cache]
        if new:
            packed = self._encoded(new)
            if max(map(len, new)) > CACHED_LENGTH or len(new) > CACHED_SEGMENTS // 2:
                own = dict(zip(new, packed, strict=True))
                own.update((s, cache[s]) for s in set(segments).difference(own))
                return own
            cache.update(zip(new, packed, strict=True))
            if len(cache) > CACHED_SEGMENTS:
                now = {s: cache[s] for s in set(segments)}
                self.cache = cache = dict(islice(cache.items(), len(cache) // 2, None))
                cache.update(now)
        return cache

    def packed(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of all texts one after another, without begin and end, as little-endian 32-bit integers; and where each
        text's begin, with the end of the last."""
        whole = "".join([MARK + t for t in texts if t]).replace(" ", MARK)
        starts = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        ids_at, out, done, pos, width = np.zeros(len(starts), np.int64), [], 0, 0, WINDOW
        while pos < len(whole):
            part = whole[pos : pos + width]
            codes = self.index[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
            apart = ~self.beside[codes[:-1].astype(np.int32) * self.kinds + codes[1:]]
            lo, hi = np.searchsorted(starts, [pos + 1, pos + len(part)])
            apart[starts[lo:hi] - pos - 1] = True
            cuts = np.flatnonzero(apart) + 1
            if pos + len(part) == len(whole):
                cuts = np.append(cuts, len(part))
            elif not len(cuts):
                width *= 2
                continue
            ends = cuts.tolist()
            segments = [part[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            known = self._known(segments)
            found = [known[s] for s in segments]
            after = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            lo, hi = np.searchsorted(starts, [pos, pos + ends[-1]], side="right")
            ids_at[lo:hi] = done + after[np.searchsorted(cuts, starts[lo:hi] - pos)]
            out.append(b"".join(found))
            done, pos, width = done + int(after[-1]), pos + ends[-1], WINDOW
        return b"".join(out), ids_at // 4

    def forget(self) -> None:
        """Give back what is cached; a worker outlives its task."""
        self.cache, self.fits = {}, {}

    def encode(self, text: str | None) -> np.ndarray:
        """Ids with the begin and end ids."""
        return np.concatenate([[self.bos], np.frombuffer(self.packed([text or ""])[0], "<u4"), [self.eos]]).astype("<u4")

    def spelled(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes that decoding gives for the ids of several texts, from ``starts[i]`` to ``starts[i + 1]``: control ids
        vanish, and one leading space is the encoder's own."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        at = np.concatenate([[0], ends])
        flat = self.raw[np.repeat(self.raw_at[ids] - at[:-1], size) + np.arange(int(at[-1]))].tobytes()
        shown = np.flatnonzero(size > 0)
        where = np.searchsorted(shown, starts[:-1])
        out = []
        for a, b, w in zip(at[starts[:-1]].tolist(), at[starts[1:]].tolist(), where.tolist(), strict=True):
            out.append(flat[a + bool(b > a and self.marked[ids[shown[w]]]) : b])
        return out

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD one by one."""
        ids = np.array(ids, np.int64)
        return _text(self.spelled(ids, np.array([0, len(ids)]))[0])


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _lenient(raw)


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_made: dict[int, Pieces] = {}


def _worker(shared) -> Pieces:
    """One encoder for each Python worker."""
    key = hash(tuple(shared.value["pieces"]))
    if key not in _made:
        _made.clear()
        _made[key] = Pieces(shared.value)
    return _made[key]


def tokenized(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, with ``ids`` and ``decoded`` too if
    ``keep_ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        own = _worker(shared)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (own.bos, own.eos))
        for batch in (part for whole in batches for part in slices(whole)):
            packed, at = own.packed([t or "" for t in batch.column("text").to_pylist()])
            texts = own.spelled(np.frombuffer(packed, "<u4"), at)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            rows = [bos + packed[4 * a : 4 * b] + eos for a, b in spans]
            decoded = [_text(t) for t in texts]
            columns = [pa.array([b - a + 2 for a, b in spans], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
            if keep_ids:
                columns += [pa.array([np.frombuffer(r, "<i4") for r in rows], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])
        own.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents."""
    return tokenized(table(spark, sf_dir, "documents"), model_path())
