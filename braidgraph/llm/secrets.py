"""Operator 10: secret scans by a character convolutional network.

*Base findings* are three patterns, leftmost and without overlap within a kind: ``assign`` (a named value of
12+ characters), ``access`` (AKIA keys of 18+) and ``hex`` (runs of 16+).  They always stay.

*Candidates* are all base findings and all other maximal runs of ``[A-Za-z0-9+/_.=-]`` of ``LEAST`` (12, the base's own
length) characters or more that hold a digit, or two capitals beside small letters (plain and shouted words hold neither).  A convolutional network in numpy
reads each whole candidate with ``CONTEXT`` characters on both sides: character embeddings and an inside/outside channel, one
convolution, maximum and mean over positions, a logistic output.  Padding takes no part in either, so a candidate has the
same probability in any batch; long candidates are read in chunks, whose maxima and sums are put together.  It is trained on
labelled findings made from a seed: tokens of many formats as positives; identifiers, paths, versions, dates, links, long
words and checksums named as such as negatives.  One held-out part calibrates its probabilities (Platt); another gives the
threshold: the highest at which recall is ``RECALL`` or above with 95 % confidence.  Candidates over the threshold that
overlap no base finding are added as kind ``model``.

Cases: null and empty texts have no finding.  Repeated rows repeat.  Positions are code points.  Other columns are
ignored.  The network has a fixed size and is broadcast.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEED, pieces, table

CONTEXT, RECALL, WIDTH, EMBED, FILTERS, LEAST, LONG = 24, 0.97, 5, 10, 24, 12, 1 << 14
KINDS = ("assign", "access", "hex", "model")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_RUN = "A-Za-z0-9+/_.=-"
_IS_HEX, _IS_RUN = np.zeros(129, bool), np.zeros(129, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_IS_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True


def _runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    return _findings(text)[0]


def _findings(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Base findings and all candidate runs."""
    if len(text) < 12:
        return [], []
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)
    out += [(a, b, "hex") for a, b in _runs(_IS_HEX[codes], 16)]
    runs = []
    for a, b in _runs(_IS_RUN[codes], LEAST):
        c = text[a:b]
        if any(map(str.isdigit, c)) or (sum(map(str.isupper, c)) > 1 and not c.isupper()):
            runs.append((a, b))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]))), runs


def window(text: str, start: int, end: int) -> tuple[np.ndarray, int, int]:
    """Codes of a candidate with its surroundings, and where it begins and ends in them."""
    a = max(0, start - CONTEXT)
    codes = np.minimum(np.frombuffer(text[a : end + CONTEXT].encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.int16)
    return codes, start - a, end - a


class CharNet:
    """Embedding, convolution, pooling and a logistic output; Adam on cross-entropy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (129, EMBED)),
            "c": rng.normal(0, (2 / (WIDTH * (EMBED + 1))) ** 0.5, (WIDTH * (EMBED + 1), FILTERS)),
            "b": np.zeros(FILTERS),
            "o": rng.normal(0, 0.2, 2 * FILTERS),
            "z": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def _batch(items: list[tuple[np.ndarray, int, int]]):
        size = max(len(x[0]) for x in items) + WIDTH - 1
        codes, inside = np.full((len(items), size), 128), np.zeros((len(items), size, 1))
        real = np.zeros((len(items), size - WIDTH + 1, 1))
        for i, (c, a, b) in enumerate(items):
            codes[i, WIDTH // 2 : WIDTH // 2 + len(c)] = c
            inside[i, WIDTH // 2 + a : WIDTH // 2 + b] = 1
            real[i, : len(c)] = 1
        length = np.array([b - a for _, a, b in items])
        return codes, inside, length, real

    def _convolved(self, codes, inside):
        x = np.concatenate([self.p["e"][codes], inside], axis=2)
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([x[:, j : j + n] for j in range(WIDTH)], axis=2)
        return cols, np.maximum(cols @ self.p["c"] + self.p["b"], 0)

    def _forward(self, items):
        codes, inside, length, real = self._batch(items)
        cols, h = self._convolved(codes, inside)
        h *= real
        core = inside[:, WIDTH // 2 : WIDTH // 2 + h.shape[1]]
        top, mean = h.argmax(axis=1), (h * core).sum(axis=1) / length[:, None]
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], mean], axis=1)
        return codes, inside, length, cols, h, core, top, pooled, pooled @ self.p["o"] + self.p["z"][0]

    def _long(self, item: tuple[np.ndarray, int, int]) -> float:
        """The score of one candidate of any length, chunk by chunk."""
        codes, inside, length, real = self._batch([item])
        top, total = np.zeros(FILTERS), np.zeros(FILTERS)
        for at in range(0, real.shape[1], LONG):
            _, h = self._convolved(codes[:, at : at + LONG + WIDTH - 1], inside[:, at : at + LONG + WIDTH - 1])
            core = inside[:, at + WIDTH // 2 : at + WIDTH // 2 + h.shape[1]]
            top, total = np.maximum(top, h[0].max(axis=0)), total + (h * core).sum(axis=(0, 1))
        return float(np.concatenate([top, total / length[0]]) @ self.p["o"] + self.p["z"][0])

    def raw(self, items: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
        """Uncalibrated scores to eight digits; items of like length share a batch."""
        out = np.zeros(len(items))
        order = sorted(range(len(items)), key=lambda i: len(items[i][0]))
        at = 0
        while at < len(order):
            if len(items[order[at]][0]) > LONG:
                out[order[at]] = self._long(items[order[at]])
                at += 1
                continue
            width, n = 0, 0
            while at + n < len(order) and n < 256:
                width = max(width, len(items[order[at + n]][0]))
                if width > LONG or (n and width * (n + 1) > 1 << 15):
                    break
                n += 1
            pick = order[at : at + n]
            out[pick] = self._forward([items[i] for i in pick])[-1]
            at += n
        return np.round(out, 8)

    def probability(self, items) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(items) + self.shift, -30, 30)))

    def fit(self, items, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = SEED):
        rng, m, s, t = np.random.default_rng(seed), {k: 0 * v for k, v in self.p.items()}, {k: 0 * v for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(items))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                codes, _, length, cols, h, core, top, pooled, raw = self._forward([items[i] for i in pick])
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
                g = {"o": pooled.T @ err, "z": np.array([err.sum()])}
                d = err[:, None] * self.p["o"]
                dh = core * (d[:, FILTERS:] / length[:, None])[:, None]
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + d[:, None, :FILTERS], 1)
                dh *= h > 0
                g["c"], g["b"] = cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, FILTERS), dh.sum(axis=(0, 1))
                dc = dh @ self.p["c"].T
                dx = np.zeros((*codes.shape, EMBED))
                for j in range(WIDTH):
                    dx[:, j : j + dh.shape[1]] += dc[:, :, j * (EMBED + 1) : j * (EMBED + 1) + EMBED]
                flat = codes.ravel()
                g["e"] = np.stack([np.bincount(flat, dx[:, :, k].ravel(), 129) for k in range(EMBED)], axis=1)
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, items, y: np.ndarray, recall: float = RECALL, apart=None):
        """Platt scaling on these findings, and the highest threshold that keeps ``recall`` on those ``apart`` (items, labels), or
        on these, with 95 % confidence."""
        raw, a, b = self.raw(items), 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            a, b = a - 0.05 * ((p - y) * raw).mean(), b - 0.05 * (p - y).mean()
        self.slope, self.shift = float(max(a, 1e-3)), float(b)
        items, y = apart or (items, y)
        p = np.sort(self.probability([x for x, t in zip(items, y, strict=True) if t]))
        missed = int(max(0, (1 - recall) * len(p) - 1.645 * (recall * (1 - recall) * len(p)) ** 0.5))
        self.threshold = float(p[missed] - 1e-9)
        return self


def labelled(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n labelled findings (text, start, end) with their labels, made from a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda cs, k: "".join(cs[i] for i in rng.integers(0, len(cs), k))
    syllables = [a + b + c for a in [*"bcdfghjklmnpqrstvwyz", "sch", "th", "st", "tr", "qu", "ch", ""] for b in [*"aeiouy", "ie", "ou", "ea"] for c in ["", "n", "r", "s", "t", "sch", "nt", "rst", "ng", "x"]]
    word = lambda a=1, b=4: "".join(pick(syllables) for _ in range(int(rng.integers(a, b))))
    alnum, url64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    num = lambda a, b: str(int(rng.integers(a, b)))
    positive = [
        lambda: chars(alnum, int(rng.integers(20, 64))),
        lambda: chars(alnum, int(rng.integers(12, 20))),
        lambda: chars(url64, 4 * int(rng.integers(6, 16)) - 1) + "=",
        lambda: chars(url64.replace("+", "-").replace("/", "_"), int(rng.integers(22, 60))),
        lambda: pick(["ghp_", "gho_", "glpat-", "npm_", "hf_"]) + chars(alnum, 36),
        lambda: pick(["sk-", "pk_live_", "sk_live_", "rk_test_", "key-"]) + chars(alnum, int(rng.integers(20, 48))),
        lambda: f"xox{pick('bpas')}-" + chars(string.digits, 11) + "-" + chars(alnum, 24),
        lambda: "eyJ" + chars(url64[:62], 30) + ".eyJ" + chars(url64[:62], 40) + "." + chars(url64[:62], 43),
        lambda: "AIza" + chars(alnum + "_-", 35),
        lambda: pick(["AKIA", "ASIA"]) + chars(string.ascii_uppercase + string.digits, 16),
        lambda: chars("0123456789abcdef", pick([32, 40, 64])),
        lambda: chars("0123456789ABCDEF", pick([32, 40, 64])),
        lambda: chars(string.ascii_uppercase + "234567", int(rng.integers(20, 40))),
    ]
    negative = [
        lambda: "_".join(word() for _ in range(int(rng.integers(3, 6)))) + num(0, 99),
        lambda: word().upper() + "_" + "_".join(word().upper() for _ in range(3)),
        lambda: "".join(word().capitalize() for _ in range(int(rng.integers(3, 6)))),
        lambda: "/".join(["", word(), word(), word() + num(0, 999), word() + pick([".py", ".html", ".txt", ".jpg"])]),
        lambda: "www." + word(3, 5) + num(1, 99) + pick([".com", ".org", ".example.net"]) + "/" + word(),
        lambda: f"{num(1990, 2030)}-{num(10, 12)}-{num(10, 28)}T{num(10, 23)}.{num(10, 59)}",
        lambda: word(2, 4) + "-" + num(0, 20) + "." + num(0, 20) + "." + num(0, 20) + pick(["-beta.1", "-rc2", "-linux-x86", ".dist-info"]),
        lambda: word(6, 10).upper(),
        lambda: word(3, 7).upper(),
        lambda: word(2, 5).upper() + pick(["KEIT", "CHEN", "SCHAFT", "LICH", "TION", "MENT", "DAD", "ING", "NESS"]) + pick(["", "", "."]),
        lambda: word(2, 4).capitalize() + word(2, 4).upper(),
        lambda: word(6, 10).upper() + pick([".", "", "-" + word().upper()]),
        lambda: word(5, 8).capitalize() + "." + word().capitalize(),
        lambda: "mail" + num(1, 99) + "." + pick(["example", word(2, 4)]) + "." + pick(["com", "org", "net"]),
        lambda: pick("=-_.xX0") * int(rng.integers(15, 60)) + num(0, 9),
        lambda: ".".join(num(0, 255) for _ in range(4)) + "." + num(1000, 99999),
        lambda: num(10**15, 10**16),
        lambda: num(10**6, 10**8) + "-" + num(10**6, 10**8) + "-" + num(100, 999),
        lambda: "-".join([chars("0123456789abcdef", 8), *(chars("0123456789abcdef", 4) for _ in range(3)), chars("0123456789abcdef", 12)]),
        lambda: word(2, 4) + "." + num(0, 99) + "." + word(2, 4) + "." + pick(["com", "example.com", "net"]),
        lambda: "-".join(word() for _ in range(int(rng.integers(4, 7)))) + "-" + num(1, 99),
    ]
    shown, plain = ["key", "token", "secret", "auth", "Authorization: Bearer", "credential", "private_key", "access", "pwd", "api"], ["commit", "sha256", "md5", "etag", "checksum", "digest", "revision", "build"]
    items, y = [], np.zeros(n)
    for i in range(n):
        bad = rng.random() < 0.5
        before = " ".join(word() for _ in range(int(rng.integers(0, 6))))
        after = " ".join(word() for _ in range(int(rng.integers(0, 6))))
        if bad:
            found = pick(positive)()
            if rng.random() < 0.5:
                before += f" {pick(shown)}{pick([' = ', '=', ': ', ' '])}{pick(['', chr(34)])}"
            else:
                before += " "
        else:
            found = pick(negative)()
            before += " "
            if rng.random() < 0.15:
                found, before = chars("0123456789abcdef", pick([32, 40, 64])), before + pick(plain) + pick([" ", ": ", "="])
        items.append((before + found + pick([" ", ". ", '" ', "\n"]) + after, len(before), len(before) + len(found)))
        y[i] = bad
    return items, y


_trained: dict[tuple, CharNet] = {}


def trained(n: int = 4000, seed: int = SEED) -> CharNet:
    """The network for a seed, trained on n labelled findings, calibrated on half as many others and its threshold taken on as
    many others again."""
    if (n, seed) not in _trained:
        sets = [labelled(max(k, 300), seed + i) for i, k in enumerate((n, n // 2, n))]
        (items, y), *rest = [([window(*x) for x in items], y) for items, y in sets]
        net = CharNet(seed).fit(items, y)
        _trained[n, seed] = net.calibrate(*rest[0], apart=rest[1])
    return _trained[n, seed]


def scan(texts: list[str | None], net: CharNet) -> list[list[tuple[int, int, str, float]]]:
    """All findings (start, end, kind, probability) of each text, base and added."""
    where, items, found = [], [], []
    for i, text in enumerate(texts):
        base, runs = _findings(text or "")
        found.append([])
        for a, b, kind in base:
            where.append((i, a, b, kind))
            items.append(window(text, a, b))
        at = 0
        ends = sorted((a, b) for a, b, _ in base)
        for a, b in runs:
            while at < len(ends) and ends[at][1] <= a and at + 1 < len(ends):
                at += 1
            if not any(x < b and y > a for x, y in ends[max(0, at - 3) : at + 4]):
                where.append((i, a, b, "model"))
                items.append(window(text, a, b))
    if items:
        for (i, a, b, kind), p in zip(where, net.probability(items).tolist(), strict=True):
            if kind != "model" or p >= net.threshold:
                found[i].append((a, b, kind, p))
    return [sorted(x, key=lambda f: (f[0], KINDS.index(f[2]))) for x in found]


def _spelled(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in spans)


def secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """doc_id, findings array<struct<start, end, kind, probability>> for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                found = scan(part.column("text").to_pylist(), shared.value)
                rows = [[dict(zip(("start", "end", "kind", "probability"), f, strict=True)) for f in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "findings"])

    schema = "doc_id long, findings array<struct<start: long, `end`: long, kind: string, probability: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents."""
    found = secrets(table(spark, sf_dir, "documents"))
    spelled = lambda xs: F.array_join(F.transform(xs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("model"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("findings")).alias("spans"))
