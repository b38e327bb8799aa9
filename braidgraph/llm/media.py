"""Operator 8: media columns as baseline JPEG, coded and read in numpy.

*Reading* parses the markers of a baseline JPEG (8-bit Huffman, any sampling, restart intervals), decodes
its first scan with luminance and rebuilds the luminance thumbnail from the DC terms alone.  All restart intervals of a batch
of files are decoded in lockstep: one numpy step reads the next Huffman symbol of every interval.  Files of few and long
intervals, as most photographs are, are read symbol by symbol with the same tables.

*Payloads.*  A payload of bytes is stored losslessly in the format's own unit, the quantised coefficient:
64 bytes are one 8x8 block of a grey image, coefficient = byte - 128 in zigzag order, all quantisers 1 and a
restart interval for every block.  Entropy coding is exact, so reading the stored file gives the bytes back.
The image is about square; blocks past the payload are 0 and a comment marker holds the payload's length.

Cases: null text is empty; empty payloads are one block of zeros.  Files that are no baseline JPEG, are cut short, claim
more blocks than their scan can hold, or have tables or counts that don't fit get null dimensions and an ``error`` instead of
failing the job.  A comment that is no payload length of the file gives a null payload.  Repeated rows repeat.  Long texts
are coded in chunks of blocks.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, text_bytes

CHUNK = 1 << 15
_REST = [r << 4 | s for r in range(1, 16) for s in range(1, 9)] + [0xF0]
#: Huffman tables of the writer: (codes of each length 1..16, symbols).  Text gives mostly sizes 5, 4 and 7.
DC_TABLE = ([1, 0, 2, 2, 2, 2] + [0] * 10, [5, 4, 7, 3, 6, 0, 8, 1, 2])
AC_TABLE = ([1, 0, 2, 2, 2, 2, 0, 0, 0, 0, 0, 0, len(_REST), 0, 0, 0], [5, 4, 7, 3, 6, 0, 8, 1, 2, *_REST])


class BadJpeg(ValueError):
    pass


def _codes(spec) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of the canonical code."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(spec[0], 1):
        for s in spec[1][at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _coder(spec) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in _codes(spec).items():
        code[s], length[s] = c, n
    return code, length


def _lookup(spec) -> np.ndarray:
    """For each 16-bit window: length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for s, (c, n) in _codes(spec).items():
        if c >> n:
            raise BadJpeg("overfull Huffman table")
        out[c << (16 - n) : (c + 1) << (16 - n)] = n << 8 | s
    return out


_SIZE = np.array([int(abs(x)).bit_length() for x in range(-2048, 2049)])
_DC, _AC = _coder(DC_TABLE), _coder(AC_TABLE)


def _scan(blocks: np.ndarray, last: bool, first: int) -> bytes:
    """Entropy-coded data of int blocks (n, 64), each a restart interval; ``first`` is the index of the
    first in its image."""
    n = len(blocks)
    value = blocks.astype(np.int64)
    size = _SIZE[value + 2048]
    k = np.arange(64)
    filled = np.where((value != 0) | (k == 0), k, -1)
    before = np.maximum.accumulate(filled, axis=1)
    run = k - 1 - np.concatenate([np.zeros((n, 1), int), before[:, :-1]], axis=1)
    used = (value != 0) | (k == 0)
    block, at = np.nonzero(used)
    v, s, r = value[block, at], size[block, at], np.where(at == 0, 0, run[block, at])
    code = np.where(at == 0, _DC[0][s], _AC[0][(r & 15) << 4 | s])
    length = np.where(at == 0, _DC[1][s], _AC[1][(r & 15) << 4 | s])
    extra = np.where(v < 0, v + (1 << s) - 1, v)
    word, bits, order = code << s | extra, length + s, (block * 130 + at * 2 + 1).astype(np.int64)
    zrl = r >> 4
    if zrl.any():
        i = np.repeat(np.flatnonzero(zrl), zrl[zrl > 0])
        word, bits, order, block = np.append(word, _AC[0][0xF0] + 0 * i), np.append(bits, _AC[1][0xF0] + 0 * i), np.append(order, order[i] - 1), np.append(block, block[i])
    short = np.flatnonzero(before[:, -1] < 63)
    if len(short):
        word, bits, order, block = np.append(word, _AC[0][0] + 0 * short), np.append(bits, _AC[1][0] + 0 * short), np.append(order, short * 130 + 129), np.append(block, short)
    if zrl.any() or len(short):
        sort = np.argsort(order, kind="stable")
        word, bits, block = word[sort], bits[sort], block[sort]
    total = np.bincount(block, bits, n).astype(np.int64)
    size_b = (total + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(size_b)])
    ends = np.cumsum(bits)
    first_bit = np.concatenate([[0], np.cumsum(total)])[:-1]
    pos = ends - bits - first_bit[block] + 8 * starts[block]
    window = word << (32 - bits - (pos & 7))
    out = np.zeros(starts[-1] + 4)
    for j in range(4):
        out += np.bincount((pos >> 3) + j, (window >> (24 - 8 * j)) & 255, len(out))
    data = out[: starts[-1]].astype(np.uint8)
    data[starts[1:] - 1] |= ((1 << (8 * size_b - total)) - 1).astype(np.uint8)
    stuffed = data == 255
    place = np.arange(len(data)) + np.concatenate([[0], np.cumsum(stuffed)[:-1]])
    place += 2 * np.repeat(np.arange(n), size_b)
    final = np.zeros(len(data) + int(stuffed.sum()) + 2 * n, np.uint8)
    final[place] = data
    tail = place[starts[1:] - 1] + 1 + stuffed[starts[1:] - 1]
    final[tail] = 255
    final[tail + 1] = 0xD0 + (np.arange(first, first + n) & 7)
    return final[:-2].tobytes() if last else final.tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def store(payload: bytes) -> bytes:
    """A baseline JPEG that holds a payload whose length is a positive multiple of 64."""
    n = len(payload) // 64
    wide = int(np.ceil(np.sqrt(n)))
    high = -(-n // wide)
    if not n or len(payload) % 64 or max(wide, high) > 8191:
        raise ValueError("the payload must be a positive multiple of 64 bytes, below 4 GB")
    head = b"\xff\xd8" + _segment(0xFE, b"payload=%d" % len(payload)) + _segment(0xDB, b"\0" + b"\1" * 64)
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0))
    for kind, spec in ((0x00, DC_TABLE), (0x10, AC_TABLE)):
        head += _segment(0xC4, bytes([kind, *spec[0], *spec[1]]))
    head += _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")
    blocks, out = wide * high, [head]
    for at in range(0, blocks, CHUNK):
        count = min(CHUNK, blocks - at)
        part = np.zeros((count, 64), np.int16)
        own = np.frombuffer(payload[64 * at : 64 * (at + count)], np.uint8).reshape(-1, 64)
        part[: len(own)] = own.astype(np.int16) - 128
        out.append(_scan(part, at + count == blocks, at))
    return b"".join(out) + b"\xff\xd9"


def parse(data: bytes) -> dict:
    """Frame, tables and the place of the scan of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    out: dict = {"dc": {}, "ac": {}, "q": {}, "restart": 0, "comment": b""}
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 255:
            raise BadJpeg("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise BadJpeg("cut short")
        if marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = 64 << (body[0] >> 4)
                if body[0] >> 4 > 1 or len(body) < 1 + wide:
                    raise BadJpeg("quantisers cut short")
                out["q"][body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if body[0] >> 4 else np.uint8).astype(int)
                body = body[1 + wide :]
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or not 1 <= body[5] <= 4 or len(body) < 6 + 3 * body[5]:
                raise BadJpeg("frame cut short")
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8 or not high or not wide:
                raise BadJpeg("not 8-bit or without size")
            if not all(1 <= x[1] <= 4 and 1 <= x[2] <= 4 for x in parts) or len({x[0] for x in parts}) < n:
                raise BadJpeg("odd components")
            out |= {"width": wide, "height": high, "parts": parts}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg("not baseline")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                if len(counts) < 16 or sum(counts) > 256 or len(body) < 17 + sum(counts):
                    raise BadJpeg("Huffman table cut short")
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            if len(body) < 2:
                raise BadJpeg("restart interval cut short")
            out["restart"] = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            if "parts" not in out:
                raise BadJpeg("scan without frame")
            ids = [x[0] for x in out["parts"]]
            if not body or len(body) < 1 + 2 * body[0] or not set(own := [body[1 + 2 * i] for i in range(body[0])]) <= set(ids) or len(set(own)) < len(own):
                raise BadJpeg("odd scan")
            out["of"] = [ids.index(x) for x in own]
            out["tables"] = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            out["scan"] = at + 2 + size
            if 0 in out["of"]:
                return out
            rest = np.frombuffer(data, np.uint8)[at + 2 + size :]
            marks = np.flatnonzero((rest[:-1] == 255) & (rest[1:] != 0) & (rest[1:] != 255) & ((rest[1:] < 0xD0) | (rest[1:] > 0xD7)))
            if not len(marks):
                raise BadJpeg("no scan with luminance")
            at += 2 + size + int(marks[0])
            continue
        elif marker == 0xD9:
            raise BadJpeg("no scan")
        at += 2 + size


def _intervals(data: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Unstuffed bytes of a scan and the offsets where its restart intervals begin."""
    b = np.frombuffer(data, np.uint8)[start:]
    ff = np.flatnonzero(b[:-1] == 255)
    after = b[ff + 1]
    end = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]
    stop = int(end[0]) if len(end) else len(b)
    keep = np.ones(len(b), bool)
    restarts = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < stop)]
    keep[ff[after == 0] + 1] = False
    keep[restarts] = False
    keep[restarts + 1] = False
    keep[stop:] = False
    place = np.cumsum(keep)
    return b[keep], np.concatenate([[0], place[restarts]])


def _lockstep(raw: np.ndarray, begin: np.ndarray, todo: np.ndarray, kinds: list[tuple], dc: dict, ac: dict) -> np.ndarray:
    """Coefficients (interval, block, 64) of intervals that begin at bytes ``begin`` and hold ``todo`` blocks.

    kinds: for each block of an MCU its (part, DC table, AC table)."""
    b = np.concatenate([raw, np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    ends = 8 * len(raw) + 16
    tables = np.stack([_lookup(dc[i]) for i in sorted(dc)] + [_lookup(ac[i]) for i in sorted(ac)]).ravel()
    dcs = np.array([sorted(dc).index(k[1]) for k in kinds]) << 16
    acs = np.array([len(dc) + sorted(ac).index(k[2]) for k in kinds]) << 16
    part = np.array([k[0] for k in kinds])
    lanes = np.flatnonzero(todo > 0)
    most = int(todo.max()) if len(todo) else 0
    out = np.zeros((len(begin), max(most, 1), 64), np.int16)
    flat = out.reshape(-1)
    pos, k, block = begin[lanes].astype(np.int64) * 8, np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    pred = np.zeros((len(begin), int(part.max()) + 1), np.int64)
    cycle = len(kinds)
    while len(lanes):
        if (pos > ends).any():
            raise BadJpeg("scan cut short")
        kind = block % cycle if cycle > 1 else 0
        peek = (window[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        is_dc = k == 0
        found = tables[np.where(is_dc, dcs[kind], acs[kind]) + peek]
        if (found == 0).any():
            raise BadJpeg("no such code")
        symbol = found & 255
        pos += found >> 8
        size = symbol & 15
        bits = (window[np.minimum(pos >> 3, len(window) - 1)].astype(np.int64) << (pos & 7) & 0xFFFFFFFF) >> (32 - size)
        value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
        value[size == 0] = 0
        pos += size
        run = symbol >> 4
        if is_dc.any():
            d = np.flatnonzero(is_dc)
            p = part[kind[d]] if cycle > 1 else part[0]
            pred[lanes[d], p] += value[d]
            value[d] = pred[lanes[d], p]
            run = np.where(is_dc, 0, run)
        k += run
        store_at = is_dc | (size > 0)
        if (k[store_at] > 63).any():
            raise BadJpeg("run past the block")
        w = np.flatnonzero(store_at)
        flat[(lanes[w] * out.shape[1] + block[w]) * 64 + k[w]] = value[w]
        k += 1
        k[~is_dc & (symbol == 0)] = 64
        over = k >= 64
        if over.any():
            block[over] += 1
            k[over] = 0
            left = block < todo[lanes]
            if not left.all():
                lanes, pos, k, block = lanes[left], pos[left], k[left], block[left]
    return out


@lru_cache(maxsize=64)
def _listed(lengths: tuple, symbols: tuple) -> list[int]:
    return _lookup((lengths, symbols)).tolist()


def _one_by_one(p: dict) -> None:
    """Coefficients of a file, symbol by symbol."""
    raw, kinds, out_at, out_value = p["raw"].tobytes() + b"\xff" * 8, p["kinds"], [], []
    ends, cycle, block = 8 * len(p["raw"]) + 16, len(p["kinds"]), 0
    tables = [(k[0], *(_listed(*map(tuple, t)) for t in (p["dc"][k[1]], p["ac"][k[2]]))) for k in kinds]
    word = int.from_bytes
    for begin, todo in zip(p["begin"].tolist(), p["todo"].tolist(), strict=True):
        pos, pred = 8 * begin, [0] * (1 + max(k[0] for k in kinds))
        for n in range(todo):
            part, dc, table = tables[n % cycle]
            k, symbols = 0, dc
            while k < 64:
                at = pos >> 3
                found = symbols[word(raw[at : at + 4], "big") >> (16 - (pos & 7)) & 0xFFFF]
                if not found or pos > ends:
                    raise BadJpeg("no such code" if pos <= ends else "scan cut short")
                pos += found >> 8
                size = found & 15
                value = 0
                if size:
                    at = pos >> 3
                    value = (word(raw[at : at + 4], "big") << (pos & 7) & 0xFFFFFFFF) >> (32 - size)
                    pos += size
                    if value < 1 << (size - 1):
                        value -= (1 << size) - 1
                if symbols is dc and not k:
                    pred[part] += value
                    out_at.append(64 * block)
                    out_value.append(pred[part])
                    symbols, k = table, 1
                    continue
                run = (found & 255) >> 4
                if size:
                    k += run
                    if k > 63:
                        raise BadJpeg("run past the block")
                    out_at.append(64 * block + k)
                    out_value.append(value)
                    k += 1
                elif found & 255:
                    k += run + 1
                else:
                    break
            block += 1
    out = np.zeros(64 * block, np.int16)
    out[out_at] = np.array(out_value, np.int64).astype(np.int16)
    p["all"] = out.reshape(-1, 64)


def _layout(p: dict) -> tuple[list[tuple], int, int]:
    """Blocks of an MCU as (part, DC table, AC table), and MCUs across and down."""
    wide, high = max(x[1] for x in p["parts"]), max(x[2] for x in p["parts"])
    if len(p["of"]) == 1:
        _, w, h, _ = p["parts"][p["of"][0]]
        return [(0, *p["tables"][0])], -(-(-(-p["width"] * w // wide)) // 8), -(-(-(-p["height"] * h // high)) // 8)
    kinds = [(i, *t) for i, t in zip(p["of"], p["tables"], strict=True) for _ in range(p["parts"][i][1] * p["parts"][i][2])]
    return kinds, -(-p["width"] // (8 * wide)), -(-p["height"] // (8 * high))


#: Files with fewer restart intervals are read symbol by symbol.
FEW = 48


def read(files: list[bytes]) -> list[dict]:
    """For each file width, height, comment, thumbnail (DC luminance, one sample a block, uint8) and the
    coefficients (block, 64) of its first part in zigzag order; or ``error``."""
    parsed: list[dict] = []
    groups: dict = {}
    for i, data in enumerate(files):
        try:
            p = parse(data)
            kinds, mw, mh = _layout(p)
            for _, d, a in kinds:
                if d not in p["dc"] or a not in p["ac"]:
                    raise BadJpeg("table missing")
            raw, begin = _intervals(data, p["scan"])
            blocks, each = mw * mh * len(kinds), (p["restart"] or mw * mh) * len(kinds)
            if len(begin) != -(-blocks // each):
                raise BadJpeg("restart markers missing")
            if blocks > 4 * len(raw):
                raise BadJpeg("scan cut short")  # a block has two codes at least
            todo = np.full(len(begin), each)
            todo[-1] = blocks - each * (len(begin) - 1)
            p |= {"kinds": kinds, "mcus": (mw, mh), "raw": raw, "begin": begin, "todo": todo}
            if len(begin) < FEW < blocks:
                _one_by_one(p)
            else:
                groups.setdefault(repr((kinds, sorted(p["dc"].items()), sorted(p["ac"].items()))), []).append(i)
        except BadJpeg as e:
            p = {"error": str(e)}
        parsed.append(p)
    for members in groups.values():
        while members:
            now, total = [], 0
            while members and (not now or total + len(parsed[members[0]]["begin"]) <= 2 * CHUNK):
                now.append(members.pop(0))
                total += len(parsed[now[-1]]["begin"])
            try:
                _decode([parsed[i] for i in now])
            except BadJpeg:
                for i in now:
                    try:
                        _decode([parsed[i]])
                    except BadJpeg as e:
                        parsed[i] = {"error": str(e)}
    return [_finished(p) for p in parsed]


def _decode(parts: list[dict]) -> None:
    """Coefficients of files that share their tables, in slices of intervals."""
    raw = np.concatenate([p["raw"] for p in parts])
    base = np.concatenate([[0], np.cumsum([len(p["raw"]) for p in parts])])
    begin = np.concatenate([p["begin"] + o for p, o in zip(parts, base, strict=False)])
    todo = np.concatenate([p["todo"] for p in parts])
    out = []
    for at in range(0, len(begin), 2 * CHUNK):
        lo, hi = int(begin[at]), int(begin[at + 2 * CHUNK]) if at + 2 * CHUNK < len(begin) else len(raw)
        got = _lockstep(raw[lo:hi], begin[at : at + 2 * CHUNK] - lo, todo[at : at + 2 * CHUNK], parts[0]["kinds"], parts[0]["dc"], parts[0]["ac"])
        out.append(got.reshape(-1, 64) if (todo[at : at + 2 * CHUNK] == got.shape[1]).all() else np.concatenate([g[:t] for g, t in zip(got, todo[at : at + 2 * CHUNK], strict=True)]))
    coefficients = np.concatenate(out)
    cuts = np.cumsum([int(p["todo"].sum()) for p in parts])[:-1]
    for p, c in zip(parts, np.split(coefficients, cuts), strict=True):
        p["all"] = c


def _finished(p: dict) -> dict:
    if "error" in p:
        return {"width": None, "height": None, "comment": b"", "thumbnail": None, "coefficients": None, "error": p["error"]}
    mw, mh = p["mcus"]
    own = [i for i, k in enumerate(p["kinds"]) if k[0] == 0]
    mine = p["all"].reshape(mw * mh, len(p["kinds"]), 64)[:, own]
    _, w, h, _ = p["parts"][0]
    rows, cols = -(-(-(-p["height"] * h // max(x[2] for x in p["parts"]))) // 8), -(-(-(-p["width"] * w // max(x[1] for x in p["parts"]))) // 8)
    if len(p["of"]) == 1:
        w = h = 1
    q = p["q"].get(p["parts"][0][3])
    dc = mine[:, :, 0].reshape(mh, mw, h, w).transpose(0, 2, 1, 3).reshape(mh * h, mw * w).astype(float)
    light = np.clip(np.round(dc * (q[0] if q is not None else 1) / 8 + 128), 0, 255).astype(np.uint8)
    return {"width": p["width"], "height": p["height"], "comment": p["comment"], "thumbnail": light[:rows, :cols], "coefficients": mine.reshape(-1, 64), "error": None}


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash of a thumbnail sampled to 8 rows of 9."""
    y = (np.arange(8) * thumb.shape[0] + thumb.shape[0] // 2) // 8
    x = (np.arange(9) * thumb.shape[1] + thumb.shape[1] // 2) // 9
    small = thumb[np.minimum(y, thumb.shape[0] - 1)][:, np.minimum(x, thumb.shape[1] - 1)].astype(int)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def payload_of(found: dict) -> bytes | None:
    """The payload that store() put into a file, from what read() gives for it; None if it holds none."""
    comment = found["comment"]
    if not comment.startswith(b"payload=") or not comment[8:].isdigit() or len(comment) > 24:
        return None
    n = int(comment[8:])
    if n % 64 or not 0 < n <= found["coefficients"].size:
        return None
    return (found["coefficients"][: n // 64] + 128).astype(np.uint8).tobytes()


def _padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored JPEG) for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                texts = text_bytes(part.column("text"))
                files = [store(_padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(files: DataFrame, column: str = "media") -> DataFrame:
    """Adds width, height, thumbnail (one byte a block, row by row), thumbnail_hash, error, and the payload of
    files made by store(); columns of these names are replaced."""
    added = {"width", "height", "thumbnail", "thumbnail_hash", "payload", "error"} - {column.lower()}
    names = [c for c in files.columns if c.lower() not in added]
    files = files.select(*names)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, column, 1 << 20):
                found = read([x or b"" for x in part.column(column).to_pylist()])
                ok = [f["error"] is None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([f["width"] for f in found], pa.int32()),
                        pa.array([f["height"] for f in found], pa.int32()),
                        pa.array([f["thumbnail"].tobytes() if g else None for f, g in zip(found, ok, strict=True)], pa.binary()),
                        pa.array([thumbnail_hash(f["thumbnail"]) if g else None for f, g in zip(found, ok, strict=True)], pa.string()),
                        pa.array([payload_of(f) if g else None for f, g in zip(found, ok, strict=True)], pa.binary()),
                        pa.array([f["error"] for f in found], pa.string()),
                    ],
                    names=[*names, "width", "height", "thumbnail", "thumbnail_hash", "payload", "error"],
                )

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.mapInArrow(run, f"{kinds}, width int, height int, thumbnail binary, thumbnail_hash string, payload binary, error string")


def _recorded(batches):
    """Texts stored, read back and described, all in one pass."""
    for part in (p for batch in batches for p in pieces(batch)):
        texts = text_bytes(part.column("text"))
        files = [store(_padded(t)) for t in texts]
        rows = []
        for t, m, f in zip(texts, files, read(files), strict=True):
            p, thumb = payload_of(f), f["thumbnail"]
            rows.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{f['width']}x{f['height']}:{thumbnail_hash(thumb)}"))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document stored as a JPEG, read back and described."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_recorded, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
