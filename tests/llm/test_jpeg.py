"""Operator 8: files of any sampling against a writer and a bit-by-bit reader of the test's own, odd files, and the whole query."""

import hashlib
import random
import struct

import numpy as np
import pytest

from braidgraph.llm import media

_ZEROS = [0] * 16


def _flat(symbols):
    """A Huffman table in which all codes have one length."""
    n = max(1, (len(symbols)).bit_length())
    return [*_ZEROS[: n - 1], len(symbols), *_ZEROS[n:]], symbols


DC = _flat(list(range(12)))
AC = _flat([0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)])


def _bits(table, symbol):
    code, at = 0, 0
    for length, n in enumerate(table[0], 1):
        for s in table[1][at : at + n]:
            if s == symbol:
                return format(code, f"0{length}b")
            code += 1
        at += n
        code <<= 1
    raise KeyError(symbol)


def _number(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def written(width, height, parts, restart, seed, apart=False):
    """(file, coefficients of the blocks of its first part in the order of the scan): one string of bits after another.

    parts: (across, down) of each; apart: a scan for each part, the last part first."""
    rng = random.Random(seed)
    wide, high = max(a for a, _ in parts), max(b for _, b in parts)
    segment = lambda m, body: struct.pack(">BBH", 255, m, len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([10 + i, a << 4 | b, 0]) for i, (a, b) in enumerate(parts)))
    out += segment(0xC4, bytes([0x00, *DC[0], *DC[1]])) + segment(0xC4, bytes([0x10, *AC[0], *AC[1]]))
    out += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    up = lambda a, b: -(-a // b)
    first = []
    scans = [[i] for i in reversed(range(len(parts)))] if apart else [list(range(len(parts)))]
    for own in scans:
        out += segment(0xDA, bytes([len(own), *(x for i in own for x in (10 + i, 0)), 0, 63, 0]))
        if len(own) == 1:
            a, b = parts[own[0]]
            mcus, order = up(up(width * a, wide), 8) * up(up(height * b, high), 8), own
        else:
            mcus, order = up(width, 8 * wide) * up(height, 8 * high), [i for i in own for _ in range(parts[i][0] * parts[i][1])]
        bits, pred, marks, data = "", [0] * len(parts), 0, b""

        def flush(bits):
            bits += "1" * (-len(bits) % 8)
            raw = int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
            return raw.replace(b"\xff", b"\xff\0")

        for m in range(mcus):
            if restart and m and m % restart == 0:
                data += flush(bits) + bytes([255, 0xD0 + marks % 8])
                bits, pred, marks = "", [0] * len(parts), marks + 1
            for i in order:
                block = [rng.randrange(-900, 900)] + [rng.choice([0] * 9 + [1, -1, 5, -60]) if rng.random() < 0.5 else 0 for _ in range(63)]
                n, extra = _number(block[0] - pred[i])
                bits += _bits(DC, n) + extra
                pred[i], run = block[0], 0
                for v in block[1:]:
                    if not v:
                        run += 1
                        continue
                    bits += _bits(AC, 0xF0) * (run // 16)
                    n, extra = _number(v)
                    bits += _bits(AC, run % 16 << 4 | n) + extra
                    run = 0
                bits += _bits(AC, 0) if run else ""
                if i == 0:
                    first.append(block)
        out += data + flush(bits)
    return out + b"\xff\xd9", np.array(first)


@pytest.mark.parametrize("few", [48, 0, 10**9])
@pytest.mark.parametrize("restart", [0, 1, 5])
@pytest.mark.parametrize(("size", "parts", "apart"), [((50, 37), [(1, 1)], False), ((70, 41), [(2, 2), (1, 1), (1, 1)], False), ((33, 70), [(2, 1), (1, 1), (1, 1)], False), ((40, 40), [(1, 1)] * 3, False), ((61, 45), [(2, 2), (1, 1), (1, 1)], True), ((30, 90), [(1, 2), (1, 2), (1, 1)], False), ((17, 9), [(2, 2)], False)])
def test_any_sampling(monkeypatch, size, parts, apart, restart, few):
    """Lanes in lockstep and symbol by symbol read what was written."""
    monkeypatch.setattr(media, "FEW", few)
    data, blocks = written(*size, parts, restart, repr((size, restart)), apart)
    found = media.read([data])[0]
    assert found["error"] is None and (found["width"], found["height"]) == size
    assert (found["coefficients"] == blocks).all()
    a, b = parts[0]
    wide, high = max(x for x, _ in parts), max(y for _, y in parts)
    rows, cols = -(-(-(-size[1] * b // high)) // 8), -(-(-(-size[0] * a // wide)) // 8)
    grid = np.zeros((rows + 8, cols + 8))
    single = apart or len(parts) == 1
    if single:
        a = b = 1
    across = cols if single else -(-size[0] // (8 * wide))
    for n, block in enumerate(blocks):
        m, k = divmod(n, a * b)
        grid[m // across * b + k // a, m % across * a + k % a] = min(255, max(0, round(block[0] * 8 / 8 + 128)))
    assert (found["thumbnail"] == grid[:rows, :cols]).all()


def _read_bits(data):
    """(coefficients) of a grey file with a restart interval for every block, bit by bit."""
    at, tables, wide, high = 2, {}, 0, 0
    while data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xC4:
            codes, code, i = {}, 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[format(code, f"0{length}b")] = body[i]
                    code, i = code + 1, i + 1
                code <<= 1
            tables[body[0] >> 4] = codes
        if data[at + 1] == 0xC0:
            high, wide = struct.unpack_from(">HH", body, 1)
        at += 2 + size
    at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    raw, lanes = data[at:-2], [bytearray()]
    i = 0
    while i < len(raw):
        if raw[i] == 255 and raw[i + 1]:
            lanes.append(bytearray())
        else:
            lanes[-1].append(raw[i])
        i += 2 if raw[i] == 255 else 1
    out = []
    for lane in lanes:
        bits, pos, block, k = "".join(format(b, "08b") for b in lane), 0, [0] * 64, 0
        while k < 64:
            n = next(n for n in range(1, 17) if bits[pos : pos + n] in tables[k > 0])
            symbol = tables[k > 0][bits[pos : pos + n]]
            pos += n
            run, size = symbol >> 4, symbol & 15
            if k and not symbol:
                break
            k += run if k else 0
            if size:
                v = int(bits[pos : pos + size], 2)
                block[k] = v if v >> (size - 1) else v - (1 << size) + 1
                pos += size
            k += 1
        out.append(block)
    return wide, high, out


def test_query_against_a_reader_bit_by_bit(spark, sf_dir):
    """Every column of the query, from the stored files of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    files = {r["doc_id"]: bytes(r["media"]) for r in media.media(docs).collect()}
    rows = {r["doc_id"]: r for r in media.op8_media(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for i in sorted(texts, key=lambda i: len(texts[i]))[:120]:
        wide, high, blocks = _read_bits(files[i])
        want = texts[i] + b"\0" * (-len(texts[i]) % 64 if texts[i] else 64)
        assert bytes(x + 128 for b in blocks for x in b)[: len(want)] == want
        light = [[min(255, max(0, round(blocks[y * (wide // 8) + x][0] / 8 + 128))) for x in range(wide // 8)] for y in range(high // 8)]
        rows_, cols = len(light), len(light[0])
        small = [[light[min((y * rows_ + rows_ // 2) // 8, rows_ - 1)][min((x * cols + cols // 2) // 9, cols - 1)] for x in range(9)] for y in range(8)]
        mark = "".join("1" if r[x + 1] > r[x] else "0" for r in small for x in range(8))
        assert rows[i]["feature"] == f"{wide}x{high}:{int(mark, 2):016x}"
        assert (rows[i]["media_bytes"], rows[i]["media_sha256"]) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())


def test_odd_files_have_an_error(spark):
    good, _ = written(40, 40, [(2, 2), (1, 1), (1, 1)], 0, 1)
    frame, tables, scan = good.index(b"\xff\xc0"), good.index(b"\xff\xc4"), good.index(b"\xff\xda")
    swap = lambda at, b: good[:at] + b + good[at + len(b) :]
    odd = {
        "odd quantisers": b"\xff\xd8\xff\xdb\0\x05\x10\1\2" + good[2:],
        "short quantisers": b"\xff\xd8\xff\xdb\0\x05\0\1\2" + good[2:],
        "no components": swap(frame + 9, b"\0"),
        "many components": swap(frame + 9, b"\x09"),
        "factor 0": swap(frame + 11, b"\x02"),
        "factor 9": swap(frame + 11, b"\x92"),
        "huge": swap(frame + 5, b"\xff\xff\xff\xff"),
        "table overfull": swap(tables + 5, b"\xff"),
        "scan of others": swap(scan + 5, b"\x77"),
        "empty scan head": swap(scan + 4, b"\0"),
        "short restart": b"\xff\xd8\xff\xdd\0\x02" + good[2:],
        "cut": good[: scan + 40],
    }
    rng = random.Random(9)
    for n in range(300):
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 9)):
            raw[rng.randrange(2, len(raw))] = rng.randrange(256)
        odd[f"noise {n}"] = bytes(raw[: rng.choice([len(raw), rng.randrange(len(raw))])])
    found = media.read(list(odd.values()))
    assert len(found) == len(odd)
    for name, f in zip(odd, found, strict=True):
        assert f["error"] or name.startswith("noise"), name
        media.payload_of(f) if f["error"] is None else None
    fake = [good[:2] + struct.pack(">BBH", 255, 0xFE, 2 + len(c)) + c + good[2:] for c in (b"payload=x", b"payload=-64", b"payload=" + b"9" * 40, b"payload=63", b"payload=64000000", b"payload=")]
    rows = media.described(spark.createDataFrame(list(enumerate(fake)), "doc_id long, media binary")).collect()
    assert all(r["error"] is None and r["payload"] is None and r["width"] == 40 for r in rows)
    assert media.described(spark.createDataFrame([], "doc_id long, media binary")).count() == 0
