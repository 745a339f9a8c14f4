import hashlib
import struct
import zlib

import numpy as np
import pytest

from vivaspark.llm import jpeg, media


def test_zigzag():
    assert jpeg.ZIGZAG.tolist()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG.tolist()[-3:] == [55, 62, 63]


@pytest.mark.parametrize("mcus", [2, 4, 14, 130, 2 * 4099])
def test_payload_round_trip_and_bit_reader(mcus, monkeypatch):
    data = np.random.default_rng(mcus).integers(0, 256, 288 * mcus, dtype=np.uint8).tobytes()
    file = jpeg.encode_payload(data)
    fast = jpeg.decode(file)
    assert jpeg.payload_of(fast) == data
    if mcus <= 14:
        monkeypatch.setattr(jpeg, "_fast", lambda *a: False)
        slow = jpeg.decode(file)
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components))


def bits_of(scan, blocks, low, high):
    """Plain encoder of AC scans without end-of-band runs over several blocks: first pass or refinement."""
    before, after = scan
    out = []
    for b in blocks:
        zeros, waiting, k = 0, [], low
        now = [abs(int(v)) >> after for v in b]
        tail = max([i for i in range(low, high + 1) if (now[i] and not before) or now[i] == 1 and before], default=low - 1)
        for k in range(low, high + 1):
            if k > tail:
                break
            if before and now[k] > 1:
                waiting.append(now[k] & 1)
                continue
            if not now[k]:
                zeros += 1
                if zeros == 16 and not before:
                    out.append(("s", 0xF0))
                    zeros = 0
                elif zeros == 16:
                    out += [("s", 0xF0), *(("b", x) for x in waiting)]
                    zeros, waiting = 0, []
                continue
            if before:
                out += [("s", zeros << 4 | 1), ("b", int(b[k] > 0)), *(("b", x) for x in waiting)]
                waiting = []
            else:
                n = now[k].bit_length()
                v = now[k] if b[k] > 0 else (1 << n) - 1 - now[k]
                out += [("s", zeros << 4 | n), *(("b", v >> j & 1) for j in range(n - 1, -1, -1))]
            zeros = 0
        if tail < high:
            rest = [now[j] & 1 for j in range(max(tail + 1, low), high + 1) if before and now[j] > 1]
            out += [("s", 0), *(("b", x) for x in waiting + rest)]
        else:
            out += [("b", x) for x in waiting]
    return out


def test_general_scans_accumulate():
    """Sparse coefficients through two bands and two refinements, in three components with sampling 2x1."""
    rng = np.random.default_rng(4)
    width, height = 40, 19
    shapes = {1: (3, 6), 2: (3, 3), 3: (3, 3)}
    used = {1: (3, 5), 2: (3, 3), 3: (3, 3)}
    coef = {c: np.where(rng.random((*s, 64)) < 0.2, rng.integers(-40, 41, (*s, 64)), 0) for c, s in shapes.items()}
    symbols = sorted({r << 4 | s for r in range(16) for s in range(8)})
    codes = {s: k for k, s in enumerate(symbols)}
    table = lambda kind: bytes([kind << 4, *([0] * 7), len(symbols), *([0] * 8), *symbols])

    def pack(events):
        bits = "".join(f"{codes[v]:08b}" if k == "s" else str(v) for k, v in events)
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""

    def scan(parts, band, approx, data):
        return jpeg._segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c, 0)), *band, approx[0] << 4 | approx[1]])) + data

    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0, *range(1, 65)])), jpeg._segment(0xC2, frame), jpeg._segment(0xC4, table(0) + table(1))]
    events, last = [], dict.fromkeys(shapes, 0)
    for my in range(3):
        for mx in range(3):
            for c, h in ((1, 2), (2, 1), (3, 1)):
                for x in range(h):
                    v = int(coef[c][my, mx * h + x, 0]) >> 1
                    d, last[c] = v - last[c], v
                    n = abs(d).bit_length()
                    events += [("s", n), *(("b", (d if d > 0 else d + (1 << n) - 1) >> j & 1) for j in range(n - 1, -1, -1))]
    out.append(scan([1, 2, 3], (0, 0), (0, 1), pack(events)))
    for approx in ((0, 2), (2, 1), (1, 0)):
        for c, (rows, cols) in used.items():
            blocks = [coef[c][y, x] for y in range(rows) for x in range(cols)]
            for band in ((1, 9), (10, 63)):
                out.append(scan([c], band, approx, pack(bits_of(approx, blocks, *band))))
    dc = [("b", int(coef[c][my, mx * h + x, 0]) & 1) for my in range(3) for mx in range(3) for c, h in ((1, 2), (2, 1), (3, 1)) for x in range(h)]
    out.append(scan([1, 2, 3], (0, 0), (1, 0), pack(dc)))
    got = jpeg.decode(b"".join([*out, b"\xff\xd9"]))
    for c, part in zip((1, 2, 3), got.components):
        rows, cols = used[c]
        assert (part.coefficients[:rows, :cols] == coef[c][:rows, :cols]).all()
    assert jpeg.to_rgb(got).shape == (height, width, 3)


def test_transform_is_the_definition():
    c = jpeg.Component(1, 1, 1, 0)
    c.coefficients = np.random.default_rng(1).integers(-50, 50, (1, 1, 64)).astype(np.int16)
    s = np.zeros((8, 8))
    s.reshape(-1)[jpeg.ZIGZAG] = c.coefficients[0, 0]
    k = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    want = [[sum(k(u) * k(v) * s[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for x in range(8)] for y in range(8)]
    assert np.allclose(jpeg._plane(c), want, atol=1e-3)


def test_query_and_defined_cases(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op10_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, data = media.payload(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(data)) and len(data) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-32:])
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "é" * 288, "x"), (3, "a" * 70_000, "x")], "doc_id long, text string, media string")
    rows = media.rgb_tensors(media.store(odd)).collect()
    assert len(rows) == 5 and all(len(r.rgb) == 3 * r.height * r.width for r in rows)
    assert len({bytes(r.rgb) for r in rows if r.doc_id in (1, 2)}) == 1
    assert media.rgb_tensors(media.store(odd.limit(0))).count() == 0
