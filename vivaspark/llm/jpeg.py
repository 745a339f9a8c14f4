"""Progressive JPEG in numpy: scans into coefficient arrays, pixels from those.

`decode` reads any Huffman-coded progressive file of 8-bit samples: DC and AC
scans, spectral selection, successive approximation, end-of-band runs, restart
intervals, one to four components with their own sampling. Scans accumulate in
one int16 array of coefficients a component. `to_rgb` transforms them back with
one matrix product, upsamples chroma and converts.

`encode_payload` stores bytes losslessly in the format's own unit, the quantised
coefficient. In 4:2:0, each block's 48 lowest AC coefficients hold 48 bytes. A
byte b becomes the coefficient of magnitude 128 to 255 whose first scan (values
without their last bit) codes b >> 1 and whose refinement scan sends b & 1. All
first-scan values are then of 7 bits after a one-bit code, a byte each, and the
refinement scan is one end-of-band run followed by raw bits, so both directions
are array operations; `decode` notices such scans and else goes bit by bit.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Order of the coefficients of a block: anti-diagonals, in turn downwards and upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
PER_BLOCK = 48
PER_MCU = 6 * PER_BLOCK
_BANDS = ((1, 24), (25, 48))
_WIDEST = 4095


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table whose codes all have one length."""
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return bytes([kind << 4 | slot, *counts, *symbols])


def _scan(parts: list[tuple[int, int]], band: tuple[int, int], approx: tuple[int, int], data: bytes) -> bytes:
    """parts: (component, table) pairs; data with its stuffing still to do."""
    head = bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([*band, approx[0] << 4 | approx[1]])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _shape(mcus: int) -> tuple[int, int]:
    """Columns and rows of MCUs: the widest exact rectangle up to 64 across, or one with filler."""
    for cols in range(min(64, mcus), 0, -1):
        if mcus % cols == 0 and mcus // cols <= _WIDEST:
            return cols, mcus // cols
    cols = -(-mcus // _WIDEST)
    return cols, -(-mcus // cols)


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 file that holds the payload; its length is a positive multiple of PER_MCU."""
    mcus = len(payload) // PER_MCU
    if not mcus or len(payload) % PER_MCU:
        raise ValueError(f"a payload has a positive multiple of {PER_MCU} bytes, not {len(payload)}")
    cols, rows = _shape(mcus)
    cells = cols * rows
    if rows > _WIDEST or cols > _WIDEST:
        raise ValueError("a payload is larger than the largest picture")
    data = np.zeros((6 * cells, PER_BLOCK), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    # DC: every difference is of size 0. AC 0: one symbol, run 0 and 7 bits. AC 1: end-of-band runs.
    tables = _table(0, 0, [0], 1) + _table(1, 0, [0x07], 1) + _table(1, 1, [n << 4 for n in range(15)], 4)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0]) + bytes([1] * 64)), _segment(0xC2, frame), _segment(0xC4, tables)]
    every = [(1, 0), (2, 0), (3, 0)]
    flat = _bits(np.zeros(6 * cells, np.uint8))
    out.append(_scan(every, (0, 0), (0, 1), flat))
    parts = np.split(data, [4 * cells, 5 * cells])
    for c, blocks in enumerate(parts, 1):
        for low, high in _BANDS:
            out.append(_scan([(c, 0)], (low, high), (0, 1), (blocks[:, low - 1 : high] >> 1).tobytes()))
    out.append(_scan(every, (0, 0), (1, 0), flat))
    for c, blocks in enumerate(parts, 1):
        runs = []
        for at in range(0, len(blocks), 32767):
            part = blocks[at : at + 32767] & 1
            n = len(part).bit_length() - 1
            head = n << n | (len(part) - (1 << n))  # 4-bit code of the symbol, then n bits
            runs += [np.array([head >> k & 1 for k in range(3 + n, -1, -1)], np.uint8), part.reshape(-1)]
        out.append(_scan([(c, 1)], (1, PER_BLOCK), (1, 0), _bits(np.concatenate(runs))))
    return b"".join([*out, b"\xff\xd9"])


class Component:
    """One component: sampling, its quantisation, and coefficients (rows, columns, 64) in zigzag order."""

    def __init__(self, ident: int, h: int, v: int, slot: int):
        self.ident, self.h, self.v, self.slot = ident, h, v, slot
        self.coefficients = np.zeros((0, 0, 64), np.int16)
        self.used = (0, 0)
        self.quantisers = np.ones(64, np.int32)


class Picture:
    def __init__(self, width: int, height: int, components: list[Component], comment: bytes):
        self.width, self.height, self.components, self.comment = width, height, components, comment


class _Bits:
    """Bit by bit through entropy-coded bytes; ones follow their end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.word = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            self.word = self.word << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.left += 8
        self.left -= n
        out = self.word >> self.left
        self.word &= (1 << self.left) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            found = codes.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode(data: bytes) -> Picture:
    """All scans of a progressive file, accumulated in coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, quantisers, picture, restart, comment = 2, {}, {}, None, 0, b""
    while True:
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        if marker == 0xD9:
            if picture is None:
                raise ValueError("no picture")
            for c in picture.components:
                c.quantisers = quantisers[c.slot]
            return picture
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            picture = _frame(body, comment)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"not a progressive Huffman file: frame {marker:#x}")
        elif marker == 0xDA:
            end = at
            while True:  # up to a marker that is neither stuffing nor a restart
                end = data.index(b"\xff", end)
                if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            _read_scan(picture, body, data[at:end], tables, restart)
            at = end


def _frame(body: bytes, comment: bytes) -> Picture:
    bits, height, width, n = struct.unpack_from(">BHHB", body)
    if bits != 8:
        raise ValueError(f"samples of {bits} bits")
    parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    cols, rows = -(-width // (8 * h)), -(-height // (8 * v))
    for c in parts:
        c.coefficients = np.zeros((rows * c.v, cols * c.h, 64), np.int16)
        c.used = (-(-(-(-height * c.v // v)) // 8), -(-(-(-width * c.h // h)) // 8))
    return Picture(width, height, parts, comment)


def _read_scan(picture: Picture, head: bytes, data: bytes, tables: dict, restart: int) -> None:
    parts = [(next(c for c in picture.components if c.ident == head[1 + 2 * k]), head[2 + 2 * k]) for k in range(head[0])]
    low, high, approx = head[-3:]
    before, after = approx >> 4, approx & 15
    if low and _fast(parts[0][0], tables.get(16 | parts[0][1] & 15, {}), data, low, high, before, after, restart):
        return
    if len(parts) == 1:
        c, t = parts[0]
        units = [[(c, t, y, x)] for y in range(c.used[0]) for x in range(c.used[1])]
    else:
        h, v = max(c.h for c in picture.components), max(c.v for c in picture.components)
        cols, rows = -(-picture.width // (8 * h)), -(-picture.height // (8 * v))
        units = [[(c, t, my * c.v + y, mx * c.h + x) for c, t in parts for y in range(c.v) for x in range(c.h)] for my in range(rows) for mx in range(cols)]
    pieces = [data]
    if restart:
        pieces, start, k = [], 0, 0
        while (k := data.find(b"\xff", k)) >= 0:
            if 0xD0 <= data[k + 1] <= 0xD7:
                pieces.append(data[start:k])
                start = k + 2
            k += 2
        pieces.append(data[start:])
    for k, piece in enumerate(pieces):
        bits = _Bits(piece.replace(b"\xff\x00", b"\xff"))
        last, run = {}, 0
        for unit in units[k * restart : (k + 1) * restart] if restart else units:
            for c, t, y, x in unit:
                block = c.coefficients[y, x]
                if low == 0:
                    if before:
                        block[0] |= bits.take(1) << after
                    else:
                        last[c.ident] = last.get(c.ident, 0) + bits.signed(bits.symbol(tables[t >> 4]))
                        block[0] = last[c.ident] << after
                elif before:
                    run = _refine(block, bits, tables[16 | t & 15], low, high, after, run)
                else:
                    run = _first(block, bits, tables[16 | t & 15], low, high, after, run)


def _first(block: np.ndarray, bits: _Bits, codes: dict, low: int, high: int, after: int, run: int) -> int:
    """First AC pass of a block; run: blocks still without any value, this one included."""
    if run:
        return run - 1
    k = low
    while k <= high:
        symbol = bits.symbol(codes)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            block[k] = bits.signed(size) * (1 << after)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1 if zeros else 0
    return 0


def _refine(block: np.ndarray, bits: _Bits, codes: dict, low: int, high: int, after: int, run: int) -> int:
    """Next AC pass: a bit for each value known, new values of magnitude one in between."""
    one, k = 1 << after, low

    def correct(k: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & one:
            block[k] += one if block[k] > 0 else -one

    if not run:
        while k <= high:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            while k <= high:
                if block[k]:
                    correct(k)
                else:
                    if not zeros:
                        if value:
                            block[k] = value
                        k += 1
                        break
                    zeros -= 1
                k += 1
    if run:
        for j in range(k, high + 1):
            if block[j]:
                correct(j)
        return run - 1
    return 0


def _fast(c: Component, codes: dict, data: bytes, low: int, high: int, before: int, after: int, restart: int) -> bool:
    """Array forms of two kinds of scan; False leaves the scan to the bit reader."""
    rows, cols = c.used
    if restart or c.coefficients.shape[:2] != c.used:
        return False
    band = c.coefficients.reshape(rows * cols, 64)[:, low : high + 1]
    if not before:
        # One symbol without zeros, its code and value a byte together: a byte a coefficient.
        if len(codes) != 1:
            return False
        ((length, code), symbol), = codes.items()
        if symbol >> 4 or length + symbol != 8 or code:
            return False
        values = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        if len(values) != band.size or (values >> symbol).any():
            return False
        half = 1 << (symbol - 1)
        signed = values.astype(np.int16)
        band[:] = (np.where(values >= half, signed, signed - (2 * half - 1)) << after).reshape(band.shape)
        return True
    if not band.all():
        return False
    bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
    at = done = 0
    raw = []
    while done < len(band):  # end-of-band runs over blocks whose values are all known
        code = length = 0
        while (symbol := codes.get((length, code))) is None:
            if length > 16 or at >= len(bits):
                return False
            code, length, at = code << 1 | int(bits[at]), length + 1, at + 1
        n = symbol >> 4
        if symbol & 15 or n > 14:
            return False
        run = (1 << n) + int("".join(map(str, bits[at : at + n])) or "0", 2)
        at += n
        raw.append(bits[at : at + run * band.shape[1]])
        at, done = at + run * band.shape[1], done + run
    add = np.concatenate(raw)[: band.size].reshape(band.shape).astype(np.int16) << after
    band += np.where(band > 0, add, -add)
    return True


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Pixels (64) of each coefficient in zigzag order: the inverse transform as a matrix."""
    k = np.arange(8)
    cos = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("vy,ux->vuyx", cos, cos).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _plane(c: Component) -> np.ndarray:
    rows, cols, _ = c.coefficients.shape
    top = 64
    flat = c.coefficients.reshape(-1, 64)
    while top > 1 and not flat[:, top // 2 :].any():
        top //= 2  # high frequencies that no block has need no arithmetic
    values = (flat[:, :top] * c.quantisers[:top]).astype(np.float32) @ _basis()[:top]
    return values.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)


def to_rgb(picture: Picture) -> np.ndarray:
    """uint8 tensor (height, width, 3) at full resolution."""
    h, v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components[:3]:
        p = _plane(c)
        if (c.v, c.h) != (v, h):
            p = p.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(p[: picture.height, : picture.width])
    if len(planes) < 3:
        planes = [planes[0], np.zeros_like(planes[0]), np.zeros_like(planes[0])]
    y, cb, cr = planes[0] + np.float32(128.5), planes[1], planes[2]
    out = np.empty((*y.shape, 3), np.float32)
    np.add(y, np.float32(1.402) * cr, out=out[:, :, 0])
    np.subtract(y, np.float32(0.344136) * cb + np.float32(0.714136) * cr, out=out[:, :, 1])
    np.add(y, np.float32(1.772) * cb, out=out[:, :, 2])
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def payload_of(picture: Picture) -> bytes:
    """The bytes that encode_payload stored."""
    size = int(picture.comment.removeprefix(b"payload "))
    values = np.concatenate([c.coefficients.reshape(-1, 64)[:, 1 : PER_BLOCK + 1].reshape(-1) for c in picture.components])[:size]
    magnitude = np.abs(values)
    high = np.where(values > 0, magnitude >> 1, 127 - (magnitude >> 1))
    return (high << 1 | magnitude & 1).astype(np.uint8).tobytes()
