"""Progressive JPEG: coefficient arrays to scans and back, RGB tensors, bytes as coefficients.

``decode`` accumulates DC and AC scans (spectral selection, successive
approximation, interleaved or not, any Huffman tables, restarts) into coefficient
arrays; ``rgb`` inverse-transforms them in numpy and upsamples chroma.

``store`` keeps bytes losslessly as quantized coefficients: byte b is 256 + b, or for
a DC difference plus or minus that. All such values have nine magnitude bits, so each
scan is a regular bit matrix and is written, and recognised and read, by array
operations; other streams are read symbol by symbol.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np

#: Fixed values of the format: the zigzag order.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Coefficients of each block are stored in zigzag order, three components to a unit of 192 bytes.
UNIT, OFFSET, WIDE = 192, 256, 256
BANDS = ((1, 5), (6, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbols: list[tuple[int, int]]) -> bytes:
    """A Huffman table of (length, symbol), in code order."""
    counts = [sum(n == k for n, _ in symbols) for k in range(1, 17)]
    return bytes([kind << 4 | slot, *counts, *(s for _, s in symbols)])


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits, filled up with ones, a zero byte after each 0xFF."""
    if bits.size % 8:
        bits = np.concatenate([bits, np.ones(-bits.size % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` (up to 16) bits of each value, on a new last axis."""
    return np.unpackbits(values.astype(">u2")[..., None].view(np.uint8), axis=-1)[..., 16 - width :]


def _toward_zero(value: int, step: int) -> int:
    return value - step if value > 0 else value + step


def _eob_runs(blocks: int):
    """(first block, run, bits of the run's length) for refinement scans without new coefficients."""
    at = 0
    while at < blocks:
        run = min(32767, blocks - at)
        yield at, run, run.bit_length() - 1
        at += run


def store(payload: np.ndarray) -> bytes:
    """A progressive JPEG whose coefficients hold the bytes; their number must be a positive multiple of 192."""
    units = payload.size // UNIT
    if units * UNIT != payload.size or not units:
        raise ValueError("not a positive multiple of 192 bytes")
    wide = min(units, max(WIDE, -(-units // 8000)))
    high = -(-units // wide)
    total = wide * high
    c = np.full((total, 3, 64), OFFSET, np.int32)
    c[:units] += payload.reshape(units, 3, 64)
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", payload.size))]
    out.append(_segment(0xDB, bytes([0]) + bytes([1]) * 64))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes(x for k in (1, 2, 3) for x in (k, 0x11, 0))))
    # one table for DC differences, one for first AC scans, one for refinements (runs of blocks)
    dc, ac, eob = [(1, 9)], [(1, 8)], [(4, n << 4) for n in range(15)]
    out.append(_segment(0xC4, _table(0, 0, dc) + _table(1, 0, ac) + _table(1, 1, eob)))

    def scan(parts: list[int], tables: int, start: int, end: int, was: int, now: int, data: bytes) -> None:
        head = bytes([len(parts)]) + bytes(x for k in parts for x in (k + 1, tables)) + bytes([start, end, was << 4 | now])
        out.append(_segment(0xDA, head) + data)

    # a DC difference points back to zero, so values stay within +-511
    signed = np.stack([np.diff(np.fromiter(accumulate(d.tolist(), _toward_zero, initial=0), np.int32, total + 1)) for d in c[:, :, 0].T], 1)
    magnitude = np.where(signed < 0, 511 + signed, signed)  # nine bits; of a negative value, its complement
    scan([0, 1, 2], 0, 0, 0, 0, 0, _stuffed(_bits(magnitude, 10).reshape(-1)))  # the leading zero is the code of category 9
    for k in range(3):
        for a, b in BANDS:
            scan([k], 0, a, b, 0, 1, _stuffed(_bits(c[:, k, a : b + 1] >> 1, 9).reshape(-1)))
    for k in range(3):
        for a, b in BANDS:
            low = (c[:, k, a : b + 1] & 1).astype(np.uint8)
            bits = []
            for at, run, n in _eob_runs(total):
                bits += [_bits(np.array([n]), 4).reshape(-1), _bits(np.array([run - (1 << n)]), n).reshape(-1) if n else np.zeros(0, np.uint8), low[at : at + run].reshape(-1)]
            scan([k], 1, a, b, 1, 0, _stuffed(np.concatenate(bits)))
    return b"".join(out) + b"\xff\xd9"


@dataclass
class Component:
    """One colour component; coefficients[rows of blocks, columns of blocks, 64 in zigzag order]."""

    key: int
    h: int
    v: int
    quant: int
    coefficients: np.ndarray = field(default=None)
    size: tuple[int, int] = (0, 0)  # blocks of a scan of this component alone


@dataclass
class Picture:
    height: int
    width: int
    parts: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes]


class _Reader:
    """Bits of an entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.acc = self.acc << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        self.n -= n
        value = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("bad Huffman code")

    def value(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> n - 1 else v - (1 << n) + 1


def _codes(body: bytes):
    """(class, slot) -> {(length, code): symbol} of a table segment."""
    at = 0
    while at < len(body):
        counts, symbols, code, found = body[at + 1 : at + 17], at + 17, 0, {}
        for n, many in enumerate(counts, 1):
            for _ in range(many):
                found[n, code] = body[symbols]
                symbols, code = symbols + 1, code + 1
            code <<= 1
        yield (body[at] >> 4, body[at] & 15), found
        at = symbols


def _regular(bits: np.ndarray, comps: list[Component], tables, a: int, b: int, was: int, now: int) -> bool:
    """Reads a scan whose symbols all are as ``store`` writes them; False, and nothing done, if one isn't."""
    one = comps[0]
    if a == 0:
        if was or len(comps) > 1 and any(c.h != 1 or c.v != 1 for c in comps) or any(tables[0, d] != {(1, 0): 9} for d, _ in _SLOTS(comps)):
            return False
        rows, cols = one.size
        m = _matrix(bits, rows * cols * len(comps), 10)
        if m is None or m[:, 0].any():
            return False
        value = _numbers(m[:, 1:])
        diff = np.where(m[:, 1] > 0, value, value - 511).reshape(rows * cols, len(comps))
        for c, v in zip(comps, np.cumsum(diff, axis=0).T, strict=True):
            c.coefficients[:rows, :cols, 0] = (v << now).reshape(rows, cols)
        return True
    (_, slot), (rows, cols), width = next(iter(_SLOTS(comps))), one.size, b - a + 1
    if not was:
        if tables[1, slot] != {(1, 0): 8}:
            return False
        m = _matrix(bits, rows * cols * width, 9)
        if m is None or m[:, 0].any():
            return False
        value = _numbers(m[:, 1:])
        one.coefficients[:rows, :cols, a : b + 1] = (np.where(m[:, 1] > 0, value, value - 255) << now).reshape(rows, cols, width)
        return True
    band = one.coefficients[:rows, :cols, a : b + 1].reshape(-1, width)
    if tables[1, slot] != {(4, n): n << 4 for n in range(15)} or not band.all():
        return False
    at = done = 0
    out = np.empty((rows * cols, width), np.uint8)
    while done < len(out):
        n = int(_numbers(bits[None, at : at + 4])[0])
        run = (1 << n) + (int(_numbers(bits[None, at + 4 : at + 4 + n])[0]) if n else 0)
        at += 4 + n
        if n > 14 or done + run > len(out) or at + run * width > bits.size:
            return False
        out[done : done + run] = bits[at : at + run * width].reshape(run, width)
        at, done = at + run * width, done + run
    band = band + np.where(band > 0, 1, -1) * (out.astype(np.int32) << now)
    one.coefficients[:rows, :cols, a : b + 1] = band.reshape(rows, cols, width)
    return True


def _SLOTS(comps):  # noqa: N802
    return [c.slots for c in comps]


def _matrix(bits: np.ndarray, rows: int, width: int) -> np.ndarray | None:
    return bits[: rows * width].reshape(rows, width) if 0 <= bits.size - rows * width < 8 else None


def _numbers(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(bits.shape[0], np.int32)
    for k in range(bits.shape[1]):
        out = out << 1 | bits[:, k]
    return out


def _symbols(pieces: list[bytes], comps: list[Component], tables, a: int, b: int, was: int, now: int, mcu: tuple[int, int], interval: int) -> None:
    """Reads a scan symbol by symbol."""
    if len(comps) > 1:
        blocks = [(i, r * c.v + y, q * c.h + x) for r in range(mcu[0]) for q in range(mcu[1]) for i, c in enumerate(comps) for y in range(c.v) for x in range(c.h)]
        per = sum(c.h * c.v for c in comps)
    else:
        blocks, per = [(0, r, q) for r in range(comps[0].size[0]) for q in range(comps[0].size[1])], 1
    step = interval * per or len(blocks)
    for piece, first in zip(pieces, range(0, len(blocks), step)):
        bits, last, eob = _Reader(piece), [0] * len(comps), 0
        for i, r, q in blocks[first : first + step]:
            block, (dc, ac) = comps[i].coefficients[r, q], comps[i].slots
            if a == 0:
                if was:
                    block[0] |= bits.take(1) << now
                else:
                    last[i] += bits.value(bits.symbol(tables[0, dc]))
                    block[0] = last[i] << now
                continue
            k = a
            if not was:
                if eob:
                    eob -= 1
                    continue
                while k <= b:
                    run, size = divmod(bits.symbol(tables[1, ac]), 16)
                    if size:
                        k += run
                        block[k] = bits.value(size) << now
                        k += 1
                    elif run == 15:
                        k += 16
                    else:
                        eob = (1 << run) + bits.take(run) - 1
                        break
                continue

            def refine(j: int) -> None:
                if bits.take(1):
                    block[j] += (1 if block[j] > 0 else -1) << now

            if not eob:
                while k <= b:
                    run, size = divmod(bits.symbol(tables[1, ac]), 16)
                    new = 0
                    if size:
                        new = (1 if bits.take(1) else -1) << now
                    elif run < 15:
                        eob = (1 << run) + bits.take(run)
                        break
                    while k <= b:
                        if block[k]:
                            refine(k)
                        elif run == 0:
                            if new:
                                block[k] = new
                            k += 1
                            break
                        else:
                            run -= 1
                        k += 1
            if eob:
                while k <= b:
                    if block[k]:
                        refine(k)
                    k += 1
                eob -= 1


def decode(data: bytes) -> Picture:
    """A progressive JPEG as coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quant, comments, picture, mcu, interval = 2, {}, {}, [], None, (0, 0), 0
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return picture
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            tables |= dict(_codes(body))
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 129 if wide else 65
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xC2:
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hs, vs = max(c.h for c in parts), max(c.v for c in parts)
            mcu = -(-high // (8 * vs)), -(-wide // (8 * hs))
            for c in parts:
                c.coefficients = np.zeros((mcu[0] * c.v, mcu[1] * c.h, 64), np.int32)
                c.size = -(-(-(-high * c.v // vs)) // 8), -(-(-(-wide * c.h // hs)) // 8)
            picture = Picture(high, wide, parts, quant, comments)
        elif marker == 0xDA:
            comps = []
            for i in range(body[0]):
                c = next(c for c in picture.parts if c.key == body[1 + 2 * i])
                c.slots = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                comps.append(c)
            a, b, both = body[-3:]
            pieces, start = [], at
            while True:  # up to a marker that is neither a stuffed byte nor a restart
                at = data.index(b"\xff", at)
                if data[at + 1] == 0:
                    stop = data.find(b"\xff", at + 2)
                    at = stop
                    continue
                pieces.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                if 0xD0 <= data[at + 1] <= 0xD7:
                    at += 2
                    start = at
                    continue
                break
            how = comps, tables, a, b, both >> 4, both & 15
            if interval or not _regular(np.unpackbits(np.frombuffer(pieces[0], np.uint8)), *how):
                _symbols(pieces, *how, mcu, interval)


def payload_of(picture: Picture) -> np.ndarray:
    """The bytes that ``store`` kept."""
    n = struct.unpack(">Q", picture.comments[0])[0]
    c = np.stack([p.coefficients.reshape(-1, 64) for p in picture.parts], 1)
    out = c.copy()
    out[1:, :, 0] -= c[:-1, :, 0]
    out[:, :, 0] = np.abs(out[:, :, 0])
    return (out - OFFSET).astype(np.uint8).reshape(-1)[:n]


def _cosines() -> np.ndarray:
    """64 x 64: pixels of a block from its zigzag coefficients."""
    x = np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) / 2
    one[:, 0] /= np.sqrt(2)
    both = np.einsum("yv,xu->yxvu", one, one).reshape(64, 64)
    return both[:, ZIGZAG].T.astype(np.float32).copy()


COSINES = _cosines()


def plane(c: Component, quant: np.ndarray) -> np.ndarray:
    """Samples (not yet shifted) of one component."""
    rows, cols, _ = c.coefficients.shape
    pixels = (c.coefficients.reshape(-1, 64) * quant).astype(np.float32) @ COSINES
    return pixels.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def rgb(p: Picture) -> np.ndarray:
    """uint8[height, width, 3] at full resolution; chroma is repeated over its luma samples."""
    hs, vs = max(c.h for c in p.parts), max(c.v for c in p.parts)
    planes = []
    for c in p.parts:
        x = plane(c, p.quant[c.quant])
        if c.v != vs:
            x = x.repeat(vs // c.v, 0)
        if c.h != hs:
            x = x.repeat(hs // c.h, 1)
        planes.append(x[: p.height, : p.width])
    y = planes[0] + np.float32(128)
    if len(planes) == 1:
        return np.repeat(np.clip(np.rint(y), 0, 255).astype(np.uint8)[..., None], 3, -1)
    cb, cr = planes[1:]
    out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
