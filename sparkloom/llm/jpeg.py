"""Progressive JPEG: scans are accumulated into coefficient arrays, then inverse-transformed to full-resolution RGB.

`decode_many` reads any Huffman-coded progressive files of 8-bit samples (SOF2) with one to three components: spectral
selection, successive approximation, end-of-band runs, restart intervals and subsampled components. A restart interval
can be read without those before it, so all intervals of all files' scans that do not build on each other are read side
by side: each step takes one symbol from each of them.

`encode_many` stores bytes losslessly in coefficients, the unit in which a JPEG is lossless: a byte b is the coefficient
b - 128, and those of a minimum coded unit (four luma blocks and one of each chroma at half the resolution) take 384
bytes, DC and chroma included. DC and luma go without their lowest bit first, luma in two bands, then refined.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np

#: The order in which a block's 64 coefficients are sent is that of the diagonals, in turns.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

#: Payload bytes of a minimum coded unit, units in a row of an image, units or blocks in a restart interval.
UNIT, WIDE, RESTART = 384, 64, 4

#: The largest payload of one image: 65,535 rows of samples.
MOST = 65535 // 16 * WIDE * UNIT

#: Bytes of payload that are encoded, or of files that are decoded, side by side; whole rows of units.
BATCH = 40 * WIDE * UNIT

#: Bits of the inverse transform's and the colours' constants.
FIXED = 20

_EOI, _SOF2, _DHT, _DQT, _DRI, _SOS, _COM = 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE

#: Magnitude bits of numbers below 4096.
_SIZE = np.array([i.bit_length() for i in range(1 << 12)])


def _cosines() -> np.ndarray:
    """The 64 x 64 matrix that takes a block's coefficients, row by row, to its samples: whole numbers, so that sums are
    exact whatever their order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    m = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", m, m).reshape(64, 64) * (1 << FIXED))


_IDCT = _cosines()


# --- images -----------------------------------------------------------------------------------------


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row, and rows, without the padding to whole units
    high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # in zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: dict[int, Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""
    size: int = 0  # bytes of the file

    def strips(self) -> Iterator[np.ndarray]:
        """The image from top to bottom, some rows of units at a time: (rows, width, 3) uint8."""
        hm, vm = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        units, step = -(-self.height // (8 * vm)), max(1, (1 << 14) // max(1, self.width))
        for at in range(0, units, step):
            high = min(self.height - at * 8 * vm, step * 8 * vm)
            planes = []
            for c in self.components.values():
                part = c.coef[at * c.v : (at + step) * c.v]
                freq = np.zeros((part.shape[0] * part.shape[1], 64))
                freq[:, ZIGZAG] = part.reshape(-1, 64) * self.quants[c.quant]
                samples = np.clip(np.floor((freq @ _IDCT) / (1 << FIXED) + 128.5), 0, 255).astype(np.int32)
                plane = samples.reshape(*part.shape[:2], 8, 8).swapaxes(1, 2).reshape(part.shape[0] * 8, -1)
                plane = plane.repeat(vm // c.v, 0).repeat(hm // c.h, 1)  # chroma at full resolution
                planes.append(plane[:high, : self.width])
            y, cb, cr = planes if len(planes) == 3 else (planes[0], None, None)
            out = np.empty((*y.shape, 3), np.uint8)
            if cb is None:
                out[:] = y[..., None]
            else:
                half, red, blue = 1 << 15, cr - 128, cb - 128
                for i, part in enumerate((91881 * red, -22554 * blue - 46802 * red, 116130 * blue)):  # 1.402, 0.344136, 0.714136, 1.772
                    out[..., i] = np.clip(y + ((part + half) >> 16), 0, 255)
            yield out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8 at full resolution; chroma is repeated upwards, one component gives grey."""
        return np.concatenate(list(self.strips()))


# --- reading files' segments ------------------------------------------------------------------------


@cache
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """A Huffman table: for each 16 bits, the code's length * 256 + its symbol; 0 for no code."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at, code = at + n, code << 1
    return out


@dataclass
class _Scan:
    image: Image
    parts: list[tuple[int, tuple | None]]  # of each component: its id and its Huffman table's counts and symbols
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    starts: np.ndarray  # of its intervals' bytes, in all files
    turn: int = 0  # scans of one turn do not build on each other


def _read(data: bytes, offset: int) -> tuple[Image, list[_Scan]]:
    """A file's image, with coefficients of 0, and its scans. offset: of the file among all."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & (raw[1:] != 255))
    again = (raw[marks + 1] & 0xF8) == 0xD0
    restarts, others = marks[again], marks[~again]
    at, image, tables, restart, comment, scans = 2, None, {}, 0, b"", []
    quants: dict[int, np.ndarray] = {}
    while at + 4 <= len(data):
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == _DQT:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif kind == _DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif kind == _DRI:
            restart = struct.unpack(">H", body)[0]
        elif kind == _COM:
            comment = body
        elif kind == _SOF2:
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples are not of 8 bits")
            parts = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            hm, vm = max(c.h for c in parts.values()), max(c.v for c in parts.values())
            for c in parts.values():
                c.wide, c.high = -(-wide * c.h // (8 * hm)), -(-high * c.v // (8 * vm))
                c.coef = np.zeros((-(-high // (8 * vm)) * c.v, -(-wide // (8 * hm)) * c.h, 64), np.int32)
            image = Image(wide, high, parts, quants)
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive JPEG")
        elif kind == _SOS:
            if image is None:
                raise ValueError("a scan before its frame")
            n = body[0]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            chosen = [(body[1 + 2 * i], tables.get(body[2 + 2 * i] >> 4 if ss == 0 else 0x10 | body[2 + 2 * i] & 15)) for i in range(n)]
            i = int(np.searchsorted(others, at))
            end = int(others[i]) if i < len(others) else len(data)
            inner = restarts[np.searchsorted(restarts, at) : np.searchsorted(restarts, end)] if restart else restarts[:0]
            scan = _Scan(image, chosen, ss, se, approx >> 4, approx & 15, restart, np.concatenate([[at], inner + 2]) + offset)
            ids = {i for i, _ in chosen}
            scan.turn = 1 + max((s.turn for s in scans if s.ss <= se and ss <= s.se and ids & {i for i, _ in s.parts}), default=-1)
            scans.append(scan)
            at = end
        if at + 2 <= len(data) and data[at + 1] == _EOI:
            at += 2
            break
    if image is None:
        raise ValueError("no frame")
    image.comment, image.size = comment, at
    return image, scans


# --- reading scans, all intervals side by side ------------------------------------------------------


class _Stream:
    """All files' bytes without those stuffed in, with the bits ahead of each place."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.stuffed = np.flatnonzero((raw[1:] == 0) & (raw[:-1] == 255)) + 1
        self.bytes = np.concatenate([np.delete(raw, self.stuffed), np.zeros(8, np.uint8)])
        b = self.bytes
        self.ahead = np.zeros(len(b) - 3, np.uint32)
        for i in range(4):
            self.ahead |= b[i : len(b) - 3 + i].astype(np.uint32) << np.uint32(24 - 8 * i)

    def bit(self, byte: np.ndarray) -> np.ndarray:
        """The first bit of bytes, by their places in the files."""
        return (byte - np.searchsorted(self.stuffed, byte)) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits at each of some places; zeros behind the end."""
        return self.ahead[np.minimum(at >> 3, len(self.ahead) - 1)].astype(np.int64) >> (16 - (at & 7)) & 0xFFFF

    def bits(self, at: np.ndarray) -> np.ndarray:
        return self.bytes[np.minimum(at >> 3, len(self.bytes) - 1)] >> (7 - (at & 7)).astype(np.uint8) & 1


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of magnitude bits."""
    return np.where(v >> np.maximum(size - 1, 0) != 0, v, v - (1 << size) + 1)


def _symbols(stream: _Stream, tables: np.ndarray, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol at each place, and the place behind its code."""
    found = tables[table, stream.peek(at)]
    if not found.all():
        raise ValueError("no such Huffman code")
    return found & 255, at + (found >> 8)


class _Coefs:
    """All components' coefficients in one array of blocks, and where each begins."""

    def __init__(self, images: Sequence[Image]):
        every = [c for image in images for c in image.components.values()]
        self.blocks = np.zeros((sum(c.coef.shape[0] * c.coef.shape[1] for c in every) + 1, 64), np.int32)
        self.first, at = {}, 0
        for c in every:
            n = c.coef.shape[0] * c.coef.shape[1]
            self.first[id(c)] = at
            c.coef = self.blocks[at : at + n].reshape(c.coef.shape)
            at += n


def _tables(scans: Sequence[_Scan]) -> tuple[np.ndarray, dict]:
    kinds = {t for s in scans for _, t in s.parts if t is not None}
    number = {t: i for i, t in enumerate(kinds)}
    return np.stack([_lookup(*t) for t in kinds]) if kinds else np.zeros((1, 1 << 16), np.int32), number


def _dc(scans: Sequence[_Scan], stream: _Stream, coefs: _Coefs) -> None:
    """First passes over DC, or refinements."""
    tables, number = _tables(scans)
    lanes = []  # (first bit, blocks of the interval in order, their components, tables)
    for s in scans:
        comps = [s.image.components[i] for i, _ in s.parts]
        own = [number.get(t, 0) for _, t in s.parts]
        if len(comps) == 1:
            c = comps[0]
            row, col = np.divmod(np.arange(c.high * c.wide), max(1, c.wide))
            blocks, which, per = coefs.first[id(c)] + row * c.coef.shape[1] + col, np.zeros(1, int), 1
        else:
            c = comps[0]
            wide, units = c.coef.shape[1] // c.h, c.coef.shape[0] // c.v * (c.coef.shape[1] // c.h)
            my, mx = np.divmod(np.arange(units), wide)
            slots = [(i, y, x) for i, c in enumerate(comps) for y in range(c.v) for x in range(c.h)]
            blocks = np.stack([coefs.first[id(comps[i])] + (my * comps[i].v + y) * comps[i].coef.shape[1] + mx * comps[i].h + x for i, y, x in slots], axis=1).reshape(-1)
            which, per = np.array([i for i, _, _ in slots]), len(slots)
        step = (s.restart or len(blocks) // per) * per
        for i, bit in enumerate(stream.bit(s.starts).tolist()):
            part = blocks[i * step : (i + 1) * step]
            if len(part):
                lanes.append((bit, part, np.tile(which, len(part) // per), own, s.al))
    if not lanes:
        return
    n, first = np.array([len(x[1]) for x in lanes]), np.array([x[0] for x in lanes])
    low, every = np.array([x[4] for x in lanes]), np.concatenate([x[1] for x in lanes])
    start = np.cumsum(n) - n
    if scans[0].ah:
        got = stream.bits(np.repeat(first - start, n) + np.arange(len(every)))
        coefs.blocks[every, 0] |= got.astype(np.int32) << np.repeat(low, n)
        return
    which = np.concatenate([x[2] for x in lanes])
    table = np.array([[*x[3], 0, 0][:3] for x in lanes])
    at, last, lane = first, np.zeros((len(lanes), 3), np.int64), np.arange(len(lanes))
    for i in range(int(n.max())):
        lane = lane[n[lane] > i]
        place = start[lane] + i
        comp = which[place]
        size, here = _symbols(stream, tables, table[lane, comp], at[lane])
        last[lane, comp] += np.where(size > 0, _signed(stream.peek(here) >> (16 - size), size), 0)
        at[lane] = here + size
        coefs.blocks[every[place], 0] = last[lane, comp] << low[lane]


class _Lanes:
    """The intervals of AC scans, with what each of them is at."""

    names = ("at", "block", "end", "k", "run", "first", "wide", "stride", "ss", "se", "al", "table")

    def __init__(self, scans: Sequence[_Scan], stream: _Stream, coefs: _Coefs, number: dict):
        rows, count = [], []
        for s in scans:
            c = s.image.components[s.parts[0][0]]
            rows.append((c.high * c.wide, s.restart, coefs.first[id(c)], c.wide, c.coef.shape[1], s.ss, s.se, s.al, number.get(s.parts[0][1], 0)))
            count.append(len(s.starts))
        n, restart, *same = (np.repeat(x, count) for x in np.array(rows, np.int64).T)
        i = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
        self.first, self.wide, self.stride, self.ss, self.se, self.al, self.table = same
        step = np.where(restart > 0, restart, n)
        self.at, self.block, self.end = stream.bit(np.concatenate([s.starts for s in scans])), i * step, np.minimum((i + 1) * step, n)
        self.k, self.run = self.ss.copy(), np.zeros(len(n), np.int64)
        self.left()

    def left(self) -> bool:
        """Drops those that are done; whether any is left."""
        alive = self.block < self.end
        if not alive.all():
            for name in self.names:
                setattr(self, name, getattr(self, name)[alive])
        return len(self.at) > 0

    def row(self) -> np.ndarray:
        """The number of each one's block."""
        return self.first + self.block // self.wide * self.stride + self.block % self.wide


def _ac_first(scans: Sequence[_Scan], stream: _Stream, coefs: _Coefs) -> None:
    tables, number = _tables(scans)
    x, flat = _Lanes(scans, stream, coefs, number), coefs.blocks.reshape(-1)
    row = x.row() * 64
    while len(x.at):
        symbol, at = _symbols(stream, tables, x.table, x.at)
        zeros, size = symbol >> 4, symbol & 15
        ahead = stream.peek(at)
        some = size > 0
        x.k += np.where(some | (zeros == 15), zeros, 0)
        value = _signed(ahead >> (16 - size), size) << x.al
        put = np.flatnonzero(some & (x.k <= x.se))
        flat[row[put] + x.k[put]] = value[put]
        x.k += 1
        ends = ~some & (zeros < 15)
        x.at = at + np.where(ends, zeros, size)
        over = ends | (x.k > x.se)
        if over.any():
            x.block += over
            if ends.any():  # blocks without any
                x.block += np.where(ends, (1 << zeros) - 1 + (ahead >> (16 - zeros)), 0)
            x.k = np.where(over, x.ss, x.k)
            x.left()
            row = x.row() * 64


def _ac_refine(scans: Sequence[_Scan], stream: _Stream, coefs: _Coefs) -> None:
    tables, number = _tables(scans)
    x, column = _Lanes(scans, stream, coefs, number), np.arange(64)
    while len(x.at):
        row = x.row()
        values = coefs.blocks[row]
        inside = (column >= x.k[:, None]) & (column <= x.se[:, None])
        asks = x.run == 0  # a block within a run has no symbol
        symbol, at = _symbols(stream, tables, x.table, x.at)
        zeros, size = symbol >> 4, symbol & 15
        ends = asks & (size == 0) & (zeros < 15)
        ahead = stream.peek(at)
        x.run = np.where(ends, (1 << zeros) + (ahead >> (16 - zeros)), x.run)
        at = np.where(asks, at + np.where(ends, zeros, size > 0), x.at)
        whole = x.run > 0
        free = (values == 0) & inside
        passed = np.cumsum(free, axis=1) > np.where(whole, 64, zeros)[:, None]  # from the coefficient that the zeros lead to
        stop = np.where(passed.any(1), passed.argmax(1), x.se + 1)
        held = (values != 0) & inside & (column < stop[:, None])
        n = held.sum(1)
        lane, col = np.nonzero(held)
        bit = stream.bits(at[lane] + np.arange(len(lane)) - (np.cumsum(n) - n)[lane])
        one = (1 << x.al).astype(np.int32)
        values[lane, col] += np.where(bit == 1, np.sign(values[lane, col]) * one[lane], 0).astype(np.int32)
        new = np.flatnonzero(~whole & (size > 0) & (stop <= x.se))
        values[new, stop[new]] = np.where(ahead[new] >> 15 == 1, one[new], -one[new])
        coefs.blocks[row] = values
        x.at, x.k = at + n, stop + 1
        over = whole | (x.k > x.se)
        x.block += over
        x.run -= whole
        x.k = np.where(over, x.ss, x.k)
        x.left()


def decode_many(files: Sequence[bytes]) -> list[Image]:
    """An image of each file; raises ValueError for anything but progressive files of 8-bit samples."""
    return [image for batch in batches(files) for image in _decoded(batch)]


def batches(items: Sequence[bytes]) -> Iterator[list[bytes]]:
    """Items of some BATCH bytes together."""
    held, size = [], 0
    for item in items:
        if held and size + len(item) > BATCH:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item)
    if held:
        yield held


def _decoded(files: Sequence[bytes]) -> list[Image]:
    data, read, offset = b"".join(files), [], 0
    for file in files:
        read.append(_read(file, offset))
        offset += len(file)
    stream, coefs = _Stream(data), _Coefs([image for image, _ in read])
    scans = [s for _, own in read for s in own]
    for turn in range(1 + max((s.turn for s in scans), default=-1)):
        mine = [s for s in scans if s.turn == turn]
        for run, some in (
            (_dc, [s for s in mine if s.ss == 0 and not s.ah]), (_dc, [s for s in mine if s.ss == 0 and s.ah]),
            (_ac_first, [s for s in mine if s.ss and not s.ah]), (_ac_refine, [s for s in mine if s.ss and s.ah]),
        ):
            if some:
                run(some, stream, coefs)
    return [image for image, _ in read]


def decode(data: bytes) -> Image:
    return decode_many([data])[0]


# --- encoding ---------------------------------------------------------------------------------------


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _table(at: int, length: int, symbols: bytes) -> bytes:
    """A Huffman table of codes of one length."""
    return bytes([at, *[len(symbols) if i == length else 0 for i in range(1, 17)]]) + symbols


class _Codes:
    """A Huffman table for writing: symbols by the length of their codes."""

    def __init__(self, lengths: dict[int, list[int]]):
        self.counts = bytes(len(lengths.get(i, ())) for i in range(1, 17))
        self.symbols = bytes(s for i in sorted(lengths) for s in lengths[i])
        self.code, self.length, code = np.zeros(256, np.int64), np.zeros(256, np.int64), 0
        for i in range(1, 17):
            for s in lengths.get(i, ()):
                self.code[s], self.length[s], code = code, i, code + 1
            code <<= 1


def _rest(*used: int) -> list[int]:
    """The AC symbols but some: runs of up to 15 zeros before a coefficient of up to 8 bits, 16 zeros, the end."""
    return [s for s in [*(r << 4 | n for r in range(16) for n in range(1, 9)), 0xF0, 0] if s not in used]


#: Short codes for what text has: bytes of ASCII letters and blanks are coefficients of 4 to 7 bits.
_DC_CODES = _Codes({4: list(range(10))})
_AC_CODES = _Codes({2: [4, 3, 6], 4: [5, 2], 5: [7], 6: [1, 0, 8], 12: _rest(*range(9))})
_REFINE_CODES = _Codes({1: [0], 2: [1], 7: [*(r << 4 | 1 for r in range(1, 16)), 0xF0]})

_HEAD = (
    b"\xff\xd8"
    + _segment(_DQT, b"\x00" + b"\x01" * 64)
    + _segment(_DHT, b"".join(bytes([at]) + t.counts + t.symbols for at, t in ((0, _DC_CODES), (0x10, _AC_CODES), (0x11, _REFINE_CODES))))
    + _segment(_DRI, struct.pack(">H", RESTART))
)

#: Component (0 for all), band, and the bits left out before and after.
_SCANS = ((0, 0, 0, 0, 1), (1, 1, 5, 0, 1), (2, 1, 63, 0, 0), (3, 1, 63, 0, 0), (1, 6, 63, 0, 1), (0, 0, 0, 1, 0), (1, 1, 63, 1, 0))


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v, v + (1 << size) - 1)


def _dc_entries(units: np.ndarray, lane: np.ndarray, al: int, refine: bool):
    """units: (units, 6) DC of the blocks of each, in order. Values, their bits, and the intervals they belong to."""
    if refine:
        return (units & 1).reshape(-1), np.ones(units.size, np.int64), np.repeat(lane, 6)
    v = units >> al
    before = np.zeros_like(v)
    before[:, 1:4] = v[:, :3]
    goes_on = np.flatnonzero(lane[1:] == lane[:-1]) + 1
    before[goes_on, 0], before[goes_on, 4:] = v[goes_on - 1, 3], v[goes_on - 1, 4:]
    d = (v - before).reshape(-1)
    size = _SIZE[np.abs(d)]
    return _DC_CODES.code[size] << size | _magnitude(d, size) * (size > 0), _DC_CODES.length[size] + size, np.repeat(lane, 6)


def _ac_entries(band: np.ndarray, lane: np.ndarray, al: int):
    """band: (blocks, coefficients)."""
    wide, flat = band.shape[1], band.reshape(-1)
    q = np.sign(flat) * (np.abs(flat) >> al)
    at = np.flatnonzero(q)
    block, k, v = at // wide, at % wide, q[at]
    zeros = k - 1
    same = np.flatnonzero(block[1:] == block[:-1]) + 1
    zeros[same] -= k[same - 1]
    firsts = np.ones(len(at), bool)
    firsts[same] = False
    zeros[firsts] = k[firsts]
    size = _SIZE[np.abs(v)]
    symbol = (zeros % 16) << 4 | size
    value, bits = _AC_CODES.code[symbol] << size | _magnitude(v, size), _AC_CODES.length[symbol] + size
    # ends of blocks, and sixteens of zeros, go in between
    n = np.bincount(block, minlength=len(band))
    behind = np.cumsum(n)
    last = np.full(len(band), -1)
    last[block] = k
    open_ = np.flatnonzero(last < wide - 1)
    long = np.flatnonzero(zeros > 15)
    long = np.repeat(long, zeros[long] // 16)
    place, owner = np.concatenate([behind[open_], long]), np.concatenate([open_, block[long]])
    extra = np.repeat([0, 0xF0], [len(open_), len(long)])
    order = np.lexsort((owner, place))
    place, extra = place[order], extra[order]
    lanes = np.insert(lane[block], place, lane[owner[order]])
    return np.insert(value, place, _AC_CODES.code[extra]), np.insert(bits, place, _AC_CODES.length[extra]), lanes


def _refine_entries(band: np.ndarray, lane: np.ndarray):
    """The lowest bit of coefficients that were not 0 without it, and those that become 1 or -1."""
    wide, flat = band.shape[1], band.reshape(-1)
    size = np.abs(flat)
    held, new, free = np.flatnonzero(size > 1), np.flatnonzero(size == 1), np.flatnonzero(size == 0)
    # tokens by the coefficient that they end at: new ones, and every sixteenth zero before one
    block = new // wide
    since = block * wide
    same = np.flatnonzero(block[1:] == block[:-1]) + 1
    since[same] = new[same - 1]
    from_, to = np.searchsorted(free, since), np.searchsorted(free, new)
    zeros = to - from_
    long = np.flatnonzero(zeros > 15)
    n = zeros[long] // 16
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    ends = np.concatenate([new, free[np.repeat(from_[long], n) + 16 * (nth + 1) - 1]])
    symbol = np.concatenate([(zeros % 16) << 4 | 1, np.full(len(nth), 0xF0)])
    sign = np.concatenate([flat[new] > 0, np.zeros(len(nth), bool)])
    # and the ends of blocks that have something left
    last = np.arange(len(band)) * wide - 1
    np.maximum.at(last, ends // wide, ends)
    open_ = np.flatnonzero(last < np.arange(1, len(band) + 1) * wide - 1)
    ends, symbol, sign = np.concatenate([ends, (open_ + 1) * wide - 1]), np.concatenate([symbol, np.zeros(len(open_), int)]), np.concatenate([sign, np.zeros(len(open_), bool)])
    owner = ends // wide
    order = np.lexsort((symbol == 0, ends))
    ends, symbol, sign, owner = ends[order], symbol[order], sign[order], owner[order]
    starts = owner * wide
    same = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    starts[same] = ends[same - 1] + 1
    is_new = symbol & 15
    value, bits = _REFINE_CODES.code[symbol] << is_new | sign * is_new, _REFINE_CODES.length[symbol] + is_new
    place = np.searchsorted(held, starts)  # a token goes before the bits of what it passes over
    return np.insert(size[held] & 1, place, value), np.insert(np.ones(len(held), int), place, bits), np.insert(lane[held // wide], place, lane[owner])


def _packed(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Entries as bytes, with restart marks between intervals. lanes: of each file."""
    total = int(lanes.sum())
    held = np.bincount(lane, bits, total).astype(np.int64)
    size = -(-held // 8)
    first, skip = np.cumsum(size) - size, np.cumsum(held) - held
    at = np.cumsum(bits) - bits + (8 * first - skip)[lane]
    ahead = value << (32 - (at & 7) - bits)
    out = np.zeros(int(size.sum()) + 4)
    for i in range(4):
        out += np.bincount((at >> 3) + i, ahead >> (24 - 8 * i) & 255, len(out))
    out = out[:-4].astype(np.uint8)
    out[first + size - 1] |= ((1 << (-held % 8)) - 1).astype(np.uint8)
    full = out == 255
    moved = np.cumsum(full) - full
    nth = np.repeat(np.arange(total), size)
    end = first + size + np.append(moved, full.sum())[first + size] + 2 * np.arange(total)
    made = np.zeros(len(out) + int(full.sum()) + 2 * total, np.uint8)
    made[np.arange(len(out)) + moved + 2 * nth] = out
    made[end], made[end + 1] = 255, 0xD0 + (np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)) % 8
    data, stops = made.tobytes(), np.cumsum(lanes) - 1
    begins = np.concatenate([[0], end[stops[:-1]] + 2])
    return [data[a:b] for a, b in zip(begins.tolist(), end[stops].tolist(), strict=True)]


def _scans_of(parts: Sequence[bytes], wide: bool) -> list[list[bytes]]:
    """The entropy-coded bytes of each scan of each payload. wide: rows have WIDE units, however few there are."""
    units, luma = [], []
    for p in parts:
        rows, cols = _shape(len(p), wide)
        v = np.zeros(rows * cols * UNIT, np.int64)
        v[: len(p)] = np.frombuffer(p, np.uint8)
        v[: len(p)] -= 128
        v = v.reshape(rows * cols, 6, 64)
        units.append(v)
        luma.append(v[:, :4].reshape(rows, cols, 2, 2, 64).swapaxes(1, 2).reshape(-1, 64))
    n, every = np.array([len(v) for v in units]), np.concatenate(units)
    blocks, out = {1: np.concatenate(luma), 2: every[:, 4], 3: every[:, 5]}, []
    for comp, ss, se, ah, al in _SCANS:
        count = n * 4 if comp == 1 else n
        lanes = -(-count // RESTART)
        lane = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) // RESTART + np.repeat(np.cumsum(lanes) - lanes, count)
        if comp == 0:
            made = _dc_entries(every[:, :, 0], lane, al, bool(ah))
        else:
            band = blocks[comp][:, ss : se + 1]
            made = _refine_entries(band, lane) if ah else _ac_entries(band, lane, al)
        out.append(_packed(*made, lanes))
    return [list(scans) for scans in zip(*out, strict=True)]


def _shape(n: int, wide: bool = False) -> tuple[int, int]:
    """Rows and columns of units for n bytes."""
    units = max(1, -(-n // UNIT))
    cols = WIDE if wide else min(units, WIDE)
    return -(-units // cols), cols


def _file(n: int, scans: Sequence[bytes]) -> bytes:
    rows, cols = _shape(n)
    frame = struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    body = b""
    for (comp, ss, se, ah, al), scan in zip(_SCANS, scans, strict=True):
        chosen = b"\x03\x01\x00\x02\x00\x03\x00" if comp == 0 else bytes([1, comp, 1 if ah else 0])
        body += _segment(_SOS, chosen + bytes([ss, se, ah << 4 | al])) + scan
    return _HEAD + _segment(_COM, struct.pack(">Q", n)) + _segment(_SOF2, frame) + body + b"\xff\xd9"


def encode_many(payloads: Sequence[bytes]) -> list[bytes]:
    """A progressive file of each payload, 4:2:0, with its length in a comment; an image of UNIT bytes at least."""
    out = []
    for batch in batches(payloads):
        if len(batch[0]) <= BATCH:
            out += [_file(len(p), scans) for p, scans in zip(batch, _scans_of(batch, False), strict=True)]
            continue
        p = batch[0]  # alone; its rows have some multiple of 8 intervals in each scan, so that parts of it fit together
        if len(p) > MOST:
            raise ValueError("the payload exceeds the largest image")
        parts = [_scans_of([p[at : at + BATCH]], True)[0] for at in range(0, len(p), BATCH)]
        out.append(_file(len(p), [b"\xff\xd7".join(scan) for scan in zip(*parts, strict=True)]))
    return out


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def payload(image: Image) -> bytes:
    """The bytes that encode() stored."""
    y, cb, cr = (c.coef for c in image.components.values())
    rows, cols = cb.shape[:2]
    luma = y.reshape(rows, 2, cols, 2, 64).swapaxes(1, 2).reshape(rows * cols, 4, 64)
    units = np.concatenate([luma, cb.reshape(-1, 1, 64), cr.reshape(-1, 1, 64)], axis=1)
    return (units + 128).astype(np.uint8).tobytes()[: struct.unpack(">Q", image.comment)[0]]
