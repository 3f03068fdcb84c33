"""Progressive JPEG in numpy: many images at once, scan by scan.

An entropy-coded scan is serial, but restart intervals are independent. So
the decoder runs all intervals of all images of a batch in lockstep: one step
reads one symbol of each. Scans (spectral selection, successive approximation)
accumulate into coefficient arrays; these are dequantised and inverse-
transformed as one matrix product, chroma is brought to full resolution and
the colours to RGB.

The encoder stores bytes: 64 bytes make a block of 8x8 quantised coefficients
(byte - 128, zigzag order, all quantisers 1), so what is stored is read back
exactly. Blocks fill the luma plane first, then the two chroma planes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# --- fixed values of the format (ITU-T T.81)
SOI, EOI, SOS, DQT, DHT, DRI, COM, SOF2 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE, 0xC2
RST0 = 0xD0


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    places = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return np.array(places)


ZIGZAG = _zigzag()
#: Sampling of luma and the two chroma components (4:2:0).
SAMPLING = ((2, 2), (1, 1), (1, 1))
BLOCKS_PER_MCU = 6
#: MCUs in a frame: it is one MCU wide, and heights end at 65535.
FRAME_MCUS = 4095
#: (components, first, last coefficient, high bit, low bit, restart interval)
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1, 8),
    ((0,), 1, 5, 0, 1, 16), ((1,), 1, 5, 0, 1, 16), ((2,), 1, 5, 0, 1, 16),
    ((0,), 6, 63, 0, 1, 4), ((1,), 6, 63, 0, 1, 4), ((2,), 6, 63, 0, 1, 4),
    ((0, 1, 2), 0, 0, 1, 0, 64),
    ((0,), 1, 63, 1, 0, 8), ((1,), 1, 63, 1, 0, 8), ((2,), 1, 63, 1, 0, 8),
)


def _tables() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(length, symbol) of the two Huffman tables of the encoder, by code.

    DC: 12 sizes with 4 bits. AC: sizes without a run of zeros and the end of
    block with 4 bits, all other symbols with 9.
    """
    dc = [(4, s) for s in range(12)]
    short = [0x00, *range(0x01, 0x09)]
    rest = [r << 4 | s for r in range(16) for s in range(11) if (r << 4 | s) not in short]
    return dc, [(4, s) for s in short] + [(9, s) for s in rest]


def _codes(table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical (code, length) by symbol."""
    code, length, value, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, table[0][0]
    for bits, symbol in table:
        value <<= bits - last
        code[symbol], length[symbol], last = value, bits, bits
        value += 1
    return code, length


DC_TABLE, AC_TABLE = _tables()
DC_CODE, DC_LENGTH = _codes(DC_TABLE)
AC_CODE, AC_LENGTH = _codes(AC_TABLE)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, table: list[tuple[int, int]]) -> bytes:
    counts = [sum(bits == n for bits, _ in table) for n in range(1, 17)]
    return bytes([kind << 4, *counts, *(s for _, s in table)])


_HEAD_TABLES = _segment(DQT, bytes([0] + [1] * 64)) + _segment(DHT, _dht(0, DC_TABLE) + _dht(1, AC_TABLE))


def _scan_header(scan: tuple) -> bytes:
    parts, first, last, high, low, every = scan
    body = bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, high << 4 | low])
    return _segment(DRI, every.to_bytes(2, "big")) + _segment(SOS, body)


_SCAN_HEADS = [_scan_header(s) for s in SCANS]


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude of each value."""
    return np.frexp(np.abs(values).astype(np.float64))[1]


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index within the owner) of sum(counts) items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - starts[owner]


def _bit_bytes(code: np.ndarray, length: np.ndarray, interval: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (up to 32 bits each) of intervals as bytes, and the bytes by interval.

    An interval is filled up with ones. Codes take disjoint bits of 32-bit
    words, so words are sums of shifted codes.
    """
    bits = np.bincount(interval, length, intervals).astype(np.int64)
    size = -(-bits // 8)
    fill = size * 8 - bits
    at = np.cumsum(length) - length + (np.cumsum(fill) - fill)[interval]
    total = int(size.sum())
    words = np.zeros(total // 4 + 3)

    def put(at: np.ndarray, code: np.ndarray, length: np.ndarray) -> None:
        moved = code.astype(np.uint64) << (64 - (at & 31) - length).astype(np.uint64)
        word = at >> 5
        words[:] += np.bincount(word, moved >> np.uint64(32), len(words))
        words[:] += np.bincount(word + 1, moved & np.uint64(0xFFFFFFFF), len(words))

    put(at, code, length)
    put(np.cumsum(size) * 8 - fill, (1 << fill) - 1, fill)
    return words.astype(">u4").view(np.uint8)[:total], size


def _stream(code: np.ndarray, length: np.ndarray, interval: np.ndarray, per_frame: np.ndarray) -> list[bytes]:
    """Entropy-coded data of one scan for each frame, with stuffing and restart markers."""
    intervals = int(per_frame.sum())
    data, size = _bit_bytes(code, length, interval, intervals)
    ends = np.cumsum(size)
    number = np.arange(intervals) - np.repeat(np.cumsum(per_frame) - per_frame, per_frame)
    last = number == np.repeat(per_frame, per_frame) - 1
    width = 1 + (data == 0xFF).astype(np.int64)
    width[ends[~last] - 1] += 2
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[place] = data
    marker = place[ends[~last] - 1] + width[ends[~last] - 1] - 2
    out[marker], out[marker + 1] = 0xFF, RST0 + number[~last] % 8
    frame_end = np.r_[0, (place + width)[ends[last] - 1]]
    return [out[a:b].tobytes() for a, b in zip(frame_end[:-1], frame_end[1:])]


def _encode_scan(coefficients: np.ndarray, mcus: np.ndarray, scan: tuple) -> list[bytes]:
    """One scan of all frames; coefficients: blocks in MCU order (6 in each), zigzag."""
    parts, first, last, high, low, every = scan
    frame, mcu = _ragged(mcus)
    blocks = coefficients.reshape(-1, BLOCKS_PER_MCU, 64)
    if len(parts) == 3:
        units, chosen, per_unit = mcu, blocks.reshape(-1, 64), BLOCKS_PER_MCU
        counts = mcus
    else:
        slots = range(4) if parts[0] == 0 else [3 + parts[0]]
        chosen, per_unit = blocks[:, list(slots)].reshape(-1, 64), 1
        counts = mcus * len(slots)
        frame, units = _ragged(counts)
    per_frame = -(-counts // every)
    interval = np.repeat((np.cumsum(per_frame) - per_frame)[frame] + units // every, per_unit)
    if first == 0 and high == 0:
        value = chosen[:, 0].astype(np.int64) >> low
        component = np.tile([0, 0, 0, 0, 1, 2], len(blocks))
        difference = np.zeros_like(value)
        for c in range(3):
            own = np.flatnonzero(component == c)
            before = np.r_[0, value[own][:-1]]
            before[np.r_[True, interval[own][1:] != interval[own][:-1]]] = 0
            difference[own] = value[own] - before
        size = _sizes(difference)
        extra = np.where(difference < 0, difference + (1 << size) - 1, difference)
        return _stream(DC_CODE[size] << size | extra, DC_LENGTH[size] + size, interval, per_frame)
    if first == 0:
        return _stream((chosen[:, 0].astype(np.int64) >> low) & 1, np.ones(len(chosen), np.int64), interval, per_frame)
    band = chosen[:, first : last + 1]
    pieces = []
    if high == 0:
        common = (np.abs(band) >= 1 << low).all(axis=1)
        magnitude = np.arange(-128, 128)
        magnitude = np.where(magnitude < 0, -(-magnitude >> low), magnitude >> low)
        size = _sizes(magnitude)
        signed = np.where(magnitude < 0, magnitude + (1 << size) - 1, magnitude)
        codes, lengths = (AC_CODE[size] << size | signed).astype(np.int32), (AC_LENGTH[size] + size).astype(np.int32)
        index = band[common] + 128
        pieces.append((np.flatnonzero(common), codes[index], lengths[index]))
        pieces.append((np.flatnonzero(~common), *_first_codes(band[~common].astype(np.int64), low)))
    else:
        magnitude = np.abs(band) >> low
        common = (magnitude > 1).all(axis=1)
        bits = np.zeros((int(common.sum()), 64), np.uint8)
        bits[:, 64 - band.shape[1] :] = magnitude[common] & 1
        halves = np.packbits(bits, axis=1).view(">u4").astype(np.int64)
        n = band.shape[1]
        code = np.column_stack([np.full(len(halves), AC_CODE[0]), halves])
        length = np.tile([AC_LENGTH[0], max(0, n - 32), min(n, 32)], (len(halves), 1))
        pieces.append((np.flatnonzero(common), code, length))
        pieces.append((np.flatnonzero(~common), *_refine_codes(band[~common].astype(np.int64), low)))
    width = max(code.shape[1] for _, code, _ in pieces)
    code, length = np.zeros((len(band), width), np.int64 if high else np.int32), np.zeros((len(band), width), np.int32)
    for rows, some_code, some_length in pieces:
        code[rows, : some_code.shape[1]], length[rows, : some_code.shape[1]] = some_code, some_length
    used = length > 0
    return _stream(code[used], length[used], np.repeat(interval, used.sum(axis=1)), per_frame)


def _runs(zero: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros before each stop since the last one, and the end of the last stop of a row."""
    zeros = np.cumsum(zero, axis=1)
    before = np.maximum.accumulate(np.c_[np.zeros((len(zero), 1), np.int64), np.where(stop, zeros, 0)[:, :-1]], axis=1)
    return zeros - before, np.where(stop, np.arange(zero.shape[1]), -1).max(axis=1, initial=-1) + 1


def _first_codes(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of a first scan of blocks that have zeros; an item holds 32 bits at most."""
    magnitude = np.abs(band) >> low
    n, width = band.shape
    fresh = magnitude != 0
    run, tail = _runs(~fresh, fresh)
    size = _sizes(magnitude)
    signed = np.where(band < 0, magnitude ^ ((1 << size) - 1), magnitude)
    code, length = np.zeros((n, width + 1, 2), np.int64), np.zeros((n, width + 1, 2), np.int64)
    symbol = (run % 16) << 4 | size
    code[:, :width, 1] = np.where(fresh, AC_CODE[symbol] << size | signed, 0)
    length[:, :width, 1] = np.where(fresh, AC_LENGTH[symbol] + size, 0)
    for row, k in zip(*np.nonzero(fresh & (run > 15))):
        for _ in range(run[row, k] // 16):
            _before(code, length, row, k, AC_CODE[0xF0], AC_LENGTH[0xF0])
    ends = tail < width
    code[ends, width, 1], length[ends, width, 1] = AC_CODE[0], AC_LENGTH[0]
    return code.reshape(n, 2 * (width + 1)), length.reshape(n, 2 * (width + 1))


def _refine_codes(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of a refinement scan.

    A symbol comes before the correction bits of the run it spans.
    """
    magnitude = np.abs(band) >> low
    n, width = band.shape
    zero, fresh, history = magnitude == 0, magnitude == 1, magnitude > 1
    code, length = np.zeros((n, width + 1, 2), np.int64), np.zeros((n, width + 1, 2), np.int64)
    code[:, :width, 1], length[:, :width, 1] = np.where(history, magnitude & 1, 0), history
    _, tail = _runs(zero, fresh)
    ends = tail < width
    code[ends, tail[ends], 0], length[ends, tail[ends], 0] = AC_CODE[0], AC_LENGTH[0]
    for row in np.flatnonzero(fresh.any(axis=1)):
        begin, gap = 0, 0
        for k in range(tail[row]):
            if zero[row, k]:
                gap += 1
                if gap == 16:  # a run of 16 zeros closes here and carries its correction bits
                    _before(code, length, row, begin, AC_CODE[0xF0], AC_LENGTH[0xF0])
                    begin, gap = k + 1, 0
            elif fresh[row, k]:
                sign = int(band[row, k] > 0)
                _before(code, length, row, begin, AC_CODE[gap << 4 | 1] << 1 | sign, AC_LENGTH[gap << 4 | 1] + 1)
                begin, gap = k + 1, 0
    return code.reshape(n, 2 * (width + 1)), length.reshape(n, 2 * (width + 1))


def _before(code: np.ndarray, length: np.ndarray, row: int, k: int, value: int, bits: int) -> None:
    code[row, k, 0] = code[row, k, 0] << bits | value
    length[row, k, 0] += bits


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """Payloads (bytes, a multiple of 64 each, FRAME_MCUS MCUs at most) as frames."""
    sizes = np.array([len(p) // 64 for p in payloads])
    mcus = -(-sizes // BLOCKS_PER_MCU)
    planes = np.zeros((int(mcus.sum()) * BLOCKS_PER_MCU, 64), np.int16)
    start = (np.cumsum(mcus) - mcus) * BLOCKS_PER_MCU
    for payload, size, count, at in zip(payloads, sizes, mcus, start):
        planes[at + _order(count)[:size]] = payload.reshape(-1, 64).astype(np.int16) - 128
    scans = [_encode_scan(planes, mcus, scan) for scan in SCANS]
    out = []
    for i, (payload, count) in enumerate(zip(payloads, mcus.tolist())):
        frame = bytes([8]) + (16 * count).to_bytes(2, "big") + (16).to_bytes(2, "big") + bytes([3])
        frame += b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
        note = _segment(COM, len(payload).to_bytes(4, "big"))
        out.append(b"".join([bytes([0xFF, SOI]), note, _HEAD_TABLES, _segment(SOF2, frame), *(x for k, head in enumerate(_SCAN_HEADS) for x in (head, scans[k][i])), bytes([0xFF, EOI])]))
    return out


def _order(mcus: int) -> np.ndarray:
    """Place in MCU order of the blocks, luma plane first."""
    places = np.arange(mcus * BLOCKS_PER_MCU).reshape(-1, BLOCKS_PER_MCU)
    return np.r_[places[:, :4].ravel(), places[:, 4], places[:, 5]]


# --- decoding


@dataclass
class Scan:
    parts: list[tuple[int, int, int]]  # component, DC and AC table
    first: int
    last: int
    high: int
    low: int
    every: int
    begin: int
    end: int


@dataclass
class Frame:
    """One image: what its headers say; planes are filled by the scans."""

    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quantisers: list[int] = field(default_factory=list)
    names: list[int] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    quant: dict[int, np.ndarray | None] = field(default_factory=dict)
    note: bytes = b""
    grid: list[tuple[int, int]] = field(default_factory=list)  # stored blocks: rows, columns
    base: list[int] = field(default_factory=list)  # first block of each component

    @property
    def mcus(self) -> tuple[int, int]:
        v, h = max(s[1] for s in self.sampling), max(s[0] for s in self.sampling)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def blocks(self, component: int) -> tuple[int, int]:
        """Rows and columns of blocks in a scan of this component alone."""
        h, v = self.sampling[component]
        most_h, most_v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-(-(-self.height * v // most_v)) // 8), -(-(-(-self.width * h // most_h)) // 8)


@lru_cache(maxsize=32)
def _lookup(body: bytes) -> np.ndarray:
    """16 bits ahead -> length << 8 | symbol."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for bits in range(1, 17):
        for _ in range(body[bits - 1]):
            low = code << (16 - bits)
            table[low : low + (1 << (16 - bits))] = bits << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _tables_of(body: bytes) -> list[tuple[int, np.ndarray]]:
    found = []
    while body:
        size = 17 + sum(body[1:17])
        found.append((body[0], _lookup(body[1:size])))
        body = body[size:]
    return found


def _quantisers(body: bytes) -> dict[int, np.ndarray | None]:
    """Quantisers by number; None stands for ones."""
    found = {}
    while body:
        width = 2 if body[0] >> 4 else 1
        values = np.frombuffer(body[1 : 1 + 64 * width], f">u{width}").astype(np.int32)
        found[body[0] & 15] = None if (values == 1).all() else values
        body = body[1 + 64 * width :]
    return found


@lru_cache(maxsize=32)
def _fast(table: bytes) -> np.ndarray:
    """For first AC scans: value + 32768 << 16 | run << 8 | bits, 0 where 16 bits don't tell."""
    entry = np.frombuffer(table, np.int32).astype(np.int64)
    code, size, run = entry >> 8, entry & 15, entry >> 4 & 15
    bits = code + size
    fits = (size > 0) & (entry > 0) & (bits <= 16)
    raw = np.arange(1 << 16) >> np.where(fits, 16 - bits, 0) & (1 << size) - 1
    value = np.where(raw < (1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw)
    return np.where(fits, (value + 32768) << 16 | run << 8 | bits, 0)


class Decoder:
    """Decodes the frames in a buffer; one call works on all of them."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.raw = data
        self.lookups: list[np.ndarray] = []
        self._known: dict[bytes, dict[int, int]] = {}
        self._quantisers: dict[bytes, dict[int, np.ndarray | None]] = {}
        self._layouts: dict[tuple, tuple[np.ndarray, np.ndarray, int]] = {}
        mark = np.flatnonzero(self.data[:-1] == 0xFF)
        after = self.data[mark + 1]
        self.restarts = mark[(after >= RST0) & (after < RST0 + 8)]
        self.markers = mark[(after != 0) & ((after < RST0) | (after >= RST0 + 8)) & (after != 0xFF)]
        self.stuffing = mark[after == 0] + 1
        self.frames = self._parse()
        self._decode()

    def _parse(self) -> list[Frame]:
        raw, at, frames, frame, every = self.raw, 0, [], None, 0
        tables: dict[int, int] = {}
        while at < len(raw):
            if raw[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            marker = raw[at + 1]
            at += 2
            if marker == SOI:
                frame, every, tables = Frame(), 0, {}
                frames.append(frame)
                continue
            if marker == EOI:
                continue
            size = int.from_bytes(raw[at : at + 2], "big")
            body, at = raw[at + 2 : at + size], at + size
            if marker == COM:
                frame.note = body
            elif marker == DRI:
                every = int.from_bytes(body, "big")
            elif marker == DQT:
                if body not in self._quantisers:
                    self._quantisers[body] = _quantisers(body)
                frame.quant.update(self._quantisers[body])
            elif marker == DHT:
                if body not in self._known:
                    self._known[body] = {}
                    for kind, table in _tables_of(body):
                        self._known[body][kind] = len(self.lookups)
                        self.lookups.append(table)
                tables.update(self._known[body])
            elif marker == SOF2:
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                for k in range(body[5]):
                    name, sampling, quantiser = body[6 + 3 * k : 9 + 3 * k]
                    frame.names.append(name)
                    frame.sampling.append((sampling >> 4, sampling & 15))
                    frame.quantisers.append(quantiser)
            elif marker == SOS:
                n = body[0]
                parts = [(frame.names.index(body[1 + 2 * k]), tables.get(body[2 + 2 * k] >> 4, 0), tables.get(16 | body[2 + 2 * k] & 15, 0)) for k in range(n)]
                first, last, bits = body[1 + 2 * n : 4 + 2 * n]
                end = int(self.markers[np.searchsorted(self.markers, at)])
                frame.scans.append(Scan(parts, first, last, bits >> 4, bits & 15, every, at, end))
                at = end
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive Huffman-coded JPEG")
        return frames

    def _decode(self) -> None:
        total = 0
        for f in self.frames:
            rows, columns = f.mcus
            for h, v in f.sampling:
                f.grid.append((rows * v, columns * h))
                f.base.append(total)
                total += rows * v * columns * h
        self.coefficients = np.zeros((total, 64), np.int32)
        keep = np.ones(len(self.data), bool)
        keep[self.stuffing] = False
        self.moved = np.r_[0, np.cumsum(keep)]
        compact = np.r_[self.data[keep], np.zeros(16, np.uint8)].astype(np.uint64)
        n = len(compact) - 5
        self.window = sum(compact[k : n + k] << np.uint64(8 * (4 - k)) for k in range(5))
        self.tables = np.stack(self.lookups) if self.lookups else np.zeros((1, 1 << 16), np.int32)
        for i in range(max((len(f.scans) for f in self.frames), default=0)):
            kinds: dict[tuple[bool, bool], list[tuple[Frame, Scan]]] = {}
            for f in self.frames:
                if i < len(f.scans):
                    s = f.scans[i]
                    kinds.setdefault((s.first == 0, s.high == 0), []).append((f, s))
            for (dc, fresh), group in kinds.items():
                self._run(dc, fresh, group)

    def _bits(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n bits (up to 32) from bit position at, as a number."""
        shift = (40 - (at & 7) - n).astype(np.uint64)
        return ((self.window[np.minimum(at >> 3, len(self.window) - 1)] >> shift) & ((np.uint64(1) << np.asarray(n, np.uint64)) - np.uint64(1))).astype(np.int64)

    def _layout(self, f: Frame, s: Scan) -> tuple[np.ndarray, np.ndarray, int]:
        """(blocks in the order of a scan, components, blocks in a unit) relative to the frame's first block."""
        key = (f.width, f.height, tuple(f.sampling), tuple(p[0] for p in s.parts))
        if key in self._layouts:
            return self._layouts[key]
        if len(s.parts) == 1:
            c = s.parts[0][0]
            rows, columns = f.blocks(c)
            place = f.base[c] - f.base[0] + (np.arange(rows)[:, None] * f.grid[c][1] + np.arange(columns)).ravel()
            found = place, np.full(len(place), c), 1
        else:
            rows, columns = f.mcus
            cells, component = [], []
            for c, _, _ in s.parts:
                h, v = f.sampling[c]
                for y in range(v):
                    for x in range(h):
                        cells.append(f.base[c] - f.base[0] + ((np.arange(rows) * v + y)[:, None] * f.grid[c][1] + np.arange(columns) * h + x).ravel())
                        component.append(c)
            found = np.stack(cells, axis=1).ravel(), np.tile(component, rows * columns), len(cells)
        self._layouts[key] = found
        return found

    def _run(self, dc: bool, fresh: bool, group: list[tuple[Frame, Scan]]) -> None:
        """Lanes: the restart intervals of one scan of each frame."""
        layouts = [self._layout(f, s) for f, s in group]
        sizes = np.array([len(x[0]) for x in layouts])
        per = np.array([x[2] for x in layouts])
        place = np.concatenate([x[0] for x in layouts]) + np.repeat([f.base[0] for f, _ in group], sizes)
        heads = np.array([(s.begin, s.end, s.every, s.first, s.last, s.low) for _, s in group])
        units = sizes // per
        every = np.where(heads[:, 2] > 0, heads[:, 2], units)
        lanes = -(-units // every)
        lower, upper = np.searchsorted(self.restarts, heads[:, 0]), np.searchsorted(self.restarts, heads[:, 1])
        if (upper - lower != lanes - 1).any():
            raise ValueError("the number of restart markers doesn't fit the image")
        owner, k = _ragged(lanes)
        restarts = np.r_[self.restarts, 0][np.minimum(lower[owner] + k - 1, len(self.restarts))]
        at = self.moved[np.where(k == 0, heads[owner, 0], restarts + 2)] * 8
        start = (np.cumsum(sizes) - sizes)[owner] + k * (every * per)[owner]
        count = np.minimum(every[owner], units[owner] - k * every[owner]) * per[owner]
        first, last, low = heads[owner, 3], heads[owner, 4], heads[owner, 5]
        if dc and fresh:
            component = np.concatenate([x[1] for x in layouts])
            tables = np.zeros((len(group), 4), np.int64)
            for i, (_, s) in enumerate(group):
                for c, table, _ in s.parts:
                    tables[i, c] = table
            self._dc_first(at, start, count, place, tables[np.repeat(np.arange(len(group)), sizes), component], component, low)
        elif dc:
            lane, n = _ragged(count)
            self.coefficients[place[start[lane] + n], 0] |= (self._bits(at[lane] + n, 1) << low[lane]).astype(np.int32)
        else:
            table = np.array([s.parts[0][2] for _, s in group])[owner]
            (self._ac_first if fresh else self._ac_refine)(at, start, count, place, table, first, last, low)

    def _symbol(self, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.tables[table, self._bits(at, 16)]
        if (found == 0).any():
            raise ValueError("a code that no table has")
        return found & 255, at + (found >> 8)

    def _dc_first(self, at: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray, table: np.ndarray, component: np.ndarray, low: np.ndarray) -> None:
        before = np.zeros((len(at), 4), np.int64)
        lane = np.arange(len(at))
        for k in range(int(count.max(initial=0))):
            if not (count[lane] > k).all():
                lane = lane[count[lane] > k]
            i = start[lane] + k
            size, p = self._symbol(table[i], at[lane])
            value = self._bits(p, size)
            value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
            before[lane, component[i]] += value
            self.coefficients[place[i], 0] = before[lane, component[i]] << low[lane]
            at[lane] = p + size

    def _ac_first(self, at: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray, table: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray) -> None:
        block, k = start.copy(), first.copy()
        end = start + count
        flat = self.coefficients.reshape(-1)
        fast, row, spot = np.concatenate([_fast(t.tobytes()) for t in self.tables]), table << 16, place[start] * 64
        while len(at):
            ahead = (self.window[at >> 3] >> (24 - (at & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFF
            entry = fast[row + ahead]
            if entry.all():
                at = at + (entry & 255)
                k = k + (entry >> 8 & 255)
                flat[spot + k] = (entry >> 16) - 32768 << low
                k += 1
                over = k > last
                if not over.any():
                    continue
                k[over] = first[over]
                block = block + over
                going = block < end
                if not going.all():
                    at, block, k, end, table, first, last, low, row = (x[going] for x in (at, block, k, end, table, first, last, low, row))
                spot = place[block] * 64
                continue
            symbol, at = self._symbol(table, at)
            run, size = symbol >> 4, symbol & 15
            extra = np.where(size > 0, size, np.where(run < 15, run, 0))
            bits = self._bits(at, extra)
            at = at + extra
            some = size > 0
            k = k + np.where(some | (run == 15), run, 0)
            value = np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) << low
            flat[spot[some] + k[some]] = value[some]
            k = k + (some | (run == 15))
            ended = ~some & (run < 15)
            block = block + np.where(ended, (1 << run) + bits, 0)
            over = (k > last) & ~ended
            block = block + over
            k = np.where(ended | over, first, k)
            going = block < end
            if not going.all():
                at, block, k, end, table, first, last, low, row = (x[going] for x in (at, block, k, end, table, first, last, low, row))
            spot = place[block] * 64

    def _ac_refine(self, at: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray, table: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray) -> None:
        block, k, left = start.copy(), first.copy(), np.zeros(len(at), np.int64)
        end = start + count
        column = np.arange(64)
        while len(at):
            run, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            read = np.flatnonzero(left == 0)
            if len(read):
                symbol, p = self._symbol(table[read], at[read])
                run[read], size[read] = symbol >> 4, symbol & 15
                long = (size[read] == 0) & (run[read] < 15)
                extra = np.where(long, run[read], size[read] & 1)
                bits = self._bits(p, extra)
                at[read] = p + extra
                left[read] = np.where(long, (1 << run[read]) + bits, 0)
                sign = np.zeros(len(at), np.int64)
                sign[read] = np.where(bits == 1, 1, -1)
            rows = place[block]
            values = self.coefficients[rows]
            if (left > 0).all() and (k == first).all() and (first == first[0]).all() and (last == last[0]).all() and (values[:, first[0] : last[0] + 1] != 0).all():
                # only correction bits, one for each coefficient of the band
                width = int(last[0] - first[0] + 1)
                band = values[:, first[0] : last[0] + 1]
                bit = np.empty((len(at), width), np.int32)
                for begin in range(0, width, 32):
                    n = min(32, width - begin)
                    word = self._bits(at + begin, n).astype(">u4").view(np.uint8).reshape(-1, 4)
                    bit[:, begin : begin + n] = np.unpackbits(word, axis=1)[:, 32 - n :]
                bit <<= low[:, None].astype(np.int32)
                self.coefficients[rows, first[0] : last[0] + 1] = band + np.where(band > 0, bit, -bit)
                at = at + width
                left -= 1
                block = block + 1
                going = block < end
                if not going.all():
                    at, block, k, left, end, table, first, last, low = (x[going] for x in (at, block, k, left, end, table, first, last, low))
                continue
            ahead = (column >= k[:, None]) & (column <= last[:, None])
            history = (values != 0) & ahead
            zeros = np.cumsum(~(values != 0) & ahead, axis=1)
            reached = zeros > run[:, None]
            target = np.where((left > 0) | ~reached.any(axis=1), last + 1, reached.argmax(axis=1))
            fix = history & (column < target[:, None])
            if fix.any():
                row, col = np.nonzero(fix)
                n = fix.sum(axis=1)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                bit = self._bits(at[row] + nth, 1) << low[row]
                value = values[row, col]
                self.coefficients[rows[row], col] = value + np.where(value > 0, bit, -bit)
                at = at + n
            new = np.flatnonzero((size == 1) & (left == 0) & (target <= last))
            if len(new):
                self.coefficients[rows[new], target[new]] = sign[new] << low[new]
            k = target + 1
            over = k > last
            left = np.where(left > 0, left - 1, 0)
            block = block + over
            k = np.where(over, first, k)
            going = block < end
            if not going.all():
                at, block, k, left, end, table, first, last, low = (x[going] for x in (at, block, k, left, end, table, first, last, low))

    def blocks(self, frame: Frame) -> np.ndarray:
        """Quantised coefficients of all components (zigzag), in plane order."""
        n = sum(r * c for r, c in frame.grid)
        return self.coefficients[frame.base[0] : frame.base[0] + n]

    def pixels(self) -> list[np.ndarray]:
        """The images as height x width x 3 (or 1) bytes."""
        samples = np.empty(self.coefficients.shape, np.uint8)
        quantiser = np.ones((len(self.coefficients), 1), np.int32)
        for f in self.frames:
            for c, (rows, columns) in enumerate(f.grid):
                if f.quant[f.quantisers[c]] is not None:
                    if quantiser.shape[1] == 1:
                        quantiser = np.ones(self.coefficients.shape, np.int32)
                    quantiser[f.base[c] : f.base[c] + rows * columns] = f.quant[f.quantisers[c]]
        for at in range(0, len(samples), 4096):
            samples[at : at + 4096] = inverse(self.coefficients[at : at + 4096] * quantiser[at : at + 4096])
        whole = [self._planes(f, samples) for f in self.frames]
        return [x if x.shape[-1] == 1 else rgb for x, rgb in zip(whole, _together(whole))]

    def _planes(self, frame: Frame, samples: np.ndarray) -> np.ndarray:
        """Components at full resolution, chroma by repetition."""
        h_most, v_most = max(s[0] for s in frame.sampling), max(s[1] for s in frame.sampling)
        out = np.empty((*(8 * n for n in (frame.mcus[0] * v_most, frame.mcus[1] * h_most)), len(frame.sampling)), np.uint8)
        for c, (h, v) in enumerate(frame.sampling):
            rows, columns = frame.grid[c]
            plane = samples[frame.base[c] : frame.base[c] + rows * columns].reshape(rows, columns, 8, 8).swapaxes(1, 2)
            up, wide = v_most // v, h_most // h
            if up * wide == 1:
                out[..., c].reshape(rows, 8, columns, 8)[:] = plane
            else:
                plane = plane.reshape(rows * 8, columns * 8)
                for y in range(up):
                    for x in range(wide):
                        out[y::up, x::wide, c] = plane
        return out[: frame.height, : frame.width]


def _together(images: list[np.ndarray]) -> list[np.ndarray]:
    """colours() over the pixels of all three-component images at once."""
    colour = [x for x in images if x.shape[-1] == 3]
    if not colour:
        return [x for x in images]
    flat = colours(np.concatenate([x.reshape(-1, 3) for x in colour]))
    cuts = iter(np.split(flat, np.cumsum([x.shape[0] * x.shape[1] for x in colour])[:-1]))
    return [next(cuts).reshape(x.shape) if x.shape[-1] == 3 else x for x in images]


def _basis() -> np.ndarray:
    """64 coefficients (zigzag) -> 64 samples, in integers of 1/4096."""
    k = np.arange(8)
    one = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    natural = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.rint(natural[ZIGZAG] * 4096)


BASIS = _basis()


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Samples of dequantised blocks.

    Factors are integers, so sums are exact in any order; 32-bit floats do
    where no sum can pass 2 ** 24.
    """
    small = not len(blocks) or 64 * 1024 * int(np.abs(blocks).max()) <= 1 << 24
    product = blocks.astype(np.float32 if small else np.float64) @ (BASIS32 if small else BASIS)
    product *= 1 / 4096
    product += 128.5
    np.floor(product, out=product)
    return np.clip(product, 0, 255, out=product).astype(np.uint8)


def colours(planes: np.ndarray) -> np.ndarray:
    """YCbCr (n x 3 bytes) to RGB in integers of 1/65536."""
    y = (planes[:, 0].astype(np.int32) << 16) + 32768
    cb, cr = planes[:, 1], planes[:, 2]
    out = np.empty(planes.shape, np.uint8)
    for k, shift in enumerate((_RED[cr], _GREEN_CB[cb] + _GREEN_CR[cr], _BLUE[cb])):
        value = (y + shift) >> 16
        out[:, k] = np.clip(value, 0, 255, out=value)
    return out


BASIS32 = BASIS.astype(np.float32)
_offset = np.arange(-128, 128, dtype=np.int32)
_RED, _GREEN_CB, _GREEN_CR, _BLUE = (f * _offset for f in (91881, -22554, -46802, 116130))
