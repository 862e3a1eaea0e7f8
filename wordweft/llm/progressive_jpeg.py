"""Media columns: progressive JPEG files, decoded to full-resolution RGB tensors in numpy.

The decoder reads baseline-free progressive files (SOF2): it accumulates spectral-selection and successive-approximation scans
into coefficient arrays, inverse-transforms them, upsamples chroma by repetition and converts to RGB. Entropy-coded data is
decoded in lockstep: every restart interval of every image of a batch is a lane, and one step decodes one symbol in all lanes
at once, so no Python loop runs over symbols or pixels. A file without restart markers is one lane a scan and decodes
correctly, only with less parallel work.

A payload of 64-byte blocks is stored losslessly in the format's own unit, the quantized coefficient: byte b at place k of
a block is the coefficient b - 128 at zigzag place k. Blocks fill the luma and chroma components of 16 x 16 units (4:2:0) in turn, and a comment
segment holds the number of payload blocks. Both DC and AC coefficients go through several scans.

Defined results: null counts as an empty text, which has one block of zeros; equal texts give equal files; repeated rows give
repeated rows; extra columns are ignored; an empty table gives an empty result. In `decode_media`, null files, files that are not progressive
JPEG, and files that are broken or end before their last marker give nulls. Sides hold 65,535 pixels, so a text may have the 2 GB that a string can.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: Payload bytes that one batch of lanes holds, about.
CHUNK = 2_500_000
#: Blocks in a restart interval of written files: of units in interleaved scans, of a component's blocks in the others.
INTERVAL = 16
#: Units in a row of a written image, more where the height would not fit the format's 16 bits; units that its sides can have.
UNITS_A_ROW, MOST_UNITS = 64, 65535 // 16


def zigzag() -> np.ndarray:
    """Raster place of each zigzag place of an 8 x 8 block: diagonals, walked by turns."""
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))
    return np.array([8 * r + c for r, c in at])


ZIGZAG = zigzag()
#: How written files split a block: (components, first place, last place, high bit before, low bit now).
SCANS = (((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 5, 1, 0) for c in range(3)))


def code_table(lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes of the symbols, in order, and their lengths."""
    sizes = np.repeat(np.arange(1, 17), lengths)
    codes, code, size = np.zeros(len(symbols), dtype=np.int64), 0, int(sizes[0]) if len(sizes) else 1
    for i, s in enumerate(sizes):
        code <<= int(s) - size
        size = int(s)
        codes[i] = code
        code += 1
    return codes, sizes


def lookup(lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """By the next 16 bits: symbol + 256 * code length; 0 where no code fits."""
    codes, sizes = code_table(lengths, symbols)
    out = np.zeros(1 << 16, dtype=np.int32)
    for c, n, s in zip(codes, sizes, symbols, strict=True):
        out[c << (16 - n) : (c + 1) << (16 - n)] = s + 256 * n
    return out


def _own_tables() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Huffman tables of written files, by class * 16 + id: runs of no zeros and end-of-block have short codes, all others one length."""
    dc = list(range(12))
    short = [0x05, 0x06, 0x07, 0x04, 0x03, 0x00, 0x02, 0x01]
    rest = [s for s in [*range(0x10, 0xF0, 0x10), 0xF0, *(16 * r + n for r in range(16) for n in range(1, 11))] if s not in short]
    count = lambda *pairs: np.array([dict(pairs).get(n, 0) for n in range(1, 17)])
    return {0x00: (count((4, 12)), np.array(dc)), 0x10: (count((4, len(short)), (9, len(rest))), np.array(short + rest))}


OWN_TABLES = _own_tables()


# ---------------------------------------------------------------- writing


_CATEGORY = np.ceil(np.log2(np.arange(1 << 13) + 1)).astype(np.int64)


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category and extra bits of values."""
    n = _CATEGORY[np.abs(v)]
    return n, np.where(v < 0, v + (1 << n) - 1, v)


def _merged(*lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, sizes and places of lists that are sorted by place, merged; no place is in two lists."""
    long, *others = lists
    short = tuple(np.concatenate(x) for x in zip(*others, strict=True))
    order = np.argsort(short[2], kind="stable")
    short = tuple(x[order] for x in short)
    at = np.arange(len(long[2])) + np.searchsorted(short[2], long[2])
    rest = np.ones(len(long[2]) + len(short[2]), dtype=bool)
    rest[at] = False
    out = []
    for x, y in zip(long, short, strict=True):
        z = np.empty(len(rest), dtype=np.int64)
        z[at], z[rest] = x, y
        out.append(z)
    return tuple(out)


def _packed(values: np.ndarray, sizes: np.ndarray, interval: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each interval (ascending numbers from 0): bits joined, padded with ones, 0xFF followed by 0."""
    n = int(interval[-1]) + 1
    total = np.bincount(interval, sizes, n).astype(np.int64)
    pad = -total % 8
    # One more token an interval fills its last byte.
    at, fill = np.arange(len(values)) + interval, np.cumsum(np.bincount(interval, minlength=n)) + np.arange(n)
    full_values, full_sizes = np.empty(len(values) + n, dtype=np.int64), np.empty(len(values) + n, dtype=np.int64)
    full_values[at], full_values[fill] = values, (1 << pad) - 1
    full_sizes[at], full_sizes[fill] = sizes, pad
    end = np.cumsum(full_sizes)
    first = end - full_sizes
    word, left = first >> 5, 64 - (first & 31) - full_sizes  # bits that stay free below the value in two words of 32
    wide = full_values.astype(np.uint64) << left.astype(np.uint64)
    words = int(end[-1] // 32) + 2
    high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    data = (high + low).astype(np.uint32).astype(">u4").tobytes()
    ends = np.cumsum((total + pad) // 8)
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


def _dc_tokens(blocks: np.ndarray, comp: np.ndarray, interval: np.ndarray, high: int, low: int, codes: dict) -> tuple:
    v = blocks[:, 0].astype(np.int64)
    if high:
        return (v >> low) & 1, np.ones(len(v), dtype=np.int64), interval
    v = v >> low
    diff = v.copy()
    for c in range(3):
        own = np.flatnonzero(comp == c)
        if len(own):
            same = np.concatenate([[False], interval[own][1:] == interval[own][:-1]])
            diff[own] = v[own] - np.where(same, np.concatenate([[0], v[own][:-1]]), 0)
    n, extra = _bits_of(diff)
    code, size = codes[0x00]
    return (code[n] << n) | extra, size[n] + n, interval


def _ac_first(blocks: np.ndarray, interval: np.ndarray, lo: int, hi: int, low: int, codes: dict) -> tuple:
    band = blocks[:, lo : hi + 1].astype(np.int64)
    v = np.sign(band) * (np.abs(band) >> low)
    row, col = np.nonzero(v)
    last = np.full(len(v), -1)
    last[row] = col  # ascending, so the last stays
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
    run = col - np.where(first, -1, np.concatenate([[0], col[:-1]])) - 1 if len(row) else col
    n, extra = _bits_of(v[row, col])
    code, size = codes[0x10]
    symbol = (run % 16) * 16 + n
    skips = run // 16
    # Tokens in place order: skips of sixteen before their value, end-of-block behind the last value.
    ended = np.flatnonzero(last < hi - lo)
    value, width, place = _merged(
        ((code[symbol] << n) | extra, size[symbol] + n, row * 128 + col * 2 + 1),
        (np.repeat(code[0xF0], skips.sum()), np.repeat(size[0xF0], skips.sum()), np.repeat(row * 128 + col * 2, skips)),
        (np.repeat(code[0], len(ended)), np.repeat(size[0], len(ended)), ended * 128 + 127),
    )
    return value, width, interval[place >> 7]


def _ac_refine(blocks: np.ndarray, interval: np.ndarray, lo: int, hi: int, low: int, codes: dict) -> tuple:
    band = blocks[:, lo : hi + 1].astype(np.int64)
    mag = np.abs(band) >> low
    old, new = mag > 1, mag == 1
    code, size = codes[0x10]
    zeros = np.cumsum(~old & ~new, axis=1)  # places that are still zero, up to here
    row, col = np.nonzero(new)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
    before = np.where(first, 0, np.concatenate([[0], zeros[row[:-1], col[:-1]]])) if len(row) else col
    run = zeros[row, col] - before if len(row) else col
    skips = run // 16
    # A skip of sixteen zeros stands before the correction bits that it passes: place it behind the 16th zero's predecessor span.
    tokens = []
    prev_end = np.where(first, -1, np.concatenate([[0], col[:-1]])) if len(row) else col
    at = prev_end.copy() if len(row) else col
    for k in range(int(skips.max()) if len(skips) else 0):
        live = np.flatnonzero(skips > k)
        tokens.append((np.repeat(code[0xF0], len(live)), np.repeat(size[0xF0], len(live)), row[live] * 256 + (at[live] + 1) * 2))
        target = before[live] + 16 * (k + 1)
        # The place of the 16th zero from here.
        at[live] = (zeros[row[live]] < target[:, None]).sum(1)
    s = (run % 16) * 16 + 1
    sign = (band[row, col] > 0).astype(np.int64) if len(row) else col
    tokens.append(((code[s] << 1) | sign, size[s] + 1, row * 256 + (at + 1) * 2))
    r, c = np.nonzero(old)
    bits = (mag[r, c] & 1, np.ones(len(r), dtype=np.int64), r * 256 + c * 2 + 1)
    last = np.full(len(band), -1)
    last[row] = col
    ended = np.flatnonzero(last < hi - lo)
    tokens.append((np.repeat(code[0], len(ended)), np.repeat(size[0], len(ended)), ended * 256 + (last[ended] + 1) * 2))
    value, width, place = _merged(bits, *tokens)
    return value, width, interval[place >> 8]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _layout(units_w: int, units_h: int) -> list[np.ndarray]:
    """For each component, the place of each of its blocks, in raster order, among blocks in unit order (four luma, two chroma)."""
    unit = np.arange(units_w * units_h).reshape(units_h, units_w)
    luma = np.empty((units_h * 2, units_w * 2), dtype=np.int64)
    for y in range(2):
        for x in range(2):
            luma[y::2, x::2] = unit * 6 + 2 * y + x
    return [luma.ravel(), (unit * 6 + 4).ravel(), (unit * 6 + 5).ravel()]


def write(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file of each payload, whose length is a positive multiple of BLOCK. Intervals of all files are coded together."""
    codes = {}
    for k, (lengths, symbols) in OWN_TABLES.items():
        c, s = code_table(lengths, symbols)
        code, size = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        code[symbols], size[symbols] = c, s
        codes[k] = (code, size)
    shapes, blocks, layouts = [], [], []
    for p in payloads:
        n = len(p) // BLOCK
        units = -(-n // 6)
        w = min(units, max(UNITS_A_ROW, -(-units // MOST_UNITS)))
        h = -(-units // w)
        own = np.zeros((w * h * 6, BLOCK), dtype=np.int16)
        own[:n] = np.frombuffer(p, dtype=np.uint8).reshape(n, BLOCK).astype(np.int16) - 128
        shapes.append((n, w, h))
        blocks.append(own)
        layouts.append(_layout(w, h))
    heads = []
    for n, w, h in shapes:
        out = b"\xff\xd8" + _segment(0xFE, b"blocks=%d" % n) + _segment(0xDB, bytes([0]) + bytes([1] * 64))
        out += _segment(0xC2, bytes([8]) + (h * 16).to_bytes(2, "big") + (w * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        for k, (lengths, symbols) in OWN_TABLES.items():
            out += _segment(0xC4, bytes([k]) + bytes(lengths.tolist()) + bytes(symbols.tolist()))
        heads.append([out + _segment(0xDD, INTERVAL.to_bytes(2, "big"))])
    for comps, lo, hi, high, low in SCANS:
        parts, part_comp, part_interval, n_of = [], [], [], []
        base = 0
        for own, layout in zip(blocks, layouts, strict=True):
            if len(comps) > 1:
                mine, unit = own[:, :1], 6 * INTERVAL
                part_comp.append(np.tile([0, 0, 0, 0, 1, 2], len(own) // 6))
            else:
                mine, unit = own[layout[comps[0]]], INTERVAL
            n = -(-len(mine) // unit)
            part_interval.append(base + np.arange(len(mine)) // unit)
            parts.append(mine)
            n_of.append(n)
            base += n
        all_blocks, interval = np.concatenate(parts), np.concatenate(part_interval)
        if lo == 0:
            tokens = _dc_tokens(all_blocks, np.concatenate(part_comp), interval, high, low, codes)
        else:
            tokens = (_ac_refine if high else _ac_first)(all_blocks, interval, lo, hi, low, codes)
        coded = _packed(*tokens)
        at = 0
        for head, n in zip(heads, n_of, strict=True):
            head.append(_segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), lo, hi, high << 4 | low])))
            for i in range(n):
                head.append(coded[at + i])
                if i + 1 < n:
                    head.append(bytes([0xFF, 0xD0 + i % 8]))
            at += n
    return [b"".join([*h, b"\xff\xd9"]) for h in heads]


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    blocks_w: int = 0  # of the padded array
    blocks_h: int = 0
    own_w: int = 0  # of scans of this component alone
    own_h: int = 0
    start: int = 0  # of its blocks in the batch's coefficient array


@dataclass
class Scan:
    comps: list[int]
    lo: int
    hi: int
    high: int
    low: int
    dc: list[np.ndarray]
    ac: list[np.ndarray]
    interval: int
    segments: list[bytes]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comps: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    @property
    def units(self) -> tuple[int, int]:
        h, v = max(c.h for c in self.comps), max(c.v for c in self.comps)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


_tables: dict[bytes, np.ndarray] = {}


def parse(data: bytes) -> Image:
    """Marker segments of a file, and the restart intervals of each scan with stuffed zeros removed."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, huff, at, interval = Image(), {}, 2, 0
    while True:
        if at + 1 >= len(data):
            raise ValueError("the end is missing")
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            top_h, top_v = max(c.h for c in out.comps), max(c.v for c in out.comps)
            w, h = out.units
            for c in out.comps:
                c.blocks_w, c.blocks_h = w * c.h, h * c.v
                c.own_w, c.own_h = -(-(-(-out.width * c.h // top_h)) // 8), -(-(-(-out.height * c.v // top_v)) // 8)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman files are read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                key = body[1 : 17 + n]
                if key not in _tables:
                    _tables[key] = lookup(np.frombuffer(body[1:17], dtype=np.uint8), np.frombuffer(body[17 : 17 + n], dtype=np.uint8).astype(np.int64))
                huff[body[0]] = _tables[key]
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            n = body[0]
            idents = [c.ident for c in out.comps]
            comps = [idents.index(body[1 + 2 * i]) for i in range(n)]
            pick = [body[2 + 2 * i] for i in range(n)]
            lo, hi, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            segments, begin = [], at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    at = len(data)
                    break
                if data[at + 1] == 0:
                    at += 2
                elif 0xD0 <= data[at + 1] <= 0xD7:
                    segments.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
                    at += 2
                    begin = at
                else:
                    break
            segments.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            out.scans.append(Scan(comps, lo, hi, high, low, [huff.get(p >> 4) for p in pick], [huff.get(0x10 | p & 15) for p in pick], interval, segments))
    return out


class Bits:
    """Bit readers of all lanes over one buffer."""

    def __init__(self, segments: list[bytes]):
        sizes = np.array([len(s) for s in segments])
        data = np.frombuffer(b"".join(segments) + b"\xff" * 8, dtype=np.uint8).astype(np.int64)
        # Five bytes from each place on.
        self.words = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
        self.at = (np.cumsum(sizes) - sizes) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 32 bits of each lane."""
        at = self.at[lanes]
        return (self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (8 - (at & 7))) & 0xFFFFFFFF

    def take(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n (0 to 16) bits of each lane."""
        x = self.peek(lanes) >> (32 - n)
        self.at[lanes] += n
        return x

    def symbol(self, lanes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each lane's next symbol, and its low four bits' worth of extra bits unless those are 0."""
        x = self.peek(lanes)
        got = table[x >> 16]
        used, n = np.maximum(got >> 8, 1), got & 15
        self.at[lanes] += used + n
        return got & 255, (x >> (32 - used - n)) & ((1 << n) - 1)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _lanes(images: list[Image], number: int) -> tuple[list[tuple[Image, Scan]], list[np.ndarray], list[np.ndarray], list[bytes]]:
    """For scan `number` of images whose scans are alike: block places and components of each lane, in coding order."""
    blocks, comps, segments = [], [], []
    for im in images:
        scan = im.scans[number]
        if len(scan.comps) == 1:
            c = im.comps[scan.comps[0]]
            order = c.start + (np.arange(c.own_h)[:, None] * c.blocks_w + np.arange(c.own_w)).ravel()
            which, unit = np.zeros(len(order), dtype=np.int64), 1
        else:
            w, h = im.units
            parts, names = [], []
            for i, k in enumerate(scan.comps):
                c = im.comps[k]
                y, x = np.arange(h)[:, None, None, None], np.arange(w)[None, :, None, None]
                own = (y * c.v + np.arange(c.v)[None, None, :, None]) * c.blocks_w + x * c.h + np.arange(c.h)[None, None, None, :]
                parts.append(c.start + own.reshape(w * h, -1))
                names.append(np.full(c.v * c.h, i))
            order = np.concatenate(parts, 1)
            unit = order.shape[1]
            which, order = np.tile(np.concatenate(names), w * h), order.ravel()
        step = scan.interval * unit if scan.interval else len(order)
        n = -(-len(order) // step)
        blocks += [order[i * step : (i + 1) * step] for i in range(n)]
        comps += [which[i * step : (i + 1) * step] for i in range(n)]
        segments += (scan.segments + [b""] * n)[:n]
    return blocks, comps, segments


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    sizes = np.array([len(r) for r in rows])
    out = np.full((len(rows), sizes.max()), fill, dtype=np.int64)
    out[np.arange(sizes.max())[None, :] < sizes[:, None]] = np.concatenate(rows)
    return out


def _read_scan(images: list[Image], number: int, coef: np.ndarray) -> None:
    """Adds scan `number` of the images to the coefficients; the lists of their scans are alike."""
    scan = images[0].scans[number]
    rows, which, segments = _lanes(images, number)
    place, comp = _padded(rows, -1), _padded(which, 0)
    sizes = np.array([len(r) for r in rows])
    bits = Bits(segments)
    n = len(rows)
    if scan.lo == 0:
        pred = np.zeros((n, len(scan.comps)), dtype=np.int64)
        for k in range(place.shape[1]):
            live = np.flatnonzero(sizes > k)
            at = place[live, k]
            if scan.high:
                coef[at, 0] |= (bits.take(live, np.ones(len(live), dtype=np.int64)) << scan.low).astype(np.int16)
                continue
            for c in range(len(scan.comps)):
                own = live[comp[live, k] == c]
                if len(own):
                    size, extra = bits.symbol(own, scan.dc[c])
                    pred[own, c] += _extend(extra, size)
                    coef[place[own, k], 0] = pred[own, c] << scan.low
        return
    table = scan.ac[0]
    block, k, skip = np.zeros(n, dtype=np.int64), np.full(n, scan.lo), np.zeros(n, dtype=np.int64)
    live = np.arange(n)
    band = np.arange(scan.lo, scan.hi + 1)

    def correct(lanes: np.ndarray, stop: np.ndarray) -> None:
        """Correction bits of the coefficients of the lanes' blocks, from k up to before stop, that are not zero yet."""
        at = place[lanes, block[lanes]]
        own = coef[at[:, None], band[None, :]]
        hit = (own != 0) & (band[None, :] >= k[lanes][:, None]) & (band[None, :] < stop[:, None])
        count = hit.sum(1)
        r, c = np.nonzero(hit)
        first = np.cumsum(count) - count
        where = bits.at[lanes][r] + np.arange(len(r)) - first[r]
        bit = (bits.words[np.minimum(where >> 3, len(bits.words) - 1)] >> (39 - (where & 7))) & 1
        v = own[r, c]
        coef[at[r], band[c]] = v + np.sign(v) * (bit << scan.low).astype(np.int16) * ((np.abs(v) >> scan.low) & 1 == 0)
        bits.at[lanes] += count

    end = np.int64(scan.hi + 1)
    while len(live):
        if scan.high:
            # Blocks within an end-of-band run only have correction bits.
            over = live[skip[live] > 0]
            if len(over):
                correct(over, np.full(len(over), end))
                skip[over] -= 1
                k[over] = end
            rest = live[k[live] < end]
            if len(rest):
                s, extra = bits.symbol(rest, table)
                run, size = s >> 4, s & 15
                eob = (size == 0) & (run < 15)
                ended = rest[eob]
                if len(ended):
                    r = run[eob]
                    skip[ended] = (1 << r) + bits.take(ended, r) - 1
                    correct(ended, np.full(len(ended), end))
                    k[ended] = end
                go = rest[~eob]
                if len(go):
                    run, size, sign = run[~eob], size[~eob], extra[~eob]
                    at = place[go, block[go]]
                    free = (coef[at[:, None], band[None, :]] == 0) & (band[None, :] >= k[go][:, None])
                    # The place of the zero after `run` zeros (for a skip of sixteen, the sixteenth itself), or the end.
                    passed = np.cumsum(free, axis=1)
                    stop = scan.lo + (passed < (run + 1)[:, None]).sum(1)
                    correct(go, np.minimum(stop, end))
                    put = np.flatnonzero((size > 0) & (stop < end))
                    coef[at[put], stop[put]] = np.where(sign[put] > 0, 1, -1) << scan.low
                    k[go] = np.minimum(stop + 1, end)
        else:
            over = live[skip[live] > 0]
            if len(over):
                jump = np.minimum(skip[over], sizes[over] - block[over])
                skip[over] -= jump
                block[over] += jump - 1
                k[over] = end
            rest = live[k[live] < end]
            if len(rest):
                s, extra = bits.symbol(rest, table)
                run, size = s >> 4, s & 15
                eob = (size == 0) & (run < 15)
                ended = rest[eob]
                if len(ended):
                    r = run[eob]
                    skip[ended] = (1 << r) + bits.take(ended, r) - 1
                    k[ended] = end
                go = rest[~eob]
                if len(go):
                    run, size = run[~eob], size[~eob]
                    v = _extend(extra[~eob], size)
                    at = k[go] + run
                    put = np.flatnonzero((size > 0) & (at < end))
                    coef[place[go[put], block[go[put]]], at[put]] = v[put] << scan.low
                    k[go] = np.minimum(at + 1, end)
        done = live[k[live] >= end]
        block[done] += 1
        k[done] = scan.lo
        live = live[block[live] < sizes[live]]


def read_coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Parsed files and their quantized coefficients in zigzag order, one row a block; a component's blocks start at its `start`."""
    images, total = [parse(f) for f in files], 0
    for im in images:
        for c in im.comps:
            c.start = total
            total += c.blocks_w * c.blocks_h
    coef = np.zeros((total, 64), dtype=np.int16)
    alike: dict[tuple, list[Image]] = {}
    for im in images:
        script = tuple((tuple(s.comps), s.lo, s.hi, s.high, s.low, *(id(t) for t in s.dc + s.ac)) for s in im.scans)
        alike.setdefault(script, []).append(im)
    for group in alike.values():
        for number in range(len(group[0].scans)):
            _read_scan(group, number, coef)
    return images, coef


def _inverse_matrix() -> np.ndarray:
    """64 x 64: from zigzag coefficients to raster samples, the product of two cosine transforms."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.kron(one, one)[ZIGZAG].astype(np.float32)


INVERSE = _inverse_matrix()


def to_planes(im: Image, coef: np.ndarray) -> list[np.ndarray]:
    """Red, green and blue, height x width bytes each, at full resolution."""
    top_h, top_v = max(c.h for c in im.comps), max(c.v for c in im.comps)
    planes = []
    for c in im.comps:
        own = coef[c.start : c.start + c.blocks_w * c.blocks_h].astype(np.float32) * im.quant[c.table].astype(np.float32)
        samples = (own @ INVERSE).reshape(c.blocks_h, c.blocks_w, 8, 8).transpose(0, 2, 1, 3).reshape(c.blocks_h * 8, c.blocks_w * 8)
        planes.append(np.clip(samples, -128, 127))
    full = [lambda x, c=c: x.repeat(top_v // c.v, 0).repeat(top_h // c.h, 1)[: im.height, : im.width] for c in im.comps]
    whole = lambda x: np.clip(x + 128.5, 0, 255.5).astype(np.uint8)
    y = full[0](planes[0])
    if len(planes) == 1:
        return [whole(y)] * 3
    # Chroma is weighted before it is repeated.
    cb, cr = planes[1], planes[2]
    return [whole(y + full[2](1.402 * cr)), whole(y - full[1](0.344136 * cb) - full[2](0.714136 * cr)), whole(y + full[1](1.772 * cb))]


def to_rgb(im: Image, coef: np.ndarray) -> np.ndarray:
    """height x width x 3 tensor of bytes at full resolution."""
    return np.stack(to_planes(im, coef), 2)


def read_payload(im: Image, coef: np.ndarray) -> bytes:
    """The payload that write() stored in an image."""
    n = int(im.comment.split(b"=")[1])
    w, h = im.units
    blocks = np.empty((w * h * 6, 64), dtype=np.int16)
    for c, places in zip(im.comps, _layout(w, h), strict=True):
        blocks[places] = coef[c.start : c.start + len(places)]
    return (blocks[:n] + 128).astype(np.uint8).tobytes()


def feature(planes: list[np.ndarray]) -> str:
    """Size, and mean and deviation of each channel, from the channels' histograms."""
    levels, out = np.arange(256), []
    for p in planes:
        n = np.bincount(p.ravel(), minlength=256)
        mean = (n @ levels) / p.size
        out.append(f"{mean:.3f}/{np.sqrt(max(0.0, (n @ levels**2) / p.size - mean * mean)):.3f}")
    return f"{planes[0].shape[1]}x{planes[0].shape[0]} " + " ".join(out)


def _chunks(sizes: pd.Series) -> pd.Series:
    return sizes.cumsum() // CHUNK


def _decoded(files: list[bytes]) -> list[np.ndarray | None]:
    """Tensors of files, null for those that can't be read; a file that breaks its batch is found by reading each alone."""
    held: dict[int, Image] = {}
    for i, f in enumerate(files):
        try:
            im = parse(f)
            if im.scans and im.comps and im.width and im.height and len(im.comps) in (1, 3):
                held[i] = im
        except (ValueError, IndexError, KeyError):
            pass
    out: list[np.ndarray | None] = [None] * len(files)
    try:
        images, coef = read_coefficients([files[i] for i in held])
        for i, im in zip(held, images, strict=True):
            out[i] = to_rgb(im, coef)
    except (ValueError, IndexError, KeyError, TypeError, OverflowError):
        if len(files) > 1:
            return [_decoded([f])[0] for f in files]
        return [None]
    return out


def decode_media(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """key, width, height and rgb (bytes of the tensor, rows of pixels of three channels) of progressive JPEG files; nulls where there is none to be read."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for _, b in whole.groupby(_chunks(whole[column].str.len().fillna(0)), sort=False):
                held = b[b[column].notna()]
                tensors = dict(zip(held.index, _decoded([bytes(x) for x in held[column]]), strict=True))
                rows = [(k, *((t.shape[1], t.shape[0], t.tobytes()) if (t := tensors.get(i)) is not None else (None, None, None))) for i, k in zip(b.index, b[key], strict=True)]
                yield pd.DataFrame(rows, columns=[key, "width", "height", "rgb"]).astype({"width": "Int32", "height": "Int32"})

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInPandas(decode, f"{key} {kind}, width int, height int, rgb binary")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Each text stored as a file and read back: sizes, digests and features; with_media adds the files as a column."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if with_media else [])]

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            raw = whole[text].map(lambda t: (t or "").encode("utf-8", "surrogatepass"))
            for _, part in raw.groupby(_chunks(raw.str.len()), sort=False):
                out = []
                files = write([r + bytes(-len(r) % BLOCK or (BLOCK if not r else 0)) for r in part])
                images, coef = read_coefficients(files)
                for k, r, f, im in zip(whole[key][part.index], part, files, images, strict=True):
                    back = read_payload(im, coef)
                    row = (k, len(r), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(to_planes(im, coef)))
                    out.append((*row, f) if with_media else row)
                yield pd.DataFrame(out, columns=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(key, text).mapInPandas(store, schema)


def op3_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
