"""The decoder on files that it did not write: a plain encoder, one bit at a time, with end-of-band runs, other samplings, with and without restart markers."""

import math
import random

import numpy as np

from wordweft.llm import progressive_jpeg

PLAIN = [int(x) for x in progressive_jpeg.ZIGZAG]


class Coder:
    """Entropy-coded data in which every symbol's code is its number in nine bits."""

    def __init__(self):
        self.bits, self.run, self.held = [], 0, []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def symbol(self, s):
        self.put(s, 9)

    def signed(self, v, n):
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def end_run(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.symbol(n << 4)
            self.put(self.run - (1 << n), n)
            self.run = 0
        self.bits += self.held
        self.held = []

    def finish(self):
        self.end_run()
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def first_ac(c, block, low):
    zeros = 0
    for v in block[1:]:
        size = abs(v) >> low
        if not size:
            zeros += 1
            continue
        c.end_run()
        while zeros > 15:
            c.symbol(0xF0)
            zeros -= 16
        n = size.bit_length()
        c.symbol(zeros << 4 | n)
        c.signed(size if v > 0 else -size, n)
        zeros = 0
    c.run += zeros > 0


def later_ac(c, block, low):
    sizes = [abs(v) >> low for v in block]
    last = max((k for k in range(1, 64) if sizes[k] == 1), default=0)
    zeros, own = 0, []
    for k in range(1, 64):
        if not sizes[k]:
            zeros += 1
            continue
        while zeros > 15 and k <= last:
            c.end_run()
            c.symbol(0xF0)
            zeros -= 16
            c.bits += own
            own = []
        if sizes[k] > 1:
            own.append(sizes[k] & 1)
            continue
        c.end_run()
        c.symbol(zeros << 4 | 1)
        c.put(int(block[k] > 0), 1)
        c.bits += own
        own, zeros = [], 0
    if zeros or own:
        c.run += 1
        c.held += own


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(width, height, samplings, blocks, quant, restart):
    """blocks[c][y][x]: 64 coefficients in zigzag order."""
    top_h, top_v = max(h for h, _ in samplings), max(v for _, v in samplings)
    units_w, units_h = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    flat = bytes([0] * 8 + [255] + [0] * 7)  # 255 codes of nine bits; symbol 255 is not used
    out = b"\xff\xd8" + segment(0xDB, bytes([0, *quant]))
    out += segment(0xC2, bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(samplings)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(samplings)))
    out += b"".join(segment(0xC4, bytes([k]) + flat + bytes(range(255))) for k in (0x00, 0x10))
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))

    def scan(comps, lo, hi, high, low):
        data = segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), lo, hi, high << 4 | low]))
        if len(comps) > 1 or lo == 0 and len(samplings) > 1:
            units = [[(c, y * samplings[c][1] + j, x * samplings[c][0] + i) for c in comps for j in range(samplings[c][1]) for i in range(samplings[c][0])] for y in range(units_h) for x in range(units_w)]
        else:
            h, v = samplings[comps[0]]
            own_w, own_h = -(-(-(-width * h // top_h)) // 8), -(-(-(-height * v // top_v)) // 8)
            units = [[(comps[0], y, x)] for y in range(own_h) for x in range(own_w)]
        step, n = restart or len(units), 0
        for start in range(0, len(units), step):
            if start:
                data += bytes([0xFF, 0xD0 + n % 8])
                n += 1
            c, before = Coder(), dict.fromkeys(comps, 0)
            for k, y, x in (b for u in units[start : start + step] for b in u):
                block = blocks[k][y][x]
                if lo:
                    (later_ac if high else first_ac)(c, block, low)
                elif high:
                    c.put(block[0] >> low & 1, 1)
                else:
                    value = block[0] >> low
                    size = abs(value - before[k]).bit_length()
                    c.symbol(size)
                    if size:
                        c.signed(value - before[k], size)
                    before[k] = value
            data += c.finish()
        return data

    every = list(range(len(samplings)))
    out += scan(every, 0, 0, 0, 1) + b"".join(scan([c], 1, 63, 0, 2) for c in every) + b"".join(scan([c], 1, 63, 2, 1) for c in every)
    return out + scan(every, 0, 0, 1, 0) + b"".join(scan([c], 1, 63, 1, 0) for c in every) + b"\xff\xd9"


def pixels(width, height, samplings, blocks, quant):
    """Straight from the definition: cosine sums, repeated chroma, colour transform."""
    top_h, top_v = max(h for h, _ in samplings), max(v for _, v in samplings)
    wave = [[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    planes = []
    for (h, v), rows in zip(samplings, blocks):
        plane = np.zeros((len(rows) * 8, len(rows[0]) * 8))
        for by, row in enumerate(rows):
            for bx, block in enumerate(row):
                square = np.zeros((8, 8))
                for k, c in enumerate(block):
                    if c:
                        square += c * quant[k] * np.outer(wave[PLAIN[k] // 8], wave[PLAIN[k] % 8])
                plane[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8] = np.clip(square, -128, 127)
        planes.append([[plane[y * v // top_v, x * h // top_h] for x in range(width)] for y in range(height)])
    p = np.array(planes)
    if len(p) == 1:
        return np.stack([p[0] + 128] * 3, 2)
    return np.clip(np.stack([p[0] + 1.402 * p[2], p[0] - 0.344136 * p[1] - 0.714136 * p[2], p[0] + 1.772 * p[1]], 2) + 128, 0, 255)


def pictures():
    rng = random.Random(33)
    for samplings in ([(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]):
        for restart in (0, 3):
            width, height = rng.randrange(17, 60), rng.randrange(9, 60)
            top_h, top_v = max(h for h, _ in samplings), max(v for _, v in samplings)
            across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
            own_w = [-(-(-(-width * h // top_h)) // 8) for h, _ in samplings]
            own_h = [-(-(-(-height * v // top_v)) // 8) for _, v in samplings]

            def block(inside):
                full = rng.random()
                tail = [rng.choice((-9, -5, -2, -1, 1, 2, 3, 7)) if inside and rng.random() < (0.25 if full < 0.4 else 0.02 if full < 0.7 else 0) else 0 for _ in range(63)]
                return [rng.randrange(-300, 300), *tail]

            blocks = [[[block(y < own_h[c] and x < own_w[c]) for x in range(across * h)] for y in range(down * v)] for c, (h, v) in enumerate(samplings)]
            quant = [rng.randrange(1, 4) for _ in range(64)]
            yield width, height, samplings, blocks, quant, encode(width, height, samplings, blocks, quant, restart)


def test_foreign_files_decode_exactly():
    for width, height, samplings, blocks, quant, raw in pictures():
        (im,), coef = progressive_jpeg.read_coefficients([raw])
        for c, rows in zip(im.comps, blocks):
            assert coef[c.start : c.start + c.blocks_w * c.blocks_h].tolist() == [b for row in rows for b in row]
        got = progressive_jpeg.to_rgb(im, coef)
        assert got.shape == (height, width, 3)
        assert np.abs(got.astype(float) - pixels(width, height, samplings, blocks, quant)).max() <= 1


def test_what_cannot_be_read_is_null(spark):
    files = [p[-1] for p in pictures()]
    broken = [files[0][:-2], files[1][: len(files[1]) // 2], b"", b"\xff\xd8", b"GIF89a", files[2].replace(b"\xff\xc2", b"\xff\xc0", 1), files[3][:2] + files[3][-40:], None]
    media = spark.createDataFrame([(i, f, "x") for i, f in enumerate([*files, *broken])], "k long, media binary, rgb string")
    out = {r.k: r for r in progressive_jpeg.decode_media(media, "k").collect()}
    assert [out[i].rgb is not None for i in range(len(out))] == [True] * len(files) + [False] * len(broken)
    for i, (width, height, *_) in enumerate(pictures()):
        assert (out[i].width, out[i].height, len(out[i].rgb)) == (width, height, width * height * 3)
    assert progressive_jpeg.decode_media(media.where("false"), "k").count() == 0
    assert progressive_jpeg.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tall_texts_fit_the_format():
    # The height of the longest string's image, in units, whatever the width of a shorter one's.
    units = -(-(2**31) // (64 * 6))
    wide = max(progressive_jpeg.UNITS_A_ROW, -(-units // progressive_jpeg.MOST_UNITS))
    assert wide <= progressive_jpeg.MOST_UNITS and -(-units // wide) <= progressive_jpeg.MOST_UNITS
