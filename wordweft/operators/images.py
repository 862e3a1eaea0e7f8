"""Images as rows of RGB pixels, and the pictures' models as injected functions of arrays: enlarging, cleaning, hiding and finding messages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweft.functions.text import bits_of_text, text_of_bits

RGB = "height int, width int, rgb binary"
#: Sides that the small networks work on, and how far each size enlarges; max goes to any size.
SIDE = 128
SIZES = {"2x": 2, "4x": 4, "max": None}


def _ppm(raw: bytes) -> np.ndarray:
    kind, width, height, most, at = raw[:2], 0, 0, 0, 2
    numbers: list[int] = []
    while len(numbers) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        numbers.append(int(raw[at:end]))
        at = end
    width, height, most = numbers
    bands = {b"P6": 3, b"P5": 1}[kind]
    if most != 255:
        raise ValueError("only 8-bit samples")
    return np.frombuffer(raw, np.uint8, width * height * bands, at + 1).reshape(height, width, bands)


def _png(raw: bytes) -> np.ndarray:
    """8-bit PNG without interlacing."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, palette, head = 8, b"", None, None
    while at < len(raw):
        (size,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit samples in order")
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * bands)
    out = np.zeros((height, width * bands), np.uint8)
    above = np.zeros(width * bands, np.int32)
    for y in range(height):
        how, line = int(rows[y, 0]), rows[y, 1:].astype(np.int32)
        if how == 2:
            line = line + above
        elif how in (1, 3, 4):
            for x in range(width * bands):
                a = line[x - bands] if x >= bands else 0
                b, c = above[x], above[x - bands] if x >= bands else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + {1: a, 3: (a + b) // 2, 4: near}[how]) & 255
        above = line & 255
        out[y] = above
    picture = out.reshape(height, width, bands)
    return palette[picture[:, :, 0]] if colour == 3 else picture


def rgb_of(raw: bytes | None) -> np.ndarray | None:
    """Height by width by 3 of a PNG or binary PPM or PGM file, transparency dropped; null for what can't be read."""
    if raw is None:
        return None
    for read in (_png, _ppm):
        try:
            picture = read(bytes(raw))
        except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
            continue
        return np.ascontiguousarray(np.repeat(picture[:, :, :1], 3, 2) if picture.shape[2] < 3 else picture[:, :, :3])
    return None


def rgb_column(content: Column) -> Column:
    """Struct (height, width, rgb) of image files, fields null where a file can't be read."""

    @F.pandas_udf(RGB)
    def read(files: pd.Series) -> pd.DataFrame:
        found = [rgb_of(f) for f in files]
        return pd.DataFrame([(p.shape[0], p.shape[1], p.tobytes()) if p is not None else (None, None, None) for p in found], columns=["height", "width", "rgb"]).astype({"height": "Int32", "width": "Int32"})

    return read(content)


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, samples at the centres of pixels."""

    def places(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(picture.shape[0], height), places(picture.shape[1], width)
    p = picture.astype(float)
    top = p[y0][:, x0] * (1 - fx)[None, :, None] + p[y0][:, x1] * fx[None, :, None]
    low = p[y1][:, x0] * (1 - fx)[None, :, None] + p[y1][:, x1] * fx[None, :, None]
    return top * (1 - fy)[:, None, None] + low * fy[:, None, None]


def _pictures(images: DataFrame, load: Callable, work: Callable) -> DataFrame:
    """images (..., height, width, rgb) with new pixels: work(model, array of 0 to 1) gives an array of 0 to 1."""
    kept = [c for c in images.columns if c not in ("height", "width", "rgb")]
    schema = images.select(*kept).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            out = []
            for h, w, raw in zip(b["height"], b["width"], b["rgb"], strict=True):
                if raw is None:
                    out.append((None, None, None))
                    continue
                new = work(model, np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3) / 255)
                new = np.clip(np.rint(np.asarray(new) * 255), 0, 255).astype(np.uint8)
                out.append((new.shape[0], new.shape[1], new.tobytes()))
            yield pd.concat([b[kept].reset_index(drop=True), pd.DataFrame(out, columns=["height", "width", "rgb"]).astype({"height": "Int32", "width": "Int32"})], axis=1)

    return images.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [RGB]))


def upscale(images: DataFrame, load: Callable, size: str = "2x", target: tuple[int, int] | None = None) -> DataFrame:
    """Enlarged pictures. load() gives a function of (pixels, height, width); ValueError for an unknown size, or for max without a target (width, height)."""
    if size not in SIZES:
        raise ValueError(f"size {size!r} is none of {', '.join(SIZES)}")
    if size == "max" and target is None:
        raise ValueError("max needs a target size")
    factor = SIZES[size]
    return _pictures(images, load, lambda model, p: model(p, *((p.shape[0] * factor, p.shape[1] * factor) if factor else (target[1], target[0]))))


def denoise(images: DataFrame, load: Callable) -> DataFrame:
    """Cleaned pictures of SIDE by SIDE; load() gives a function of pixels."""
    return _pictures(images, load, lambda model, p: np.clip(model(resized(p, SIDE, SIDE)), 0, 1))


def hide(images: DataFrame, message: Column, load: Callable, num_bits: int = 96) -> DataFrame:
    """Pictures of SIDE by SIDE that carry a message; load() gives a function of (pixels, bits)."""
    withbits = images.withColumn("_bits", bits_of_text(message, num_bits))
    kept = [c for c in withbits.columns if c != "_bits"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            b = b.copy()
            for i in b.index:
                if b.at[i, "rgb"] is not None and b.at[i, "_bits"] is not None:
                    p = np.frombuffer(b.at[i, "rgb"], np.uint8).reshape(int(b.at[i, "height"]), int(b.at[i, "width"]), 3) / 255
                    new = np.clip(model(resized(p, SIDE, SIDE), np.asarray(b.at[i, "_bits"], dtype=float)), 0, 1)
                    b.at[i, "rgb"] = np.rint(new * 255).astype(np.uint8).tobytes()
                    b.at[i, "height"] = b.at[i, "width"] = SIDE
            yield b[kept]

    return withbits.mapInPandas(run, schema)


def reveal(images: DataFrame, load: Callable) -> DataFrame:
    """images with `message`; load() gives a function of pixels of SIDE by SIDE to the shares of its bits."""

    @F.pandas_udf("array<double>")
    def bits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for hs, ws, raws in batches:
            yield pd.Series([None if r is None else list(map(float, model(resized(np.frombuffer(r, np.uint8).reshape(int(h), int(w), 3) / 255, SIDE, SIDE)))) for h, w, r in zip(hs, ws, raws, strict=True)], dtype=object)

    return images.withColumn("_bits", bits("height", "width", "rgb")).withColumn("message", text_of_bits(F.col("_bits"))).drop("_bits")
