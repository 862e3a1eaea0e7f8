"""Texts in chunks of bounded size that trade packed tables with buckets of keys, instead of one row a text and key."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a chunk holds and that fill one bucket, about. A bucket holds the distinct terms of so much text at most.
CHUNK, BUCKET = 8 << 20, 8 << 20


def number(volume: int, size: int) -> int:
    """How many parts of about this size hold the volume."""
    return max(1, -(-int(volume) // size))


def deal(docs: DataFrame, volume: int, *by: str) -> DataFrame:
    """docs with their chunk, dealt by a hash of the columns by; equal plans of it share one shuffle."""
    return docs.select(F.pmod(F.xxhash64(*by), F.lit(number(volume, CHUNK))).cast("int").alias("chunk"), "*")


def hashes(words: pa.Array) -> np.ndarray:
    """32-bit numbers of distinct words, the same in every process."""
    return np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], dtype=np.uint64)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each two, far from either; below 2**31."""
    with np.errstate(over="ignore"):
        h = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((second.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def numbers(counts: np.ndarray) -> bytes:
    """Counts of 0 and more, in as few bytes each as the largest needs."""
    kind = np.dtype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if not counts.size or counts.max() <= np.iinfo(t).max))
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def read_numbers(blob: bytes, rows: int) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(blob[1:]), {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[blob[0]])
    return flat.reshape(rows, -1).astype(np.int64) if rows else flat.reshape(0, 0).astype(np.int64)


def packed(chunk: int, terms: pa.Array, counts: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
    """(chunk, bucket, terms, counts) of every bucket that has terms; terms hold no line feed."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), terms), "\n").to_pylist()
    full = [b for b in range(len(starts) - 1) if starts[b] < starts[b + 1]]
    blobs = [zlib.compress(joined[b].encode() + b"\n", 1) for b in full]
    return pd.DataFrame({"chunk": chunk, "bucket": full, "terms": blobs, "counts": [numbers(counts[:, starts[b] : starts[b + 1]]) for b in full]})


def unpacked(terms: pd.Series, counts: pd.Series, rows: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of all blobs, one after another and each with its line feed, their counts, and how many each blob has."""
    texts = [zlib.decompress(b) for b in terms]
    data = b"".join(texts)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    sizes = np.array([t.count(b"\n") for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return found, np.concatenate([np.zeros((rows, 0), np.int64), *(read_numbers(b, rows) for b in counts)], axis=1), sizes


def text_lines(lines: list[str]) -> bytes:
    """Lines without line feeds inside, packed."""
    return zlib.compress("\n".join(lines).encode(), 1)


def read_lines(blob: bytes) -> list[str]:
    return zlib.decompress(blob).decode().split("\n")


def keyed(chunk: int, rows: dict[str, dict[str, int]], buckets: int) -> pd.DataFrame:
    """(chunk, bucket, lines) of counts by key and item; a line is a key, then items and their counts, all parted by tabs. Keys and items hold neither tab nor line feed."""
    dealt: dict[int, list[str]] = {}
    for key in sorted(rows):
        dealt.setdefault(zlib.crc32(key.encode()) % buckets, []).append("\t".join([key, *(f"{item}\t{n}" for item, n in rows[key].items())]))
    return pd.DataFrame({"chunk": chunk, "bucket": list(dealt), "lines": [text_lines(x) for x in dealt.values()]})


def summed(p: pd.DataFrame, shown=lambda key, items: "\t".join(f"{i}\t{n}" for i, n in sorted(items.items(), key=lambda x: (-x[1], x[0])))) -> pd.DataFrame:
    """(chunk, lines) for what keyed() sent to one bucket: to each chunk its keys, each with its items and counts over all chunks, commonest first."""
    sums: dict[str, dict[str, int]] = {}
    for blob in p["lines"]:
        for line in read_lines(blob):
            key, *rest = line.split("\t")
            of = sums.setdefault(key, {})
            for item, n in zip(rest[::2], rest[1::2], strict=True):
                of[item] = of.get(item, 0) + int(n)
    told = {key: shown(key, items) for key, items in sums.items()}
    del sums

    def answer(blob: bytes) -> bytes:
        keys = (line.split("\t", 1)[0] for line in read_lines(blob))
        return text_lines([f"{k}\t{told[k]}" if told[k] else k for k in keys])

    return pd.DataFrame({"chunk": p["chunk"], "lines": [answer(b) for b in p["lines"]]})


def answered(lines: pd.Series) -> dict[str, list[tuple[str, int]]]:
    """Keys with their items and counts, as summed() sent them."""
    found = {}
    for blob in lines:
        for line in read_lines(blob):
            key, *rest = line.split("\t")
            found[key] = [(i, int(n)) for i, n in zip(rest[::2], rest[1::2], strict=True)]
    return found
