"""BPE encoding and decoding with a vocabulary file of the tokenizers library.

A word is held as a contiguous array of parts with the rank of each adjacent pair beside it. The least rank is found by
scanning, its boundary deleted and the two neighbouring ranks refreshed, until no pair has a rank. Words longer than
SHORT, where scanning would grow with the square of their length, take the same merges from a heap. Words that come
again are looked up in a per-worker table of bounded size.

Handled are files with a BPE model, NFC + white space + lower case normalization, a Split pre-tokenizer followed by byte
level, and no decoder or post-processor. Added tokens that are not normalized are found in the raw text first.

Defined results: null counts as empty and gives no ids; repeated rows give repeated rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 128
CACHED = 300_000
#: Above this code point the library's own Unicode tables decide, as Python's may be of another version.
LATIN_END = 0x24F
_NOT_LATIN = regex.compile(f"[^\\x00-\\u{LATIN_END:04x}]")
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: bytes that print stand for themselves, the others follow from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._path = path
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = (tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"])
        self.merges = {(self.vocab[a] << 32) | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self._bytes = {x: b for b, x in enumerate(letters)}
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # White space is that of the library, which has no U+001C to U+001F.
        self._split = regex.compile(split.replace(r"\s", r"\t-\r\x20\x85\p{Z}"))
        self.pieces = {i: t for t, i in (self.vocab | self.added).items()}
        self._known: dict[bytes, list[int]] = {}
        self._library = None

    def _words(self, text: str) -> list[bytes]:
        """Pre-tokens as UTF-8, normalized."""
        if not _NOT_LATIN.search(text):
            return [w.encode() for w in self._split.findall(unicodedata.normalize("NFC", text).lower())]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        lib = self._library
        return [bytes([self._bytes[c] for c in w]) for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.first[b] for b in word[:-1]]
        parts.append(self.last[word[-1]])
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        merges = self.merges
        none = (_NONE, 0)
        ranks = [merges.get((a << 32) | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least[0] == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((parts[i] << 32) | parts[i + 1], none)
            if i:
                ranks[i - 1] = merges.get((parts[i - 1] << 32) | parts[i], none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get((parts[i] << 32) | parts[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get((parts[x] << 32) | parts[y])):
                    heapq.heappush(queue, (m[0], x, m[1], parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self._known
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                ids.append(self.added[part])
                continue
            for w in self._words(part):
                got = known.get(w)
                if got is None:
                    got = self.word(w)
                    if len(w) <= SHORT:
                        if len(known) >= CACHED:
                            known.clear()
                        known[w] = got
                ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces, ids of no token left out."""
        pieces = self.pieces
        return " ".join([pieces[i] for i in ids if i in pieces])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder per worker and path."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_column(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of a text column."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for texts in batches:
            yield texts.map(bpe.encode)

    return docs.withColumn(into, ids(F.coalesce(F.col(text), F.lit(""))))


def decode_column(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of an ids column."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for rows in batches:
            yield rows.map(bpe.decode)

    return docs.withColumn(into, decoded(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of encoding and decoding, without moving ids out of the Python workers."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        names = {i: str(i) for i in bpe.pieces}
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                ids = bpe.encode(t)
                rows.append((k, len(ids), sha(" ".join([names[i] for i in ids])), sha(bpe.decode(ids))))
            yield pd.DataFrame(rows, columns=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    return source.mapInPandas(digests, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
