"""Subword tokenization by vocabulary files of the tokenizers library, one tokenizer a worker."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_loaded: dict[object, object] = {}
#: A word behind one space, between words that stand like it. No vocabulary's words or normalization reach over such a space, so the tokens of a text
#: are those of its pieces.
_APART = re.compile("((?<=[!-~\u00c0-\u024f]) [!-~\u00c0-\u024f]+(?= [!-~\u00c0-\u024f]))")
#: Pieces that a worker keeps the tokens of, and their longest.
CACHED, SHORT = 400_000, 40


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def encode(text: Column, path: str) -> Column:
    """Ids of a text; null and empty texts have none."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for texts in batches:  # one text at a time: the library holds some 100 bytes a token until its ids are taken
            yield pd.Series([np.array(t.encode(x or "").ids, "int32") for x in texts], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids; null and empty lists give an empty text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for rows in batches:
            yield rows.map(lambda x: t.decode(list(x)) if x is not None and len(x) else "")

    return texts(ids)


class _Pieces:
    """Texts by their pieces; what `of` gives for those that come again is looked up in a table of bounded size."""

    def __init__(self, of):
        self.of, self.known = of, {}

    def _piece(self, piece: str):
        found = self.of(piece)
        if len(piece) <= SHORT and len(self.known) < CACHED:
            self.known[piece] = found
        return found

    def __call__(self, text: str) -> list:
        known = self.known
        return [known[p] if p in known else self._piece(p) for p in _APART.split(text) if p]


def _pieces(path: str, what: str) -> _Pieces:
    """A worker's table of a vocabulary: how many tokens a piece has, or with `trip` also what they decode to. It outlives a task."""
    if (path, what) not in _loaded:
        t = _tokenizer(path)

        def trip(piece: str) -> tuple[int, str]:
            ids = t.encode(piece).ids
            return len(ids), t.decode(ids) if ids else ""

        _loaded[path, what] = _Pieces(trip if what == "trip" else lambda piece: len(t.encode(piece)))
    return _loaded[path, what]


def count(text: Column, path: str) -> Column:
    """How many ids encode() gives, without making them."""

    @F.pandas_udf("long")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(path, "count")
        for texts in batches:
            yield pd.Series([sum(pieces(x or "")) for x in texts], dtype="int64")

    return n(text)


def round_trip(text: Column, path: str) -> Column:
    """Struct of n_tokens and same, whether decode() gives the encoded text back; null for null texts."""

    def one(pieces: _Pieces, text: str | None) -> tuple[int, bool | None]:
        found = pieces(text or "")
        return sum(n for n, _ in found), None if text is None else "".join(t for _, t in found) == text

    @F.pandas_udf("n_tokens long, same boolean")
    def trips(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(path, "trip")
        for texts in batches:
            rows = [one(pieces, x) for x in texts]
            yield pd.DataFrame({"n_tokens": pd.Series([n for n, _ in rows], dtype="int64"), "same": pd.Series([same for _, same in rows], dtype=object)})

    return trips(text)
