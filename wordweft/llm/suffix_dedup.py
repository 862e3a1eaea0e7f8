"""Repeated byte strings, found by suffix arrays of bounded blocks.

Every start of a WIDTH-byte string has a key: the least hash of the strings of 2/5 of that length inside it. Equal strings have equal
keys, so starts are dealt by key, and neighbouring starts of one key travel together as a segment. Keys that occur once in the whole
table - most - are dropped before any text moves. Segments of a key that are equal throughout are settled by counting their hashes; of the
others one of each kind is cut out of its text, and they meet in blocks of whole keys. A block's suffix array is built in two stages: only suffixes smaller
than their successor are sorted directly, the rest is induced by scanning the buckets, and adjacent common prefixes then tell
which starts share WIDTH bytes. Keys with more than MOST distinct segments (a passage that very many documents
share has one for each different neighbourhood) would outgrow a block; their strings are compared exactly by 128-bit hashes, dealt by hash.

Equal texts are one node throughout. Positions are UTF-8 bytes. All occurrences are removed, the first included.

Passages that repeat but are shorter than WIDTH can be counted in the same pass: starts are then dealt by the shorter strings, a segment carries the bytes
that its starts need for WIDTH, and one suffix array tells which of them share the shorter and which the longer width.

Defined results: null counts as empty; texts shorter than WIDTH bytes keep everything; repeated rows are separate documents, so
what they say is repeated; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweft.llm.common import cut, digest, drop

WIDTH = 400
#: What counts as a repeated passage is said in words, more than fifty, which take at least this many bytes in running text.
PASSAGE = 250
#: Starts a segment has at most; distinct segments a key has at most in a block; bytes of a block (more if one key has more).
LONGEST, MOST, BLOCK = 256, 2000, 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE[which], pow(_BASE[which], -1, 2**64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _POWERS[which] = (out[0], out[1])
    return _POWERS[which]


def window_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every width-byte string, from differences of one running sum."""
    n = len(data)
    p, q = _powers(n + 1, which)
    letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE[which]))
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(letters[data] * p[:n])])
        return _mix((s[width:] - s[:-width]) * q[: n - width + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    got, m = 1, x
    while got * 2 <= width:
        m = np.minimum(m[:-got], m[got:])
        got *= 2
    return m if got == width else np.minimum(m[: len(x) - width + 1], m[width - got :])


def gram_of(width: int) -> int:
    """Bytes of the strings whose hashes are keys."""
    return width * 2 // 5


def runs(data: np.ndarray, width: int = WIDTH, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, first starts and numbers of starts of the segments of a text of at least width bytes, and whether a key's string comes twice in its segment."""
    gram = gram_of(width)
    h = window_hashes(data, gram)
    least = _sliding_min(h, width - gram + 1)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], change])
    end = np.append(change, len(least))
    if (end - first).max() > longest:
        pieces = -(-(end - first) // longest)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + at * longest
        end = np.minimum(np.repeat(end, pieces), first + longest)
    keys = least[first]
    twice = np.fromiter((np.count_nonzero(h[a : b + width - gram] == k) > 1 for a, b, k in zip(first, end, keys, strict=True)), dtype=bool, count=len(first))
    return keys.view(np.int64), first, end - first, twice


def suffix_array(data: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` bytes, an ended suffix before longer ones.

    Suffixes smaller than their successor are sorted directly; in the bucket of a byte they stand behind the others, which
    are induced: scanning buckets upwards, each suffix puts its predecessor, if that is larger, at the next free place of the predecessor's bucket.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    step = np.sign(np.append(data[1:].astype(np.int16), -1) - data)  # the empty suffix at the end is the least
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    direct = step[at] > 0
    padded = np.concatenate([data, np.zeros(depth, dtype=np.uint8)])
    chosen = np.flatnonzero(direct)
    strings = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    if len(chosen):
        # A suffix that ends early is padded by zeros; longer starts come last among equals, which puts ended ones first.
        # Sorted byte by byte of their beginnings, since all strings at once would take depth times the block.
        chosen = chosen[::-1]
        chosen = chosen[np.argsort(data[chosen], kind="stable")]
        parts = np.split(chosen, np.flatnonzero(np.diff(data[chosen])) + 1)
        chosen = np.concatenate([x[np.argsort(np.ascontiguousarray(strings[x]).view(f"S{depth}").ravel(), kind="stable")] for x in parts])
    by_byte = np.searchsorted(data[chosen], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1]))  # what the empty suffix induces
    out = []

    def induce(of: np.ndarray, own: int) -> np.ndarray:
        before = of[of > 0] - 1
        before = before[~direct[before]]
        b = data[before]
        for c in np.unique(b):
            if c != own:
                waiting[c].append(before[b == c])
        return before[b == own]

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, dtype=np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        own = chosen[by_byte[c] : by_byte[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def adjacent_prefixes(data: np.ndarray, order: np.ndarray, cap: int = WIDTH) -> np.ndarray:
    """Bytes that each suffix of order shares with the next one, at most cap; eight bytes are compared at once."""
    padded = np.concatenate([data, np.zeros(cap + 8, dtype=np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data) + cap, 8), (1, 1))).view("<u8").ravel()
    a, b = order[:-1], order[1:]
    shared = np.full(len(a), cap, dtype=np.int64)
    live, x, y = np.arange(len(a)), a, b
    for d in range(0, cap, 8):
        differ = words[x + d] ^ words[y + d]
        found = np.flatnonzero(differ)
        if len(found):
            bits = differ[found]
            # The lowest bit that differs lies in the first byte that does.
            shared[live[found]] = d + (np.log2((bits & (~bits + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3)
            rest = np.flatnonzero(differ == 0)
            live, x, y = live[rest], x[rest], y[rest]
            if not len(live):
                break
    return np.minimum(np.minimum(shared, len(data) - np.maximum(a, b)), cap)


def repeated_starts(segments: list[bytes], weights: list[int], width: int = WIDTH, counts: list[int] | None = None, longer: int | None = None) -> tuple[list[np.ndarray], ...]:
    """For each segment, whether the width-byte string at each of its starts starts elsewhere too; a segment of weight 2 or more is repeated itself.

    counts are the numbers of starts, by default all that have width bytes. With longer, a second list says the same of strings of that many bytes, at the starts that have them.
    """
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes) - sizes
    order = suffix_array(data, longer or width)
    shared = adjacent_prefixes(data, order, longer or width)
    own = sizes - width + 1 if counts is None else np.array(counts)
    out = []
    for of in (width, longer) if longer else (width,):
        group = np.empty(len(data), dtype=np.int64)
        group[order] = np.concatenate([[0], np.cumsum(shared < of)])
        starts = np.clip(sizes - of + 1, 0, own)
        at = np.repeat(begin, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        weight = np.repeat(np.array(weights), starts)
        total = np.bincount(group[at], weight, len(data) + 1)
        out.append(np.split(total[group[at]] >= 2, np.cumsum(starts)[:-1]))
    return tuple(out)


def _intervals(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the stretches of True, by turns."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))


def _keys(texts: DataFrame, width: int) -> DataFrame:
    """digest, least key, copies c, and the keys of the segments (twice where the string comes twice) of each different text; texts has digest, key, text."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, rows in b.groupby("digest", sort=False):
                own, _, _, twice = runs(np.frombuffer(rows["text"].iloc[0].encode("utf-8", "surrogatepass"), dtype=np.uint8), width)
                least = rows["key"].min()
                out.append((d, None if pd.isna(least) else least, len(rows), np.concatenate([own, own[twice]])))
            yield pd.DataFrame({"digest": [x[0] for x in out], "key": pd.Series([x[1] for x in out], dtype=object), "c": [x[2] for x in out], "keys": [x[3] for x in out]})

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInPandas(keyed, f"digest binary, key {kind}, c bigint, keys array<bigint>").groupBy("digest").agg(F.min("key").alias("key"), F.sum("c").alias("c"), F.first("keys").alias("keys"))


def _segments(texts: DataFrame, width: int, longer: int) -> DataFrame:
    """digest, key, sid, first, n, size, twice and copies c of the segments whose key is among the text's repeated ones; size is of the bytes that strings of `longer` bytes need, as far as the text goes."""

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t, repeated, c in zip(b["digest"], b["text"], b["repeated"], b["c"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                keys, first, n, twice = runs(np.frombuffer(raw, dtype=np.uint8), width)
                for i in np.flatnonzero(np.isin(keys, repeated)):
                    s = raw[first[i] : first[i] + n[i] + longer - 1]
                    out.append((d, keys[i], xxhash.xxh3_128_digest(s, seed=int(n[i])), first[i], n[i], len(s), twice[i], c))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["digest", "key", "sid", "first", "n", "size", "twice", "c"]
    return texts.mapInPandas(segment, "digest binary, key bigint, sid binary, first int, n int, size int, twice boolean, c bigint")


def _cut_out(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """key, sid, n, weight, kinds and bytes of segments (digest, first, size besides the first five) of texts (digest, text)."""

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for t, *of in zip(b["text"], *(b[c] for c in fields), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for first, length, *rest in zip(*of, strict=True):
                    out.append((*rest, raw[first : first + length]))
                    size += length
                if size > 8_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    fields = ["first", "size", "key", "sid", "n", "weight", "kinds"]
    names = [*fields[2:], "bytes"]
    of_text = segments.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("of"))  # bounded by the text's length
    return texts.join(of_text, "digest").select("text", *(F.col(f"of.{c}").alias(c) for c in fields)).mapInPandas(cut_out, "key bigint, sid binary, n int, weight bigint, kinds bigint, bytes binary")


def _by_blocks(segments: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """sid, width and stretches of starts repeated at that width, for segments (key, sid, n, bytes, weight) with all of a key in one partition, sorted by key."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def done() -> pd.DataFrame:
            found = repeated_starts([x[3] for x in held], [x[4] for x in held], widths[0], [x[2] for x in held], *widths[1:])
            rows = [(x[1], w, _intervals(f)) for w, flags in zip(widths, found, strict=True) for x, f in zip(held, flags, strict=True) if f.any()]
            return pd.DataFrame(rows, columns=["sid", "width", "stretches"])

        for b in batches:
            for row in zip(b["key"], b["sid"], b["n"], b["bytes"], b["weight"], strict=True):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done()

    return segments.mapInPandas(resolve, "sid binary, width int, stretches array<int>")


def _by_hashes(segments: DataFrame, widths: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The same, and the table that was written for it, for keys with very many segments: every string's 128-bit hash meets its equals."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in range(0, len(b), 500):
                rows = b.iloc[part : part + 500]
                out = []
                for s, own, raw, weight in zip(rows["sid"], rows["n"], rows["bytes"], rows["weight"], strict=True):
                    data = np.frombuffer(raw, dtype=np.uint8)
                    for width in widths:
                        if len(data) >= width:
                            out.append((window_hashes(data, width, 0)[:own], window_hashes(data, width, 1)[:own], s, width, weight))
                n = [len(x[0]) for x in out]
                yield pd.DataFrame(
                    {
                        "h0": np.concatenate([x[0] for x in out]).view(np.int64),
                        "h1": np.concatenate([x[1] for x in out]).view(np.int64),
                        "sid": np.repeat(np.array([x[2] for x in out], dtype=object), n),
                        "at": np.concatenate([np.arange(k) for k in n]).astype(np.int32),
                        "width": np.repeat(np.array([x[3] for x in out], dtype=np.int32), n),
                        "weight": np.repeat(np.array([x[4] for x in out], dtype=np.int64), n),
                    }
                )

    strings = cut(segments.mapInPandas(hashed, "h0 bigint, h1 bigint, sid binary, at int, width int, weight bigint"), "strings")
    common = strings.groupBy("h0", "h1", "width").agg(F.sum("weight").alias("w")).where("w > 1").select("h0", "h1", "width")
    found = strings.join(common, ["h0", "h1", "width"]).groupBy("sid", "width").agg(F.sort_array(F.collect_list("at")).alias("at"))  # at most LONGEST each

    @F.pandas_udf("array<int>")
    def stretches(at: pd.Series) -> pd.Series:
        def of(x):
            flags = np.zeros(LONGEST + 1, dtype=bool)
            flags[x] = True
            return _intervals(flags)

        return at.map(of)

    return found.select("sid", "width", stretches("at").alias("stretches")), strings


def _keep(raw: bytes, spans, width: int) -> tuple[list[tuple[int, int]], bytes]:
    """Merged removed runs and the bytes outside them; spans are (first start, end of starts)."""
    merged: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        end = b + width - 1
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([a, end])
    kept, at = [], 0
    for a, b in merged:
        kept.append(raw[at:a])
        at = b
    return [(a, b) for a, b in merged], b"".join([*kept, raw[at:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, carry: tuple[str, ...] = (), width: int = WIDTH, passage: int | None = None) -> DataFrame:
    """key, the carried columns of docs, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; with_text adds kept_text, where broken UTF-8 at a cut is dropped, null if nothing is removed.

    Strings of `width` bytes that start twice or more are removed. With `passage`, a smaller number of bytes, n_passage_bytes follows: the bytes covered by strings
    of that many bytes that start twice or more, whether removed or not.
    """
    widths = (width,) if passage is None else (passage, width)
    if passage is not None and not 2 < passage < width:
        raise ValueError(f"passage must be less than width, {width}, and more than 2")
    whole_text = F.coalesce(F.col(text), F.lit(""))
    texts_of = docs.select(digest(F.col(text)).alias("digest"), F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") >= widths[0])
    nodes = cut(_keys(texts_of, widths[0]), "repeat-nodes")
    keyed = nodes.select("digest", "c", F.explode("keys").alias("k"))
    often = keyed.groupBy("k").agg(F.sum("c").alias("n")).where("n > 1").select("k")
    repeated = keyed.join(often, "k").groupBy("digest").agg(F.collect_set("k").alias("repeated"))  # bounded by the text's length
    # One row for each different text: that of the least key among its copies.
    wanted = cut(nodes.select(F.col("digest").alias("of"), F.col("key").alias("_k"), "c").join(repeated.withColumnRenamed("digest", "of"), "of"), "repeated-keys")
    drop(nodes)
    read = texts_of.join(wanted, (F.col("digest") == F.col("of")) & F.col("key").eqNullSafe(F.col("_k")))
    texts = cut(read.select("digest", "text", "repeated", "c").dropDuplicates(["digest"]), "repeat-texts")
    drop(wanted)
    segments = cut(_segments(texts, widths[0], width), "segments")
    distinct = segments.groupBy("key", "sid").agg(F.sum("c").alias("weight"), F.max("twice").alias("twice"), F.min(F.struct("digest", "first", "n", "size")).alias("at"))
    distinct = cut(distinct, "distinct-segments")
    by_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("within")).where("kinds > 1 or within").drop("within")
    unsettled = cut(_cut_out(texts.select("digest", "text"), distinct.join(by_key, "key").select("key", "sid", "weight", "kinds", "at.*")), "unsettled-segments")
    blocks = _by_blocks(unsettled.where(F.col("kinds") <= MOST).select("key", "sid", "n", "bytes", "weight").repartition("key").sortWithinPartitions("key"), widths)
    hashed, *strings = _by_hashes(unsettled.where(F.col("kinds") > MOST).select("sid", "n", "bytes", "weight"), widths)
    whole = distinct.where("weight > 1").select("sid")
    pairs = F.transform(F.sequence(F.lit(0), (F.size("stretches") / 2).cast("int") - 1), lambda i: F.struct((F.col("first") + F.get("stretches", 2 * i)).alias("a"), (F.col("first") + F.get("stretches", 2 * i + 1)).alias("b")))
    some = segments.join(blocks.unionByName(hashed).join(whole, "sid", "left_anti"), "sid").select("digest", "width", F.explode(pairs).alias("s"))
    ends = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.least("n", F.col("size") - w + 1).alias("m")) for w in widths)))
    all_of = segments.join(whole, "sid").select("digest", "first", ends.alias("e")).where("e.m > 0").select("digest", "e.width", F.struct(F.col("first").alias("a"), (F.col("first") + F.col("e.m")).alias("b")).alias("s"))
    of = {f"_{w}": F.collect_list(F.when(F.col("width") == w, F.col("s"))) for w in widths}  # bounded by the text's length
    spans = cut(some.unionByName(all_of).groupBy("digest").agg(*(x.alias(name) for name, x in of.items())), "spans")
    drop(segments, distinct, unsettled, *strings)
    names = ["n_removed", "n_spans", "kept_sha256", *(["n_passage_bytes"] if passage else []), *(["kept_text"] if with_text else [])]

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t, *spans_of in zip(b["digest"], b["text"], *(b[f"_{w}"] for w in widths), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                removed, kept = _keep(raw, spans_of[-1], width)
                row = (d, len(raw) - len(kept), len(removed), hashlib.sha256(kept).hexdigest())
                if passage:
                    row += (len(raw) - len(_keep(raw, spans_of[0], passage)[1]),)
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            yield pd.DataFrame(out, columns=["_of", *names])

    changed = cut(texts.select("digest", "text").join(spans, "digest").mapInPandas(clean, "_of binary, n_removed bigint, n_spans bigint, kept_sha256 string" + ", n_passage_bytes bigint" * bool(passage) + ", kept_text string" * with_text), "changed-texts")
    drop(texts, spans)
    rows = docs.select(key, *carry, digest(F.col(text)).alias("_d"), F.octet_length(whole_text).cast("long").alias("_n"), F.sha2(whole_text.cast("binary"), 256).alias("_sha256"))
    return rows.join(changed, F.col("_d") == F.col("_of"), "left").select(
        key,
        *carry,
        F.col("_n").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "_sha256").alias("kept_sha256"),
        *([F.coalesce("n_passage_bytes", F.lit(0)).cast("long").alias("n_passage_bytes")] if passage else []),
        *([F.when(F.col("n_removed") > 0, F.col("kept_text")).alias("kept_text")] if with_text else []),
    )


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), passage=PASSAGE)
