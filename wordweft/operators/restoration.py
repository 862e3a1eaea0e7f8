"""Restoring marks: lookup by character context, decoding over word candidates, and their training tables."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweft.functions.text import split_sentences
from wordweft.functions.unicode import strip_column
from wordweft.operators import chunks
from wordweft.session import cut

# Java has U+0300 to U+036F outside \w, where this splitting wants them inside.
WORD_CLASS = r"[\p{L}\p{N}_\u0300-\u036f]"
TOKEN = rf"{WORD_CLASS}+|[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\p{{Z}}\u0300-\u036f]|[\s\x1c-\x1f\x85\p{{Z}}]+"
# The letters that context lookup may change, by language; the marks that a six-way letter classifier adds.
TARGETS = {"yor": "oes", "ibo": "iuoe"}
CLASSIFIED = ("", "\u0323", "\u0301", "\u0300", "\u0323\u0301", "\u0323\u0300")


def tokens(text: Column) -> Column:
    """Words, single other characters and runs of white space; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(f"^{WORD_CLASS}+$")


def transfer_case(original: Column, restored: Column) -> Column:
    """The restored lower-case word in the case of the original: all upper, first upper, or as it is."""
    first = F.substring(original, 1, 1)
    upper = (F.upper(original) == original) & (F.lower(original) != original)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(upper, F.upper(restored)).when(capital, F.concat(F.upper(F.substring(restored, 1, 1)), F.lower(F.substring(restored, F.lit(2), F.length(restored))))).otherwise(restored)


def _placed_words(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return docs.select("doc_id", *by, F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def _contexts(words: DataFrame, word: str) -> DataFrame:
    """One row a character of a word: its place and the five characters around it, padded with _."""
    padded = F.concat(F.lit("__"), F.col(word), F.lit("__"))
    return words.withColumn("at", F.explode(F.sequence(F.lit(1), F.length(word)))).withColumn("ctx", F.substring(padded, F.col("at"), F.lit(5)))


def knn_train(marked: DataFrame, plain: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(width, ctx, out): for plain contexts of 5, 3 and 1 characters the commonest marked character, equal counts by character.

    marked has doc_id and text; plain strips the column `word` without changing its length. by names columns of marked that
    keep models apart, the language for one; they come first in the result.
    """
    each = marked.select(*by, F.explode(F.transform(F.filter(tokens(F.col("text")), is_word), F.lower)).alias("word"))
    words = each.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("times")).withColumn("plain", plain)
    chars = _contexts(words.where(F.length("word") == F.length("plain")), "plain").withColumn("out", F.substring("word", F.col("at"), F.lit(1)))
    widths = F.array(F.struct(F.lit(5).alias("width"), F.col("ctx").alias("c")), F.struct(F.lit(3).alias("width"), F.substring("ctx", 2, 3).alias("c")), F.struct(F.lit(1).alias("width"), F.substring("ctx", 3, 1).alias("c")))
    counted = chars.select(*by, F.explode(widths).alias("w"), "out", "times").groupBy(*by, F.col("w.width").alias("width"), F.col("w.c").alias("ctx"), "out").agg(F.sum("times").alias("n"))
    best = counted.groupBy(*by, "width", "ctx").agg(F.max(F.struct("n", F.lit(1).alias("x"))).alias("m"))
    return counted.join(best, [*by, "width", "ctx"]).where(F.col("n") == F.col("m.n")).groupBy(*by, "width", "ctx").agg(F.min("out").alias("out"))


def knn_decode(docs: DataFrame, model: DataFrame, targets: str | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, restored): every target character looked up by 5, then 3, then 1 characters of context.

    Distinct words are decoded once; tables are joined on their context, whatever their size. With by, each text meets the
    model of its own values there, and targets may be a column made of them.
    """
    docs = docs.select("doc_id", "text", *by)
    own = docs.select("doc_id", *by, F.explode(F.array_distinct(F.transform(F.filter(tokens(F.col("text")), is_word), F.lower))).alias("word"))
    words = own.select(*by, "word").distinct()
    chars = _contexts(words, "word").withColumn("c", F.substring("ctx", 3, 1))
    open_ = chars.where(F.contains(F.lit(targets), F.col("c"))).select(*by, "ctx", "c").distinct()
    of = lambda width: model.where(F.col("width") == width).select(*by, F.col("ctx").alias("k"), F.col("out").alias(f"o{width}"))
    looked = open_
    for width, key in ((5, F.col("ctx")), (3, F.substring("ctx", 2, 3)), (1, F.col("c"))):
        looked = looked.withColumn("k", key).join(of(width), [*by, "k"], "left").drop("k")
    looked = looked.select(*by, "ctx", F.coalesce("o5", "o3", "o1", "c").alias("new"))
    back = chars.join(looked, [*by, "ctx"], "left").groupBy(*by, "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "c").alias("x")))), lambda x: x["x"]), "").alias("restored"))
    # Only words that change come back to their texts, which look them up in place.
    new = own.join(back.where("restored <> word"), [*by, "word"]).groupBy("doc_id", *by).agg(F.map_from_entries(F.collect_set(F.struct("word", "restored"))).alias("new"))
    out = lambda t: F.when(is_word(t), transfer_case(t, F.coalesce(F.try_element_at("new", F.lower(t)), F.lower(t)))).otherwise(t)
    return docs.join(new, ["doc_id", *by], "left").select("doc_id", F.array_join(F.transform(tokens(F.col("text")), out), "").alias("restored"))


def _windows(words: str, targets: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The code points of words that have two line feeds before, between and after them; where they are a target; a number for each such place's context, and the distinct contexts."""
    points = np.frombuffer(words.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(np.isin(points, [ord(c) for c in targets]))
    around = np.lib.stride_tricks.sliding_window_view(np.where(points == 10, np.uint32(ord("_")), points), 5)[at - 2]
    coded = pa.Array.from_buffers(pa.binary(20), len(at), [None, pa.py_buffer(around.tobytes())]).dictionary_encode()
    return points, at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [c.decode("utf-32-le") for c in coded.dictionary.to_pylist()]


def _each_stripped(text: str, plain: Callable[[str], str]) -> str:
    """plain of a long text that it strips letter by letter; it meets the distinct ones only."""
    points, letters = np.frombuffer(text.encode("utf-32-le"), np.uint32), "".join(set(text))
    table = np.zeros(ord(max(letters)) + 1, np.uint32)
    table[[ord(c) for c in letters]] = [ord(c) for c in plain(letters)]
    return table[points].tobytes().decode("utf-32-le")


def own_knn(marked: DataFrame, plain: Callable[[str], str], targets: Callable[[str], str], by: str) -> DataFrame:
    """(doc_id, restored): knn_decode of the stripped texts by the table that knn_train makes of the marked ones (doc_id, text, by).

    plain strips letters to letters, one by one. by keeps models apart and has few values, none null; targets gives the letters to look up
    for each. Texts are dealt into chunks; a chunk sends what its distinct words have at each context of a target to the context's bucket
    and gets the commonest characters over all chunks back. Contexts of other letters are never looked up.
    """
    rows = marked.groupBy(F.col(by).alias("g")).agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).collect()  # a row a group
    group, volume = {r["g"]: i for i, r in enumerate(sorted(rows, key=lambda r: r["g"]))}, sum(r["b"] for r in rows)
    buckets = chunks.number(volume, chunks.BUCKET)
    texts = chunks.deal(marked.select("doc_id", F.col(by).alias("g"), "text"), volume, "doc_id", "text").groupBy("chunk")

    def spaced(words: Iterable[str]) -> str:
        return "\n\n" + "\n\n".join(words) + "\n\n"

    def widths(i: int, ctx: str) -> tuple[str, str, str]:
        return f"{i} {ctx}", f"{i} {ctx[1:4]}", f"{i} {ctx[2]}"

    def ask(p: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, dict[str, int]] = {}
        for g, own in p.groupby("g")["text"]:
            seen, i = Counter(), group[g]
            for t in own:
                seen.update(_WORD.findall(t) if t else ())
            if not seen:
                continue
            words = spaced(seen)
            lower, bare = words.lower(), _each_stripped(words, plain).lower()
            points, at, ids, contexts = _windows(key := _each_stripped(lower, plain), targets(g))
            word = np.cumsum(points == 10)[at] // 2 - 1
            out = np.frombuffer(lower.encode("utf-32-le"), np.uint32)[at]
            both, place = np.unique(ids << 21 | out, return_inverse=True)
            counts = np.bincount(place, np.fromiter(seen.values(), np.int64, len(seen))[word], len(both)).astype(np.int64)
            for k, c, n in zip((both >> 21).tolist(), (both & 0x1FFFFF).tolist(), counts.tolist(), strict=True):
                c = chr(c)
                for ctx in widths(i, contexts[k]):
                    of = rows.setdefault(ctx, {})
                    of[c] = of.get(c, 0) + n
            if bare != key:  # lower case can bring a mark back: such words ask for contexts that they don't have
                for c in _windows(bare, targets(g))[3]:
                    for ctx in widths(i, c):
                        rows.setdefault(ctx, {})
        return chunks.keyed(p["chunk"].iloc[0], rows, buckets)

    def give(p: pd.DataFrame) -> pd.DataFrame:
        return chunks.summed(p, lambda key, outs: min(outs, key=lambda c: (-outs[c], c)) if outs else "")

    def decoded(p: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        best = {key: out for blob in back["lines"] for key, _, out in (line.partition("\t") for line in chunks.read_lines(blob))}
        out = pd.Series([None] * len(p), index=p.index, dtype=object)
        for g, own in p.groupby("g")["text"]:
            parts = [_SPLIT.split(t) if t else [t] for t in own]
            words = list({w for x in parts for w in x[1::2]})
            new: dict[str, str] = {}
            if words:
                bare = _each_stripped(spaced(words), plain)
                points, at, ids, contexts = _windows(lower := bare.lower(), targets(g))
                found = [next((x for k in widths(group[g], c) if (x := best[k])), c[2]) for c in contexts]
                points = points.copy()
                points[at] = np.array([ord(x) for x in found], np.uint32)[ids]
                restored = points.tobytes().decode("utf-32-le")
                new = {w: _cased(*x) for w, *x in zip(words, *(x[2:-2].split("\n\n") for x in (bare, lower, restored)), strict=True)}
            for where, x in zip(own.index, parts, strict=True):
                x[1::2] = map(new.__getitem__, x[1::2])
                out[where] = x[0] if len(x) == 1 else "".join(x)
        return pd.DataFrame({"doc_id": p["doc_id"], "restored": out})

    answers = texts.applyInPandas(ask, "chunk int, bucket int, lines binary").groupBy("bucket").applyInPandas(give, "chunk int, lines binary")
    kind = marked.schema["doc_id"].dataType.simpleString()
    return texts.cogroup(answers.groupBy("chunk")).applyInPandas(decoded, f"doc_id {kind}, restored string")


def _cased(token: str, lower: str, word: str) -> str:
    """transfer_case of a word to a token, whose lower case is given."""
    if token == lower:
        return word
    if token.upper() == token:
        return word.upper()
    first = token[0]
    return word[:1].upper() + word[1:].lower() if first.upper() == first != first.lower() else word


def viterbi_train(marked: DataFrame, plain: Column, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (plain, idx, form) by falling count, unigrams (form, logp) and transitions (prev, cur, logp) of marked texts (doc_id, text).

    by names columns of marked that keep models apart, the language for one; they come first in all three.
    """
    words = _placed_words(marked, by).where(is_word(F.col("token"))).select("doc_id", *by, "pos", F.lower("token").alias("word"))
    counts = words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n")).withColumn("plain", plain).withColumnRenamed("word", "form")
    candidates = counts.select(*by, "plain", (F.row_number().over(Window.partitionBy(*by, "plain").orderBy(F.desc("n"), "form")) - 1).alias("idx"), "form")
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))  # one row for each value of by
    forms = counts.groupBy(*by, "form").agg(F.sum("n").alias("n"))
    unigrams = (forms.join(F.broadcast(total), list(by)) if by else forms.crossJoin(F.broadcast(total))).select(*by, "form", F.log(F.col("n") / F.col("total")).alias("logp"))
    pairs = words.withColumn("prev", F.lag("word").over(Window.partitionBy("doc_id").orderBy("pos"))).where("prev is not null").groupBy(*by, "prev", F.col("word").alias("cur")).agg(F.count(F.lit(1)).alias("n"))
    transitions = pairs.join(forms.select(*by, F.col("form").alias("prev"), F.col("n").alias("m")), [*by, "prev"]).select(*by, "prev", "cur", F.log(F.col("n") / F.col("m")).alias("logp"))
    return candidates, unigrams, transitions


def _first_best(scores: list[float]) -> int:
    """The place of the best score. Paths of one likelihood add their logarithms in another order, so what differs by rounding only is equal."""
    if len(scores) == 1:
        return 0
    least = max(scores) - 1e-9
    return next(i for i, s in enumerate(scores) if s >= least)


def best_path(words: list[str], candidates: dict[str, list[str]], unigrams: dict[str, float], transitions: dict[tuple[str, str], float]) -> list[str]:
    """The likeliest forms of lower-case words; among equals the first candidate. A missing unigram counts -12, a missing transition the unigram less 5."""
    paths: list[list[str]] = []
    back: list[list[int]] = []
    now: list[float] = []
    for w in words:
        forms = candidates.get(w, [w])
        if not paths:
            now, link = [unigrams.get(c, -12.0) for c in forms], [0] * len(forms)
        else:
            new, link = [], []
            for c in forms:
                alone = unigrams.get(c, -12.0) - 5
                steps = [s + transitions.get((p, c), alone) for s, p in zip(now, paths[-1], strict=True)]
                k = _first_best(steps)
                new.append(steps[k])
                link.append(k)
            now = new
        paths.append(forms)
        back.append(link)
    if not paths:
        return []
    k = _first_best(now)
    out = []
    for forms, link in zip(reversed(paths), reversed(back), strict=True):
        out.append(forms[k])
        k = link[k]
    return out[::-1]


def viterbi_decode(docs: DataFrame, candidates: DataFrame, unigrams: DataFrame, transitions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, restored): one chain a text. Each text meets only the entries of its own words, so no table is sent to every worker; with by, those of its own values there."""
    placed = _placed_words(docs, by).withColumn("word", F.when(is_word(F.col("token")), F.lower("token")))
    own = placed.where("word is not null").select("doc_id", *by, "word").distinct()
    forms = own.join(candidates.withColumnRenamed("plain", "word"), [*by, "word"], "left").select("doc_id", *by, "word", F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce("form", "word").alias("form"))
    with_p = forms.join(unigrams, [*by, "form"], "left")
    cand = with_p.groupBy("doc_id").agg(F.collect_list(F.struct("word", "idx", "form", "logp")).alias("forms"))
    nexts = placed.where("word is not null").withColumn("prev_word", F.lag("word").over(Window.partitionBy("doc_id").orderBy("pos"))).where("prev_word is not null").select("doc_id", *by, "prev_word", "word").distinct()
    left = forms.select("doc_id", *by, F.col("word").alias("prev_word"), F.col("form").alias("prev"))
    right = forms.select("doc_id", *by, "word", F.col("form").alias("cur"))
    steps = nexts.join(left, ["doc_id", *by, "prev_word"]).join(right, ["doc_id", *by, "word"]).select("doc_id", *by, "prev", "cur").distinct().join(transitions, [*by, "prev", "cur"]).groupBy("doc_id").agg(F.collect_list(F.struct("prev", "cur", "logp")).alias("steps"))
    toks = docs.select("doc_id", tokens(F.col("text")).alias("tokens"))

    @F.pandas_udf("array<string>")
    def decoded(toks: pd.Series, forms: pd.Series, steps: pd.Series) -> pd.Series:
        import re

        word = re.compile(r"[\w\u0300-\u036f]+")

        def one(ts, fs, ss) -> list[str]:
            table: dict[str, list[tuple[int, str]]] = {}
            uni: dict[str, float] = {}
            for f in fs if fs is not None else []:
                table.setdefault(f["word"], []).append((f["idx"], f["form"]))
                if f["logp"] is not None:
                    uni[f["form"]] = f["logp"]
            moves = {(s["prev"], s["cur"]): s["logp"] for s in (ss if ss is not None else [])}
            at = [i for i, t in enumerate(ts) if word.fullmatch(t)]
            best = best_path([ts[i].lower() for i in at], {w: [f for _, f in sorted(x)] for w, x in table.items()}, uni, moves)
            out = list(ts)
            for i, b in zip(at, best, strict=True):
                t = ts[i]
                out[i] = b.upper() if t.isupper() else b.capitalize() if t[:1].isupper() else b
            return out

        return pd.Series([one(t, f, s) if t is not None else None for t, f, s in zip(toks, forms, steps, strict=True)], dtype=object)

    return toks.join(cand, "doc_id", "left").join(steps, "doc_id", "left").select("doc_id", F.array_join(decoded("tokens", "forms", "steps"), "").alias("restored"))


def _recased(token: str, word: str) -> str:
    return word.upper() if token.isupper() else word.capitalize() if token[:1].isupper() else word


def _words_by_group(docs: DataFrame, by: str) -> tuple[dict[str, int], dict[str, int], int]:
    """A number for every value of the column by, how many words its texts have, and the bytes of all texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"g": b["g"], "n": [len(_WORD.findall(t)) if t else 0 for t in b["text"]], "b": [len(t.encode()) if t else 0 for t in b["text"]]})

    rows = docs.select(F.col(by).alias("g"), "text").mapInPandas(counted, "g string, n long, b long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()  # a row a group
    return {r["g"]: i for i, r in enumerate(sorted(rows, key=lambda r: r["g"]))}, {r["g"]: r["n"] for r in rows}, sum(r["b"] for r in rows)


class _Coded:
    """The words of texts as numbers of distinct tokens; `lower` has their lower case, `bare` that of their stripped forms, `key` the stripped forms of both."""

    def __init__(self, texts: list[str | None], plain: Callable[[str], str]) -> None:
        self.parts = [_SPLIT.split(t) if t else [t] for t in texts]
        self.sizes = [len(x) // 2 for x in self.parts]
        coded = pa.array([w for x in self.parts for w in x[1::2]], pa.string()).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.plain = [plain(w) for w in coded.dictionary.to_pylist()]
        self.lower = [w.lower() for w in coded.dictionary.to_pylist()]
        self.bare = [w.lower() for w in self.plain]
        self.key, self.bare_key = [plain(w) for w in self.lower], [plain(w) for w in self.bare]
        text = np.repeat(np.arange(len(texts)), self.sizes)
        self.beside = np.flatnonzero(text[1:] == text[:-1])

    def pairs(self, several: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Distinct neighbours of which one is among several, and how often they stand together."""
        at = self.beside[several[self.ids[self.beside]] | several[self.ids[self.beside + 1]]]
        n = max(1, len(self.lower))
        both, counts = np.unique(self.ids[at] * n + self.ids[at + 1], return_counts=True)
        return zip((both // n).tolist(), (both % n).tolist(), counts.tolist(), strict=True)


class _Paths:
    """best_path by counts of one group. Neighbours that have one form each need no transition: between them every path pays the same."""

    def __init__(self, forms: Callable[[str], list[tuple[str, int]]], moves: Callable[[str, str], list[tuple[str, int]]], total: int) -> None:
        self.forms, self.moves, self.total, self.known = forms, moves, total, {}

    def first(self, word: str) -> list[float]:
        return [math.log(n / self.total) if n else -12.0 for _, n in self.forms(word)]

    def steps(self, a: str, b: str) -> list[list[float]]:
        """For every form of b the transition from every form of a."""
        if (a, b) not in self.known:
            seen = dict(self.moves(a, b))
            alone = [x - 5 for x in self.first(b)]
            self.known[a, b] = [[math.log(seen[k] / m) if (k := f"{p} {c}") in seen else x for p, m in self.forms(a)] for (c, _), x in zip(self.forms(b), alone, strict=True)]
        return self.known[a, b]

    def run(self, before: str | None, words: list[str], after: str | None) -> list[str]:
        """The forms of neighbours that have several each, between words of one form or the text's ends."""
        now = self.first(words[0]) if before is None else [row[0] for row in self.steps(before, words[0])]
        back = []
        for a, b in zip(words, words[1:] if after is None else [*words[1:], after], strict=after is not None):
            link, new = [], []
            for row in self.steps(a, b):
                costs = [s + t for s, t in zip(now, row, strict=True)]
                link.append(k := _first_best(costs))
                new.append(costs[k])
            back.append(link)
            now = new
        k, out = _first_best(now), []
        for w, link in zip(reversed(words), reversed(back) if after is not None else [None, *reversed(back)], strict=True):
            k = k if link is None else link[k]
            out.append(self.forms(w)[k][0])
        return out[::-1]


def own_viterbi(marked: DataFrame, plain: Callable[[str], str], by: str) -> DataFrame:
    """(doc_id, restored): viterbi_decode of the stripped texts by the tables that viterbi_train makes of the marked ones (doc_id, text, by).

    plain strips letters to letters, one by one, and a second time without effect. by keeps models apart and has few values, none null. Texts are
    dealt into chunks; a chunk asks the bucket of each of its words for the word's forms, then the bucket of each pair of neighbours for its
    transitions where one of the two has several forms.
    """
    group, total, volume = _words_by_group(marked, by)
    buckets = chunks.number(volume, chunks.BUCKET)
    dealt = chunks.deal(marked.select("doc_id", F.col(by).alias("g"), "text"), volume, "doc_id", "text")

    def told(lines: pd.Series) -> dict[int, dict[str, list[tuple[str, int]]]]:
        """By group the forms of words: a word alone where the answer has only a count, or nothing."""
        found: dict[int, dict[str, list[tuple[str, int]]]] = {i: {} for i in group.values()}
        for blob in lines:
            for line in chunks.read_lines(blob):
                key, *rest = line.split("\t")
                g, word = key.split(" ")
                found[int(g)][word] = [(word, int(rest[0]))] if len(rest) == 1 else [(i, int(n)) for i, n in zip(rest[::2], rest[1::2], strict=True)] or [(word, 0)]
        return found

    def lookup(found: dict[str, list[tuple[str, int]]]) -> Callable[[str], list[tuple[str, int]]]:
        # Lower case can bring a mark back; such a word has no candidates, but is a form.
        return lambda w: found[w] if w in found else [(w, dict(found[plain(w)]).get(w, 0))]

    def ask_words(p: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, dict[str, int]] = {}
        for g, own in p.groupby("g")["text"]:
            c, i = _Coded(list(own), plain), group[g]
            for form, key, bare, n in zip(c.lower, c.key, c.bare_key, np.bincount(c.ids, minlength=len(c.lower)).tolist(), strict=True):
                of = rows.setdefault(f"{i} {key}", {})
                of[form] = of.get(form, 0) + n
                if bare != key:
                    rows.setdefault(f"{i} {bare}", {})
        return chunks.keyed(p["chunk"].iloc[0], rows, buckets)

    def give_forms(p: pd.DataFrame) -> pd.DataFrame:
        def shown(key: str, items: dict[str, int]) -> str:
            if len(items) == 1 and key.split(" ")[1] in items:
                return str(*items.values())
            return "\t".join(f"{i}\t{n}" for i, n in sorted(items.items(), key=lambda x: (-x[1], x[0])))

        return chunks.summed(p, shown).assign(kind=0)[["chunk", "kind", "lines"]]

    def ask_pairs(p: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"chunk": [], "bucket": [], "lines": []})
        found, rows = told(back["lines"]), {}
        for g, own in p.groupby("g")["text"]:
            c, i = _Coded(list(own), plain), group[g]
            forms = lookup(found[i])
            many = np.array([len(forms(k)) > 1 or len(forms(b)) > 1 for k, b in zip(c.key, c.bare, strict=True)], dtype=bool)
            for a, b, n in c.pairs(many):
                of = rows.setdefault(f"{i} {c.key[a]} {c.key[b]}", {})
                pair = f"{c.lower[a]} {c.lower[b]}"
                of[pair] = of.get(pair, 0) + n
                if c.bare_key[a] != c.key[a] or c.bare_key[b] != c.key[b]:
                    rows.setdefault(f"{i} {c.bare_key[a]} {c.bare_key[b]}", {})
        return chunks.keyed(p["chunk"].iloc[0], rows, buckets)

    def give_moves(p: pd.DataFrame) -> pd.DataFrame:
        return chunks.summed(p).assign(kind=1)[["chunk", "kind", "lines"]]

    def decoded(p: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        found, moves = told(back["lines"][back["kind"] == 0]), chunks.answered(back["lines"][back["kind"] == 1])
        out = pd.Series([None] * len(p), index=p.index, dtype=object)
        for g, own in p.groupby("g")["text"]:
            c, i = _Coded(list(own), plain), group[g]
            forms = lookup(found[i])
            paths = _Paths(forms, lambda a, b: moves[f"{i} {plain(a)} {plain(b)}"], total[g])  # noqa: B023
            many = np.array([len(forms(b)) > 1 for b in c.bare], dtype=bool)
            alone = [_recased(t, forms(b)[0][0]) for t, b in zip(c.plain, c.bare, strict=True)]
            open_, at = many[c.ids], 0
            for where, x in zip(own.index, c.parts, strict=True):
                ids = c.ids[at : at + len(x) // 2].tolist()
                put = [alone[k] for k in ids]
                spots = np.flatnonzero(open_[at : at + len(ids)])
                for run in np.split(spots, np.flatnonzero(np.diff(spots) > 1) + 1) if len(spots) else []:
                    a, z = int(run[0]), int(run[-1]) + 1
                    best = paths.run(c.bare[ids[a - 1]] if a else None, [c.bare[k] for k in ids[a:z]], c.bare[ids[z]] if z < len(ids) else None)
                    put[a:z] = [_recased(c.plain[k], w) for k, w in zip(ids[a:z], best, strict=True)]
                at += len(ids)
                if ids:
                    x[1::2] = put
                out[where] = x[0] if len(x) == 1 else "".join(x)
        return pd.DataFrame({"doc_id": p["doc_id"], "restored": out})

    asked, answer = "chunk int, bucket int, lines binary", "chunk int, kind int, lines binary"
    texts = dealt.groupBy("chunk")
    forms = texts.applyInPandas(ask_words, asked).groupBy("bucket").applyInPandas(give_forms, answer)
    moves = texts.cogroup(forms.groupBy("chunk")).applyInPandas(ask_pairs, asked).groupBy("bucket").applyInPandas(give_moves, answer)
    kind = marked.schema["doc_id"].dataType.simpleString()
    return texts.cogroup(forms.unionAll(moves).groupBy("chunk")).applyInPandas(decoded, f"doc_id {kind}, restored string")


def recase_words(text: Column) -> Column:
    """What viterbi_decode gives without tables: every word stands for itself, in its case. No word leaves its text."""

    @F.pandas_udf("string")
    def recased(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _WORD.sub(lambda m: _recased(m[0], m[0].lower()), t), na_action="ignore")

    return recased(text)


def _words_of_text(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, tokens, n (how many are words), and the given columns."""
    return docs.select("doc_id", tokens(F.col("text")).alias("tokens"), *others).withColumn("n", F.size(F.filter("tokens", is_word)))


def _put_back(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, restored): the i-th word token of a text replaced by the word (doc_id, i, word) of that number, others left; null texts stay null."""
    found = words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "word"))).alias("new"))  # at most a text's words
    numbered = lambda t: F.aggregate(
        t,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("of")),
        lambda s, x: F.struct((s["at"] + is_word(x).cast("int")).alias("at"), F.concat(s["of"], F.array(F.when(is_word(x), s["at"]))).alias("of")),
    )["of"]
    joined = _words_of_text(docs).join(found, "doc_id", "left").withColumn("of", numbered(F.col("tokens")))
    out = F.zip_with("tokens", "of", lambda t, i: F.when(i.isNull(), t).otherwise(F.coalesce(F.try_element_at("new", i), t)))
    return joined.select("doc_id", F.array_join(out, "").alias("restored"))


def apply_classes(text: Column, classes: Column) -> Column:
    """The text's plain characters with the marks of a letter classifier's classes, one class a character without nonspacing marks; NFC."""

    @F.pandas_udf("string")
    def marked(texts: pd.Series, rows: pd.Series) -> pd.Series:
        import unicodedata as ud

        def one(t, own):
            if t is None:
                return None
            plain = [c for c in ud.normalize("NFD", t) if ud.category(c) != "Mn"]
            return ud.normalize("NFC", "".join(c + (CLASSIFIED[k] if c.isalpha() else "") for c, k in zip(plain, own, strict=False)))

        return pd.Series([one(t, own) for t, own in zip(texts, rows, strict=True)], dtype=object)

    return marked(text, classes)


def _numbered_words(docs: DataFrame, column: Column, name: str) -> DataFrame:
    """(doc_id, i, name): the runs of anything but white space, numbered."""
    runs = F.regexp_extract_all(column, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+"), F.lit(0))
    return docs.select("doc_id", F.posexplode(runs).alias("i", name))


def correct_words(docs: DataFrame, predicted: DataFrame | Column, candidates: DataFrame) -> DataFrame:
    """(doc_id, restored): predicted texts (doc_id, predicted), or a column of docs, corrected by attested forms, candidates (plain, forms array).

    The i-th run of plain text between white space stands for the i-th word token, so a text with free-standing punctuation shifts. A predicted word
    that is none of its plain form's candidates becomes the first of them, capitalised like the prediction. Each distinct pair of words is judged
    once, and only those that change come back to their texts.
    """
    both = docs.withColumn("predicted", predicted) if isinstance(predicted, Column) else docs.join(predicted.select("doc_id", "predicted"), "doc_id", "left")
    both = both.select("doc_id", "text", "predicted", strip_column(F.col("text"), "all").alias("stripped"))
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+"), F.lit(0))
    # A key holds no white space besides the one between its two words; words without a partner have none.
    keys = F.zip_with(F.transform(runs(F.col("stripped")), F.lower), runs(F.col("predicted")), lambda p, g: F.concat(p, F.lit(" "), g))
    own = both.select("doc_id", F.explode(F.filter(F.array_distinct(keys), lambda k: k.isNotNull())).alias("key"))
    pairs = own.select("key").distinct().withColumn("plain", F.substring_index("key", " ", 1)).withColumn("guess", F.substring_index("key", " ", -1)).join(candidates, "plain")
    first = F.get("forms", F.lit(0))
    initial = F.substring("guess", 1, 1)
    cased = F.when((F.upper(initial) == initial) & (F.lower(initial) != initial), F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, F.lit(2), F.length(first))))).otherwise(first)
    changes = cut(pairs.where((F.size("forms") > 0) & ~F.array_contains("forms", F.lower("guess"))).select("key", cased.alias("word")), "corrections")
    new = own.join(changes, "key").groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("key", "word"))).alias("new"))  # at most a text's words
    return both.join(new, "doc_id", "left").select("doc_id", _corrected(F.col("text"), F.col("stripped"), F.col("predicted"), F.col("new")).alias("restored"))


_RUN, _WORD = re.compile(r"\S+"), re.compile(r"[\w\u0300-\u036f]+")
_SPLIT = re.compile(rf"({_WORD.pattern})")


def _corrected(text: Column, stripped: Column, predicted: Column, new: Column) -> Column:
    """The i-th word of a text replaced by the i-th run of the prediction, or by what new has for it and the i-th stripped run."""

    def one(t: str | None, s: str | None, p: str | None, changed) -> str | None:
        if t is None:
            return None
        of = dict(changed) if changed is not None else {}
        put = ((of.get(f"{a.lower()} {b}", b) if of else b) for a, b in zip(_RUN.findall(s or ""), _RUN.findall(p or ""), strict=False))
        return _WORD.sub(lambda m: next(put, m[0]), t)

    @F.pandas_udf("string")
    def corrected(texts: pd.Series, stripped: pd.Series, predicted: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([one(*r) for r in zip(texts, stripped, predicted, new, strict=True)], dtype=object)

    return corrected(text, stripped, predicted, new)


def pick_words(docs: DataFrame, picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, restored): for the i-th plain word the picked candidate of picks (doc_id, i, pick), the first where there are fewer, in the word's case."""
    plain = _numbered_words(docs, strip_column(F.col("text"), "all"), "plain_word").withColumn("plain", F.lower("plain_word"))
    joined = plain.join(picks, ["doc_id", "i"]).join(candidates, "plain", "left").withColumn("forms", F.coalesce("forms", F.array("plain")))
    form = F.coalesce(F.get("forms", F.col("pick")), F.get("forms", F.lit(0)))
    return _put_back(docs, joined.select("doc_id", "i", transfer_case(F.col("plain_word"), form).alias("word")))


def restore_auto(docs: DataFrame, langs: DataFrame, ibo, other) -> DataFrame:
    """(doc_id, restored): Igbo texts by `ibo`, all others by `other`; both map (doc_id, text) to (doc_id, restored)."""
    both = docs.join(langs.select("doc_id", "lang"), "doc_id")
    return ibo(both.where("lang = 'ibo'").select("doc_id", "text")).unionByName(other(both.where("lang is null or lang <> 'ibo'").select("doc_id", "text")))


def _decoded(ready: DataFrame, load, batch: int, aligned: bool) -> DataFrame:
    """(doc_id, at, out) of pieces (doc_id, at, piece, prompt). Pieces of all texts are pooled: dealt and sorted by length, so that a batch's lengths are alike."""
    from wordweft.functions.unicode import align

    sized = ready.withColumn("size", F.octet_length("piece"))
    pooled = sized.repartitionByRange(F.desc("size"), F.xxhash64("doc_id", "at")).sortWithinPartitions(F.desc("size"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            out: list[str] = []
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                out += model(part["prompt"].tolist(), (2 * part["size"] + 16).tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "at": b["at"], "out": [align(p, o) if aligned else o for p, o in zip(b["piece"], out, strict=True)]})

    kind = ready.schema["doc_id"].dataType.simpleString()
    return pooled.mapInPandas(run, f"doc_id {kind}, at int, out string")


def decode_in_batches(docs: DataFrame, tag: str | Column, load, n: int = 300, batch: int = 16, hints: str | None = None, aligned: bool = True, by_sentence: bool = False) -> DataFrame:
    """(doc_id, restored) by a sequence model: chunks of n characters, or sentences, as `<tag> [hint] chunk`, decoded in batches, aligned and rejoined by a space.

    load() gives the model, once a worker: a function from a list of prompts and their token budgets to a list of outputs. tag may be a column of
    docs, hints the name of one. Empty texts give "" and are not sent.
    """
    from wordweft.functions.text import chunk_text

    pieces = F.transform(split_sentences(F.col("text")), lambda s: s) if by_sentence else chunk_text(F.col("text"), n)
    each = docs.select("doc_id", *([hints] if hints else []), (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"), F.posexplode(pieces).alias("at", "piece"))
    hint = F.coalesce(F.concat(F.col(hints), F.lit(" ")), F.lit("")) if hints else F.lit("")
    ready = each.select("doc_id", "at", "piece", F.concat(F.lit("<"), "tag", F.lit("> "), hint, "piece").alias("prompt"))
    texts = _decoded(ready, load, batch, aligned).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), " ").alias("restored"))
    return docs.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("restored", F.lit("")).alias("restored"))
