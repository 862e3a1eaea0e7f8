"""Language-model scoring with a log-bilinear neural model trained in numpy by noise-contrastive estimation.

The output has two levels, so that normalising stays a small matrix product. Classes: the FIRST most frequent tokens have one each, all
others share BUCKETS classes by a hash of their last two bytes, whose mix of languages and forms a context tells a lot about. Units: inside its class, a
token of at least 1 / SECOND of all counts has a unit of its own, and the class's other tokens share one, inside which each has its
smoothed share of the counts. A network predicts the class from the classes of the two tokens before, another the unit from the class
and the class of the token before. Both are fitted to counts over all training texts - class counts with at most
(CLASSES + 1)^2 * CLASSES cells, unit counts with at most (SECOND + BUCKETS) * (CLASSES + 1) - and batched matrix products give both normalised
log-probabilities for every context.

Tokens with at least 1 / FREQUENT of all counts - there are at most FREQUENT - are sent to every worker; the others are looked up
by a join on the token, so no vocabulary is collected.

Defined results: null counts as empty, and an empty text has one token, its end; repeated rows give repeated rows; a null
doc_id is no held-out row and is learnt from; without any training row every token has log-probability 0 under the base
and classes are equally likely; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweft.llm.common import cut, in_fold

FIRST, BUCKETS = 64, 96
CLASSES = FIRST + BUCKETS
SECOND = 10_000
FREQUENT = 400_000
#: Fewer occurrences than this tell nothing about contexts.
LEAST = 5
#: The end of a text; no word is empty.
END = b""
_FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes.lower and bytes.split know only ASCII letters and the six ASCII white spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, c over all texts, the empty token standing for ends; each task adds up before the shuffle, in bounded memory."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"token": [t.decode("utf-8", "replace") for t in seen], "c": list(seen.values())})

        for b in batches:
            for t in b[text]:
                seen.update(tokens(t))
                seen[END] += 1
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select(text).mapInPandas(counted, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def bucket(token: bytes) -> int:
    """The class of a token that has none of its own."""
    return FIRST + zlib.crc32(token[-2:]) % BUCKETS


def bucket_column(token: Column) -> Column:
    raw = F.encode(token, "UTF-8")
    return F.crc32(F.when(F.octet_length(raw) <= 2, raw).otherwise(F.substring(raw, -2, 2))) % BUCKETS + FIRST


class _Buckets(dict):
    """bucket by the last two bytes, remembered."""

    def __missing__(self, end: bytes) -> int:
        self[end] = found = bucket(end)
        return found


def _dealt(counts: np.ndarray, batches: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One epoch: places of cells and weights that add up to every cell's count. Heavy cells are split over all batches, so that no batch is one cell's."""
    heavy = np.flatnonzero(counts * batches * 10 > counts.sum())
    light = rng.permutation(np.flatnonzero(counts * batches * 10 <= counts.sum()).astype(np.int32))
    for part in np.array_split(light, batches):
        yield np.concatenate([heavy, part]), np.concatenate([counts[heavy] / batches, counts[part]])


def train(cells: np.ndarray, counts: np.ndarray, classes: int = CLASSES, width: int = 32, steps: int = 300, batch: int = 4096, noise: int = 64, seed: int = 7, epochs: int = 4) -> np.ndarray:
    """log10 P(class | two classes before) of shape (classes + 1, classes + 1, classes), fitted by NCE to counted cells.

    cells holds ((before2 * (classes + 1)) + before1) * classes + class. The score of a class is the product of its vector with
    a prediction that is linear in the vectors of the context, plus its bias. Noise comes from the class frequencies.
    Every epoch goes over every cell, weighted by its count, in steps / epochs updates; batch bounds the cells held at once.
    """
    rng = np.random.default_rng(seed)
    r, q = rng.normal(0, 0.1, (classes + 1, width)), rng.normal(0, 0.1, (classes, width))
    c1, c2 = np.eye(width), 0.3 * np.eye(width)
    bias = np.full(classes, -math.log(classes))
    if len(cells):
        order = np.argsort(cells)
        cells, counts = cells[order], counts[order].astype(np.float64)
        del order
        # An int16 holds any class.
        target, p1 = (cells % classes).astype(np.int16), (cells // classes % (classes + 1)).astype(np.int16)
        p2 = (cells // classes // (classes + 1)).astype(np.int16)
        share = (np.bincount(target, counts, classes) + 1) / (counts.sum() + classes)
        bias = np.log(share)
        log_noise = np.log(noise * share)
        cum = np.cumsum(share)
        weights = [r, q, c1, c2, bias]
        squares = [np.full_like(w, 1e-6) for w in weights]
        steps = max(1, steps // epochs) * epochs
        dealt = (x for _ in range(epochs) for x in _dealt(counts, steps // epochs, rng))
        for step, (cell, times) in enumerate(dealt):
            sums = [np.zeros_like(w) for w in weights]
            n = np.minimum(np.searchsorted(cum, rng.random(noise) * cum[-1], side="right"), classes - 1)
            for start in range(0, len(cell), batch):
                i, m = cell[start : start + batch], times[start : start + batch]
                a, b, w = p1[i], p2[i], target[i]
                ra, rb = r[a], r[b]
                guess = ra @ c1 + rb @ c2
                true = m * (1 / (1 + np.exp(-np.clip((guess * q[w]).sum(1) + bias[w] - log_noise[w], -30, 30))) - 1)
                fake = m[:, None] / (1 + np.exp(-np.clip(guess @ q[n].T + bias[n] - log_noise[n], -30, 30)))
                d_guess = true[:, None] * q[w] + fake @ q[n]
                one = np.zeros((classes, len(i)))
                one[w, np.arange(len(i))] = true
                d_q = one @ guess
                np.add.at(d_q, n, fake.T @ guess)
                d_bias = one.sum(1) + np.bincount(n, fake.sum(0), classes)
                d_r = np.zeros((classes + 1, width))
                for at, d in ((a, d_guess @ c1.T), (b, d_guess @ c2.T)):
                    pick = np.zeros((classes + 1, len(i)))
                    pick[at, np.arange(len(i))] = 1
                    d_r += pick @ d
                for s, d in zip(sums, (d_r, d_q, ra.T @ d_guess, rb.T @ d_guess, d_bias), strict=True):
                    s += d
            rate = 0.15 * (1 - step / steps) + 0.005
            for x, d, s in zip(weights, sums, squares, strict=True):
                d = d / max(times.sum(), 1e-300)
                s += d * d
                x -= rate * d / np.sqrt(s)
    table = np.empty((classes + 1, classes + 1, classes), dtype=np.float32)
    for before2 in range(classes + 1):
        z = (r @ c1 + r[before2] @ c2) @ q.T + bias
        z -= z.max(1, keepdims=True)
        table[before2] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / math.log(10)
    return table


def train_units(cells: np.ndarray, counts: np.ndarray, unit_class: np.ndarray, mass: np.ndarray, classes: int = CLASSES, width: int = 32, noise: int = 4, seed: int = 11, epochs: int = 6, batch: int = 16_384) -> np.ndarray:
    """log10 P(unit | its class, class before) of shape (units, classes + 1), fitted by NCE to counted cells unit * (classes + 1) + class before.

    unit_class gives the class of every unit and mass its smoothed count. Noise for a unit comes from its own class, by mass. Every epoch goes over every
    cell whose unit is not alone in its class, weighted by its count; batch bounds the cells held at once.
    """
    rng = np.random.default_rng(seed)
    in_order = np.argsort(cells, kind="stable")
    cells, counts = cells[in_order], counts[in_order].astype(np.float64)
    del in_order
    units = len(unit_class)
    order = np.argsort(unit_class, kind="stable")
    inside = np.bincount(unit_class, mass, classes)
    share = mass / inside[unit_class]
    # Units of one class stand together; the running sum of their shares finds the unit of a random place.
    cum = np.cumsum(share[order])
    of_class = unit_class[order]
    low = np.searchsorted(of_class, np.arange(classes), side="left")
    size = np.searchsorted(of_class, np.arange(classes), side="right") - low
    r, q = rng.normal(0, 0.1, (classes + 1, width)).astype(np.float32), rng.normal(0, 0.1, (units, width)).astype(np.float32)
    bias = np.log(share).astype(np.float32)
    log_noise = np.log(noise * share).astype(np.float32)
    weights = [r, q, bias]
    squares = [np.full_like(w, 1e-6) for w in weights]
    unit, before = (cells // (classes + 1)).astype(np.int32), (cells % (classes + 1)).astype(np.int16)
    live = size[unit_class[unit]] > 1
    unit, before, counts = unit[live], before[live], counts[live]
    batches = max(40, -(-len(unit) // batch)) if len(unit) else 0
    steps, step = batches * epochs, 0
    for _ in range(epochs if batches else 0):
        for cell, times in _dealt(counts, batches, rng):
            if not len(cell):
                continue
            u, p, m = unit[cell], before[cell], times.astype(np.float32)
            x = unit_class[u]
            start = np.where(low[x] > 0, cum[low[x] - 1], 0.0)
            at = np.searchsorted(cum, start[:, None] + rng.random((len(u), noise)) * (cum[low[x] + size[x] - 1] - start)[:, None], side="right")
            n = order[np.clip(at, low[x][:, None], (low[x] + size[x] - 1)[:, None])]
            every = np.concatenate([u[:, None], n], axis=1)
            guess, rows = r[p], q[every]
            score = np.einsum("bd,bkd->bk", guess, rows) + bias[every] - log_noise[every]
            wrong = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            wrong[:, 0] -= 1
            wrong *= m[:, None]
            flat = every.ravel()
            d_q = np.zeros_like(q)
            np.add.at(d_q, flat, (wrong[:, :, None] * guess[:, None, :]).reshape(-1, width))
            d_r = np.zeros_like(r)
            np.add.at(d_r, p, np.einsum("bk,bkd->bd", wrong, rows))
            d_b = np.bincount(flat, wrong.ravel(), units).astype(np.float32)
            rate = np.float32(0.15 * (1 - step / steps) + 0.005)
            step += 1
            for w, d, s in zip(weights, (d_r, d_q, d_b), squares, strict=True):
                d /= np.float32(max(m.sum(), 1e-30))
                s += d * d
                w -= rate * d / np.sqrt(s)
    table = q @ r.T + bias[:, None]
    for x in range(classes):
        own = order[low[x] : low[x] + size[x]]
        if len(own):
            z = table[own] - table[own].max(0, keepdims=True)
            table[own] = (z - np.log(np.exp(z).sum(0, keepdims=True))) / math.log(10)
    return table


@dataclass
class Vocabulary:
    """What every worker gets: frequent tokens with their counts by falling count, and the totals.

    class_of and unit_of: by place in frequent. The units are those of the first n_units tokens, then one of every class for the rest; rest: for each class the
    smoothed mass of its tokens without a unit, unseen ones included.
    """

    frequent: dict[bytes, int]
    c: np.ndarray
    n_units: int
    total: int
    distinct: int
    class_of: np.ndarray
    rest: np.ndarray

    @property
    def z(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    @property
    def unit_of(self) -> np.ndarray:
        return np.where(np.arange(len(self.c)) < self.n_units, np.arange(len(self.c)), self.n_units + self.class_of)

    @property
    def unit_class(self) -> np.ndarray:
        return np.concatenate([self.class_of[: self.n_units], np.arange(CLASSES)])

    @property
    def unit_mass(self) -> np.ndarray:
        return np.concatenate([self.c[: self.n_units] + 0.1, self.rest])


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    rows = counts.where(F.col("c") * FREQUENT >= total).toPandas() if total else pd.DataFrame({"token": [], "c": []})
    rows = rows.sort_values(["c", "token"], ascending=[False, True])
    names = [t.encode() for t in rows["token"]]
    c = rows["c"].to_numpy(dtype=np.int64)
    del rows
    class_of = np.array([i if i < FIRST else bucket(t) for i, t in enumerate(names)], dtype=np.int64)
    n_units = int(((c >= LEAST) & (c * SECOND >= total)).sum()) if len(c) else 0
    n_units = max(n_units, min(FIRST, len(c)))
    # Mass by class: of all tokens by their hash, a row a bucket, less those that have a unit.
    mass = np.zeros(CLASSES)
    for x, s, n in counts.groupBy(bucket_column(F.col("token")).alias("x")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[x] = s + 0.1 * n
    own = np.array([bucket(t) for t in names[:n_units]], dtype=np.int64)
    rest = np.maximum(mass - np.bincount(own, c[:n_units] + 0.1, CLASSES), 0.0) + 0.1
    rest[:FIRST] = 1e-9  # no token without a unit has one of these classes
    return Vocabulary({t: i for i, t in enumerate(names)}, c, n_units, int(total), int(distinct), class_of, rest)


def _flat(texts: list[str | None], vocab: dict[bytes, int], end: int, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Places of all tokens of a batch, ~class where they are not in vocab, where each text starts, and the tokens themselves."""
    ids: list[int] = []
    starts, toks = [], []
    get = vocab.get
    last = end if end >= 0 else ~buckets[END]
    for t in texts:
        own = tokens(t)
        starts.append(len(ids))
        ids += [i if (i := get(w, -1)) >= 0 else ~buckets[w[-2:]] for w in own]
        ids.append(last)
        toks.append(own)
    return np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64), toks


def _contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class one and two places before, CLASSES before a text's start."""
    p1, p2 = np.full(len(classes), CLASSES), np.full(len(classes), CLASSES)
    p1[1:], p2[2:] = classes[:-1], classes[:-2]
    p1[starts] = p2[starts] = CLASSES
    second = starts + 1
    p2[second[second < len(classes)]] = CLASSES
    return p1, p2


def _batches(b: pd.DataFrame, text: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Slices of a batch of bounded size."""
    size = b[text].str.len().fillna(0).cumsum() // chars
    for _, part in b.groupby(size, sort=False):
        yield part


def _placed(ids: np.ndarray, of: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """of by place, rare where a token is not in the vocabulary."""
    return np.where(ids >= 0, np.append(of, 0)[np.maximum(ids, -1)], rare)


def context_counts(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Cells and counts over all texts, of classes after two classes and of units after one class."""
    n_class = (CLASSES + 1) ** 2 * CLASSES
    shared = docs.sparkSession.sparkContext.broadcast((vocab.frequent, vocab.class_of, vocab.unit_of, vocab.n_units))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, class_of, unit_of, n_units = shared.value
        end, buckets = names.get(END, -1), _Buckets()
        found = np.zeros(n_class, dtype=np.int32)
        units = np.zeros((n_units + CLASSES) * (CLASSES + 1), dtype=np.int32)
        for whole in batches:
            for b in _batches(whole, text):
                ids, starts, _ = _flat(b[text].tolist(), names, end, buckets)
                cls = _placed(ids, class_of, ~ids)
                p1, p2 = _contexts(cls, starts)
                for into, at in ((found, (p2 * (CLASSES + 1) + p1) * CLASSES + cls), (units, _placed(ids, unit_of, n_units + ~ids) * (CLASSES + 1) + p1)):
                    cell, n = np.unique(at, return_counts=True)
                    into[cell] += n.astype(np.int32)
        for held, base in ((found, 0), (units, n_class)):
            at = np.flatnonzero(held)
            if len(at):
                yield pd.DataFrame({"cell": (at + base).astype(np.int32), "n": held[at].astype(np.int64)})

    summed = docs.select(text).mapInPandas(cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
    got = summed.toArrow()  # eight bytes a cell
    shared.destroy()
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    del got
    own = cell < n_class
    return (cell[own], n[own]), (cell[~own] - n_class, n[~own])


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row of docs, learnt from the rows of training."""
    spark = docs.sparkSession
    counts = cut(count_tokens(training, text), "token-counts")
    vocab = vocabulary(counts)
    classes, units = context_counts(training, vocab, text)
    table = train(*classes)
    del classes
    unit_table = train_units(*units, vocab.unit_class, vocab.unit_mass).astype(np.float32)
    del units
    shared = spark.sparkContext.broadcast((vocab, table, unit_table))
    log_z = math.log10(vocab.z)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, table, unit_table = shared.value
        end, buckets = vocab.frequent.get(END, -1), _Buckets()
        logs, log_rest = np.log10(vocab.c + 0.1), np.log10(vocab.rest)
        base = logs - math.log10(vocab.z)
        inside = np.where(np.arange(len(vocab.c)) < vocab.n_units, 0.0, logs - log_rest[vocab.class_of]) if len(logs) else logs
        for whole in batches:
            for b in _batches(whole, text):
                ids, starts, toks = _flat(b[text].tolist(), vocab.frequent, end, buckets)
                known = ids >= 0
                cls = _placed(ids, vocab.class_of, ~ids)
                unit = _placed(ids, vocab.unit_of, vocab.n_units + ~ids)
                p1, p2 = _contexts(cls, starts)
                add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                # Of a token that is looked up, only the logarithm of its count is still to come.
                share = _placed(ids, inside, -log_rest[np.where(known, 0, ~ids)])
                rare = [Counter([w for w in t if w not in vocab.frequent]) for t in toks]
                if end < 0:
                    for r in rare:
                        r[END] += 1
                yield pd.DataFrame(
                    {
                        key: b[key].to_numpy(),
                        "row": b["row"].to_numpy(),
                        "n_tokens": [len(t) + 1 for t in toks],
                        "known": add(known.astype(np.int64)),
                        "base": add(_placed(ids, base, np.zeros(len(ids)))),
                        "model": add(table[p2, p1, cls].astype(np.float64) + unit_table[unit, p1] + share),
                        "rare": [[w.decode("utf-8", "replace") for w in r] for r in rare],
                        "times": [list(r.values()) for r in rare],
                    }
                )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key), text).withColumn("row", F.monotonically_increasing_id())
    # One pass over the texts; written, so that the sums and the rare tokens are read apart.
    done = cut(source.mapInPandas(scored, f"{key} {kind}, row bigint, n_tokens bigint, known bigint, base double, model double, rare array<string>, times array<bigint>"), "token-scores")
    found = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    rare_counts = counts.where(F.col("c") * FREQUENT < vocab.total)
    looked_up = (
        found.join(rare_counts, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("logs"), F.sum("times").alias("times"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.drop("rare", "times").join(looked_up, "row", "left").select(
        key,
        "n_tokens",
        (F.col("known") + zero("seen")).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - zero("times") * log_z).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )


def op10_bilinear_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 10, 0)
    return score(docs, docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
