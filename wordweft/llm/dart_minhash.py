"""Near-duplicate documents by DartMinHash signatures and banded joining.

Each element throws darts at the plane of weight and rank. The plane is cut into cells - weights into [0,1), [1,2), [2,4), ..., ranks into
[0,1/16), [1/16,1/4), [1/4,1), [1,2), ... - and a cell's darts, their number Poisson by its area, follow from a hash of element and cell. The darts below
the element's weight are real; the earliest in rank for each of K coordinates make the signature, and two weighted sets
agree in a coordinate with the probability of their weighted Jaccard similarity. Sparse sets need no more darts than dense
ones: ranks are searched only up to a limit that grows until every coordinate has a dart.

Elements are shingles weighted by how often they occur in the text, so similarity is the weighted one: the sum of the lesser counts over the
sum of the greater. Signatures are banded: ROWS coordinates agree in one of BANDS bands. In each bucket every member is linked to one
node - a star, not all pairs - and links are verified exactly. Connected components follow. What stars can't decide, members of one
bucket in different components whose sizes allow the similarity, goes through an exact prefix filter
(`linked_across`) and is verified too, so no bucket is capped and no link hidden. Copies of a text are one node throughout.

Defined results: shingles are runs of five words, a text of fewer words has one shingle of all its words; null and empty texts are copies
of each other and, like texts of white space only, near-duplicates of their exact copies only; repeated rows fall into one class; different
texts with one key are different nodes; extra columns are ignored; classes are named by their least key, null if no member has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweft.llm.common import cut, digest, drop

ROWS, BANDS = 5, 50
K = ROWS * BANDS
SIZE = 5
SIMILARITY = 0.8
PARITIES = 32
#: Characters of text whose signatures are worked out together.
CHUNK = 600_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def rank_limits() -> Iterator[float]:
    """Upper ends of the rank cells, the same for every set: few darts an element at first, then at most half as far again."""
    yield from (0.0625, 0.25, 1.0)
    end = 1.0
    while True:
        end = end + max(1.0, end // 2)
        yield end


def _poisson_table(area: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable."""
    n = int(area + 12 * np.sqrt(area) + 20)
    logs = np.cumsum(np.concatenate([[0.0], np.log(area) - np.log(np.arange(1, n))])) - area
    return np.cumsum(np.exp(logs))


def shingles(text: str | None, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of `size` words, and how often each occurs; words are split at the six ASCII white spaces."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    h = xxhash.xxh3_64_intdigest
    if len(words) < size:
        return np.array([h(b" ".join(words))], dtype=np.uint64), np.ones(1, dtype=np.int64)
    own = {w: h(w) for w in set(words)}
    v = np.array([own[w] for w in words], dtype=np.uint64)
    n = len(v) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix((out + v[i : i + n]) * _GOLD + np.uint64(i + 1))
    return np.unique(out, return_counts=True)


def numbered(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash for each occurrence: the j-th of a shingle in one text equals the j-th in another, so sets of these have the weighted similarity."""
    again = counts.cumsum()
    nth = np.arange(again[-1] if len(again) else 0) - np.repeat(again - counts, counts)
    every = np.repeat(hashes, counts)
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(every + nth.astype(np.uint64) * _GOLD), every)


def parities(hashes: np.ndarray, longs: int = PARITIES) -> np.ndarray:
    """For each of 64 * longs classes of hashes, whether an odd number of these is in it. What two sets have in common cancels out,
    so the parities that differ are at most the elements that differ."""
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """Signatures, one row of k 64-bit coordinates for each set of distinct 64-bit hashes; weights are positive, 1 where not given.

    A coordinate is the least packed value of rank and dart; sets without elements have the largest value throughout.
    """
    full = np.uint64(2**64 - 1)
    out = np.full(len(sets) * k, full, dtype=np.uint64)
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    elements = mix(np.concatenate(sets)) if len(of) else np.empty(0, dtype=np.uint64)
    w = np.concatenate(weights) if weights is not None and len(of) else np.ones(len(of))
    light = len(w) and w.min() < 1  # else all darts of the first weight cell are real
    lo, bits = 0.0, np.uint64(32)
    for step, hi in enumerate(rank_limits()):
        if not len(of):
            break
        low, level = 0.0, 0
        while (pick := np.flatnonzero(w > low) if level or weights is not None else np.arange(len(of))).size:
            wide = 1.0 if level == 0 else low
            with np.errstate(over="ignore"):
                seed = mix(elements[pick] + np.uint64((step << 16) + level + 1) * _GOLD)
                n = np.searchsorted(_poisson_table((hi - lo) * wide), _unit(seed), side="right")
                which = np.repeat(np.arange(len(pick)), n)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(seed[which] + (nth.astype(np.uint64) + np.uint64(1)) * _M1)
                if weights is not None and (level or light):
                    real = low + wide * _unit(mix(dart ^ _M2)) < w[pick][which]
                    dart, which = dart[real], which[real]
                coordinate = ((dart >> bits) * np.uint64(k)) >> bits
                rank = (lo * 2.0**36 + (dart & np.uint64(0xFFFFFFFF)).astype(np.float64) * ((hi - lo) * 16)).astype(np.uint64)
                packed = (rank << np.uint64(14)) | ((dart >> bits) & np.uint64(0x3FFF))
            np.minimum.at(out, of[pick][which] * k + coordinate.astype(np.int64), packed)
            low, level = (1.0 if level == 0 else 2 * low), level + 1
            if weights is None:
                break
        # Later ranks can't be earlier than what each coordinate of a finished set has.
        going = (out.reshape(-1, k) == full).any(1)[of]
        of, elements, w, lo = of[going], elements[going], w[going], hi
    return out.reshape(-1, k)


def dart_signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """The signature of one set."""
    return dart_signatures([elements], None if weights is None else [np.asarray(weights, dtype=np.float64)], k)[0]


def band_keys(signature: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One key a band for each row of signatures."""
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), 0)
    by = signature[:, : rows * bands].reshape(-1, bands, rows)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix((out + by[:, :, r]) * _GOLD)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """digest, least key, rows, weight n and band keys; one row for each different text of a batch."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by = b.groupby("digest", sort=False)
            once = pd.DataFrame({"digest": by[text].size().index, "least": by[key].min().to_numpy(), "n_rows": by[text].size().to_numpy(), text: by[text].agg(lambda x: x.iloc[0]).to_numpy()})
            sizes = once[text].str.len().fillna(0)
            for _, rows in once.groupby(sizes.cumsum() // CHUNK, sort=False):
                sets = [shingles(t) for t in rows[text]]
                bands = _signed(band_keys(dart_signatures([h for h, _ in sets], [c.astype(np.float64) for _, c in sets])))
                n = [int(c.sum()) for _, c in sets]
                least = [None if pd.isna(k) else k for k in rows["least"]]
                yield pd.DataFrame({"digest": rows["digest"].to_numpy(), "least": pd.Series(least, dtype=object), "n_rows": rows["n_rows"].to_numpy(), "n": n, "bands": [x if m else x[:0] for x, m in zip(bands, n, strict=True)]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, digest(F.col(text)).alias("digest"), text).mapInPandas(sign, f"digest binary, least {kind}, n_rows bigint, n bigint, bands array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with whether the exact weighted Jaccard similarity of their shingles (id, s: occurrences numbered) is enough."""
    sets = sets.select("id", "s")
    one = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
    both = one.join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).alias("near"))


def prefixes(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Keys (x, c) of nodes (id, n), written: two nodes similar enough share a key, one of them as the smaller, one as the larger.

    Nodes order their shingles by how many nodes have them, rare ones first. The first shingle that two similar nodes share stands so
    early in both orders that enough shingles can follow; only shingles up to there are keys. How early depends on the sizes
    of both, so the larger node of a pair has a key for each class of sizes that the smaller may have. A shingle that one node
    alone has is no key, so nodes that differ from all others by many shingles of their own, however many they are, meet nobody.
    """
    share = similarity / (1 + similarity)  # of both sizes, that similar sets have in common at least
    step = -np.log1p(-0.02)
    size_class = lambda n: F.floor(F.log(n) / step)
    shingle = rest.join(sets.select("id", "s"), "id").select("id", F.explode("s").alias("x"))
    common = shingle.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = shingle.join(common, "x").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))  # at most a text's shingles
    n, alone = F.col("n").cast("double"), (F.col("n") - F.size("xs")).cast("int")
    early = F.greatest(F.lit(0), F.floor(n * (1 - similarity) + 1e-6).cast("int") + 1 - alone)
    placed = rest.join(ordered, "id").select("id", "n", alone.alias("alone"), F.posexplode(F.slice("xs", F.lit(1), early)).alias("k", "one"))
    placed = placed.select("id", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("one.x").alias("x"))  # at: shingles before it
    smaller = placed.where(F.col("at") <= n * (1 - 2 * share) + 1e-6).withColumn("c", size_class(n))
    # With a smaller partner of size m, shingles up to n - share * (n + m) before it leave room.
    most = F.least(n, (n - F.col("at") + 1e-6) / share - n)
    least = n * similarity - 1e-6
    larger = placed.where(most >= least).withColumn("c", F.explode(F.sequence(size_class(F.greatest(least, F.lit(0.5))), size_class(most + 1e-6))))
    return cut(smaller.withColumn("small", F.lit(True)).unionByName(larger.withColumn("small", F.lit(False))), "prefixes")


def live_keys(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of keys where nodes of different labels meet, written, with label, and other: whether it is not the key's commonest label."""
    marked = keys.join(labels, "id")
    votes = marked.groupBy("x", "c", "label").agg(F.count(F.lit(1)).alias("v"), F.max("small").alias("s"), F.min("small").alias("l"))
    mixed = votes.groupBy("x", "c").agg(F.max_by("label", "v").alias("top"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("s").alias("s"), F.min("l").alias("l")).where("low != high and s and not l").select("x", "c", "top")
    return cut(marked.join(mixed, ["x", "c"]).withColumn("other", F.col("label") != F.col("top")).drop("top"), "mixed-prefixes")


def hub_pairs(live: DataFrame, similarity: float, hubs: int = 4) -> DataFrame:
    """For each key a few nodes of the commonest label, others for other keys, with every node of other labels: linear in the keys."""
    pick = lambda turn: F.min(F.struct(F.xxhash64("id", "x", F.lit(turn)).alias("h"), "id", "n"))
    picked = live.where("not other").groupBy("x", "c").agg(F.array(*map(pick, range(hubs))).alias("hubs"))
    met = live.where("other").join(picked, ["x", "c"]).select("id", "n", F.explode(F.array_distinct("hubs")).alias("hub"))
    fits = F.least("n", "hub.n") + 1e-6 >= similarity * F.greatest("n", "hub.n")
    return met.where(fits).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def all_pairs(live: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Every pair (a, b) of nodes of different labels that share a key and may be similar enough. Nodes of a key's commonest label are compared with the others only."""
    share = similarity / (1 + similarity)
    live = live.join(sets.select("id", "p"), "id")
    side = lambda small, mark: live.where(F.col("small") == small).select("x", "c", *(F.col(k).alias(f"{k}_{mark}") for k in ("id", "n", "label", "at", "other", "p")))
    a, b = side(True, "a"), side(False, "b")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1e-6 >= share * (F.col("n_a") + F.col("n_b"))
    fits = (F.col("label_a") != F.col("label_b")) & (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") + 1e-6 >= similarity * F.col("n_b")) & room
    differ = sum((F.bit_count(F.col("p_a")[i].bitwiseXOR(F.col("p_b")[i])) for i in range(1, PARITIES)), F.bit_count(F.col("p_a")[0].bitwiseXOR(F.col("p_b")[0])))
    fits &= differ <= (1 - 2 * share) * (F.col("n_a") + F.col("n_b")) + 1e-6
    met = a.where("other_a").join(b, ["x", "c"]).where(fits).unionByName(a.where("not other_a").join(b.where("other_b"), ["x", "c"]).where(fits))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _with(rows: DataFrame, of_label: DataFrame, salts: int = 16) -> DataFrame:
    """rows left-joined with of_label, which has a row a label; a label that very many rows have is dealt over several tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return dealt.join(of_label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["label", "_salt"], "left").drop("_salt")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label), written anew, with the labels of linked nodes (a, b) made one; labels has all nodes."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    joined = components(links.join(of("a"), "a").join(of("b"), "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    new = cut(_with(labels, joined.select(F.col("id").alias("label"), F.col("label").alias("new"))).select("id", F.coalesce("new", "label").alias("label")), "merged-labels")
    drop(labels, joined)
    return new


def linked_across(rest: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """labels with those of all similar nodes of rest (id, n) made one; every similar pair is met unless its labels are one already.

    First each node is compared with a few nodes of its keys' commonest labels, which merges what has many links; then all
    pairs of different labels that are left, few by then, are compared.
    """
    keys = prefixes(rest, sets, similarity)
    for pairs_of in (lambda live: hub_pairs(live, similarity), lambda live: all_pairs(live, sets, similarity)):
        live = live_keys(keys, labels)
        drop(keys)
        asked = cut(pairs_of(live), "pairs")
        links = cut(verified(asked, sets, similarity).where("near").select("a", "b"), "more-links")
        if links.limit(1).count():
            labels = merged(labels, links)
        drop(asked, links)
        keys = live.select("x", "c", "id", "n", "at", "small")
        keys._cut_path = live._cut_path
    drop(keys)
    return labels


def components(edges: DataFrame, what: str = "labels") -> DataFrame:
    """id, label (least id of the component) of every node of edges (a, b), by least labels and pointer jumping.

    Every round halves long chains; labels are written each round, so that lineage stays short and nothing is collected.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{what}-edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), what)
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnsRenamed({"a": "id"})
        lower = labels.join(near, "id").select("id", F.least("label", "m").alias("to"), "label")
        root = labels.select(F.col("id").alias("to"), F.col("label").alias("up"))
        new = cut(lower.join(root, "to").select("id", F.least("to", "up").alias("new"), "label"), what)
        changed = new.where(F.col("new") != F.col("label")).limit(1).count()
        drop(labels)
        labels = cut(new.select("id", F.col("new").alias("label")), what)
        drop(new)
        if not changed:
            drop(both)
            return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A written table with one row for each different text: digest, least key, n_rows, class_id, and head: whether it is its class's representative."""
    # Texts, not keys, are the nodes: different texts may have the same key. Ids are given once, when the table is written.
    signed = signatures(docs, key, text).groupBy("digest").agg(F.min("least").alias("least"), F.sum("n_rows").alias("n_rows"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(signed.withColumn("id", F.monotonically_increasing_id()), "texts")
    members = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "first")
    shared = cut(members.join(leaders, "bucket").select("bucket", "first", "id", "n"), "buckets")
    stars = cut(shared.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "stars")

    @F.pandas_udf("s array<bigint>, p array<bigint>")
    def occurrences(texts: pd.Series) -> pd.DataFrame:
        every = [numbered(*shingles(t)) for t in texts]
        return pd.DataFrame({"s": [_signed(x) for x in every], "p": [parities(x) for x in every]})

    involved = cut(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    wanted = nodes.join(involved, "id").select("id", F.col("digest").alias("_of"), F.col("least").alias("_key"))
    read = docs.select(F.col(key).alias("_k"), digest(F.col(text)).alias("_d"), F.col(text).alias("text"))
    texts = read.join(wanted, (F.col("_d") == F.col("_of")) & F.col("_k").eqNullSafe(F.col("_key"))).groupBy("id").agg(F.first("text").alias("text"))
    sets = cut(texts.select("id", occurrences("text").alias("o")).select("id", "o.*"), "shingles")
    linked = cut(verified(stars, sets, similarity).where("near").select("a", "b"), "links")
    stars_labels = components(linked)
    labels = cut(involved.join(stars_labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "star-labels")
    # Members of one bucket in different components, of sizes that allow the similarity: the star has not compared them with each other.
    sized = shared.join(labels, "id").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / -np.log(similarity))).withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
    mixed = sized.groupBy("bucket", "size").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket", "size")
    rest = cut(sized.join(mixed, ["bucket", "size"]).select("id", "n").distinct(), "undecided")
    drop(shared, stars, linked, stars_labels)
    labels = linked_across(rest, sets, labels, similarity)
    drop(sets, rest, involved)
    known = nodes.select("digest", "least", "n_rows", "id").join(labels, "id", "left")
    heads = known.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id")).alias("head"))
    out = cut(
        _with(known, heads).select(
            "digest", "least", "n_rows", F.when(F.col("head").isNull(), F.col("least")).otherwise(F.col("head.least")).alias("class_id"), F.coalesce(F.col("head.id") == F.col("id"), F.lit(True)).alias("head")
        ),
        "classes",
    )
    drop(nodes, labels)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key and class_id of every row of docs."""
    found = classes(docs, key, text, similarity).select(F.col("digest").alias("_of"), "class_id")
    return docs.select(key, digest(F.col(text)).alias("_d")).join(found, F.col("_d") == F.col("_of")).select(key, "class_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of each class one row with its least key; columns must not be named _d, _of, _key or _rows."""
    heads = classes(docs, key, text, similarity).where("head").select(F.col("digest").alias("_of"), F.col("least").alias("_key"), F.col("n_rows").alias("_rows"))
    kept = docs.withColumn("_d", digest(F.col(text))).join(heads, (F.col("_d") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    if heads.where("_rows > 1").limit(1).count():  # only texts that occur again can have a row with the same key again
        kept = kept.where("_rows = 1").unionByName(kept.where("_rows > 1").dropDuplicates(["_d"]))
    return kept.select(docs.columns)


def op7_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
