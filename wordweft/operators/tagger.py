"""The per-character tagger around an injected model: windows, protected spans, legality, joint decoding, case endings, lexicon.

`restore` is the whole plan: texts become rows of graphemes, an injected model scores windows of them, and joins with the label space and
the lexicon decide what every position ends as.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweft.functions import unicode
from wordweft.functions.classes import EDGE, W
from wordweft.functions.columns import let
from wordweft.operators import labels
from wordweft.operators.labels import LabelSpace

_NOT_S = r"[^\s\x1c-\x1f\x85\p{Z}]"
# Spans that stay as they are - links, addresses, handles, code, tags, constants, domains.
PROTECTED = rf"https?://{_NOT_S}+|www\.{_NOT_S}+|[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.]+|[@#]{W}+|`[^`]*`|<[^>\s\x1c-\x1f\x85\p{{Z}}]{{1,40}}>|{EDGE}[A-Z]{{2,}}(?:_[A-Z0-9]+)+{EDGE}|{EDGE}{W}+\.(?:com|org|net|io|ng|vn){EDGE}"


#: Generations of the grapheme rules by the first part of their version, and the languages of each.
GENERATIONS = {"1": tuple(x for x in unicode.ALPHABETS if x != "ara"), "2": tuple(unicode.ALPHABETS)}
#: The log probability of what is not legal.
NEVER = -1e30


@dataclass(frozen=True)
class Config:
    """How the tagger runs. abstain: what an unsure position keeps, the input or its bare letter; margin: how far below the model's own word an attested one may score."""

    window: int = 384
    stride: int = 256
    batch: int = 32
    min_confidence: float = 0.0
    abstain: str = "input"
    respect_existing: bool = True
    legality: bool = True
    margin: float = 2.0
    temperature: float = 1.0
    case_endings: bool = True

    def __post_init__(self) -> None:
        if self.abstain not in ("input", "bare"):
            raise ValueError(f"abstain is input or bare, not {self.abstain!r}")
        if not 0 <= self.min_confidence <= 1 or not 0 < self.stride <= self.window or self.temperature <= 0 or self.batch < 1:
            raise ValueError("confidence lies in [0, 1], the stride in the window, temperature and batch above 0")


def generation(spec_version: str | None) -> str:
    """The generation that reads a label space of this version; ValueError for none and for one that there is no code for."""
    if not (spec_version or "").strip():
        raise ValueError("the labels name no version")
    major = spec_version.strip().split(".")[0]
    if major not in GENERATIONS:
        raise ValueError(f"labels of version {spec_version} can't be read; {', '.join(f'{m}.x' for m in GENERATIONS)} can")
    return major


def check_language(lang: str, spec_version: str) -> str:
    if lang not in GENERATIONS[generation(spec_version)]:
        raise ValueError(f"version {spec_version} does not know {lang!r}")
    return lang


def protected_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))


def protected_flags(text: Column) -> Column:
    """For each code point, whether it starts inside a protected span."""
    gaps, found = F.split(text, PROTECTED), F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))
    pieces = F.zip_with(gaps, found, lambda a, b: F.concat(F.repeat(F.lit("0"), F.length(F.coalesce(a, F.lit("")))), F.repeat(F.lit("1"), F.length(F.coalesce(b, F.lit(""))))))
    return F.transform(F.filter(F.split(F.array_join(pieces, ""), ""), lambda x: x != ""), lambda x: x == "1")


def plan_windows(n: Column, window: int = 384, stride: int = 256) -> Column:
    """Windows (start, end, accept_start, accept_end) that cover [0, n): each position is accepted once, hand-over halfway through an overlap."""
    last = n - window
    even = F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(stride))
    starts = F.when(F.element_at(even, -1) == last, even).otherwise(F.concat(even, F.array(last.cast("int"))))
    hand = lambda s, i: F.floor((F.get(s, i + 1) + F.get(s, i) + window) / 2).cast("int")

    def plan(s: Column) -> Column:
        return F.transform(
            s,
            lambda x, i: F.struct(
                x.alias("start"),
                (x + window).cast("int").alias("end"),
                F.when(i == 0, F.lit(0)).otherwise(hand(s, i - 1)).cast("int").alias("accept_start"),
                F.when(i == F.size(s) - 1, n.cast("int")).otherwise(hand(s, i)).alias("accept_end"),
            ),
        )

    whole = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end"), F.lit(0).alias("accept_start"), n.cast("int").alias("accept_end")))
    return F.when(n <= window, whole).otherwise(let(starts, plan))


def decode(logits: DataFrame, legal: DataFrame | None, temperature: float = 1.0) -> DataFrame:
    """(doc_id, pos, shape_id, tone_id, confidence): the likeliest legal pair at each position.

    logits: (doc_id, pos, lang, base, shapes array, tones array); legal: (lang, base, shape_id, tone_id). A base without legal pairs keeps its identity (0, 0).
    """
    scored = logits.select("doc_id", "pos", "lang", "base", log_shares(F.col("shapes"), temperature).alias("s"), log_shares(F.col("tones"), temperature).alias("t"))
    if legal is not None:
        pairs = legal.groupBy("lang", "base").agg(F.array_sort(F.collect_set(F.struct("shape_id", "tone_id"))).alias("pairs"))
        scored = scored.join(pairs, ["lang", "base"], "left")
        pick = F.coalesce("pairs", F.array(F.struct(F.lit(0).alias("shape_id"), F.lit(0).alias("tone_id"))))
    else:
        grid = lambda n: F.sequence(F.lit(0), F.size(n) - 1)
        pick = F.flatten(F.transform(grid("s"), lambda i: F.transform(grid("t"), lambda j: F.struct(i.alias("shape_id"), j.alias("tone_id")))))
    each = scored.withColumn("p", F.transform(pick, lambda p: F.struct((F.get("s", p["shape_id"]) + F.get("t", p["tone_id"])).alias("logp"), (-p["shape_id"]).alias("a"), (-p["tone_id"]).alias("b"))))
    best = F.array_max("p")
    mass = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.exp(x["logp"]))
    return each.select("doc_id", "pos", (-best["a"]).alias("shape_id"), (-best["b"]).alias("tone_id"), (F.exp(best["logp"]) / mass).alias("confidence"))


def respect(typed: Column, restored: Column, had_mark: Column, plain: Column, protected: Column, confidence: Column, least: float = 0.0, policy: str = "input") -> Column:
    """What a position ends as: protected and typed marks stay, an unsure restoration keeps the input (or its bare letter)."""
    unsure = (confidence < least) if least > 0 else F.lit(False)
    return F.when(protected, typed).when(unsure, typed if policy == "input" else plain).when(had_mark & (restored == plain), typed).otherwise(restored)


def drop_case_endings(chars: DataFrame) -> DataFrame:
    """chars (doc_id, pos, arabic, tone, typed): the last letter of every run of Arabic letters loses its tone unless it was typed."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    last = F.col("arabic") & ~F.coalesce(F.lead("arabic").over(own), F.lit(False))
    return chars.withColumn("tone", F.when(last & ~F.col("typed"), F.lit("")).otherwise(F.col("tone")))


def rerank(words: DataFrame, candidates: DataFrame, margin: float = 2.0) -> DataFrame:
    """words (word_id, word, score, attested) and candidates (word_id, variant, score): unattested words become their best candidate if it scores above score - margin."""
    best = candidates.groupBy("word_id").agg(F.max_by("variant", F.struct("score", "variant")).alias("variant"), F.max("score").alias("best"))
    joined = words.join(best, "word_id", "left")
    return joined.select("word_id", F.when(~F.col("attested") & (F.col("best") > F.col("score") - margin), F.col("variant")).otherwise(F.col("word")).alias("word"))


def log_shares(a: Column, temperature: float = 1.0) -> Column:
    """Logarithm of the softmax of an array."""
    return let(F.array_max(a), lambda m: let(F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp((x - m) / temperature))), lambda z: F.transform(a, lambda x: (x - m) / temperature - z)))


def logits(encoded: DataFrame, load: Callable, config: Config = Config()) -> DataFrame:
    """(doc_id, lang, pos, shapes, tones) of encoded texts (doc_id, lang, pos, id).

    load() gives the model, once a worker: a function from lists of ids and languages to a list of (shape logits, tone logits), one row a position.
    Texts run through overlapping windows, and each position keeps what the window says in which it stands farthest from the edges.
    """
    texts = encoded.groupBy("doc_id", "lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))  # a text's graphemes
    each = texts.select("doc_id", "lang", "ids", F.explode(plan_windows(F.size("ids"), config.window, config.stride)).alias("w"))
    ready = each.select("doc_id", "lang", "w.start", "w.accept_start", "w.accept_end", F.slice("ids", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            for i in range(0, len(b), config.batch):
                part = b.iloc[i : i + config.batch]
                out = []
                for row, (shape, tone) in zip(part.itertuples(index=False), model([list(x) for x in part["ids"]], part["lang"].tolist()), strict=True):
                    out += [(row.doc_id, row.lang, k, np.asarray(shape[k - row.start], dtype=float), np.asarray(tone[k - row.start], dtype=float)) for k in range(row.accept_start, row.accept_end)]
                yield pd.DataFrame(out, columns=["doc_id", "lang", "pos", "shapes", "tones"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return ready.mapInPandas(run, f"doc_id {kind}, lang string, pos int, shapes array<double>, tones array<double>")


def languages(docs: DataFrame, space: LabelSpace, load: Callable, classes: list[str], config: Config = Config()) -> DataFrame:
    """(doc_id, lang, proba) by the model's own language head over a text's first window. load() gives a function from lists of ids to a list of logits."""
    first = labels.encode(labels.placed(docs.select("doc_id", F.lit("").alias("lang"), "text")).where(F.col("pos") < config.window), space)
    texts = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "logits": [np.asarray(x, dtype=float) for x in model([list(x) for x in b["ids"]])]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    shares = texts.mapInPandas(run, f"doc_id {kind}, logits array<double>").select("doc_id", F.transform(log_shares(F.col("logits")), F.exp).alias("p"))
    return shares.select("doc_id", F.element_at(F.array(*map(F.lit, classes)), F.array_position("p", F.array_max("p")).cast("int")).alias("lang"), F.array_max("p").alias("proba"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, g, base, typed, protected) of texts (doc_id, lang, text): typed is whether the grapheme came marked; protected are
    places in protected spans and marked graphemes of other alphabets."""
    normal = docs.select("doc_id", "lang", unicode.nfc_column(F.col("text")).alias("text"))
    gs = F.transform(unicode.graphemes_column(F.col("text")), lambda g: g)
    flags = F.when(F.col("text").rlike(PROTECTED), protected_flags(F.col("text"))).otherwise(F.array().cast("array<boolean>"))
    placed = normal.select("doc_id", "lang", flags.alias("flags"), F.posexplode(gs).alias("pos", "g"))
    before = F.sum(F.length("g")).over(Window.partitionBy("doc_id").orderBy("pos")) - F.length("g")
    held = placed.withColumn("held", F.coalesce(F.get("flags", before.cast("int")), F.lit(False))).drop("flags")
    facts = unicode.factor_table(held.select("lang", "g").distinct()).select("lang", "g", "base", "own")
    joined = held.join(facts, ["lang", "g"])
    typed = F.col("g") != F.col("base")
    return joined.select("doc_id", "lang", "pos", "g", "base", typed.alias("typed"), (F.col("held") | (typed & ~F.col("own"))).alias("protected"))


def word_runs(chars: DataFrame) -> DataFrame:
    """chars (doc_id, lang, pos, char) that belong to words, with the word's first place and the word."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    inside = F.substring("char", 1, 1).rlike(W)
    marked = chars.withColumn("inside", inside).withColumn("new", F.col("inside") & ~F.coalesce(F.lag("inside").over(own), F.lit(False)))
    numbered = marked.withColumn("first", F.last(F.when(F.col("new"), F.col("pos")), ignorenulls=True).over(own)).where("inside").drop("new", "inside")
    words = numbered.groupBy("doc_id", "lang", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]).alias("cs"))
    return words.select("doc_id", "lang", "first", F.array_join("cs", "").alias("word"), F.size("cs").alias("n"))


def lexicon_rerank(chars: DataFrame, joint: DataFrame, space: LabelSpace, lexicon: DataFrame, margin: float = 2.0) -> DataFrame:
    """(doc_id, pos, char) of chars (doc_id, lang, pos, char): words that are not attested give way to their best attested spelling.

    joint: (doc_id, pos, s, t), log shares of shapes and tones; lexicon: (lang, key, variant). A spelling must have the word's letters, case included, and
    score above the word's own score less margin. Distinct words meet the lexicon, not places.
    """
    words = word_runs(chars)
    distinct = words.select("lang", "word").distinct()
    keyed = distinct.withColumn("bare", unicode.strip_column(F.col("word"))).withColumn("key", F.lower("bare"))
    capital = lambda c: F.substring(c, 1, 1).rlike(r"\p{Lu}")
    found = keyed.join(lexicon, ["lang", "key"]).where(~capital(F.col("word")) | capital(F.col("variant")))
    odd = found.groupBy("lang", "word").agg(F.max((F.col("variant") == F.col("word")).cast("int")).alias("attested")).where("attested = 0").select("lang", "word")
    spelled = found.join(odd, ["lang", "word"]).where(unicode.strip_column(F.col("variant")) == F.col("bare")).select("lang", "word", "variant")
    options = spelled.unionByName(spelled.select("lang", "word", F.col("word").alias("variant"))).distinct()
    letters = options.select("lang", "word", "variant", F.posexplode(unicode.graphemes_column(F.col("variant"))).alias("k", "g"))
    factors = unicode.factor_table(letters.select("lang", "g").distinct()).select("lang", "g", labels.shape_key(F.col("shape")).alias("shape"), "tone")
    ids = factors.join(space.shapes.withColumnRenamed("id", "shape_id"), "shape", "left").join(space.tones.withColumnRenamed("id", "tone_id"), "tone", "left").select("lang", "g", "shape_id", "tone_id")
    placed = words.join(letters.join(ids, ["lang", "g"]), ["lang", "word"]).withColumn("pos", F.col("first") + F.col("k"))
    scored = placed.join(joint, ["doc_id", "pos"]).withColumn("p", F.coalesce(F.get("s", F.col("shape_id")) + F.get("t", F.col("tone_id")), F.lit(NEVER)))
    totals = scored.groupBy("doc_id", "first", "word", "variant", "n").agg(F.sum("p").alias("score"), F.count(F.lit(1)).alias("m")).where("m = n")
    own = totals.where("variant = word").select("doc_id", "first", F.col("score").alias("mine"))
    best = totals.where("variant <> word").groupBy("doc_id", "first").agg(F.max_by("variant", F.struct("score", "variant")).alias("variant"), F.max("score").alias("score"))
    chosen = best.join(own, ["doc_id", "first"]).where(F.col("score") > F.col("mine") - margin)
    new = chosen.select("doc_id", F.posexplode(unicode.graphemes_column(F.col("variant"))).alias("k", "new"), "first").select("doc_id", (F.col("first") + F.col("k")).alias("pos"), "new")
    return chars.join(new, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("new", "char").alias("char"))


def strip_invariant(typed: Column, restored: Column) -> Column:
    """Whether a restored text has the typed text's letters."""
    return unicode.same_letters(typed, restored)


def restore(docs: DataFrame, space: LabelSpace, load: Callable, config: Config = Config(), lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, restored) and (doc_id, pos, char, confidence, abstained, protected) of texts (doc_id, lang, text).

    A text whose letters the result changed fails the query: that can't happen. Blank texts and languages without an alphabet give "".
    """
    ready = docs.where(F.col("text").rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"))
    at = positions(ready)
    scored = logits(labels.encode(at.select("doc_id", "lang", "pos", "g"), space), load, config)
    decoded = decode(scored.join(at.select("doc_id", "pos", "base"), ["doc_id", "pos"]), space.legal if config.legality else None, config.temperature)
    joined = at.join(decoded, ["doc_id", "pos"])
    chars = labels.decode_chars(joined, space)
    abstained = (F.col("confidence") < config.min_confidence) if config.min_confidence > 0 else F.lit(False)
    kept = F.col("typed") if config.respect_existing else F.lit(False)
    out = chars.withColumn("abstained", abstained & ~F.col("protected")).withColumn("char", respect(F.col("g"), F.col("char"), kept, F.col("base"), F.col("protected"), F.col("confidence"), config.min_confidence, config.abstain))
    if not config.case_endings:
        arabic = F.col("base").rlike(f"^[{unicode.char_class('arabic letter')}]")
        last = arabic & ~F.coalesce(F.lead(arabic).over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(False))
        drops = out.withColumn("drops", (F.col("lang") == "ara") & last & ~F.col("protected") & ~kept)
        bare = labels.decode_chars(drops.where("drops").select("doc_id", "pos", "base", "shape_id", F.lit(0).alias("tone_id")), space).select("doc_id", "pos", F.col("char").alias("bare"))
        out = drops.join(bare, ["doc_id", "pos"], "left").withColumn("char", F.coalesce("bare", "char")).drop("bare", "drops")
    if lexicon is not None:
        shares = scored.select("doc_id", "pos", log_shares(F.col("shapes"), config.temperature).alias("s"), log_shares(F.col("tones"), config.temperature).alias("t"))
        out = out.drop("char").join(lexicon_rerank(out.select("doc_id", "lang", "pos", "char"), shares, space, lexicon, config.margin), ["doc_id", "pos"])
    texts = out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("restored"))
    checked = ready.join(texts, "doc_id").select("doc_id", F.when(strip_invariant(F.col("text"), F.col("restored")), F.col("restored")).otherwise(F.raise_error(F.lit("the tagger changed a letter"))).alias("restored"))
    details = out.select("doc_id", "pos", "char", F.when(F.col("protected"), 1.0).otherwise(F.col("confidence")).alias("confidence"), "abstained", "protected")
    return docs.select("doc_id").join(checked, "doc_id", "left").select("doc_id", F.coalesce("restored", F.lit("")).alias("restored")), details
