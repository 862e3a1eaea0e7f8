"""Corpus statistics of marked words: variants, ambiguity, words out of vocabulary, and error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nl}\p{No}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def build(docs: DataFrame, stripped: Column, least: int = 3, most: int = 8, density: Column | None = None, floors: dict[str, float] | None = None) -> DataFrame:
    """(lang, key, variant, cnt): per language and stripped lower-case key its commonest variants, at most `most`, each at least `least` times.

    docs has lang and text (NFC); stripped strips the column `variant`. Equal counts are ordered by variant. With floors, texts
    of a language below its density do not count. Words are counted before they are stripped, so each distinct word is stripped once.
    """
    if floors:
        floor = F.try_element_at(F.create_map(*(F.lit(x) for kv in floors.items() for x in kv)), F.col("lang"))
        docs = docs.where(floor.isNull() | (density >= floor))
    counts = docs.select("lang", F.explode(words_of(F.col("text"))).alias("variant")).groupBy("lang", "variant").agg(F.count(F.lit(1)).alias("cnt"))
    keyed = counts.withColumn("key", F.lower(stripped))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("lang", "key").orderBy(F.desc("cnt"), "variant")))
    return ranked.where((F.col("r") <= most) & (F.col("cnt") >= least)).select("lang", "key", "variant", "cnt")


def variants(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Variants of words (lang, word, key); for a capitalised word only capitalised ones."""
    capital = lambda c: F.substring(c, 1, 1).rlike(r"\p{Lu}")
    found = words.join(lexicon, ["lang", "key"])
    return found.where(~capital(F.col("word")) | capital(F.col("variant"))).select("lang", "word", "variant", "cnt")


def true_variants(lexicon: DataFrame, factors: DataFrame) -> DataFrame:
    """Variants that no other variant of the key dominates: one that has the same bases and every mark of this one, and more.

    factors: (variant, bases array, marks array of arrays), one row a variant.
    """
    own = lexicon.join(factors, "variant")
    a = own.select("lang", "key", "variant", "cnt", "bases", "marks")
    b = own.select("lang", "key", F.col("variant").alias("other"), F.col("bases").alias("other_bases"), F.col("marks").alias("other_marks"))
    # At most `most` variants a key, so the join of a key's variants stays small.
    covers = F.forall(F.zip_with("marks", "other_marks", lambda x, y: F.size(F.array_except(x, y)) == 0), lambda ok: ok)
    lost = a.join(b, ["lang", "key"]).where((F.col("variant") != F.col("other")) & (F.col("bases") == F.col("other_bases")) & covers).select("lang", "key", "variant").distinct()
    return a.select("lang", "key", "variant", "cnt").join(lost, ["lang", "key", "variant"], "left_anti")


def ambiguity(lexicon: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """By language: keys, ambiguous keys, their share, and the share of tokens whose key is ambiguous.

    With true, the variants that true_variants leaves, also: keys ambiguous among these, their share, the share of tokens on them, and the share
    of ambiguous keys that are not truly so. A lexicon built from densely marked texts is its own `true`.
    """
    keys = lexicon.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("variants"), F.sum("cnt").alias("tokens"))
    two = F.col("variants") > 1
    share = lambda a, b: F.round(F.sum(a) / F.greatest(F.lit(1), F.sum(b)), 4)
    one = F.lit(1).cast("long")
    of = lambda c, x: F.when(c, x).otherwise(F.lit(0))
    raw = [F.count(F.lit(1)).alias("forms"), F.sum(two.cast("long")).alias("ambiguous"), share(two.cast("long"), one).alias("ambiguous_share"), share(of(two, F.col("tokens")), F.col("tokens")).alias("token_share")]
    if true is None:
        return keys.groupBy("lang").agg(*raw)
    left = true.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("true_variants"))
    both = keys.join(left, ["lang", "key"], "left")
    real = two & (F.coalesce("true_variants", F.lit(0)) > 1)
    return both.groupBy("lang").agg(
        *raw,
        F.sum(real.cast("long")).alias("true_ambiguous"),
        share(real.cast("long"), one).alias("true_share"),
        share(of(real, F.col("tokens")), F.col("tokens")).alias("true_token_share"),
        share((two & ~real).cast("long"), two.cast("long")).alias("spurious_share"),
    )


def stats(lexicon: DataFrame) -> DataFrame:
    """By language: forms, ambiguous, ambiguous_share."""
    return ambiguity(lexicon).select("lang", "forms", "ambiguous", "ambiguous_share")


def is_attested(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (lang, word, key) with attested: whether the word itself is a variant of its key. A capitalised word only meets capitalised ones, so nothing else is asked."""
    own = lexicon.select("lang", "key", F.col("variant").alias("word"), F.lit(True).alias("attested"))
    return words.join(own, ["lang", "key", "word"], "left").withColumn("attested", F.coalesce("attested", F.lit(False)))


def oov_rate(docs: DataFrame, lexicon: DataFrame, stripped: Column) -> DataFrame:
    """(doc_id, oov): share of a text's words whose key is known but which are no variant of it, case kept; stripped strips the column `word`.

    Distinct words meet the lexicon once and bring one flag back; texts are NFC.
    """
    words = docs.select("doc_id", "lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("doc_id", "lang", "word").agg(F.count(F.lit(1)).alias("n"))
    distinct = docs.select("lang", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).distinct().withColumn("key", F.lower(stripped))
    known = distinct.join(lexicon.select("lang", "key").distinct(), ["lang", "key"], "left_semi")
    missing = is_attested(known, lexicon).where("not attested").select("lang", "word", F.lit(True).alias("missing"))
    rate = words.join(missing, ["lang", "word"], "left").groupBy("doc_id").agg((F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)) / F.sum("n")).alias("oov"))
    return docs.select("doc_id").join(rate, "doc_id", "left").select("doc_id", F.coalesce("oov", F.lit(0.0)).alias("oov"))


def error_rates(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Character error rates of restored graphemes against gold ones: pairs (gold, restored, eligible) with factor structs (g, shape, tone); with confidence
    and threshold columns also the coverage, the share of eligible places that are sure enough. With n, a row stands for so many places."""
    eligible = F.col("eligible")
    n = F.col("n") if "n" in pairs.columns else F.lit(1).cast("long")
    share = lambda c: F.sum(F.when(eligible & c, n).when(eligible & ~c, 0)) / F.sum(F.when(eligible & c.isNotNull(), n))
    wrong = lambda f: share(F.col(f"gold.{f}") != F.col(f"restored.{f}"))
    out = [wrong("g").alias("der"), wrong("shape").alias("shape_der"), wrong("tone").alias("tone_der")]
    if "confidence" in pairs.columns:
        out.append(share(F.col("confidence") >= F.col("threshold")).alias("coverage"))
    return pairs.groupBy(*by).agg(*out)


def text_rates(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of texts restored exactly, and of texts whose letters are kept: pairs (gold, restored, kept)."""
    return pairs.groupBy(*by).agg(F.avg((F.col("gold") == F.col("restored")).cast("double")).alias("exact"), F.avg(F.col("kept").cast("double")).alias("compliance"))
