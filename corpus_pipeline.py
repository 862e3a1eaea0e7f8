"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the rule ensemble rejects go; it learns from the labels outside the held-out third.
2. near_duplicates: of each class of near-duplicates one row with the least doc_id stays.
3. repeated_strings: bytes covered by strings of PASSAGE bytes that start elsewhere too go; a document may become empty, but stays.
4. secrets: every span that the scan finds is replaced by a mark.
5. packing: each document's length in words, its bucket and its batch.

Whatever columns documents have besides doc_id and text travel along untouched, under any name; n_chars, where it is there,
follows the text. Null texts stay null and count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweft.llm import dart_minhash, length_buckets, rule_ensemble, secret_scan, suffix_dedup
from wordweft.llm.common import WORD, cut, drop

BESIDE = "_beside"
#: What counts as a repeated passage is said in words: more than fifty. Fifty words of running text take at least this many bytes; 400 bytes,
#: the width of the query op8_suffix_dedup, would be nearly seventy words.
PASSAGE = 50 * 5


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and one struct of all other columns, so that no operator meets their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("string")).alias(BESIDE))


def _unpacked(docs: DataFrame, like: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of `like` again, in order."""
    # The new text gets a name of its own first: inside lambdas, `text` would be taken for an alias of the same select.
    docs = docs.withColumn("_after", F.col("text") if text is None else text)
    at = {"doc_id": F.col("doc_id"), "text": F.col("_after")}
    if text is not None and "n_chars" in like.columns:
        at["n_chars"] = F.when(F.col("_after").isNull(), F.col(f"{BESIDE}.n_chars")).otherwise(F.length("_after")).cast(like.schema["n_chars"].dataType)
    return docs.select(*(at.get(c, F.col(f"{BESIDE}.`{c}`")).alias(c) for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = rule_ensemble.learn(docs.select("doc_id", "text"), labels, ~rule_ensemble.held_out())
    return _unpacked(rule_ensemble.classify(_packed(docs), ensemble).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(dart_minhash.first_of_each(_packed(docs)), docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(_packed(docs), with_text=True, carry=("text", BESIDE), width=PASSAGE)
    return _unpacked(done, docs, F.coalesce("kept_text", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_packed(docs), ["doc_id", "text", BESIDE])
    return _unpacked(found, docs, secret_scan.redact(F.col("text"), F.col("spans")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lengths = cut(docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("n")), "lengths")
    return length_buckets.pack(lengths, F.col("n")).select("doc_id", F.col("length").alias("n_tokens"), "bucket", "bucket_len", "batch_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [(f.__name__, f) for f in (quality, near_duplicates, repeated_strings, secrets, packing)]

#: Near-duplicate classes and the learnt ensemble have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before:
            drop(*before)  # nothing reads the stage before any more
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
