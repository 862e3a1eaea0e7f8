"""Nearest vectors and stable ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordweft.functions.columns import let
from wordweft.functions.vectors import cosine_similarity

#: Query vectors that one block holds, and vectors of the corpus that meet it at once, about.
BLOCK, CHUNK = 256, 2048


def _bundled(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Rows (key, v) in bundles of about `size`, dealt by a hash of the key, as one array of structs each."""
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), "v")).alias(name)).drop("_b")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank) of the k corpus vectors (id, v) of largest cosine for each query (query_id, v); ties by id.

    A stated query set meets all vectors, a block of queries and a chunk of vectors at a time, by one matrix product; of each such product only k
    rows a query go on.
    """
    pairs = _bundled(corpus, "id", CHUNK, "cs").crossJoin(_bundled(queries, "query_id", BLOCK, "qs"))
    kinds = [queries.schema["query_id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()]

    def unit(bundle) -> tuple[np.ndarray, np.ndarray]:
        v = np.array([x["v"] for x in bundle], dtype=np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.array([x["k"] for x in bundle]), v / np.sqrt((v * v).sum(1, keepdims=True))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cs, qs in zip(b["cs"], b["qs"], strict=True):
                (ids, c), (names, q) = unit(cs), unit(qs)
                scores = q @ c.T
                by_id = np.argsort(ids, kind="stable")
                # Undefined scores come first, as they do when rows are sorted by falling score.
                order = by_id[np.argsort(-np.nan_to_num(scores[:, by_id], nan=np.inf), axis=1, kind="stable")[:, :k]]
                yield pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    found = pairs.mapInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return rank(found, k)


def rank(scored: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): best first, equal scores by id; a limit k is applied in every partition before the shuffle too."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "id", "score", "rank")


def most_similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of vectors with at least this cosine."""
    return pairs.withColumn("cosine", let(F.struct("a", "b"), lambda x: cosine_similarity(x["a"], x["b"]))).where(F.col("cosine") >= similarity)
