"""Packing into optimal length buckets.

The global histogram of lengths is aggregated on the executors; a dynamic programme over it chooses the bucket
boundaries that minimise padding, and batches with a token budget form inside each bucket.

The histogram has a row for each length that occurs, so at most as many as the longest text has words, and the boundaries are optimal.

Defined results: null or empty texts have length 0 and sit in the first bucket; documents longer than the token budget form
batches of one; ties, repeated rows and rows without a key are dealt by a hash, each row once; extra columns are kept, but those whose names
are those of results (RESULTS) are refused with ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweft.llm.common import WORD, cut


RESULTS = ("length", "bucket", "bucket_len", "batch_id")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with least padding; lengths ascend.

    With one bucket more, the cost up to length x is the least of lines in x, one for each end of the buckets before, whose slopes fall as x
    grows; so every layer is one walk along their lower hull, in whole numbers.
    """
    n = len(lengths)
    if n == 0:
        return []
    size, times = [int(x) for x in lengths], [int(x) for x in counts]
    rows, words = [0], [0]  # rows and words of the first j lengths
    for x, k in zip(size, times, strict=True):
        rows.append(rows[-1] + k)
        words.append(words[-1] + k * x)
    best = [size[j] * rows[j + 1] - words[j + 1] for j in range(n)]
    splits = []
    for _ in range(1, min(buckets, n)):
        now, arg = best[:], [-1] * n
        hull: list[tuple[int, int, int]] = []  # slope, height, end of the buckets before
        first = 0
        for j in range(1, n):
            slope, height = -rows[j], best[j - 1] + words[j]
            while len(hull) - first > 1:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (height - b1) * (m1 - m2) > (b2 - b1) * (m1 - slope):
                    break
                hull.pop()
            hull.append((slope, height, j - 1))
            x = size[j]
            while len(hull) - first > 1 and hull[first + 1][0] * x + hull[first + 1][1] <= hull[first][0] * x + hull[first][1]:
                first += 1
            m, b, i = hull[first]
            cost = m * x + b + x * rows[j + 1] - words[j + 1]
            if cost < now[j]:
                now[j], arg[j] = cost, i
        best = now
        splits.append(arg)
    ends, j = [size[-1]], n - 1
    for arg in reversed(splits):
        if arg[j] >= 0:
            j = arg[j]
            ends.append(size[j])
    return sorted(ends)


def pack(docs: DataFrame, length: Column, buckets: int = 16, token_budget: int = 65536, group_rows: int = 32768, key: str = "doc_id") -> DataFrame:
    """docs with length, bucket, bucket_len (padded length) and batch_id; a batch holds at most max(1, token_budget // bucket_len) rows of one bucket.

    Batches are numbered inside groups of about group_rows rows of a bucket, dealt by a hash of the key, so no bucket is sorted in one task.
    """
    if clash := sorted({*docs.columns} & {*RESULTS}):
        raise ValueError(f"rename {', '.join(clash)}: results have these names")
    sized = docs.withColumn("length", F.coalesce(length, F.lit(0)).cast("long"))
    histogram = sized.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r["length"], r["n"]) for r in histogram.collect())  # bounded, see above
    ends = best_boundaries(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), buckets)
    held, at = [0] * max(1, len(ends)), 0
    for b, n in rows:
        while b > ends[at]:
            at += 1
        held[at] += n
    groups = [max(1, -(-n // group_rows)) for n in held]
    pick = lambda values: F.array(*(F.lit(int(v)).cast("long") for v in values))[F.col("bucket")]
    bucket = F.aggregate(F.array(*(F.lit(e).cast("long") for e in ends[:-1])).cast("array<bigint>"), F.lit(0), lambda a, e: a + (F.col("length") > e).cast("int"))
    dealt = sized.withColumn("bucket", bucket).withColumn("bucket_len", pick(ends or [0])).withColumn("_group", F.pmod(F.xxhash64(F.col(key), F.lit(7)), pick(groups)))
    cap = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1))))
    order = Window.partitionBy("bucket", "_group").orderBy(F.xxhash64(F.col(key)), key, "length")
    return dealt.withColumn("_at", F.floor((F.row_number().over(order) - 1) / cap)).withColumn("batch_id", F.concat_ws("-", "bucket", "_group", "_at")).drop("_group", "_at")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("n"))
    return pack(cut(docs, "lengths"), F.col("n")).select("doc_id", F.col("length").alias("n_tokens"), "bucket", "bucket_len", "batch_id")
