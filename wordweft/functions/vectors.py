"""Vector arithmetic without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordweft.functions.columns import let


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN where either vector is zero."""
    product = norm(a) * norm(b)
    return F.when(product == 0, F.lit(float("nan"))).otherwise(dot(a, b) / product)


def softmax(scores: Column) -> Column:
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(p, lambda x: x / total)))


def pair_score(logits: Column) -> Column:
    """A cross-encoder's score: the probability of the second class where there are two, else the raw logit."""
    return F.when(F.size(logits) > 1, F.element_at(softmax(logits), 2)).otherwise(F.element_at(logits, 1))
