"""Quality classifier: a sparse ensemble of rules over text statistics.

Gradient-boosted trees of small depth are grown in numpy on a bounded sample of labelled rows. Every path from a root to
a node is a conjunctive rule over statistics; lasso logistic regression keeps few of the rules, and these are compiled into one
Spark column expression, so scoring whole texts needs no Python. SAMPLE bounds the labelled rows that are fitted to
(those with the smallest hash of doc_id).

Defined results: null and empty texts have all statistics 0 and get a score; rows without a label are scored and never
learnt from; rows with other labels than 0 and 1 are not learnt from; of documents that share a doc_id the sample takes one;
without training rows of both classes every score is the share of label 1, or 0.5 without any; extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweft.llm.common import GAP_CHARS, in_fold, let, words

SAMPLE = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text, from which rules are made: a struct in `base` first, then ratios over it."""
    t = F.coalesce(text, F.lit(""))
    n_of = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = let(F.split(t, "\n"), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    w = let(
        words(text),
        lambda v: F.struct(
            F.size(v).alias("n"),
            F.size(F.array_distinct(v)).alias("distinct"),
            F.size(F.filter(v, lambda x, i: x == F.get(v, i - 1))).alias("again"),
        ),
    )
    upper = "".join(map(chr, range(0x41, 0x5B))) + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
    return {
        "chars": F.length(t),
        "gaps": n_of(GAP_CHARS),
        "symbols": n_of("#*$%&<>@\\^~{}[]_+="),
        "bars": n_of("|"),
        "shouts": n_of("!?"),
        "stops": n_of(".,;:"),
        "digits": n_of("0123456789"),
        "upper": n_of(upper),
        "lines": lines,
        "w": w,
    }


RATIOS: dict[str, str] = {
    "words": "w.n",
    "chars_a_word": "(chars - gaps) / greatest(w.n, 1)",
    "symbols_a_word": "symbols / greatest(w.n, 1)",
    "bars_a_word": "bars / greatest(w.n, 1)",
    "shouts_a_word": "shouts / greatest(w.n, 1)",
    "stops_a_word": "stops / greatest(w.n, 1)",
    "digits_a_char": "digits / greatest(chars, 1)",
    "upper_a_char": "upper / greatest(chars, 1)",
    "repeated_lines": "1 - lines.d / lines.n",
    "repeated_words": "1 - w.distinct / greatest(w.n, 1)",
    "stutter": "w.again / greatest(w.n, 1)",
}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `_stats` of the ratios as doubles."""
    counted = docs.withColumn("_base", F.struct(*(c.alias(n) for n, c in statistics(F.col(text)).items())))
    of = lambda sql: F.expr(_qualified(sql))
    return counted.withColumn("_stats", F.struct(*(of(sql).cast("double").alias(n) for n, sql in RATIOS.items()))).drop("_base")


def _qualified(sql: str) -> str:
    import re

    return re.sub(r"\b(chars|gaps|symbols|bars|shouts|stops|digits|upper|lines|w)\b", r"_base.\1", sql)


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, whether above, bound) hold; an empty rule always does."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for name, above, bound in self.conditions:
            c = F.col(f"{stats}.{name}")
            out = out & ((c > bound) if above else (c <= bound))
        return out

    def mask(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, dtype=bool)
        for name, above, bound in self.conditions:
            out &= (x[name] > bound) if above else (x[name] <= bound)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    terms: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "_stats") -> Column:
        z = F.lit(float(self.intercept))
        for rule, weight in self.terms:
            z = z + F.when(rule.column(stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 10) -> list[Rule]:
    """Distinct rules of all nodes of boosted trees with logistic loss; splits between quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]
    f, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p) + 1e-6
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            after = []
            for rows, path in nodes:
                best = None
                if level < depth and len(rows) >= 2 * least:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[j][rows]
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k)
                if best is None:
                    f[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                _, j, k = best
                low = binned[j][rows] <= k
                for side, above in ((rows[low], False), (rows[~low], True)):
                    new = (*path, (names[j], above, float(cuts[j][k])))
                    rules[tuple(sorted(new))] = None
                    after.append((side, new))
            nodes = after
    return [Rule(r) for r in rules]


def fit_lasso(masks: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of logistic regression over 0/1 columns, by accelerated proximal gradient."""
    n, m = masks.shape
    a = masks.astype(np.float64)
    mean = a.mean(0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    z = (a - mean) / scale
    v, top = np.ones(m), 1.0
    for _ in range(30):
        v = z.T @ (z @ v)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (0.25 * (top / n + 1))
    w, b, w0, b0, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        e = (1 / (1 + np.exp(-np.clip(z @ u + c, -30, 30))) - y) / n
        w0, b0, t = w, b, t1
        w = u - step * (z.T @ e)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = c - step * e.sum()
    out = w / scale
    return float(b - (out * mean).sum()), out


def fit(labelled: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """labelled: at most `sample` rows with `_stats` and the label, brought to the driver."""
    rows = labelled.select(*(F.col(f"_stats.{n}").alias(n) for n in RATIOS), F.col(label).alias("_y")).toPandas().sort_values([*RATIOS, "_y"])
    assert len(rows) <= sample
    y = rows["_y"].to_numpy(dtype=np.float64)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    flat = Ensemble(float(np.log(share / (1 - share))), ())
    if len(set(y)) < 2:
        return flat
    names = list(RATIOS)
    rules = grow_rules(rows[names].to_numpy(dtype=np.float64), y, names)
    if not rules:
        return flat
    columns = {n: rows[n].to_numpy(dtype=np.float64) for n in names}
    b, w = fit_lasso(np.column_stack([r.mask(columns, len(y)) for r in rules]), y)
    return Ensemble(b, tuple((r, float(x)) for r, x in zip(rules, w, strict=True) if abs(x) > 1e-6))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Ensemble:
    """The ensemble fitted to the labelled rows of docs for which may_learn holds, at most `sample` of them."""
    chosen = labels.where(F.col(label).isin(0, 1) & may_learn).groupBy(key).agg(F.max(label).alias(label)).orderBy(F.xxhash64(key), key).limit(sample)
    # Both sides of the join have proven bounds: `sample` rows are broadcast, one row per chosen id comes out.
    own = with_statistics(docs.select(key, text).join(F.broadcast(chosen), key), text).groupBy(key).agg(F.max(F.struct("_stats", label)).alias("x"))
    return fit(own.select("x._stats", F.col(f"x.{label}").alias(label)), label, sample)


def classify(docs: DataFrame, ensemble: Ensemble, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    scored = with_statistics(docs, text).withColumn("score", ensemble.score()).drop("_stats")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    return in_fold(F.col(key), 3, 1)


def op1_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, learn(docs, labels, ~held_out())).select("doc_id", held_out().alias("held_out"), "score", "predicted")
