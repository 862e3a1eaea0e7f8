"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Every statistic of a text is a native column expression over the whole text. A KLL sketch of each
statistic, over the rows that pass the base rules, is built per (lang, source) with map-side partial sketches, so that a hot source
never reaches one task as rows; merged sketches stand for languages and for everything. A group's median and upper quantile are
drawn towards its language's, and these towards everything's, the more the fewer rows it has. The fence lies beyond
the upper quantile by a multiple of its distance from the median, plus a grain, about the change that one more line or word makes.

Defined results: null text counts as empty (no words, base_failed); null lang or source form a group
of their own together with the empty string; repeated rows give repeated rows; extra columns are ignored by the
query; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweft.llm.common import GAP_CHARS, WORD, cut, let, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """level: the upper quantile; reach: times its distance from the median; grain: added to it; lower: whether low values fail too."""

    stat: str
    level: float
    reach: float
    grain: float
    lower: bool = False

    @property
    def levels(self) -> tuple[float, ...]:
        return (0.5, self.level, 1 - self.level) if self.lower else (0.5, self.level)


#: Junk with symbols can be a quarter of a source; repeats are found in good texts too, so only a group's last hundredth sets their fences.
FENCES = (
    Fence("symbols_per_word", 0.75, 6.0, 0.10),
    Fence("dup_line_share", 0.99, 0.5, 0.05),
    Fence("repeat_word_share", 0.99, 0.5, 0.05),
    Fence("chars_per_word", 0.75, 6.0, 0.25, lower=True),
)


def _covered_by_repeats(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Sorting longs that hold a hash above the window's place leaves the few windows whose hash repeats;
    only these are compared as strings, sorted with their places, so that equal ones are neighbours.
    """

    def suspects(v: Column) -> Column:
        room = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(v).cast("double") + 1)).cast("int"))
        high = lambda m: F.lit(2**63 - 1).bitwiseAND(F.bitwise_not(m - 1))
        keys = lambda m, h: F.sort_array(F.transform(F.slice(v, F.lit(1), F.size(v) - 2), lambda x, i: F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2)).bitwiseAND(h).bitwiseOR(i)))
        pairs = lambda k, m: F.filter(F.sequence(F.lit(0), F.size(k) - 2), lambda i: F.get(k, i).bitwiseXOR(F.get(k, i + 1)) < m)
        place = lambda k, m, i: F.get(k, i).bitwiseAND(m - 1).cast("int")
        both = lambda k, m: F.array_distinct(F.flatten(F.transform(pairs(k, m), lambda i: F.array(place(k, m, i), place(k, m, i + 1)))))
        return let(room, lambda m: let(high(m), lambda h: let(keys(m, h), lambda k: F.when(F.size(k) < 2, F.array().cast("array<int>")).otherwise(both(k, m)))))

    def places(grams: Column) -> Column:
        same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(grams, lambda x, i: same(x, F.get(grams, i - 1)) | same(x, F.get(grams, i + 1))), lambda x: x["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(v: Column, at: Column) -> Column:
        return F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)).alias("g"), i.alias("i"))))

    none = F.lit(0).cast("long")
    exact = lambda v: let(suspects(v), lambda at: F.when(F.size(at) == 0, none).otherwise(let(windows(v, at), lambda g: let(places(g), total))))
    return let(w, lambda v: F.when(F.size(v) < 4, none).otherwise(exact(v)))


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns, counts of each whole text, and the ratios that fences look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    counted = docs.select(
        *keep,
        F.length(F.translate(t, GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _covered_by_repeats(w).alias("repeats"))).alias("w"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return counted.select(
        *keep,
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("w.repeats").alias("n_repeat_words"),
        share(F.col("n_symbols"), F.col("w.n")).alias("symbols_per_word"),
        share(F.col("lines.dup"), F.col("lines.n")).alias("dup_line_share"),
        share(F.col("w.repeats"), F.col("w.n")).alias("repeat_word_share"),
        share(F.col("word_chars"), F.col("w.n")).alias("chars_per_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def group_fences(stats: DataFrame, fences: tuple[Fence, ...] = FENCES, lean: int = 200, k: int = 2000) -> DataFrame:
    """Per (lang, source): low and high fence of each statistic. A group of `lean` rows stands halfway between its own quantiles and its language's."""
    sketches = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(f.stat, F.lit(k)).alias(f.stat) for f in fences))
    merged = lambda by: sketches.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(f.stat, F.lit(k)).alias(f.stat) for f in fences))
    per_lang, whole = merged(["lang"]), merged([])
    up = lambda df, mark: df.withColumnsRenamed({c: f"{c}_{mark}" for c in ["n", *(f.stat for f in fences)]})
    wide = sketches.join(up(per_lang, "lang"), "lang").crossJoin(F.broadcast(up(whole, "all")))  # one row
    of = lambda f, level, mark: F.kll_sketch_get_quantile_double(F.col(f.stat + mark), F.lit(level))
    drawn = lambda own, n, wider: (own * F.col(n) + wider * lean) / (F.col(n) + lean)
    out = [F.col("lang"), F.col("source")]
    for f in fences:
        q = {level: drawn(of(f, level, ""), "n", drawn(of(f, level, "_lang"), "n_lang", of(f, level, "_all"))) for level in f.levels}
        middle = q[0.5]
        out.append((q[f.level] + (q[f.level] - middle) * f.reach + f.grain).alias(f"{f.stat}_high"))
        out.append((q[1 - f.level] - (middle - q[1 - f.level]) * f.reach - f.grain if f.lower else F.lit(float("-inf"))).alias(f"{f.stat}_low"))
    return wide.select(*out)


def judge(docs: DataFrame, fences: tuple[Fence, ...] = FENCES, text: str = "text", salts: int = 64) -> DataFrame:
    """Statistics, base_failed, the failed fences and kept, for every row of docs (doc_id, lang, source and the text)."""
    stats = cut(text_stats(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text), text), "rule-stats").withColumn("base_failed", base_failed())
    # A hot group is dealt over all salts; the fences, a few numbers a group, are repeated for each salt. Groups without fences have no row that passes the base.
    limits = group_fences(stats.where("not base_failed"), fences).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")).join(limits, ["lang", "source", "salt"], "left")
    failed = F.filter(F.array(*(F.when((F.col(f.stat) > F.col(f"{f.stat}_high")) | (F.col(f.stat) < F.col(f"{f.stat}_low")), F.lit(f.stat)) for f in fences)), lambda x: x.isNotNull())
    return joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("salt")


def op2_adaptive_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
