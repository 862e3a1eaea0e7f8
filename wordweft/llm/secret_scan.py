"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns give the base spans. Candidates of the battery are runs of at least LEAST encoding characters. For each, an encoding
is inferred from the characters it has, and three statistics are compared with what words, names and numbers written in
that encoding give: the chi-squared distance of its characters from the uniform alphabet, the number of runs of character
classes, and the serial correlation of one class. Classes are vowels and consonants where all letters have one case, else the
kinds of characters; random letters change class less often than words, random mixtures more often. The combined normal score gives
a p-value of "this is text". Over the whole table, p-values are counted by length class in bins of bounded number, and in each length
class the Benjamini-Hochberg procedure at RATE decides which candidates are secrets; so short tokens do not borrow from long ones.

Positions are code points, ends exclusive. Positions of matches follow from the texts between them, so all runs in the JVM.

Defined results: null and empty texts have no spans; repeated rows give repeated rows and count as often in the control;
a candidate inside a base span is not added again; an empty table gives an empty result; kept columns whose names are those of
results (RESULTS) are refused with ValueError, all others travel along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweft.llm.common import cut, let

#: Kind, pattern, the group with a least length, and that length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "random")
LEAST = 20
RATE = 0.01
#: Length classes: from these lengths on.
CLASSES = (20, 24, 32, 48, 96)
BINS = 400


@dataclass(frozen=True)
class Encoding:
    """What text in an encoding looks like, measured on words, identifiers, paths and numbers and rounded.

    share: of pairs of places that have one character; change: of neighbours in different classes; serial: correlation of neighbours. Spreads are
    for one character and fall with the root of the length. spread: of the sum of the three scores, which are not independent.
    """

    pattern: str
    letters: int
    share: tuple[float, float]
    change: tuple[float, float]
    serial: tuple[float, float]
    spread: float


#: Fixed values, the first whose pattern holds counts. Random strings have a lesser share; of one case they change class less often, else more often.
ENCODINGS = (
    Encoding("^(?:[A-Z]?[a-z]+|[A-Z]+)$", 26, (0.065, 0.115), (0.60, -0.72), (-0.32, 0.95), 2.0),
    Encoding("^(?:[0-9a-f]+|[0-9A-F]+)$", 16, (0.115, 0.25), (0.20, 0.70), (0.30, -1.0), 1.5),
    Encoding("^[A-Z2-7]+=*$", 32, (0.070, 0.14), (0.20, 0.60), (-0.30, 1.0), 1.5),
    Encoding("^(?:[a-z0-9]+|[A-Z0-9]+)$", 36, (0.060, 0.12), (0.20, 0.55), (-0.30, 1.0), 1.5),
    Encoding("", 64, (0.048, 0.10), (0.30, 0.50), (-0.28, 1.0), 1.5),
)
_RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
RESULTS = ("n_assign", "n_access", "n_hex", "base", "spans", "candidates", "least")
_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(t: Column, pattern: str, kind: int, group: int, least: int, found: str | None = None) -> Column:
    """Spans of the matches whose group has the least length; `found` is a quick test that holds wherever one is."""

    def walk(parts: Column) -> Column:
        step = lambda s, i: let(
            F.struct((s["at"] + F.length(F.get(parts["gaps"], i))).alias("start"), F.length(F.get(parts["all"], i)).alias("n")),
            lambda m: F.struct(
                (m["start"] + m["n"]).alias("at"),
                F.when(
                    F.length(F.get(parts["part"], i)) >= least,
                    F.concat(s["out"], F.array(F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + m["n"]).alias("end")))),
                ).otherwise(s["out"]).alias("out"),
            ),
        )
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.when(F.size(parts["all"]) == 0, first["out"]).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(parts["all"]) - 1), first, step)["out"])

    p = F.lit(pattern)
    every = F.regexp_extract_all(t, p, F.lit(0))
    parts = F.struct(F.split(t, pattern).alias("gaps"), every.alias("all"), (F.regexp_extract_all(t, p, F.lit(group)) if group else every).alias("part"))
    return F.when(t.rlike(found or pattern), let(parts, walk)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> list[Column]:
    """Spans by pattern. A hex run is matched whole, so only runs of the least length need to be looked for; likewise for access keys."""
    t = F.coalesce(text, F.lit(""))
    out = []
    for kind, (name, pattern, group, least) in enumerate(PATTERNS):
        if group == 0:
            # The run is maximal, so asking for the least length inside the pattern drops exactly the failing matches.
            fixed = len("AKIA") if name == "access" else 0
            pattern = f"{pattern[:-1]}{{{least - fixed},}}"
        out.append(_spans(t, pattern, kind, group, least))
    return out


def text_surprise(token: Column) -> Column:
    """-log10 of the p-value of `token is made of words`, 0 or more."""
    own = len(ENCODINGS) - 1
    which = F.lit(own)
    for i in range(own - 1, -1, -1):
        which = F.when(token.rlike(ENCODINGS[i].pattern), i).otherwise(which)
    vowel = lambda x: F.lower(x).isin("a", "e", "i", "o", "u").cast("int")
    kind = lambda x: F.when(x.between("a", "z"), 1).when(x.between("A", "Z"), 2).when(x.between("0", "9"), 3).otherwise(4)

    def tests(c: Column, e: Column) -> Column:
        n = F.size(c).cast("double")
        of = lambda value: F.get(F.array(*(F.lit(float(value(x))) for x in ENCODINGS)), e)
        classes = F.when(e == 0, F.transform(c, vowel)).otherwise(F.transform(c, kind))
        marks = F.when(e == 1, F.transform(c, lambda x: x.between("0", "9").cast("int"))).otherwise(F.transform(c, vowel))
        squares = F.aggregate(F.array_distinct(c), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(c, lambda y: y == x)).cast("double"), F.lit(2.0)))
        turns = let(classes, lambda k: F.size(F.filter(k, lambda x, i: (i > 0) & (x != F.get(k, i - 1)))).cast("double"))
        held = let(marks, lambda m: F.struct(F.aggregate(m, F.lit(0), lambda a, x: a + x).alias("one"), F.size(F.filter(m, lambda x, i: (i > 0) & (x == 1) & (F.get(m, i - 1) == 1))).alias("two")))
        # Chi-squared is k / n times the squares, less n; among texts it is as the share of equal pairs has it.
        chi = of(lambda x: x.letters) / n * squares - n
        text_chi = of(lambda x: x.letters) * (1 + (n - 1) * of(lambda x: x.share[0])) - n
        chi_spread = of(lambda x: x.letters) * (n - 1) * of(lambda x: x.share[1]) / F.sqrt(n)

        def serial(v: Column) -> Column:
            r = (v["vv"] - v["v"] * v["v"]) / (v["v"] * (1 - v["v"]))
            return F.when((v["v"] > 0) & (v["v"] < 1), (r - of(lambda x: x.serial[0])) / of(lambda x: x.serial[1]) * F.sqrt(n)).otherwise(0.0)

        score = (
            (text_chi - chi) / chi_spread
            + (turns / (n - 1) - of(lambda x: x.change[0])) / of(lambda x: x.change[1]) * F.sqrt(n)
            + let(held, lambda h: let(F.struct((h["one"] / n).alias("v"), (h["two"] / (n - 1)).alias("vv")), serial))
        ) / of(lambda x: x.spread)
        # The tail of the normal distribution by Sampford's bound, which is on the safe side.
        return let(score, lambda z: F.when(z > 0, F.greatest(F.lit(0.0), z * z / 2 * math.log10(math.e) + math.log10(math.sqrt(2 * math.pi)) - F.log10(4 / (3 * z + F.sqrt(z * z + 8))))).otherwise(0.0))

    return let(F.struct(F.filter(F.split(token, ""), lambda x: x != "").alias("c"), which.alias("e")), lambda s: tests(s["c"], s["e"]))


def analyse(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, counts by kind, base (spans sorted) and candidates (span, length class, bin) of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    runs = _spans(t, _RUN, KINDS.index("random"), 0, LEAST)
    found = docs.select(*keep, F.array(*base_spans(F.col(text))).alias("_by"), runs.alias("_runs"), t.alias("_t"))
    base = F.array_sort(F.flatten("_by"))

    def candidate(r: Column) -> Column:
        length = r["end"] - r["start"]
        cls = F.lit(0)
        for i, least in enumerate(CLASSES[1:], 1):
            cls = F.when(length >= least, i).otherwise(cls)
        surprise = let(F.substring(F.col("_t"), r["start"] + 1, length), text_surprise)
        return F.struct(r.alias("span"), cls.alias("cls"), F.least(F.floor(surprise * 10), F.lit(BINS - 1)).cast("int").alias("bin"))

    fresh = F.filter("_runs", lambda r: ~F.exists(F.flatten("_by"), lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    size = lambda i: F.size(F.col("_by")[i]).cast("long")
    return found.select(*keep, size(0).alias("n_assign"), size(1).alias("n_access"), size(2).alias("n_hex"), base.alias("base"), F.transform(fresh, candidate).alias("candidates"))


def thresholds(analysed: DataFrame, rate: float = RATE) -> DataFrame:
    """One row: for each length class the least bin that the Benjamini-Hochberg procedure accepts, null where it accepts none."""
    bins = analysed.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("cls").orderBy(F.desc("bin"))  # at most BINS rows for each of the length classes
    ranked = bins.withColumn("at_least", F.sum("n").over(above)).withColumn("m", F.sum("n").over(Window.partitionBy("cls")))
    passes = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("m") <= rate * F.col("at_least")
    return ranked.agg(F.array(*(F.min(F.when(passes & (F.col("cls") == i), F.col("bin"))) for i in range(len(CLASSES)))).alias("least"))


def scan(docs: DataFrame, keep: list[str], text: str = "text", rate: float = RATE) -> DataFrame:
    """keep, counts by kind, base and spans: arrays of (start, kind, end), kind being a place in KINDS."""
    if clash := sorted({*keep} & {*RESULTS}):
        raise ValueError(f"rename {', '.join(clash)}: results have these names")
    analysed = cut(analyse(docs, keep, text), "secret-candidates")
    accepted = F.filter("candidates", lambda c: F.coalesce(c["bin"] >= F.get(F.col("least"), c["cls"]), F.lit(False)))
    with_limits = analysed.crossJoin(F.broadcast(thresholds(analysed, rate)))  # one row
    return with_limits.withColumn("spans", F.array_sort(F.concat("base", F.transform(accepted, lambda c: c["span"])))).drop("candidates", "least")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal stretch of spans replaced by a mark; spans are sorted by start."""
    grow = lambda out, s: F.when(
        (F.size(out) > 0) & (s["start"] <= F.get(out, F.size(out) - 1)["end"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["start"].alias("start"), F.greatest(F.get(out, F.size(out) - 1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    merged = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), grow)

    def cut_out(m: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)
        pieces = F.transform(m, lambda s, i: F.substring(text, before(i) + 1, s["start"] - before(i)))
        last = F.get(m, F.size(m) - 1)["end"]
        return F.concat(F.array_join(pieces, mark), F.lit(mark), F.substring(text, last + 1, F.length(text)))

    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(let(merged, cut_out))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, ["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
