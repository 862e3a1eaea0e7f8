"""Label spaces of the per-character tagger: which graphemes, shapes and tones there are, which pairs are legal, and texts as ids.

A label space is four small tables (an alphabet's size each), made from grapheme counts of a corpus, from the alphabets alone, or from a file. Texts
become rows of (doc_id, pos, ...) and meet these tables by joins; graphemes are factored once for each distinct one.
"""

from __future__ import annotations

import string
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweft.functions import unicode
from wordweft.session import cut

# The first five character ids, the key of the empty shape, the version of the grapheme rules.
RESERVED = ("<pad>", "<unk>", "<mask>", "<bos>", "<eos>")
UNKNOWN = RESERVED.index("<unk>")
NONE = "NONE"
SPEC_VERSION = "2"
#: Characters besides ASCII letters that a space made from alphabets has.
_PLAIN = string.ascii_letters + " .,;:!?'\"-()0123456789\n"


class LabelSpace(NamedTuple):
    """chars (char, id), shapes (shape, id), tones (tone, id), legal (lang, base, shape_id, tone_id)."""

    chars: DataFrame
    shapes: DataFrame
    tones: DataFrame
    legal: DataFrame


def shape_key(shape: Column) -> Column:
    return F.when(F.size(shape) == 0, F.lit(NONE)).otherwise(F.array_join(shape, "+"))


def count_graphemes(docs: DataFrame) -> DataFrame:
    """(lang, g, n) over texts (lang, text). Texts are read once, here: every table of a label space is made from what is written."""
    return cut(unicode.grapheme_counts(docs), "graphemes")


def _numbered(counts: DataFrame, name: str, zero: str) -> DataFrame:
    """Ids in order of name, `zero` being 0; an alphabet's size."""
    rest = counts.where(F.col(name) != zero).select(name, F.row_number().over(Window.orderBy(name)).alias("id"))
    return rest.unionByName(counts.sparkSession.createDataFrame([(zero, 0)], f"{name} string, id int"))


def build(counted: DataFrame, least_char: int = 20, least: int = 3) -> LabelSpace:
    """The label space of grapheme counts (lang, g, n).

    Foreign graphemes and unmodelled sequences of several characters have no label. A grapheme's base counts as input too. The empty
    shape and tone are legal with every base that has a legal pair.
    """
    factored = unicode.factor_table(counted).withColumn("shape", shape_key(F.col("shape")))
    kept = factored.where("own").where(~((F.col("base") == F.col("g")) & (F.col("shape") == NONE) & (F.col("tone") == "") & (F.length("g") > 1)))
    enough = lambda by, n: kept.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") >= n)
    chars = kept.select(F.explode(F.array("g", "base")).alias("char"), "n").groupBy("char").agg(F.sum("n").alias("n")).where(F.col("n") >= least_char)
    ids = chars.select("char", (F.row_number().over(Window.orderBy(F.desc("n"), "char")) + len(RESERVED) - 1).alias("id"))
    shapes, tones = _numbered(enough(["shape"], least), "shape", NONE), _numbered(enough(["tone"], least), "tone", "")
    pairs = enough(["lang", "base", "shape", "tone"], least).join(shapes.withColumnRenamed("id", "shape_id"), "shape").join(tones.withColumnRenamed("id", "tone_id"), "tone")
    pairs = pairs.select("lang", "base", "shape_id", "tone_id")
    return LabelSpace(ids, shapes, tones, pairs.unionByName(pairs.select("lang", "base", F.lit(0).alias("shape_id"), F.lit(0).alias("tone_id"))).distinct())


def from_alphabets(spark: SparkSession) -> LabelSpace:
    """The label space of the alphabets alone: each language's shapes and tones, or none, on every ASCII letter and plain character, and its special letters."""
    langs = unicode.alphabet_table(spark)
    or_none = lambda marks: F.explode(F.concat(F.array(F.lit("")), marks))
    bases = spark.createDataFrame([(c,) for c in _PLAIN], "base string")
    grid = langs.select("lang", "tones", or_none(F.array_except("own_marks", "tones")).alias("shape")).select("lang", "shape", or_none(F.col("tones")).alias("tone")).crossJoin(bases)  # alphabets by alphabets

    @F.pandas_udf("string")
    def composed(base: pd.Series, shape: pd.Series, tone: pd.Series) -> pd.Series:
        return pd.Series([unicode.compose(b, (s,) if s else (), t) for b, s, t in zip(base, shape, tone, strict=True)])

    special = langs.select("lang").crossJoin(spark.createDataFrame([(c,) for c in unicode.SPECIAL], "g string"))
    graphemes = grid.select("lang", composed("base", "shape", "tone").alias("g")).where("g <> ''").unionByName(special).distinct()
    return build(graphemes.withColumn("n", F.lit(1).cast("long")), 1, 1)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, g): one row a grapheme of texts (doc_id, lang, text)."""
    return docs.select("doc_id", "lang", F.posexplode(unicode.graphemes_column(F.col("text"))).alias("pos", "g"))


def encode(placed: DataFrame, space: LabelSpace) -> DataFrame:
    """placed with id: what the tagger reads."""
    return placed.join(space.chars.withColumnRenamed("char", "g"), "g", "left").withColumn("id", F.coalesce("id", F.lit(UNKNOWN)))


def gold(placed: DataFrame, space: LabelSpace) -> DataFrame:
    """placed with shape_id and tone_id of the marked text; 0 for shapes and tones that the space does not have. Languages without an alphabet fall away."""
    factors = unicode.factor_table(placed.select("lang", "g").distinct()).select("lang", "g", shape_key(F.col("shape")).alias("shape"), "tone")
    ids = factors.join(space.shapes.withColumnRenamed("id", "shape_id"), "shape", "left").join(space.tones.withColumnRenamed("id", "tone_id"), "tone", "left")
    known = ids.select("lang", "g", F.coalesce("shape_id", F.lit(0)).alias("shape_id"), F.coalesce("tone_id", F.lit(0)).alias("tone_id"))
    return placed.join(known, ["lang", "g"])


def encode_texts(text: Column, space: LabelSpace) -> Column:
    """Array of a text's ids, as encode gives them one a row. The characters of the space, an alphabet's size, are collected."""
    ids = {r["char"]: (r["id"],) for r in space.chars.collect()}
    return unicode.grapheme_values(text, F.lit(""), {"": ids}, (UNKNOWN,))["v0"]


def gold_texts(text: Column, lang: Column, space: LabelSpace, counted: DataFrame) -> Column:
    """Struct of a text's shape ids v0 and tone ids v1, as gold gives them one a row; counted (lang, g, n) has the graphemes of all texts.

    Those that have a shape or tone of the space, an alphabet's size, are collected.
    """
    found: dict[str, dict[str, tuple[int, int]]] = {}
    for r in gold(counted.select("lang", "g"), space).where("shape_id > 0 or tone_id > 0").collect():
        found.setdefault(r["lang"], {})[r["g"]] = r["shape_id"], r["tone_id"]
    return unicode.grapheme_values(text, lang, found, (0, 0))


def decode_chars(rows: DataFrame, space: LabelSpace) -> DataFrame:
    """rows (base, shape_id, tone_id, ...) with char, the base where there is no such letter; each distinct triple is composed once."""

    @F.pandas_udf("string")
    def char(base: pd.Series, shape: pd.Series, tone: pd.Series) -> pd.Series:
        return pd.Series([unicode.compose(b, () if s == NONE else tuple(s.split("+")), t) or b for b, s, t in zip(base, shape, tone, strict=True)])

    triples = rows.select("base", "shape_id", "tone_id").distinct()
    named = triples.join(space.shapes.withColumnRenamed("id", "shape_id"), "shape_id").join(space.tones.withColumnRenamed("id", "tone_id"), "tone_id")
    return rows.join(named.select("base", "shape_id", "tone_id", char("base", "shape", "tone").alias("char")), ["base", "shape_id", "tone_id"])


def outcomes(space: LabelSpace) -> DataFrame:
    """(lang, char, n_legal, eligible) of every language and character: a marked character may become what its base may; an unseen base only itself.
    Eligible characters have more than one outcome."""
    langs = space.legal.select("lang").distinct()
    facts = unicode.grapheme_table(space.chars.select(F.col("char").alias("g"))).select(F.col("g").alias("char"), "base")
    n = space.legal.groupBy("lang", "base").agg(F.count(F.lit(1)).alias("n"))
    every = langs.crossJoin(facts).join(n, ["lang", "base"], "left")  # languages by characters
    return every.select("lang", "char", F.coalesce("n", F.lit(1)).alias("n_legal"), (F.coalesce("n", F.lit(1)) > 1).alias("eligible"))


def write_json(space: LabelSpace, path: str) -> None:
    """One row a table entry: what, name, lang, id, other; read back by read_json."""
    row = lambda df, what, name, lang, a, b: df.select(F.lit(what).alias("what"), name.alias("name"), lang.alias("lang"), a.alias("id"), b.alias("other"), F.lit(SPEC_VERSION).alias("spec_version"))
    none, null = F.lit(None).cast("string"), F.lit(None).cast("int")
    parts = [row(df, what, F.col(what), none, F.col("id"), null) for df, what in ((space.chars, "char"), (space.shapes, "shape"), (space.tones, "tone"))]
    parts.append(row(space.legal, "legal", F.col("base"), F.col("lang"), F.col("shape_id"), F.col("tone_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> LabelSpace:
    """The label space that write_json wrote; ValueError for another version of the grapheme rules."""
    from wordweft.sources.tables import check_spec

    raw = spark.read.schema("what string, name string, lang string, id int, other int, spec_version string").json(path)
    check_spec(raw, SPEC_VERSION)
    of = lambda what: raw.where(F.col("what") == what).select(F.col("name").alias(what), "id")
    legal = raw.where("what = 'legal'").select("lang", F.col("name").alias("base"), F.col("id").alias("shape_id"), F.col("other").alias("tone_id"))
    return LabelSpace(of("char"), of("shape"), of("tone"), legal)
