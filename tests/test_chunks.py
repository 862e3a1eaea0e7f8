"""Queries whose texts are dealt into chunks: the same results as row by row, without a row a text and word in any shuffle."""

import random

from pyspark.sql import functions as F

from wordweft.functions import unicode
from wordweft.operators import chunks, language_id, restoration
from wordweft.plans import catalog

WORDS = ["ola", "oko", "ọkọ", "Año", "ano", "İs", "ΟΔΟΣ", "x_1", "12", "naïve", "Été", "été", "ete", "ETÉ", "áb", "日本", "wá"]


def _texts(n, seed=5):
    r = random.Random(seed)
    return [None, "", " \n\x1c", "!?", "only-once here", *(r.choice([" ", ", ", "\n"]).join(r.choice(WORDS) for _ in range(r.randrange(1, 30))) for _ in range(n))]


def _docs(spark, n=120):
    rows = [(i, t, ("fr", "es", "de", None)[i % 4]) for i, t in enumerate(_texts(n))]
    return spark.createDataFrame([*rows, rows[9], rows[9]], "doc_id long, text string, lang string").repartition(3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_own_scores_are_those_of_the_joined_model(spark, monkeypatch):
    """Many chunks and buckets give what a model table joined by term gives, repeated rows included."""
    monkeypatch.setattr(chunks, "CHUNK", 700)
    monkeypatch.setattr(chunks, "BUCKET", 400)
    docs = _docs(spark)
    for least in (1, 2):
        arrays, classes = language_id.own_score_arrays(docs, least)
        want, names = language_id.score_arrays(docs, *language_id.train(docs, least))
        tidy = lambda df: sorted((r.doc_id, *(round(s, 9) + 0.0 for s in r.scores)) for r in df.collect())
        assert classes == names and tidy(arrays) == tidy(want)
    assert dealt_parts(docs) > 3


def dealt_parts(docs):
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return chunks.deal(docs, volume, "doc_id").select("chunk").distinct().count()


def test_no_row_for_each_term_of_a_text(spark):
    """Neither the model's training nor its scores take terms apart into rows, and the flagship joins lengths, not texts."""
    sf_dir = "/root/testdata/sf0.001"
    for name in ("lid_predict", "lid_scores", "lid_proba", "lid_coverage", "lid_traffic", "pipeline_flagship"):
        plan = _plan(catalog.QUERIES[name](spark, sf_dir))
        assert "explode(term_counts" not in plan and "array_distinct" not in plan and "sort_array" not in plan, name
        assert "FlatMapCoGroupsInPandas" in plan, name


def test_own_viterbi_is_that_of_the_joined_tables(spark, monkeypatch):
    """Chunks that ask for forms and transitions give the text that candidate, unigram and transition tables give."""
    monkeypatch.setattr(chunks, "CHUNK", 900)
    monkeypatch.setattr(chunks, "BUCKET", 500)
    docs = _docs(spark, 200).withColumn("lang", F.coalesce("lang", F.lit("und"))).dropDuplicates(["doc_id"])
    odd = spark.createDataFrame([(900, "été \u212b été ETE \u212b ete", "fr"), (901, "\u212b", "xx\n y"), (902, "", "fr"), (903, None, "zz")], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd).cache()
    tables = restoration.viterbi_train(docs, unicode.strip_native(F.col("word")), ("lang",))
    want = restoration.viterbi_decode(docs.select("doc_id", "lang", unicode.strip_native(F.col("text")).alias("text")), *tables, ("lang",))
    found = restoration.own_viterbi(docs, unicode.strip_plain, "lang")
    assert dict(map(tuple, found.collect())) == dict(map(tuple, want.collect()))
    plan = _plan(catalog.viterbi_decode(spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "explode" not in plan


def test_own_knn_is_that_of_the_joined_table(spark, monkeypatch):
    """Chunks that ask for their contexts give the text that a table of all contexts, joined, gives; no text and word is a row."""
    monkeypatch.setattr(chunks, "CHUNK", 900)
    monkeypatch.setattr(chunks, "BUCKET", 500)
    docs = _docs(spark, 200).withColumn("lang", F.coalesce("lang", F.lit("und"))).dropDuplicates(["doc_id"])
    # Contexts that only a bare form has, by three and by one character; words of marks, of one letter, of the padding; letters that grow in upper case.
    odd = [(900, "\u0130x \u0130a a\u0130b xib xib x\u00edb", "fr"), (901, "\u0130", "xx\n y"), (902, "", "fr"), (903, None, "zz"), (904, "!?", "yy"), (905, "_a_ __ a \u00e0 A \u00c0 e\u0301 E\u0301", "fr")]
    odd += [(906, "Stra\u00dfe STRASSE \u1e9eo \U00020000\u00e9\U00020000 \U00020000e\U00020000 \u01c5a \u03a3\u0391\u03a3 MAN man m\u00e1n M\u00e1N", "de"), (907, "ano a\u00f1o ano a\u00f1o Ano A\u00d1O", "pt")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).cache()
    letters = {"fr": "aceiouy", "de": "aou"}
    column = F.when(F.col("lang") == "fr", letters["fr"]).when(F.col("lang") == "de", letters["de"]).otherwise("aeioun_")
    model = restoration.knn_train(docs, unicode.strip_native(F.col("word")), ("lang",))
    want = restoration.knn_decode(docs.select("doc_id", "lang", unicode.strip_native(F.col("text")).alias("text")), model, column, ("lang",))
    found = restoration.own_knn(docs, unicode.strip_plain, lambda lang: letters.get(lang, "aeioun_"), "lang")
    assert dict(map(tuple, found.collect())) == dict(map(tuple, want.collect()))
    plan = _plan(catalog.knn_decode(spark, "/root/testdata/sf0.001"))
    assert "explode" not in plan and "array_distinct" not in plan and "FlatMapCoGroupsInPandas" in plan
