import random

from pyspark.sql import functions as F

from wordweft.functions import unicode
from wordweft.operators import language_id, lexicon, restoration, scoring, tagger

SAMPLES = {
    "yor": "ṣé ẹranko náà sì gbọ́ ọ?",
    "ibo": "Ndewo, kedu ka ị mere?",
    "hau": "ƙasar Hausa ɓarna ɗan yaƴi",
    "vie": "Cô ấy rất đảm đang.",
    "pol": "Zażółć gęślą jaźń, łódź i ćma.",
    "tur": "Iğdır'ın çığır açan şişli İstanbul.",
    "fra": "Où êtes-vous ? Ça coûte cher.",
    "ara": "ذَهَبَ الطَّالِبُ إِلَى الْمَدْرَسَةِ",
}


def test_letters_come_apart_and_together():
    for lang, text in SAMPLES.items():
        gs = unicode.graphemes(text)
        assert [unicode.compose(*unicode.factorize(g, lang)) for g in gs] == gs
        assert len(unicode.strip_diacritics(text)) == len(gs)
        assert unicode.strip_diacritics(unicode.strip_diacritics(text)) == unicode.strip_diacritics(text)
        assert all(unicode.in_inventory(g, lang) for g in gs)


def test_four_strips_differ():
    table = {"ł": "l l ł ł", "å": "å a a a", "ά": "ά α α α", "ọ": "o o o ọ", "أ": "أ أ ا ا", "ɲ": "n ɲ ɲ ɲ", "ß": "ß ß ß ß"}
    strips = (unicode.strip_diacritics, unicode.strip_marks, unicode.strip_all, unicode.remove_tones)
    for letter, wanted in table.items():
        assert [f(letter) for f in strips] == wanted.split()


def test_align_keeps_the_source():
    assert unicode.align("se eranko naa si gbo o", "ṣe ẹranko náà sì gbọ́ ọ?") == "ṣe ẹranko náà sì gbọ́ ọ"
    assert [unicode.align(*p) for p in (("ola", "ọlu"), ("recieve", "receive"), ("abc", "abcd"), ("ɗan", "dan"))] == ["ọla", "recieve", "abc", "dan"]
    rng = random.Random(5)
    for text in SAMPLES.values():
        for _ in range(30):
            other = "".join(c for c in text if rng.random() < 0.9)
            assert unicode.strip_marks(unicode.align(text, other)) == unicode.strip_marks(text)


def test_native_strip_equals_python(spark):
    df = spark.createDataFrame([(t,) for t in [*SAMPLES.values(), "", "ǻ", "é"]], "t string").where(~F.col("t").rlike(r"[^\x00-ɏ]"))
    for r in df.select("t", unicode.strip_native(F.col("t")).alias("a"), unicode.strip_column(F.col("t")).alias("b"), unicode.density_native(F.col("t")).alias("c"), unicode.density_column(F.col("t")).alias("d")).collect():
        assert r.a == r.b == unicode.strip_diacritics(r.t) and r.c == r.d


def test_linear_scores_by_hand(spark):
    model = spark.createDataFrame([("ola", 1.0, [2.0, -2.0])], "term string, idf double, weights array<double>")
    meta = spark.createDataFrame([("yor", 0, 0.0), ("eng", 1, 0.0)], "class string, idx int, intercept double")
    docs = spark.createDataFrame([(1, "Ola"), (2, ""), (3, None), (4, "zzz"), (4, "Ola ola")], "doc_id long, text string")
    found = sorted((r.doc_id, r["class"], round(r.score, 9)) for r in language_id.scores(docs, model, meta).collect())
    zero = [(i, c, 0.0) for i in (2, 3, 4) for c in ("yor", "eng")]
    assert found == sorted([(1, "yor", 2.0), (1, "eng", -2.0), *zero, (4, "yor", 2.0), (4, "eng", -2.0)])
    assert sorted((r.doc_id, r.lang) for r in language_id.predict(docs, model, meta).collect()) == [(i, "yor") for i in (1, 2, 3, 4, 4)]
    routed = language_id.route(docs.where("doc_id < 4"), model, meta, lambda d: d.select("doc_id", F.lit("ibo").alias("lang")), short=0)
    assert {r.doc_id: (r.lang, r.by) for r in routed.collect()} == {1: ("yor", "linear"), 2: ("ibo", "strong"), 3: ("ibo", "strong")}


def test_training_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "b", "x"), (3, "b c", "y"), (4, "a", None)], "doc_id long, text string, lang string")
    model, meta = language_id.train(docs, least=2)
    rows = {r.term: r for r in model.collect()}
    assert set(rows) == {"b"} and abs(rows["b"].idf - (math.log(4 / 4) + 1)) < 1e-12
    shares = [math.log(3 / 4), math.log(2 / 3)]
    assert all(abs(w - (s - sum(shares) / 2)) < 1e-12 for w, s in zip(rows["b"].weights, shares))
    assert [(r["class"], r.idx, round(r.intercept, 9)) for r in sorted(meta.collect())] == [("x", 0, round(math.log(2 / 3), 9)), ("y", 1, round(math.log(1 / 3), 9))]


def test_logits_and_modes(spark):
    import pytest

    row = spark.range(1).select(language_id.logit_traffic(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)), ["a", "b", "c"], {"b": 1.0}).alias("p")).select("p", language_id.ranked(F.col("p"), ["a", "b", "c"]).alias("r")).first()
    assert abs(sum(row.p) - 1) < 1e-12 and [x.label for x in row.r] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        language_id.check_mode("best")


def test_priors_change_the_order(spark):
    ratios = spark.createDataFrame([("aaa", 0.0), ("bbb", 5.0), ("ccc", -5.0)], "label string, log_prior_ratio double")
    candidates = spark.createDataFrame([(1, 1, "aaa", 0.60), (1, 2, "bbb", 0.39), (1, 3, "ccc", 0.01)], "doc_id long, rank int, label string, p double")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {r.doc_id: r.label for r in language_id.coverage(candidates, docs).collect()} == {1: "aaa", 2: language_id.NOISE}
    found = language_id.traffic(candidates, language_id.prior_table(ratios, 0.2)).orderBy("rank").collect()
    assert [r.label for r in found] == ["bbb", "aaa", "ccc"]


def test_windows_partition_the_text(spark):
    sizes = [0, 1, 5, 383, 384, 385, 640, 641, 1000, 4096, *random.Random(1).sample(range(10_000), 30)]
    for r in spark.createDataFrame([(n,) for n in sizes], "n int").select("n", tagger.plan_windows(F.col("n")).alias("w")).collect():
        at = 0
        for w in r.w:
            assert w.accept_start == at and w.start <= w.accept_start <= w.accept_end <= w.end
            at = w.accept_end
        assert at == r.n


def test_viterbi(spark):
    docs = spark.createDataFrame([(1, "Ojo, OJO!"), (2, ""), (3, None)], "doc_id long, text string")
    candidates = spark.createDataFrame([("ojo", 0, "ọjọ́")], "plain string, idx int, form string")
    unigrams = spark.createDataFrame([("ọjọ́", 0.0)], "form string, logp double")
    moves = spark.createDataFrame([], "prev string, cur string, logp double")
    assert {r.doc_id: r.restored for r in restoration.viterbi_decode(docs, candidates, unigrams, moves).collect()} == {1: "Ọjọ́, ỌJỌ́!", 2: "", 3: None}


def test_context_lookup(spark):
    marked = spark.createDataFrame([(1, "mañana niño"), (2, "mañana")], "doc_id long, text string")
    model = restoration.knn_train(marked, unicode.strip_native(F.col("word")))
    plain = spark.createDataFrame([(1, "Manana, nino 12"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.restored for r in restoration.knn_decode(plain, model, "n").collect()} == {1: "Mañana, niño 12", 2: None}


def test_sequence_decoding_batches_and_aligns(spark):
    docs = spark.createDataFrame([(1, "se ola " * 100), (2, "")], "doc_id long, text string")

    def load():
        return lambda prompts, budgets: [p.split("> ", 1)[1].replace("ola", "ọla") for p in prompts]

    out = {r.doc_id: r.restored for r in restoration.decode_in_batches(docs, "yor", load).collect()}
    assert out == {1: "se ọla " * 100, 2: ""}


def test_lexicon(spark):
    docs = spark.createDataFrame([("fr", "ou où où OÙ été ete été été ete ete ou ou")], "lang string, text string").withColumn("doc_id", F.lit(1))
    built = lexicon.build(docs, unicode.strip_native(F.col("variant")), least=2)
    assert {(r.key, r.variant, r.cnt) for r in built.collect()} == {("ou", "ou", 3), ("ou", "où", 2), ("ete", "été", 3), ("ete", "ete", 3)}
    stats = lexicon.ambiguity(built).first()
    assert (stats.forms, stats.ambiguous, stats.token_share) == (2, 2, 1.0)
    factors = spark.createDataFrame([(v, [unicode.row(g).letter for g in v], [list(unicode.row(g).marks) for g in v]) for v in ("ou", "où", "ete", "été")], "variant string, bases array<string>, marks array<array<string>>")
    assert {r.variant for r in lexicon.true_variants(built, factors).collect()} == {"où", "été"}


def test_scorer_runs_in_batches(spark):
    class Length:
        def predict(self, batch):
            return [len(x or "") for x in batch]

    df = spark.createDataFrame([("a",), ("bb",), (None,)], "t string")
    assert [r[0] for r in df.select(scoring.scored(Length, "int", F.col("t"))).collect()] == [1, 2, 0]


def test_script_columns(spark):
    texts = ["Ünïcode ª", "ذَهَبَ", "Ελλάδα abc", "12 !", "", "nǫ ệ đ", "niño", "ọ́ é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    share, foreign = unicode.script_share(F.col("t")), unicode.foreign_count(F.col("t"), "spa")
    for r in df.select("t", share.alias("a"), unicode.script_share(F.col("t"), True).alias("b"), foreign.alias("n"), unicode.graphemes_column(F.col("t")).alias("g"), unicode.roundtrip_column(F.col("t"), "vie").alias("ok")).collect():
        assert r.a == unicode.share_of_names(r.t, "LATIN") and r.b == unicode.share_of_names(r.t, "ARABIC LETTER")
        assert r.g == unicode.graphemes(r.t) and r.n == sum(not unicode.in_inventory(g, "spa") for g in r.g) and r.ok


def test_factor_table_equals_the_scalar_rule(spark):
    rows = [(lang, g) for lang in unicode.ALPHABETS for text in SAMPLES.values() for g in unicode.graphemes(text + " ÀŁ̣ệọ́")]
    made = unicode.factor_table(spark.createDataFrame([*rows, ("xxx", "a")], "lang string, g string").distinct()).collect()
    assert {(r.lang, r.g) for r in made} == set(rows)
    for r in made:
        assert (r.base, tuple(r["shape"]), r.tone) == unicode.factorize(r.g, r.lang) and r.own == unicode.in_inventory(r.g, r.lang)


def test_partial_strip(spark):
    df = spark.createDataFrame([(1, SAMPLES["vie"]), (2, None)], "k long, t string")
    half = unicode.partial_strip(F.col("t"), 0.5, F.col("k"))
    rows = df.select(half.alias("half"), unicode.partial_strip(F.col("t"), 0.0, F.col("k")).alias("none"), unicode.partial_strip(F.col("t"), 1.0, F.col("k")).alias("all")).collect()
    assert rows[0].none == unicode.strip_diacritics(SAMPLES["vie"]) and rows[0]["all"] == SAMPLES["vie"] and rows[1].half is None
    assert rows[0].none != rows[0].half != rows[0]["all"] and unicode.strip_diacritics(rows[0].half) == rows[0].none


def test_nearest_vectors(spark, monkeypatch):
    import numpy as np

    from wordweft.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "CHUNK", 7)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 5))
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    found = retrieval.top_k(rows.where("id % 5 = 0").withColumnRenamed("id", "query_id"), rows, 4).collect()
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(0, 40, 5):
        own = [(r.rank, r.id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q]
        scores = u @ u[q]
        assert [i for _, i in own] == sorted(range(40), key=lambda i: (-round(scores[i], 12), i))[:4]
