"""The front of the restoration models, the tagger around a fake model, label spaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordweft.functions import unicode
from wordweft.operators import labels, lexicon, restoration, restorer, tagger


def test_options_are_checked_before_planning(spark):
    docs = spark.createDataFrame([(1, "Ola")], "doc_id long, text string")
    refused = [("nothing", {}), ("yor-viterbi", {"details": True}), ("sequence-2.0", {"min_confidence": 0.5}), ("yor-below", {"case_endings": False}), ("tagger-1.0", {"aligned": True}), ("sequence-1.0", {"hints": "h"}), ("ibo-below", {"lang": "ig"})]
    for model, options in refused:
        with pytest.raises(ValueError):
            restorer.check_options(model, **options)
    for model, lang in (("sequence-1.0", "ar"), ("tagger-1.0", "ar"), ("tagger-2.0", "auto"), ("sequence-2.0", "de")):
        with pytest.raises(ValueError):
            restorer.Restorer(model, {"load": None}, lang=lang)
    with pytest.raises(TypeError):
        restorer.Restorer().restore("Ola")
    with pytest.raises(ValueError):
        restorer.Restorer("yor-viterbi").restore(docs, min_confidence=0.1)
    assert restorer.registry(spark).count() == len(restorer.MODELS) == 12


def test_dispatch(spark):
    docs = spark.createDataFrame([(1, "Ola eBay. KO"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.restored for r in restorer.Restorer().restore(docs).collect()} == {1: "Ola ebay. KO", 2: "", 3: None}
    seen = lambda prompts, budgets: [p.replace("o", "ọ") for p in prompts]
    sentences = restorer.Restorer("sequence-1.1", {"load": lambda: seen}).restore(docs.where("doc_id < 3"), lang="yo")
    assert {r.doc_id: r.restored for r in sentences.collect()} == {1: "<yọr> Ola eBay. <yọr> KO", 2: ""}
    hinted = docs.where("doc_id = 1").withColumn("h", F.lit("[g: ola=x]"))
    aligned = restorer.Restorer("sequence-2.0", {"load": lambda: lambda prompts, budgets: [p.split("] ")[1].replace("o", "ọ").replace("O", "Ọ") + "!" for p in prompts]}).restore(hinted, lang="ar", case_endings=False, hints="h")
    assert aligned.first().restored == "Ọla eBay. KỌ"
    tags = restorer.Restorer("sequence-2.0", {"load": lambda: lambda prompts, budgets: prompts}).restore(hinted, lang=F.lit("ar"), case_endings=False, aligned=False)
    assert tags.first().restored == "<ara-nocase> Ola eBay. KO"


def test_letter_classes_and_word_corrections(spark):
    docs = spark.createDataFrame([(1, "Oko ile, OKO !"), (2, None)], "doc_id long, text string")
    marked = spark.createDataFrame([("oko", [1, 0, 4])], "t string, k array<int>").select(restoration.apply_classes(F.col("t"), F.col("k")).alias("x")).first().x
    assert marked == unicode.ud.normalize("NFC", "o\u0323ko\u0323\u0301")
    predicted = spark.createDataFrame([(1, "Ọkó ile, ỌKỌ !")], "doc_id long, predicted string")
    candidates = spark.createDataFrame([("oko", ["ọkọ", "oko"]), ("ile,", ["ilé"])], "plain string, forms array<string>")
    assert {r.doc_id: r.restored for r in restoration.correct_words(docs, predicted, candidates).collect()} == {1: "Ọkọ ilé, ỌKỌ !", 2: None}
    picks = spark.createDataFrame([(1, 0, 1), (1, 1, 5), (1, 2, 0)], "doc_id long, i int, pick int")
    assert {r.doc_id: r.restored for r in restoration.pick_words(docs, picks, candidates).collect()} == {1: "Oko ilé, ỌKỌ !", 2: None}


class Marks:
    """A tagger that marks every o with a dot below and an acute, and knows nothing else."""

    def __init__(self, char_ids, n_shapes, n_tones, shape, tone):
        self.o, self.size, self.pick = char_ids, (n_shapes, n_tones), (shape, tone)

    def __call__(self, ids, langs):
        out = []
        for row in ids:
            shape, tone = np.zeros((len(row), self.size[0])), np.zeros((len(row), self.size[1]))
            for k, i in enumerate(row):
                mine = i in self.o
                shape[k, self.pick[0] if mine else 0] = 4
                tone[k, self.pick[1] if mine else 0] = 4
            out.append((shape, tone))
        return out


def held(spark, space):
    """A label space as plain rows, so that plans do not count a corpus again and again."""
    return labels.LabelSpace(*(spark.createDataFrame(df.collect(), df.schema) for df in space))


def test_tagger_restores_whole_texts(spark):
    corpus = spark.createDataFrame([("yor", "ọ́ o ọ ó abc Ọ́ O l w " * 30)], "lang string, text string")
    space = held(spark, labels.build(labels.count_graphemes(corpus)))
    chars = {r.char: r.id for r in space.chars.collect()}
    shapes, tones = {r["shape"]: r.id for r in space.shapes.collect()}, {r.tone: r.id for r in space.tones.collect()}
    assert min(chars.values()) == 5 and shapes == {"NONE": 0, "DOT_BELOW": 1} and tones == {"": 0, "ACUTE": 1}
    args = ({chars["o"]}, 2, 2, 1, 1)
    long = "olo " * 200
    docs = spark.createDataFrame([(1, "yor", "Olo bo ó https://oo.o/o"), (2, "yor", " "), (3, "yor", long), (4, "yor", "o ñ"), (5, "xxx", "o")], "doc_id long, lang string, text string")
    out, details = tagger.restore(docs, space, lambda: Marks(*args), tagger.Config(window=64, stride=48))
    got = {r.doc_id: r.restored for r in out.collect()}
    assert got == {1: "Olọ́ bọ́ ó https://oo.o/o", 2: "", 3: "ọ́lọ́ " * 200, 4: "ọ́ ñ", 5: ""}
    places = {(r.doc_id, r.pos): r for r in details.collect()}
    assert places[(1, 9)].protected and places[(1, 9)].confidence == 1.0 and places[(4, 2)].protected and not places[(1, 0)].protected
    bare, _ = tagger.restore(docs.where("doc_id = 1"), space, lambda: Marks(*args), tagger.Config(min_confidence=0.999, abstain="bare"))
    assert bare.first().restored == "Olo bo o https://oo.o/o"
    words = spark.createDataFrame([("yor", "olo", "ọló"), ("yor", "bo", "bọ́"), ("yor", "olo", "OLO")], "lang string, key string, variant string")
    low = spark.createDataFrame([(1, "yor", "olo Olo bo")], "doc_id long, lang string, text string")
    assert tagger.restore(low, space, lambda: Marks(*args), tagger.Config(margin=20.0), words)[0].first().restored == "ọló Olọ́ bọ́"
    assert tagger.restore(low, space, lambda: Marks(*args), tagger.Config(margin=0.1), words)[0].first().restored == "ọ́lọ́ Olọ́ bọ́"
    with pytest.raises(ValueError):
        tagger.Config(abstain="never")
    with pytest.raises(ValueError):
        tagger.generation("3.1")
    assert tagger.check_language("ara", "2.0.0") == "ara"
    with pytest.raises(ValueError):
        tagger.check_language("ara", "1.2.0")


def test_tagger_language_head(spark):
    space = held(spark, labels.from_alphabets(spark))
    docs = spark.createDataFrame([(1, "abc"), (2, "b")], "doc_id long, text string")
    b = {r.char: r.id for r in space.chars.collect()}["b"]
    found = tagger.languages(docs, space, lambda: lambda rows: [[float(len(r)), 2.0 * (r[0] == b)] for r in rows], ["yor", "ibo"])
    assert {r.doc_id: r.lang for r in found.collect()} == {1: "yor", 2: "ibo"}


def test_case_endings(spark):
    space = held(spark, labels.build(labels.count_graphemes(spark.createDataFrame([("ara", "ذَهَبَ بَا ب ه ذ " * 40)], "lang string, text string"))))
    tones = {r.tone: r.id for r in space.tones.collect()}

    def load():
        def run(ids, langs):
            out = []
            for row in ids:
                tone = np.zeros((len(row), len(tones)))
                tone[:, tones["FATHA"]] = 5
                out.append((np.zeros((len(row), 1)), tone))
            return out

        return run

    docs = spark.createDataFrame([(1, "ara", "ذهب به")], "doc_id long, lang string, text string")
    assert tagger.restore(docs, space, load)[0].first().restored == "ذَهَبَ بَهَ"
    assert tagger.restore(docs, space, load, tagger.Config(case_endings=False))[0].first().restored == "ذَهَب بَه"


def test_label_space_files(spark, tmp_path):
    space = held(spark, labels.from_alphabets(spark))
    labels.write_json(space, str(tmp_path / "labels"))
    back = labels.read_json(spark, str(tmp_path / "labels"))
    for a, b in zip(space, back, strict=True):
        assert sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))
    legal = {(r.lang, r.base, r.shape_id, r.tone_id) for r in back.legal.collect()}
    shapes, tones = {r["shape"]: r.id for r in back.shapes.collect()}, {r.tone: r.id for r in back.tones.collect()}
    assert ("pol", "l", shapes["SPECIAL:STROKE"], 0) in legal and ("yor", "o", shapes["DOT_BELOW"], tones["ACUTE"]) in legal and ("tur", "o", 0, tones["ACUTE"]) not in legal
    rows = spark.createDataFrame([("o", shapes["DOT_BELOW"], tones["ACUTE"]), ("q", shapes["SPECIAL:STROKE"], 0)], "base string, shape_id int, tone_id int")
    assert {r.base: r.char for r in labels.decode_chars(rows, back).collect()} == {"o": "ọ́", "q": "q"}


def test_error_rates(spark):
    g = "struct<g:string,shape:string,tone:string>"
    rows = [(("é", "", "A"), ("é", "", "A"), True, 0.9, 0.5), (("ọ́", "D", "A"), ("o", "", "A"), True, 0.4, 0.5), ((".", "", ""), ("x", "", ""), False, 0.1, 0.5)]
    r = lexicon.error_rates(spark.createDataFrame(rows, f"gold {g}, restored {g}, eligible boolean, confidence double, threshold double")).first()
    assert (r.der, r.shape_der, r.tone_der, r.coverage) == (0.5, 0.5, 0.0, 0.5)


def test_oov_keeps_the_case(spark):
    docs = spark.createDataFrame([(1, "fr", "École école ecole rien"), (2, "fr", "")], "doc_id long, lang string, text string")
    lexed = spark.createDataFrame([("fr", "ecole", "école", 9)], "lang string, key string, variant string, cnt long")
    assert {r.doc_id: r.oov for r in lexicon.oov_rate(docs, lexed, unicode.strip_native(F.col("word"))).collect()} == {1: 0.5, 2: 0.0}
