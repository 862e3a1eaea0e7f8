import pytest
from pyspark.sql import functions as F

from wordweft.functions import text
from wordweft.sources import tables
from wordweft.streaming import files

ROWS = [
    {"name": "pairs", "description": "d", "configs": ["graded", "triples"], "default_config": "graded", "splits": ["train"]},
    {"name": "plain", "description": "d", "configs": None, "default_config": None, "splits": ["train"]},
]


def test_registry(spark, tmp_path):
    registry = tables.Registry(str(tmp_path), ROWS)
    assert [r.name for r in registry.frame(spark).collect()] == ["pairs", "plain"]
    spark.range(3).write.parquet(str(tmp_path / "plain/train"))
    assert registry.load(spark, "plain", split="train").count() == 3
    assert registry.path(" own/pairs ", split="train").endswith("pairs/graded/train")
    for call in (lambda: registry.info("none"), lambda: registry.path("pairs", "x"), lambda: registry.path("plain", "x")):
        with pytest.raises(ValueError):
            call()


def test_model_files(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"classes": ["yor", "eng"], "intercept": [0.5, 0.0],\n "features": {"ola": {"idf": 1.0, "weights": [2.0, -2.0]}}}')
    model, meta = tables.read_linear_model(spark, str(path))
    assert [(r.term, r.idf, r.weights) for r in model.collect()] == [("ola", 1.0, [2.0, -2.0])]
    assert {(r["class"], r.idx, r.intercept) for r in meta.collect()} == {("yor", 0, 0.5), ("eng", 1, 0.0)}
    assert tables.resolve_model("m.json", ["/none", str(tmp_path)]) == str(path)
    with pytest.raises(FileNotFoundError):
        tables.resolve_model("x.json", [str(tmp_path)])


def test_model_tables_in_json(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    candidates, unigrams, moves = tables.read_viterbi_model(spark, put("v.json", '{"candidates": {"oko": ["ọkọ", "oko"]}, "unigrams": {"oko": -1.5}, "transitions": {"a oko": -0.5}}'))
    assert [tuple(r) for r in candidates.collect()] == [("oko", 0, "ọkọ"), ("oko", 1, "oko")] and unigrams.first().logp == -1.5 and tuple(moves.first()) == ("a", "oko", -0.5)
    assert tables.read_viterbi_model(spark, str(tmp_path / "no.json"), custom=False)[0].count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_viterbi_model(spark, str(tmp_path / "no.json"))
    lookup = tables.read_lookup_model(spark, put("k.json", '{"db_5": {"__o__": "ọ"}, "db_3": {}, "db_1": {"e": "ẹ"}}'))
    assert {tuple(r) for r in lookup.collect()} == {(5, "__o__", "ọ"), (1, "e", "ẹ")}
    entry = '{"yor": {"oko": {"ọkọ": 3, "oko": 4}}}'
    for text, gated in (('{"density_gated": true, "table": %s}' % entry, True), (entry, False)):
        table, was = tables.read_lexicon(spark, put("l.json", text))
        assert was == gated and {tuple(r) for r in table.collect()} == {("yor", "oko", "ọkọ", 3), ("yor", "oko", "oko", 4)}
    assert tables.read_temperature(spark, put("c.json", '{"shared": 1.3}')) == 1.3 and tables.read_temperature(spark, None) == 1.0 and tables.read_temperature(spark, put("d.json", "{}")) == 1.0
    texts = spark.createDataFrame([(1, "Ola")], "doc_id long, text string")
    model = put("m5.json", '{"classes": ["yor", "eng"], "intercept": [0.0, 0.5], "features": {"ola": {"idf": 1.0, "weights": [2.0, -2.0]}}}')
    from wordweft.operators.language_id import detect_language

    assert detect_language(spark, texts, str(tmp_path / "none"), model).first().lang == "yor"
    with pytest.raises(FileNotFoundError):
        detect_language(spark, texts, str(tmp_path / "none"))


def test_files_by_name(tmp_path, monkeypatch):
    for name in ("bpe-50k-yo.json", "own.json", "sw-50k/tokenizer.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    (tmp_path / "empty.json").write_text("")
    for lang, wanted in ((" Yoruba ", "bpe-50k-yo.json"), ("own", "own.json"), ("SW-50k", "sw-50k/tokenizer.json")):
        assert tables.tokenizer_file(lang, [str(tmp_path)]) == str(tmp_path / wanted)
    assert tables.tokenizer_file("x", [], str(tmp_path / "own")) == str(tmp_path / "own.json")
    for call in (lambda: tables.tokenizer_file("empty", [str(tmp_path)]), lambda: tables.tokenizer_file("x", [], str(tmp_path / "gone"))):
        with pytest.raises(FileNotFoundError):
            call()
    monkeypatch.setenv("WORDWEFT_MODELS_DIR", "/models")
    assert tables.model_folders("/package", "/cache", "a/b") == ["/models", "/cache/a--b", "/cache", "/package"]
    assert tables.Registry("r").names()[-1] == "marked-sentences"
    with pytest.raises(ValueError):
        tables.Registry("r").path("marked-sentences")


def test_wav_round_trip(spark):
    df = spark.createDataFrame([(8000, [0.0, 0.5, -0.5])], "rate int, samples array<double>")
    back = df.select(tables.wav_samples(tables.wav_bytes(F.col("rate"), F.col("samples"))).alias("w")).first().w
    assert back.rate == 8000 and back.samples == [0.0, 0.5, -0.5]
    assert spark.createDataFrame([(bytearray(b"x"),)], "c binary").select(tables.wav_samples(F.col("c")).alias("w")).first().w.rate is None


def test_stateless_steps_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<b>x</b> {i}  y") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    step = lambda df: df.select("doc_id", text.clean_text(F.col("text")).alias("t"))
    files.apply(files.read(spark, str(tmp_path / "in"), docs, 1), step, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, step(docs).collect()))
