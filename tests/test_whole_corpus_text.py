"""Queries that once grew by characters or words, against plain definitions on odd texts."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from wordweft.functions import unicode
from wordweft.operators import labels, lexicon, subwords
from wordweft.plans import catalog


def _odd(n, seed=3):
    r = random.Random(seed)
    some = ["a", " ", "  ", "\n", "\x1c", "́", "é", "'s", "<|endoftext|>", "12", "İ", "ß", "Σ", "\x85", "\xa0", "　", "foo", " bar", "Z", "=", "日", "ﬁ", "\t", "😀", " ola"]
    return [None, "", *("".join(r.choice(some) for _ in range(r.randrange(1, 40))) for _ in range(n))]


def test_tokens_by_pieces_are_the_librarys(spark):
    """Counting holds no text's tokens, and cuts nothing where a vocabulary's word goes on."""
    texts = _odd(600)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
    cols = [c for k, p in enumerate(paths) for c in (subwords.count(F.col("text"), p).alias(f"n{k}"), subwords.round_trip(F.col("text"), p).alias(f"r{k}"), subwords.encode(F.col("text"), p).alias(f"ids{k}"))]
    rows = df.select("i", *cols).collect()
    assert len(rows) == len(texts)
    for k, p in enumerate(paths):
        t = subwords._tokenizer(p)
        for r in rows:
            ids = t.encode(texts[r.i] or "").ids
            assert r[f"n{k}"] == r[f"r{k}"].n_tokens == len(ids) and r[f"ids{k}"] == ids
            if k == 0:
                assert r.r0.same == (None if texts[r.i] is None else t.decode(ids) == texts[r.i])


def _graphemes_table(spark, tmp_path):
    texts = [*_odd(60), "à" * 40, "ñ" * 30, "é̂" * 9, "a" * 50, "ç" * 25, *["año día è"] * 9]
    rows = [(i, t, ("fr", "es", "de", None)[i % 4]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_graphemes_are_counted_once(spark, tmp_path):
    """Label tables read what was counted, not the texts; counts are those of the graphemes of every text."""
    from collections import Counter

    rows = _graphemes_table(spark, tmp_path)
    counted = labels.count_graphemes(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = Counter((lang, g) for _, t, lang in rows for g in unicode.graphemes(t or ""))
    assert {(r.lang, r.g): r.n for r in counted.collect()} == want
    space = labels.build(counted)
    for part in space:
        assert "documents.parquet" not in " ".join(part.inputFiles())


def test_labels_of_whole_texts(spark, tmp_path):
    """Arrays of ids are what the rows of graphemes give."""
    rows = _graphemes_table(spark, tmp_path)
    space = catalog._space(spark, str(tmp_path))
    docs = catalog._alphabetic(spark, str(tmp_path))
    by_row = lambda df, *cs: {k: [v for _, v in sorted(x)] for k, x in _grouped(df, cs).items()}
    ids = by_row(labels.encode(labels.placed(docs), space), "id")
    assert {r.doc_id: [(x,) for x in r.ids] for r in docs.select("doc_id", labels.encode_texts(F.col("text"), space).alias("ids")).collect() if r.ids} == ids
    assert {r.doc_id: (r.n, r.unknown, r.checksum) for r in catalog.labels_encode(spark, str(tmp_path)).collect()} == {k: (len(v), sum(x == (labels.UNKNOWN,) for x in v), sum(x * (i % 7 + 1) for i, (x,) in enumerate(v))) for k, v in ids.items()}
    gold = by_row(labels.gold(labels.placed(docs), space), "shape_id", "tone_id")
    assert {r.doc_id: (r.n, r.shapes, r.tones) for r in catalog.labels_gold(spark, str(tmp_path)).collect()} == {k: (len(v), sum(a > 0 for a, _ in v), sum(b > 0 for _, b in v)) for k, v in gold.items()}
    assert any(a or b for v in gold.values() for a, b in v)


def _grouped(df, columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.pos, tuple(r[c] for c in columns)))
    return out


def test_error_rates_of_counted_places(spark):
    g = "struct<g:string,shape:array<string>,tone:string>"
    rows = [(("é", [], "ACUTE"), ("e", [], ""), True), (("e", [], ""), ("e", [], ""), True), (("!", [], ""), ("?", [], ""), False)]
    counted = spark.createDataFrame([(*rows[0], 3), (*rows[1], 1), (*rows[2], 5)], f"gold {g}, restored {g}, eligible boolean, n long")
    each = spark.createDataFrame([rows[0]] * 3 + [rows[1]] + [rows[2]] * 5, f"gold {g}, restored {g}, eligible boolean")
    assert lexicon.error_rates(counted).collect() == lexicon.error_rates(each).collect()
    assert lexicon.error_rates(counted).first().der == 0.75


def test_one_pass_marks_are_the_plain_ones(spark):
    """Stripping, round trips and foreign letters by tables of characters, against one grapheme at a time."""
    texts = _odd(300)
    t = F.col("text")
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    cols = [unicode.same_letters(t, F.concat(t, F.lit("é"))).alias("more"), unicode.same_letters(t, unicode.strip_column(t)).alias("kept"), unicode.recomposed_column(t, "spa").alias("again"), unicode.roundtrip_column(t, "fra").alias("back"), unicode.foreign_count(t, "spa").alias("foreign")]
    old = unicode.compose_column(unicode.factorize_column(t, "spa")).alias("old")
    for r in df.select("i", *cols, old, *(unicode.strip_column(t, how).alias(f"s_{how}") for how in ("diacritics", "marks", "all", "tones"))).collect():
        x = texts[r.i]
        if x is None:
            assert not any(v is not None for v in r[1:])
            continue
        assert not r.more and r.kept and r.again == r.old
        assert r.back == unicode.roundtrip_ok(x, "fra") and r.foreign == sum(not unicode.in_inventory(g, "spa") for g in unicode.graphemes(x))
        assert (r.s_diacritics, r.s_marks, r.s_all, r.s_tones) == tuple(f(x) for f in (unicode.strip_diacritics, unicode.strip_marks, unicode.strip_all, unicode.remove_tones))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_restoring_without_tables_stays_in_the_row(spark):
    from wordweft.operators import restoration, restorer

    empty = [spark.createDataFrame([], s) for s in ("plain string, idx int, form string", "form string, logp double", "prev string, cur string, logp double")]
    docs = spark.createDataFrame(list(enumerate([*_odd(200), "Ola eBay. KO"])), "doc_id long, text string")
    found = restorer.Restorer("yor-viterbi").restore(docs)
    assert _shuffles(found) == 0
    assert dict(found.collect()) == dict(restoration.viterbi_decode(docs, *empty).collect())


def test_corrections_of_long_texts(spark):
    """Texts of many words, repeated words, free-standing punctuation and no prediction; a prediction may be a column or a table."""
    from wordweft.operators import restoration

    long = "Oko ile oko, OKO ! " * 4000
    docs = spark.createDataFrame([(1, long), (2, "ile oko"), (3, ""), (4, None), (5, "a\x1cb oko")], "doc_id long, text string")
    candidates = spark.createDataFrame([("oko", ["ọkọ"]), ("ile", ["ilé", "ile"])], "plain string, forms array<string>")
    found = restoration.correct_words(docs, F.col("text"), candidates)
    wanted, guesses = iter([]), long.split()
    fixed = ["Ọkọ" if g in ("Oko", "OKO") else "ọkọ" if g == "oko" else g for g in guesses]
    wanted = iter(fixed)
    assert dict(found.collect()) == {1: restoration._WORD.sub(lambda m: next(wanted, m[0]), long), 2: "ile ọkọ", 3: "", 4: None, 5: "a\x1cb ọkọ"}
    table = docs.where("doc_id <> 2").select("doc_id", F.col("text").alias("predicted"))
    assert dict(restoration.correct_words(docs, table, candidates).collect())[2] == "ile oko"
