from pyspark.sql import functions as F

from wordweft.functions import prompts, spoken, text, vectors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()[0]


def test_mask_pii(spark):
    t = F.col("t")
    assert one(spark, text.mask_pii(t), "Call me on 08012345678 or email me@example.com") == "Call me on [PHONE] or email [EMAIL]"
    masked = one(spark, text.mask_pii(t), "My card is 4111111111111111 and SSN is 123-45-6789")
    assert "[CREDIT_CARD]" in masked and "[SSN]" in masked
    assert one(spark, text.mask_pii(t), "+1-800-555-0199") == "+[PHONE]"
    assert one(spark, text.mask_pii(t), None) is None
    assert one(spark, text.pii_findings(t), "a@b.co 123456789").asDict() == {"email": 1, "ssn": 1, "credit_card": 0, "phone": 0}


def test_clean_text(spark):
    t = F.col("t")
    assert one(spark, text.clean_text(t), "  <b>Hello</b>   world  visit https://example.com/page now  ") == "Hello world visit now"
    assert one(spark, text.clean_text(t, remove_urls=False), "<i>keep urls</i> http://example.com") == "keep urls http://example.com"
    assert one(spark, text.clean_text(t), "a\x1c　b\x85") == "a b"
    assert one(spark, text.clean_text(t), "") == ""


def test_spoken_forms(spark):
    t = F.col("t")
    assert one(spark, spoken.expand_abbreviations(t, "yo"), "Mr. Ojo and dr. Tunde") == "Míṣìtà Ojo and Dọ́kítà Tunde"
    assert one(spark, spoken.expand_numbers(t, "yo"), "Call 911") == "Call ẹ́sàn-án ọ̀kan ọ̀kan"
    assert one(spark, spoken.speak(t, "ig"), "Mr. Obi has 2 cars") == "Mista Obi has abụo cars"
    assert one(spark, spoken.speak(t, "de"), "  2  ") == "  2  "
    assert one(spark, spoken.speak(t, "ig"), None) == ""
    assert one(spark, spoken.speak_naija(t), "Abeg u dey smh 2moro, bro.") == "Abeg you they shake my head tomorrow, broda."
    assert one(spark, spoken.normalize_informal(t), "$1 \\d u") == "$1 \\the you"


def test_values_hold_no_keys_at_word_edges():
    """The SQL twins replace key after key, which equals one pass only if no value holds another key."""
    import re

    for pairs in (*spoken.ABBREVIATIONS.values(), spoken.INFORMAL):
        for key in pairs:
            for value in pairs.values():
                if value.lower() != key:
                    assert not re.search(rf"(?<!\w){re.escape(key)}(?!\w)", value, re.I), (key, value)


def test_stopwords(spark):
    kept = text.filter_stopwords(F.col("t"), spoken.stopwords("yo"))
    assert one(spark, kept, ["bawo", "ni", "Ade", "ṣe", "dara", "?"], "array<string>") == ["Ade", "dara", "?"]
    assert spoken.stopwords("eng") == []


def test_sentences_and_chunks(spark):
    t = F.col("t")
    assert one(spark, text.split_sentences(t), "One. Two! Three?") == ["One.", "Two!", "Three?"]
    assert one(spark, text.split_sentences(t), "  \t ") == []
    assert len(one(spark, text.chunk_text(t, 300), "a " + "x" * 500 + " b")) == 3
    assert one(spark, text.chunk_text(t), "") == []
    words = "one two  three four" * 40
    assert " ".join(one(spark, text.chunk_text(t, 50), words)) == words


def test_currency(spark):
    for value, wanted in (("1500000", "₦1,500,000.00"), ("0.125", "₦0.12"), ("not-a-number", "₦not-a-number")):
        assert one(spark, text.format_currency(F.col("t"), "₦"), value) == wanted


def test_bits_round_trip(spark):
    assert one(spark, text.text_of_bits(text.bits_of_text(F.col("t"), 96)), "héllo") == "héllo"
    assert one(spark, text.bits_of_text(F.col("t"), 16), "A") == [0, 1, 0, 0, 0, 0, 0, 1] + [0] * 8


def test_codes_and_prompts(spark):
    t = F.col("t")
    for code, tag in (("YO", "yor"), ("ara_nocase", "ara-nocase"), ("<yor>", "yor"), (None, "auto"), ("de", None)):
        assert one(spark, prompts.resolve_tag(t), code) == tag
    for code, lang in (("yo", "yor"), ("pt-BR", "por"), ("de", None)):
        assert one(spark, prompts.normalize_lang(t), code) == lang
    assert one(spark, prompts.build_hint(t), {"ogun": "twenty", "ranh": "free"}, "map<string,string>") == "[g: ogun=twenty | ranh=free]"
    assert one(spark, prompts.build_hint(t), {"a|": "b"}, "map<string,string>") is None
    assert one(spark, prompts.parse_questions(t), 'x {"questions": ["a?", " b? "]} y') == ["a?", "b?"]
    assert one(spark, prompts.parse_questions(t), '{"questions": ["what is it?", "who') == ["what is it?"]
    assert one(spark, prompts.parse_questions(t), "garbage") == []
    assert one(spark, prompts.question_messages(t), " ") is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    assert round(one(spark, vectors.pair_score(F.col("t")), [0.0, 2.0], "array<double>"), 4) == 0.8808
