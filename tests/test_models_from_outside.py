"""Generation, speech and images around fake models."""

import struct
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordweft.operators import generation, images, restorer, scoring


def test_retries_only_while_busy():
    waited, calls = [], iter([generation.Busy(), generation.Busy(), "done"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert generation.with_retries(call, 3, 5.0, waited.append) == "done" and waited == [5.0, 10.0]
    with pytest.raises(generation.Busy):
        generation.with_retries(lambda: (_ for _ in ()).throw(generation.Busy()), 2, 0, waited.append)
    with pytest.raises(KeyError):
        generation.with_retries(lambda: {}["x"], 3, 0, waited.append)


def test_parameters():
    assert generation.parameters(True, repetition_penalty=1.2)["frequency_penalty"] == pytest.approx(0.2) and "repetition_penalty" not in generation.parameters(True)
    assert generation.parameters(False, top_p=0.5)["top_p"] == 0.5 and generation.parameters(True, repetition_penalty=0.5)["frequency_penalty"] == 0


class Echo:
    def complete(self, messages, params):
        said = messages[-1]["content"]
        return '{"questions": ["%s?", "Why so?"]}' % said.split()[-1] if "Passage:" in said else f"{messages[0]['role']}:{said}:{params['temperature']}"

    def stream(self, messages, params):
        yield from ("a", "", "b")


def test_generation_and_questions(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.answer for r in generation.generate(docs, Echo, "Be brief.", temperature=0.1).collect()} == {1: "system:Hello there:0.1", 2: None}
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        asked = {r.doc_id: r for r in generation.questions(docs, Echo, 2, "amh").collect()}
    assert asked[1].questions == ["there?", "Why so?"] and asked[1].warnings == ["short passage"] and asked[2].questions is None and any("Amharic" in str(w.message) for w in said)
    assert list(generation.stream(Echo(), [])) == ["a", "b"]


def test_speech(spark):
    from wordweft.operators import speech

    docs = spark.createDataFrame([(1, "Mr. Obi has 2 cars"), (2, None)], "doc_id long, text string")
    plain = {r.doc_id: r for r in speech.synthesize(docs, "ig", restorer.Restorer().restore).collect()}
    assert plain[1].normalized_text == "Mista Obi has abụo cars" and plain[1].audio is None and plain[1].status == speech.NO_MODEL and plain[2].diacritized_text == ""
    with pytest.warns(speech.ExperimentalWarning):

        class Acoustic(speech.AcousticModel):
            def load_weights(self, path): ...
            def forward(self, text):
                return np.full(3, len(text))

        class Loud(speech.Vocoder):
            def load_weights(self, path): ...
            def generate(self, spectrogram):
                return spectrogram * 2

    made = speech.synthesize(docs.where("doc_id = 1"), "ig", restorer.Restorer().restore, Acoustic, Loud).first()
    assert made.audio == [2.0 * len(made.diacritized_text)] * 3 and made.status == speech.DONE


def png(picture, filters):
    """An 8-bit file of an array, its rows filtered by turns."""
    h, w, bands = picture.shape
    rows, above = b"", np.zeros(w * bands, int)
    for y in range(h):
        line, how = picture[y].ravel().astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(bands, int), line[:-bands]])
        corner = np.concatenate([np.zeros(bands, int), above[:-bands]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows += bytes([how]) + ((line - [0, left, above, (left + above) // 2, near][how]) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark):
    rng = np.random.default_rng(1)
    files = []
    for bands in (1, 2, 3, 4):
        picture = rng.integers(0, 256, (7, 5, bands)).astype(np.uint8)
        raw = png(picture, [0, 1, 2, 3, 4])
        want = picture[:, :, :3] if bands > 2 else np.repeat(picture[:, :, :1], 3, 2)
        assert (images.rgb_of(raw) == want).all()
        files.append(raw)
    ppm = rng.integers(0, 256, (2, 3, 3)).astype(np.uint8)
    assert (images.rgb_of(b"P6 # a note\n3 2\n255\n" + ppm.tobytes()) == ppm).all()
    df = spark.createDataFrame([(i, f) for i, f in enumerate([*files, b"no image", None])], "k long, content binary")
    found = df.select("k", images.rgb_column(F.col("content")).alias("p")).select("k", "p.*")
    assert [r.height for r in sorted(found.collect())] == [7, 7, 7, 7, None, None]
    twice = lambda: lambda p, h, w: images.resized(p, h, w)
    assert {(r.height, r.width) for r in images.upscale(found, twice, "4x").collect()} == {(28, 20), (None, None)}
    assert {(r.height, r.width) for r in images.upscale(found, twice, "max", (9, 8)).collect()} == {(8, 9), (None, None)}
    for size, target in (("8x", None), ("max", None)):
        with pytest.raises(ValueError):
            images.upscale(found, twice, size, target)
    assert {r.height for r in images.denoise(found, lambda: lambda p: p * 2).collect()} == {128, None}

    def hider():
        def run(p, bits):
            out = p.copy()
            out[0, : len(bits), 0] = bits
            return out

        return run

    held = images.hide(found.where("height is not null"), F.concat(F.lit("id-"), "k"), hider, 96)
    assert {r.k: r.message for r in images.reveal(held, lambda: lambda p: p[0, :96, 0]).collect()} == {i: f"id-{i}" for i in range(4)}


def test_named_outputs():
    class Named:
        def __init__(self, name):
            self.name = name

    class Session:
        def __init__(self, ins, outs):
            self.ins, self.outs = ins, outs

        def get_inputs(self):
            return [Named(x) for x in self.ins]

        def get_outputs(self):
            return [Named(x) for x in self.outs]

        def run(self, names, feed):
            assert set(feed) == set(self.ins)
            return list(range(len(self.outs)))

    new, old = Session(["ids", "lang_known"], ["shape", "lid_logits"]), Session(["ids"], ["shape", "lid_logits"])
    assert scoring.by_name(new, {"ids": 1, "lang_known": 2, "attn": 3}) == {"shape": 0, "lid_logits": 1}
    assert scoring.has_language_head(new) and not scoring.has_language_head(old)


def test_classifier_and_embedder(spark):
    class Count:
        def predict(self, batch):
            return [[float(len(x or "")), 1.0] for x in batch]

    df = spark.createDataFrame([(1, "a\n b"), (2, None)], "k long, t string")
    rows = {r.k: r for r in df.select("k", scoring.classifier(Count, F.col("t")).alias("l"), scoring.embed(Count, F.col("t")).alias("e")).collect()}
    assert rows[1].l == [3.0, 1.0] and rows[2].l == [0.0, 1.0] and rows[1].e == [4.0, 1.0] and rows[2].e is None
