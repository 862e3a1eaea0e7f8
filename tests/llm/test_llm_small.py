"""Each operator against brute force, exact round trips or held-out accuracy, and its edge cases: nulls, empty tables, ties, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordweft.llm import adaptive_rules, bilinear_lm, bpe, chat_format, dart_minhash, length_buckets, progressive_jpeg, rule_ensemble, secret_scan, suffix_dedup

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, **columns):
    rows = [(i, t, *(v[i] for v in columns.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in columns))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(60, 300)) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in t.split()) for t in base[:10]]
    passage = prose(rng, 150)
    shared = [f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}" for _ in range(5)]
    return [*base, *near, *shared, base[0], base[0], None, "", " \n", "a b", "a b", "é" * 700, "ab" * 600, 'token = "0123456789abcdef0123"', prose(rng, 5000)]


# ---------------------------------------------------------------- 1


def test_rule_ensemble_learns_and_scores_everything(spark, texts):
    rng = random.Random(1)
    good = [prose(rng, 80) for _ in range(150)]
    bad = [" ".join(w + "***" for w in prose(rng, 80).split()) for _ in range(60)]
    docs = documents(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(0, None), (1, 7)], "doc_id long, quality int")
    ensemble = rule_ensemble.learn(docs, labels, ~rule_ensemble.held_out())
    got = {r.doc_id: r for r in rule_ensemble.classify(docs, ensemble).collect()}
    held = [i for i in range(210) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == int(i < 150) for i in held]) == 1
    assert len(got) == 212 and all(0 <= r.score <= 1 for r in got.values())
    flat = rule_ensemble.learn(docs, labels.where("false"), ~rule_ensemble.held_out())
    assert {r.score for r in rule_ensemble.classify(docs, flat).collect()} == {0.5}
    assert rule_ensemble.classify(docs.where("false"), ensemble).count() == 0


def statistics_by_hand(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = t.split("\n")
    n = max(1, len(w))
    upper = {chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7}
    count = lambda chars: sum(c in chars for c in t)
    return {
        "words": len(w),
        "chars_a_word": (len(t) - count(" \t\n\x0b\f\r")) / n,
        "symbols_a_word": count("#*$%&<>@\\^~{}[]_+=") / n,
        "bars_a_word": count("|") / n,
        "shouts_a_word": count("!?") / n,
        "stops_a_word": count(".,;:") / n,
        "digits_a_char": count("0123456789") / max(1, len(t)),
        "upper_a_char": count(upper) / max(1, len(t)),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
        "repeated_words": 1 - len(set(w)) / n,
        "stutter": sum(x == y for x, y in zip(w, w[1:])) / n,
    }


def test_statistics_and_compiled_rules_by_brute_force(spark, texts):
    rng = random.Random(12)
    own = [*texts, "A|B ! ? 12 a a a\n\nÀÖ×ß #x\n\n", *("".join(rng.choice("ab A1.!|#\n\t é") for _ in range(rng.randrange(200))) for _ in range(120))]
    docs = documents(spark, own, words=["x"] * len(own))
    got = {r.doc_id: r["_stats"].asDict() for r in rule_ensemble.with_statistics(docs).collect()}
    for i, t in enumerate(own):
        wanted = statistics_by_hand(t)
        assert got[i].keys() == wanted.keys() and all(abs(got[i][k] - v) < 1e-12 for k, v in wanted.items())
    x = {k: np.array([got[i][k] for i in range(len(own))]) for k in got[0]}
    y = (x["digits_a_char"] + 0.3 * x["stutter"] > 0.08).astype(float)
    rows = spark.createDataFrame([(got[i], int(v)) for i, v in enumerate(y)], "_stats struct<" + ",".join(f"{k}:double" for k in got[0]) + ">, quality int")
    ensemble = rule_ensemble.fit(rows, "quality", 10_000)
    assert ensemble.terms and any(len(rule.conditions) > 1 for rule, _ in ensemble.terms)
    wanted = np.full(len(own), ensemble.intercept)
    for rule, weight in ensemble.terms:
        wanted += weight * np.array([all(x[n][i] > b if above else x[n][i] <= b for n, above, b in rule.conditions) for i in range(len(own))])
    scored = {r.doc_id: r.score for r in rule_ensemble.classify(docs, ensemble).collect()}
    assert all(abs(scored[i] - 1 / (1 + np.exp(-wanted[i]))) < 1e-9 for i in range(len(own)))
    assert np.mean([(scored[i] >= 0.5) == bool(y[i]) for i in range(len(own))]) > 0.97


# ---------------------------------------------------------------- 2


def test_adaptive_rules_base(spark, texts):
    rng = random.Random(2)
    extra = ["x y z " * 30, "line one\nline one\n \nline two\nline one", "a #* b" * 30, " ".join(rng.choice("abc") for _ in range(300))]
    own = [*texts, *extra]
    docs = documents(spark, own, lang=["en"] * len(own), source=[None if i % 2 else "s" for i in range(len(own))], n=["?"] * len(own))
    for r in adaptive_rules.judge(docs).collect():
        t = own[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.kept or not r.base_failed)
    assert adaptive_rules.judge(docs.where("false")).count() == 0


def test_thresholds_follow_the_group(spark):
    rng = random.Random(22)

    def with_repeats(n):  # 200 words, n lines of 10 said again
        lines = [prose(rng, 10) for _ in range(20 - n)]
        return "\n".join([*lines, *lines[:n]])

    plain, noisy = [with_repeats(0) for _ in range(600)], [with_repeats(rng.randrange(6)) for _ in range(600)]
    short, long = [prose(rng, 100) for _ in range(600)], [" ".join(w * 4 for w in prose(rng, 100).split()) for _ in range(600)]
    groups = {"plain": plain, "noisy": noisy, "short": short, "long": long}
    rows = [(t, g) for g, texts in groups.items() for t in texts]
    probes = [(with_repeats(4), "plain"), (with_repeats(4), "noisy"), (long[0], "short"), (long[0], "long"), (short[0], "long")]
    docs = spark.createDataFrame([(i, t, g, "s") for i, (t, g) in enumerate([*probes, *rows])], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in adaptive_rules.judge(docs).collect()}
    assert [out[i].kept for i in range(5)] == [False, True, False, True, False]
    assert out[0].failed == ["dup_line_share", "repeat_word_share"] and out[2].failed == out[4].failed == ["chars_per_word"]
    # Sketches of so few rows are exact: fences from the quantiles themselves.
    stats = adaptive_rules.text_stats(docs).withColumn("base_failed", adaptive_rules.base_failed()).where("not base_failed").toPandas()
    quantile = lambda x, q: sorted(x)[max(0, int(np.ceil(q * len(x))) - 1)]
    for limits in adaptive_rules.group_fences(spark.createDataFrame(stats)).collect():
        own = stats[stats.lang == limits.lang]
        for f in adaptive_rules.FENCES:
            q = {}
            for level in f.levels:
                whole, mine = quantile(stats[f.stat], level), quantile(own[f.stat], level)
                wider = (mine * len(own) + whole * 200) / (len(own) + 200)
                q[level] = (mine * len(own) + wider * 200) / (len(own) + 200)
            assert abs(limits[f"{f.stat}_high"] - (q[f.level] + (q[f.level] - q[0.5]) * f.reach + f.grain)) < 0.02 * (1 + f.reach)


# ---------------------------------------------------------------- 3


def test_jpeg_round_trip_and_foreign_features(spark, texts):
    docs = documents(spark, texts, media=["x"] * len(texts))
    rows = {r.doc_id: r for r in progressive_jpeg.store_texts(docs, with_media=True).collect()}
    assert len(rows) == len(texts) and rows[texts.index("")].feature == rows[texts.index(None)].feature
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    media = spark.createDataFrame([(1, rows[0].media), (2, None)], "k long, media binary")
    out = {r.k: r for r in progressive_jpeg.decode_media(media, "k").collect()}
    assert len(out[1].rgb) == out[1].width * out[1].height * 3 and out[2].rgb is None


def test_jpeg_inverse_transform_is_a_cosine_transform():
    im = progressive_jpeg.parse(progressive_jpeg.write([bytes([128] * 64)])[0])
    coef = np.zeros((6, 64), dtype=np.int16)
    coef[:, 0] = 80
    for c, start in zip(im.comps, (0, 4, 5), strict=True):
        c.start = start
    coef[4:] = 0
    assert set(progressive_jpeg.to_rgb(im, coef).ravel()) == {138}  # 128 + 80 / 8


# ---------------------------------------------------------------- 4


def test_secret_spans(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    own = ["é secret=token: abcdefghijklmnop", 'API_KEY = "abcdefghijkl" x', "AKIAABCDEFGHIJKLMN AKIA12", "f" * 15 + " " + "0" * 16, f"see {key} here", "internationalisation-of-documents", None, ""]
    docs = documents(spark, own + [prose(rng, 50)] * 20)
    got = {r.doc_id: r for r in secret_scan.scan(docs, ["doc_id", "text"]).withColumn("w", secret_scan.written(F.col("spans"))).withColumn("red", secret_scan.redact(F.col("text"), F.col("spans"))).collect()}
    assert [got[i].w for i in range(4)] == ["", "assign:0:23", "access:0:18", "hex:16:32"]
    assert got[4].w == f"random:4:{4 + len(key)}" and got[4].red == "see [SECRET] here"
    assert [got[i].w for i in range(5, 8)] == ["", "", ""] and got[6].red is None and got[1].red == '[SECRET]" x'
    assert secret_scan.scan(docs.where("false"), ["doc_id"]).count() == 0


def test_base_spans_equal_regular_expressions(spark):
    rng = random.Random(41)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", '"', "'", " ", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x.y-z_", "é", "ſecret", "\n", "\t", "K"]
    own = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    got = {r.doc_id: r for r in secret_scan.scan(documents(spark, own), ["doc_id"]).withColumn("w", secret_scan.written(F.col("base"))).collect()}
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for i, t in enumerate(own):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got[i].w == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_battery_finds_random_tokens_of_every_encoding_and_leaves_text(spark):
    rng = random.Random(42)
    alphabets = {"HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "lower": "abcdefghijklmnopqrstuvwxyz"}
    random_ones = [(name, n, "".join(rng.choice(a) for _ in range(n))) for name, a in alphabets.items() for n in (20, 32, 64) for _ in range(40)]
    words = re.findall(r"[a-z]{3,}", " ".join(x.__doc__ or "" for x in (random, re, hashlib, np, Counter)))
    named = ["_".join(rng.choice(words) for _ in range(6)) for _ in range(200)] + ["".join(rng.choice(words) for _ in range(7)) for _ in range(200)] + ["".join(rng.choice(words).capitalize() for _ in range(6)) for _ in range(200)] + ["2024" * 6, "0" * 30, "-" * 40, "=" * 25]
    named = [x for x in named if len(x) >= 20]
    docs = documents(spark, [f"see {t} here" for _, _, t in random_ones] + [f"see {t} here" for t in named])
    found = {r.doc_id: "random:" in r.w for r in secret_scan.scan(docs, ["doc_id"]).withColumn("w", secret_scan.written(F.col("spans"))).collect()}
    rate = lambda name, n: np.mean([found[i] for i, (a, m, _) in enumerate(random_ones) if (a, m) == (name, n)])
    assert rate("base64", 32) > 0.9 and all(rate(name, 64) > 0.7 for name in alphabets)
    assert np.mean([found[i + len(random_ones)] for i in range(len(named))]) <= 0.01
    with pytest.raises(ValueError):
        secret_scan.scan(docs.withColumn("base", F.lit(1)), ["doc_id", "base"])


# ---------------------------------------------------------------- 5


def test_bpe_equals_the_library(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(6)
    odd = ["<|endoftext|> it's I'LL 12½²", "ΣΑΣ İ ß \x1c\x85", "a" * 500 + "the" * 200, *("".join(chr(rng.randrange(32, 0x3000)) for _ in range(40)) for _ in range(200))]
    for t in [t for t in texts if t] + odd:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    docs = documents(spark, texts)
    ids = bpe.decode_column(bpe.encode_column(docs, path), path)
    assert {r.doc_id: len(r.ids) for r in ids.collect()} == {r.doc_id: r.n_tokens for r in bpe.round_trip_digests(docs, path).collect()}


# ---------------------------------------------------------------- 6


def test_chat_format_reads_back(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b\\\\", "[\\INST]", "<<SYS>>\n", "", None, "<|role|>x<|text|>"]
    rows = [(c, i, r, said[(c + i) % len(said)], "x") for c in range(12) for i, r in enumerate(["system", "user", "assistant", "tool", None][: 2 + c % 4])]
    rows += [(90, 0, "user", "hi", "x"), (90, 1, "assistant", "yo", "x"), (91, 0, "assistant", "yo", "x"), (None, 0, "user", "q", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat_format.format_conversations(turns).withColumn("read", chat_format.read_turns(F.col("formatted"))).collect()}
    for c, r in out.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: x[1])
        assert [(t.role, t.text) for t in r.read] == [(x[2] or "", x[3] or "") for x in mine]
        learnt = "".join(re.sub(r"\\(\\?)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert learnt == "".join(x[3] or "" for x in mine if x[2] == "assistant")
    assert out[90].valid and not out[91].valid and out[91].error_at == 0
    assert chat_format.format_conversations(turns.where("false")).count() == 0


def test_states_not_roles_emit_segments(spark):
    # One role, two states: a greeting is not learnt, an answer is.
    steps = {("start", "assistant"): "greeting", ("start", "user"): "user", ("greeting", "user"): "user", ("user", "assistant"): "answer", ("answer", "user"): "user"}
    template = chat_format.Template(opens={"user": "[U]", "assistant": "[A]"}, close="[/]", loss=frozenset({"answer"}), steps=steps, accepts=frozenset({"answer"}))
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "user", "again"), (2, 2, "assistant", "a2"), (3, 0, "tool", "x"), (3, 1, "assistant", "late")]
    out = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), template).collect()}
    assert [[s.text for s in out[c].segments if s.loss] for c in (1, 2, 3)] == [["a"], ["a2"], []]
    assert [(out[c].valid, out[c].error_at) for c in (1, 2, 3)] == [(True, None), (False, 1), (False, 0)]
    assert out[1].formatted == "[A]hello[/][U]q[/][A]a[/]"


def test_the_machine_is_in_the_query(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x")], "conv_id long, turn long, role string, text string, state string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    plan = chat_format.op6_chat_format(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "user>assistant" in plan


# ---------------------------------------------------------------- 7


def classes_by_brute_force(texts, names=None):
    """Least name of each text's component; links are weighted similarities of 0.8 or more."""

    def shingles(t):
        w = (t or "").encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    names = list(range(len(texts))) if names is None else names
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = (sets[i] & sets[j]).total()
            if (texts[i] or "") == (texts[j] or "") or n and n >= 0.8 * (sets[i].total() + sets[j].total() - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, name in enumerate(names):
        least[find(i)] = min(least.get(find(i), name), name)
    return [least[find(i)] for i in range(len(texts))]


def test_near_duplicates(spark, texts):
    own = [*texts, "again and again it says " * 40, "again and again it says " * 48, "again and again it says " * 70]
    docs = documents(spark, own, class_id=["x"] * len(own))
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()} == dict(enumerate(classes_by_brute_force(own)))
    twice = dart_minhash.near_duplicates(docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "a b", "x"), (None, "b c", "x")], docs.schema)))
    assert twice.count() == len(own) + 5 and sorted(str(r.class_id) for r in twice.where("doc_id is null").collect()) == sorted(["None", str(own.index("a b"))])
    assert dart_minhash.near_duplicates(docs.where("false")).count() == 0


def test_different_texts_with_one_key_stay_apart(spark, texts):
    rng = random.Random(17)
    own = [t for t in texts if t] + [prose(rng, 100) for _ in range(20)]
    names = [i // 2 for i in range(len(own))]
    docs = spark.createDataFrame(list(zip(names, own, ["x"] * len(own), strict=True)), "doc_id long, text string, extra string")
    wanted = classes_by_brute_force(own, names)
    got = dart_minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(zip(names, wanted, strict=True))
    kept = dart_minhash.first_of_each(docs.union(docs.limit(7))).collect()
    parts = classes_by_brute_force(own)
    assert len(kept) == len(set(parts)) and {parts[own.index(r.text)] for r in kept} == set(parts)
    assert dart_minhash.first_of_each(docs.where("false")).count() == 0


def test_undecided_pairs_lose_no_link(spark):
    # Copies of one text, each changed at its own places: nearer to each other than to anything else, some above and some below 0.8.
    rng = random.Random(18)
    base = prose(rng, 150).split()
    own = [" ".join(f"x{rng.random()}" if rng.random() < share else w for w in base) for share in (0.01, 0.02, 0.03, 0.05) for _ in range(40)]
    wanted = classes_by_brute_force(own)
    assert 1 < len(set(wanted)) < len(own)
    assert [r.class_id for r in sorted(dart_minhash.near_duplicates(documents(spark, own)).collect())] == wanted
    # The exact filter alone, every text a component of its own: it must meet every similar pair.
    every = [dart_minhash.numbered(*dart_minhash.shingles(t)) for t in own]
    sets = spark.createDataFrame([(i, x.view(np.int64).tolist(), dart_minhash.parities(x).tolist()) for i, x in enumerate(every)], "id long, s array<long>, p array<long>")
    keys = dart_minhash.prefixes(sets.select("id", F.size("s").cast("long").alias("n")), sets, 0.8)
    apart = sets.select("id", F.col("id").alias("label"))
    met = {tuple(r) for r in dart_minhash.all_pairs(dart_minhash.live_keys(keys, apart), sets, 0.8).collect()}
    have = {r.id: set(r.s) for r in sets.collect()}
    near = {(i, j) for j in have for i in range(j) if len(have[i] & have[j]) >= 0.8 * len(have[i] | have[j])}
    assert near and near <= met and len(met) < 0.8 * len(own) * (len(own) - 1) / 2
    labels = dart_minhash.linked_across(sets.select("id", F.size("s").cast("long").alias("n")), sets, dart_minhash.cut(apart, "apart"), 0.8)
    assert [r.label for r in sorted(labels.collect())] == wanted


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    w = rng.integers(1, 9, 500).astype(float)
    v = np.maximum(1, w - rng.integers(0, 3, 500))
    same = (dart_minhash.dart_signature(a, w, 2000) == dart_minhash.dart_signature(a, v, 2000)).mean()
    assert abs(same - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05


# ---------------------------------------------------------------- 8


def removed_by_brute_force(texts, width=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((sum(gone), len(re.findall(b"\1+", gone)), bytes(c for c, g in zip(r, gone) if not g)))
    return out


def test_repeated_strings(spark, texts, monkeypatch):
    rng = random.Random(8)
    edge = prose(rng, 200)
    # Repeats of just the width, one byte less, and of one another's parts; strings with a period; one text inside another.
    own = [*texts, *(f"{prose(rng, 30)}|{edge[k : k + n]}|{prose(rng, 30)}" for k, n in ((0, 400), (0, 399), (1, 400), (300, 420), (310, 400), (600, 250), (600, 249), (601, 250))), "xyz" * 400, "xyz" * 170, texts[3] + " tail", "head " + texts[3]]
    docs = documents(spark, own, sha256=["x"] * len(own))
    for width, most in ((400, suffix_dedup.MOST), (400, 1), (250, suffix_dedup.MOST)):  # with 1, keys with several segments are compared by hashes
        wanted = removed_by_brute_force(own, width)
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_text=True, width=width).collect()}
        assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(own))] == [(n, s, hashlib.sha256(k).hexdigest()) for n, s, k in wanted]
        assert all((got[i].kept_text if n else own[i]) == (k.decode("utf-8", "ignore") if n else own[i]) for i, (n, _, k) in enumerate(wanted))
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_shorter_passages_are_counted_beside_what_is_removed(spark, texts, tmp_path, monkeypatch):
    rng = random.Random(18)
    shared = [" ".join(word for word in prose(rng, 200).split() if len(word) < 6)[:n] for n in (249, 250, 330, 399, 400, 460)]
    # Each passage in two documents, at a start, inside and at an end; followed by the same bytes and by others; in one document twice.
    own = [*texts, *(f"{prose(rng, 30)}|{x}|{prose(rng, 40)}" for x in shared for _ in "ab"), *(f"{prose(rng, 60)}#{x}" for x in shared), *(f"{x}#{prose(rng, 60)}" for x in shared)]
    own += [f"{(x := prose(rng, 60)[:300])} {prose(rng, 40)} {x}", "xyz" * 100, "xyz" * 140, "q" * 700, "r" * 250, "r" * 250, None, ""]
    docs = documents(spark, own, sha256=["x"] * len(own))
    removed, passages = removed_by_brute_force(own), removed_by_brute_force(own, 250)
    assert sum(n == 0 < m for (n, _, _), (m, _, _) in zip(removed, passages, strict=True)) > 10
    for most in (suffix_dedup.MOST, 1):
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_text=True, passage=250).collect()}
        assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(own))] == [(n, s, hashlib.sha256(k).hexdigest()) for n, s, k in removed]
        assert [got[i].n_passage_bytes for i in range(len(own))] == [n for n, _, _ in passages]
        assert all((got[i].kept_text is None) == (n == 0) for i, (n, _, _) in enumerate(removed))
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    query = suffix_dedup.op8_suffix_dedup(spark, str(tmp_path))
    assert query.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: r.n_passage_bytes for r in query.collect()} == {i: n for i, (n, _, _) in enumerate(passages)}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, passage=400)


def test_repeats_of_rows_without_a_key_and_with_a_shared_one(spark, texts):
    own = [t for t in texts if t]
    names = [None if i % 5 == 0 else i // 2 for i in range(len(own))]
    docs = spark.createDataFrame(list(zip(names, own, strict=True)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == Counter((k, n, hashlib.sha256(x).hexdigest()) for k, (n, _, x) in zip(names, removed_by_brute_force(own), strict=True))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        data = rng.integers(0, rng.integers(2, 5), rng.integers(1, 120)).astype(np.uint8)
        raw = data.tobytes()
        wanted = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert suffix_dedup.suffix_array(data, 128).tolist() == wanted
        common = [next((k for k in range(64) if max(a, b) + k >= len(raw) or raw[a + k] != raw[b + k]), 64) for a, b in zip(wanted, wanted[1:])]
        assert suffix_dedup.adjacent_prefixes(data, np.array(wanted), 64).tolist() == common


# ---------------------------------------------------------------- 9


def test_best_boundaries_are_best():
    rng = random.Random(9)
    from itertools import combinations

    for spread in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 200), 8)))
        counts = np.array([rng.randrange(1, 50) ** (1 + spread % 3) for _ in lengths])
        cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths.tolist(), counts.tolist()))  # noqa: B023, E731
        wanted = min(cost([*e, int(lengths[-1])]) for e in combinations(lengths[:-1].tolist(), 2))
        assert cost(length_buckets.best_boundaries(lengths, counts, 3)) == wanted
    assert length_buckets.best_boundaries(np.array([]), np.array([]), 3) == []


def test_packing(spark, texts):
    docs = documents(spark, [*texts, *texts[:5]], media=["x"] * (len(texts) + 5))
    docs = docs.unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    out = length_buckets.pack(docs, n, buckets=4, token_budget=600).collect()
    assert len(out) == len(texts) + 9
    lengths = Counter(len((r.text or "").split(" ")) for r in out)
    ends = length_buckets.best_boundaries(np.array(sorted(lengths)), np.array([lengths[x] for x in sorted(lengths)]), 4)
    held = Counter((r.bucket, r.batch_id) for r in out)
    full, batches, rows = {}, Counter(b for b, _ in held), Counter(r.bucket for r in out)
    for r in out:
        assert r.length == len((r.text or "").split(" ")) and r.bucket_len == min(e for e in ends if e >= r.length) and r.bucket == ends.index(r.bucket_len)
        full[r.bucket] = max(1, 600 // max(1, r.bucket_len))
        assert held[(r.bucket, r.batch_id)] <= full[r.bucket] and r.batch_id.startswith(f"{r.bucket}-")
    # All rows of a bucket of few rows are one group, so no batch but the last is short.
    assert all(batches[b] == -(-rows[b] // full[b]) for b in rows)
    assert length_buckets.pack(docs.where("false"), n).count() == 0
    with pytest.raises(ValueError):
        length_buckets.pack(docs.withColumn("bucket", F.lit(1)), n)


# ---------------------------------------------------------------- 10


def test_language_model(spark):
    import math

    rng = random.Random(10)
    own = ["A the a the", None, "", "new words", *(" ".join(x for _ in range(rng.randrange(1, 40)) for x in ("the", rng.choice(WORDS))) for _ in range(80))]
    docs = documents(spark, own)
    train = docs.where("doc_id % 5 <> 0")
    out = {r.doc_id: r for r in bilinear_lm.score(docs, train).collect()}
    counts = Counter(w for i, t in enumerate(own) if i % 5 for w in [*bilinear_lm.tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(own):
        toks = [*bilinear_lm.tokens(t), b""]
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(toks), sum(w in counts for w in toks), n)
        assert abs(out[i].base_score - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)) < 1e-6
    held = [i for i in range(0, len(own), 5) if len(own[i] or "") > 40]
    assert sum(out[i].score for i in held) > sum(out[i].base_score for i in held)
    assert all(r.base_score == 0 for r in bilinear_lm.score(docs, docs.where("false")).collect())


def test_model_scores_by_brute_force(spark):
    import math

    lm = bilinear_lm
    rng = random.Random(20)
    # Two languages whose words never mix; most words are rare.
    words = {0: [f"aw{i}um" for i in range(300)], 1: [f"be{i}en" for i in range(300)]}
    own = [" ".join(rng.choice(["the", "of", *(rng.choices(words[i % 2], k=4))]) for _ in range(rng.randrange(5, 60))) for i in range(300)] + ["", None, "unseen words only"]
    docs = documents(spark, own)
    trained = [t for i, t in enumerate(own) if i % 10]
    out = {r.doc_id: r for r in lm.score(docs, docs.where("doc_id % 10 <> 0")).collect()}
    counts = Counter(w for t in trained for w in [*lm.tokens(t), b""])
    total = sum(counts.values())
    names = sorted(counts, key=lambda w: (-counts[w], w))
    class_of = {w: i if i < lm.FIRST else lm.bucket(w) for i, w in enumerate(names)}
    units = [w for i, w in enumerate(names) if i < lm.FIRST or counts[w] >= lm.LEAST and counts[w] * lm.SECOND >= total]
    cls = lambda w: class_of.get(w, lm.bucket(w))
    unit = lambda w: units.index(w) if w in units else len(units) + cls(w)
    rest = np.full(lm.CLASSES, 0.1)
    for w in names[len(units) :]:
        rest[cls(w)] += counts[w] + 0.1
    rest[: lm.FIRST] = 1e-9
    class_cells, unit_cells = Counter(), Counter()

    def walk(t):
        p2 = p1 = lm.CLASSES
        for w in [*lm.tokens(t), b""]:
            yield p2, p1, w
            p2, p1 = p1, cls(w)

    for t in trained:
        for p2, p1, w in walk(t):
            class_cells[(p2 * (lm.CLASSES + 1) + p1) * lm.CLASSES + cls(w)] += 1
            unit_cells[unit(w) * (lm.CLASSES + 1) + p1] += 1
    arrays = lambda c: (np.array(list(c)), np.array(list(c.values()), dtype=float))
    mass = np.concatenate([[counts[w] + 0.1 for w in units], rest])
    of_unit = np.concatenate([[class_of[w] for w in units], np.arange(lm.CLASSES)]).astype(int)
    table, unit_table = lm.train(*arrays(class_cells)), lm.train_units(*arrays(unit_cells), of_unit, mass)
    for x in set(of_unit):
        assert np.allclose((10.0 ** unit_table[of_unit == x]).sum(0), 1, atol=1e-4)
    for i, t in enumerate(own):
        wanted = sum(table[p2, p1, cls(w)] + unit_table[unit(w), p1] + (0 if w in units else math.log10((counts[w] + 0.1) / rest[cls(w)])) for p2, p1, w in walk(t))
        assert abs(out[i].score - wanted) < 1e-3 + 1e-5 * abs(wanted)
    held = range(0, 300, 10)
    assert sum(out[i].score - out[i].base_score for i in held) > 0.15 * sum(out[i].n_tokens for i in held)


def test_class_probabilities_are_normalised():
    table = bilinear_lm.train(np.array([5, 700, 9000]), np.array([10.0, 4.0, 2.0]), steps=20)
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(-1), 1, atol=1e-4)
