import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from wordweft.llm import length_buckets


def test_pipeline_with_clashing_columns(spark, tmp_path):
    good = [" ".join(f"word{(i * 7 + k * k) % 997}" for k in range(120)) for i in range(60)]
    bad = [" ".join(f"w{(i + k * k) % 97}###" for k in range(120)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t), 1, "x") for i, t in enumerate([*good, *bad, good[0], good[1] + " end", "", 'api_key = "abcdefghijklmnop0"'])] + [(None, "no id", "en", "s", 5, 1, "x"), (3, good[3], "en", "s", 1, 1, "x"), (200, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60)) for i in range(90)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns
        kept[name] = {r.doc_id for r in at.collect()}
    assert not kept["quality"] & set(range(60, 90)) and set(range(60)) <= kept["quality"]
    assert 90 not in kept["near_duplicates"] and 91 not in kept["near_duplicates"] and {0, 1, 3, None} <= kept["near_duplicates"]
    assert kept["packing"] == kept["near_duplicates"]
    secret = corpus_pipeline.secrets(spark, docs.where("doc_id = 93"), str(tmp_path)).first()
    assert secret.text == '[SECRET]"' and secret.n_chars == 9
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("doc_id").isNotNull()).count() == len(kept["near_duplicates"]) - 1


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def test_stages_by_brute_force(spark, tmp_path):
    """Passages of more than fifty words that documents share go, whatever else these say; shorter ones and all other texts stay as they are."""
    rng = random.Random(51)
    passages = [prose(rng, 56) for _ in range(8)]
    short = prose(rng, 30)
    shared = [f"{prose(rng, 150)}\n{passages[i % 8]}\n{prose(rng, 150)}" for i in range(24)]
    clean = [f"{prose(rng, 200)}\n{short}\n{prose(rng, 60)}" for _ in range(20)]
    own = [*shared, *clean, shared[0], clean[1] + " once more", "", None]
    names = [i // 2 for i in range(len(own))]  # two texts a doc_id
    docs = spark.createDataFrame(list(zip(names, own, strict=True)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    # Both texts of a doc_id stay; copies, near copies and one of the two empty texts go.
    assert Counter(r.text or "" for r in kept) == Counter([*shared, *clean, ""])
    docs = spark.createDataFrame(kept, docs.schema)
    raws = [(r.text or "").encode() for r in kept]
    width = corpus_pipeline.PASSAGE
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    wanted = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        wanted.append(bytes(c for c, g in zip(r, gone) if not g).decode())
    done = corpus_pipeline.repeated_strings(spark, docs, "").collect()
    assert Counter(r.text or "" for r in done) == Counter(wanted)
    assert not any(p in (r.text or "") for r in done for p in passages) and sum(short in (r.text or "") for r in done) == len(clean)
    packed = corpus_pipeline.packing(spark, spark.createDataFrame(done, docs.schema), "").collect()
    lengths = Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in wanted)
    ends = length_buckets.best_boundaries(sorted(lengths), [lengths[n] for n in sorted(lengths)], 16)
    assert Counter(r.n_tokens for r in packed) == lengths and all(r.bucket_len == min(e for e in ends if e >= r.n_tokens) for r in packed)
    rows = Counter(r.batch_id for r in packed)
    assert all(rows[r.batch_id] * r.bucket_len <= 65536 or rows[r.batch_id] == 1 for r in packed)
