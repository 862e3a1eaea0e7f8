"""Sources and sinks: dataset registries, model tables in JSON, images and sound."""

from __future__ import annotations

import io
import os
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = "name string, description string, configs array<string>, default_config string, splits array<string>"
#: The datasets that the models are trained and measured on. Configs: null where there is one; a default where one is taken unasked.
DATASETS = [
    {"name": "graded-relevance", "description": "English queries and passages with graded relevance", "configs": ["pairs-graded", "triplets"], "default_config": "pairs-graded", "splits": ["train", "test"]},
    {"name": "query-passage-pairs", "description": "queries and passages in 25 languages", "configs": None, "default_config": None, "splits": ["train"]},
    {"name": "passage-questions", "description": "passages and questions that they answer, in 25 languages", "configs": None, "default_config": None, "splits": ["train"]},
    {"name": "reranker-triples", "description": "queries, passages and hard negatives in 25 languages", "configs": None, "default_config": None, "splits": ["train"]},
    {"name": "passage-questions-held-out", "description": "passages that no training has seen", "configs": None, "default_config": None, "splits": ["train"]},
    {"name": "marked-sentences", "description": "sentences without and with their marks, a config a language", "configs": ["es", "fr", "ha", "ig", "it", "pl", "pt", "tr", "vi", "yo"], "default_config": None, "splits": ["test"]},
]
#: Vocabulary files by language or variant, names in any case.
TOKENIZERS = {
    **{code: f"bpe-50k-{code}.json" for code in ("yo", "ig", "ha", "pcm")},
    **{name: f"bpe-50k-{code}.json" for name, code in (("yoruba", "yo"), ("igbo", "ig"), ("hausa", "ha"), ("pidgin", "pcm"))},
    "naija": "bpe-50k-unified.json",
    **{f"{family}-{size}": f"{family}-{size}/tokenizer.json" for family in ("sw", "kin", "merged") for size in ("50k", "100k", "150k")},
}


class Registry:
    """Named datasets under a root folder: root/name[/config]/split, as Parquet."""

    def __init__(self, root: str, rows: list[dict] | None = None):
        self.root, self.rows = root, {r["name"]: r for r in (DATASETS if rows is None else rows)}

    def names(self) -> list[str]:
        return list(self.rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [x.split(" ")[0] for x in REGISTRY_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows.values()], REGISTRY_SCHEMA)

    def info(self, name: str) -> dict:
        key = name.strip().split("/")[-1]
        if key not in self.rows:
            raise ValueError(f"no dataset {name!r}; there are {', '.join(self.rows)}")
        return dict(self.rows[key])

    def path(self, name: str, config: str | None = None, split: str | None = None) -> str:
        row = self.info(name)
        configs = row.get("configs")
        if config is not None and not configs:
            raise ValueError(f"{name} has no configs")
        if configs:
            config = config or row.get("default_config")
            if config is None:
                raise ValueError(f"{name} requires a config: {', '.join(configs)}")
            if config not in configs:
                raise ValueError(f"unknown config {config!r} of {name}: {', '.join(configs)}")
        return "/".join(x for x in (self.root, row["name"], config, split) if x)

    def load(self, spark: SparkSession, name: str, config: str | None = None, split: str | None = None, streaming: bool = False):
        """One DataFrame for a split, else a dict of them; streaming reads new files as they come."""

        def read(path: str) -> DataFrame:
            return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) if streaming else spark.read.parquet(path)

        if split is not None:
            return read(self.path(name, config, split))
        return {s: read(self.path(name, config, s)) for s in self.info(name)["splits"]}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can see a file that is not empty, or a folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(at)) and (fs.getFileStatus(at).isDirectory() or fs.getFileStatus(at).getLen() > 0)


def model_folders(package: str, cache: str | None = None, namespace: str | None = None) -> list[str]:
    """Where a model file is looked for: the folder that WORDWEFT_MODELS_DIR names, the cache (its namespace first), the package."""
    named = os.environ.get("WORDWEFT_MODELS_DIR")
    cached = [os.path.join(cache, namespace.replace("/", "--"))] if cache and namespace else []
    return [x for x in (named, *cached, cache, package) if x]


def resolve_model(filename: str, folders: list[str]) -> str:
    """The first non-empty file of that name in the folders; FileNotFoundError without one. Nothing is downloaded."""
    for folder in folders:
        path = os.path.join(folder, filename)
        if os.path.isfile(path) and os.path.getsize(path):
            return path
    raise FileNotFoundError(f"{filename} is in none of {folders}")


def tokenizer_file(lang: str, folders: list[str], path: str | None = None) -> str:
    """The vocabulary file of a language, variant or file name (.json may be left out), or the given path; FileNotFoundError without it."""
    if path is not None:
        for p in (path, f"{path}.json"):
            if os.path.isfile(p):
                return p
        raise FileNotFoundError(path)
    name = lang.strip()
    return resolve_model(TOKENIZERS.get(name.lower(), name if name.endswith(".json") else f"{name}.json"), folders)


def read_linear_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A linear model in JSON (classes, intercept, features {term: {idf, weights}}) as tables (term, idf, weights) and (class, idx, intercept)."""
    raw = spark.read.option("multiLine", True).schema("classes array<string>, intercept array<double>, features map<string,struct<idf:double,weights:array<double>>>").json(path)
    meta = raw.select(F.posexplode("classes").alias("idx", "class"), "intercept").select("class", "idx", F.get("intercept", F.col("idx")).alias("intercept"))
    return raw.select(F.explode("features").alias("term", "f")).select("term", "f.idf", "f.weights"), meta


def read_viterbi_model(spark: SparkSession, path: str, custom: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (plain, idx, form), unigrams (form, logp), transitions (prev, cur, logp) of a JSON file; a missing file of the caller's own is an error, else empty tables."""
    if not path_exists(spark, path):
        if custom:
            raise FileNotFoundError(path)
        empty = lambda schema: spark.createDataFrame([], schema)
        return empty("plain string, idx int, form string"), empty("form string, logp double"), empty("prev string, cur string, logp double")
    raw = spark.read.option("multiLine", True).schema("candidates map<string,array<string>>, unigrams map<string,double>, transitions map<string,double>").json(path)
    candidates = raw.select(F.explode("candidates").alias("plain", "forms")).select("plain", F.posexplode("forms").alias("idx", "form"))
    words = F.split("pair", " ", 2)
    moves = raw.select(F.explode("transitions").alias("pair", "logp")).select(words[0].alias("prev"), words[1].alias("cur"), "logp")
    return candidates, raw.select(F.explode("unigrams").alias("form", "logp")), moves


def read_lookup_model(spark: SparkSession, path: str) -> DataFrame:
    """(width, ctx, out) of a JSON file with a map for each width."""
    raw = spark.read.option("multiLine", True).schema("db_5 map<string,string>, db_3 map<string,string>, db_1 map<string,string>").json(path)
    out = None
    for width in (5, 3, 1):
        one = raw.select(F.lit(width).alias("width"), F.explode(f"db_{width}").alias("ctx", "out"))
        out = one if out is None else out.unionByName(one)
    return out


def read_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(lang, key, variant, cnt) of a lexicon in JSON, and whether it was built from densely marked texts; older files hold the table alone."""
    entries = "map<string,map<string,map<string,bigint>>>"
    wide = spark.read.option("multiLine", True).schema(f"density_gated boolean, table {entries}").json(path)
    head = wide.select(F.col("table").isNotNull().alias("new"), F.coalesce("density_gated", F.lit(False)).alias("gated")).first()
    if head is not None and head["new"]:
        gated, raw = head["gated"], wide.select(F.explode("table").alias("lang", "keys"))
    else:
        langs, gated = spark.read.option("multiLine", True).json(path).columns, False
        fields = ", ".join(f"`{x}` map<string,map<string,bigint>>" for x in langs)
        wide = spark.read.option("multiLine", True).schema(fields).json(path)
        raw = wide.select(F.explode(F.create_map(*(x for lang in langs for x in (F.lit(lang), F.col(f"`{lang}`"))))).alias("lang", "keys"))
    return raw.select("lang", F.explode("keys").alias("key", "variants")).select("lang", "key", F.explode("variants").alias("variant", "cnt")), gated


def read_temperature(spark: SparkSession, path: str | None) -> float:
    """The shared temperature of a calibration file; 1.0 without a file or a number in it."""
    if path is None or not path_exists(spark, path):
        return 1.0
    found = spark.read.option("multiLine", True).schema("shared double").json(path).first()
    return 1.0 if found is None or found["shared"] is None else float(found["shared"])


def read_prior_model(spark: SparkSession, path: str) -> DataFrame:
    """Priors in JSON (alpha, log_prior_ratio {label: ratio}) as (label, bias)."""
    raw = spark.read.option("multiLine", True).schema("alpha double, log_prior_ratio map<string,double>").json(path)
    return raw.select("alpha", F.explode("log_prior_ratio").alias("label", "ratio")).select("label", (F.col("alpha") * F.col("ratio")).alias("bias"))


def check_spec(labels: DataFrame, wanted: str) -> None:
    """ValueError unless every spec_version of a label table is the wanted one."""
    other = [r[0] for r in labels.select("spec_version").distinct().limit(10).collect() if r[0] != wanted]
    if other:
        raise ValueError(f"the labels have spec_version {other}, not {wanted}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def wav_samples(content: Column) -> Column:
    """(rate, samples) of PCM WAV files as doubles between -1 and 1, channels averaged; null where a file can't be read."""

    @F.pandas_udf("rate int, samples array<double>")
    def read(files: pd.Series) -> pd.DataFrame:
        import wave

        rows = []
        for f in files:
            try:
                with wave.open(io.BytesIO(bytes(f))) as w:
                    n, width, channels = w.getnframes(), w.getsampwidth(), w.getnchannels()
                    raw = w.readframes(n)
                    size = {1: "B", 2: "h", 4: "i"}[width]
                    x = struct.unpack(f"<{n * channels}{size}", raw)
                    one = [(v - 128) / 128 if width == 1 else v / 2 ** (8 * width - 1) for v in x]
                    rows.append((w.getframerate(), [sum(one[i : i + channels]) / channels for i in range(0, len(one), channels)]))
            except (EOFError, KeyError, TypeError, struct.error, wave.Error):
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["rate", "samples"]).astype({"rate": "Int32"})

    return read(content)


def wav_bytes(rate: Column, samples: Column) -> Column:
    """16-bit mono WAV files of samples between -1 and 1."""

    @F.pandas_udf("binary")
    def write(rates: pd.Series, rows: pd.Series) -> pd.Series:
        import wave

        out = []
        for r, s in zip(rates, rows, strict=True):
            held = io.BytesIO()
            with wave.open(held, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(int(r))
                w.writeframes(struct.pack(f"<{len(s)}h", *(max(-32768, min(32767, round(v * 32768))) for v in s)))
            out.append(held.getvalue())
        return pd.Series(out, dtype=object)

    return write(rate, samples)
