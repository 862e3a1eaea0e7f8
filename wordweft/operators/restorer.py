"""One front for all ways of restoring marks: a table of models, options checked before anything is planned, and dispatch to the model's plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweft.functions import prompts
from wordweft.operators import restoration

#: Models by name: the language, "multi" for eleven of them, and the method.
MODELS = {
    "yor-viterbi": ("yo", "viterbi"),
    "yor-below": ("yo", "lookup"),
    "ibo-below": ("ig", "lookup"),
    "yor-letters": ("yo", "letters"),
    "yor-words": ("yo", "words"),
    "sequence-1.0": ("multi", "sequence1"),
    "sequence-1.1": ("multi", "sequence1"),
    "tagger-1.0": ("multi", "tagger"),
    "tagger-2.0": ("multi", "tagger"),
    "sequence-2.0": ("multi", "sequence2"),
    "sequence-mini-2.0": ("multi", "sequence2"),
    "auto": ("auto", "auto"),
}
#: Options and the methods that take them; an option that is not given is None.
OPTIONS = {
    "details": {"tagger"},
    "min_confidence": {"tagger"},
    "case_endings": {"tagger", "sequence2"},
    "aligned": {"sequence1", "sequence2"},
    "hints": {"sequence2"},
    "lang": {"sequence1", "sequence2", "tagger"},
}


def registry(spark: SparkSession) -> DataFrame:
    """model, lang, method, and the options that the model takes."""
    rows = [(m, lang, method, sorted(o for o, who in OPTIONS.items() if method in who)) for m, (lang, method) in MODELS.items()]
    return spark.createDataFrame(rows, "model string, lang string, method string, options array<string>")


def check_options(model: str, **options) -> None:
    """ValueError for an unknown model, or an option that its method does not take."""
    if model not in MODELS:
        raise ValueError(f"no model {model!r}; there are {', '.join(MODELS)}")
    method = MODELS[model][1]
    for name, value in options.items():
        if name not in OPTIONS:
            raise ValueError(f"no option {name!r}; there are {', '.join(OPTIONS)}")
        if value is not None and method not in OPTIONS[name]:
            takers = [m for m, (_, how) in MODELS.items() if how in OPTIONS[name]]
            raise ValueError(f"{model} does not take {name}; {', '.join(takers)} do")


@dataclass
class Restorer:
    """A model by name and what it runs on.

    parts: for viterbi `tables` (candidates, unigrams, transitions; without them every word stands for itself), for lookup `table`, for
    letters and words `load` and `candidates`, for sequence models `load`, for the tagger `run`, a function from (docs, tag column, options) to a
    frame, for auto `langs` and the Restorers `ibo` and `other`.
    """

    model: str = "yor-viterbi"
    parts: dict = field(default_factory=dict)
    lang: str | None = None
    case_endings: bool = True
    aligned: bool | None = None
    batch: int = 16

    def __post_init__(self) -> None:
        check_options(self.model, case_endings=None if self.case_endings else False, aligned=self.aligned)
        self.method = MODELS[self.model][1]
        if self.lang is not None:
            self._code(self.lang)

    def _code(self, lang: str) -> str:
        """The tag of a language code; ValueError for one that the model does not know."""
        known = {**{t: t for t in prompts.TAGS}, **prompts.RESTORED}
        code = known.get(lang.strip().strip("<>").lower().replace("_", "-").split("-")[0] if self.method != "sequence2" else lang.strip().strip("<>").lower().replace("_", "-"))
        if self.method == "sequence1":
            code = None if code in ("ara", "ara-nocase", "auto") else code
        if self.method == "tagger":
            code = None if code in ("ara-nocase", "auto") or (self.model == "tagger-1.0" and code == "ara") else code
        if self.method in OPTIONS["lang"] and code is None:
            raise ValueError(f"{self.model} does not know the language {lang!r}")
        return code or ""

    def _tags(self, lang: str | Column | None, case_endings: bool) -> Column:
        if isinstance(lang, Column):
            return F.coalesce(prompts.resolve_tag(lang, case_endings), F.lit("auto"))
        chosen = lang if lang is not None else self.lang
        if chosen is None:
            return F.lit("yor" if self.method == "sequence1" else "auto")
        code = self._code(chosen)
        return F.lit("ara-nocase" if code == "ara" and not case_endings else code)

    def restore(self, docs: DataFrame, lang: str | Column | None = None, min_confidence: float | None = None, details: bool | None = None, case_endings: bool | None = None, aligned: bool | None = None, hints: str | None = None) -> DataFrame:
        """(doc_id, restored) of docs (doc_id, text). lang: one code, or a column of codes; hints: the name of a column of hint blocks. Options are checked first."""
        if not isinstance(docs, DataFrame):
            raise TypeError("restore() takes a frame of doc_id and text")
        check_options(self.model, lang=lang, min_confidence=min_confidence, details=details, case_endings=case_endings, aligned=aligned, hints=hints)
        endings = self.case_endings if case_endings is None else case_endings
        run: dict[str, Callable[[], DataFrame]] = {
            "viterbi": lambda: self._viterbi(docs),
            "lookup": lambda: restoration.knn_decode(docs, self.parts["table"], restoration.TARGETS[prompts.RESTORED[MODELS[self.model][0]]]),
            "letters": lambda: restoration.correct_words(docs, self.parts["load"](docs), self.parts["candidates"]),
            "words": lambda: restoration.pick_words(docs, self.parts["load"](docs), self.parts["candidates"]),
            "sequence1": lambda: restoration.decode_in_batches(docs, self._tags(lang, True), self.parts["load"], batch=self.batch, aligned=bool(self.aligned if aligned is None else aligned), by_sentence=True),
            "sequence2": lambda: restoration.decode_in_batches(docs, self._tags(lang, endings), self.parts["load"], batch=self.batch, hints=hints, aligned=self._aligned(aligned)),
            "tagger": lambda: self.parts["run"](docs, self._tags(lang, True), {"min_confidence": min_confidence or 0.0, "details": bool(details), "case_endings": endings}),
            "auto": lambda: restoration.restore_auto(docs, self.parts["langs"], self.parts["ibo"].restore, self.parts["other"].restore),
        }
        return run[self.method]()

    def _aligned(self, aligned: bool | None) -> bool:
        chosen = self.aligned if aligned is None else aligned
        return True if chosen is None else chosen

    def _viterbi(self, docs: DataFrame) -> DataFrame:
        if "tables" not in self.parts:
            return docs.select("doc_id", restoration.recase_words(F.col("text")).alias("restored"))
        return restoration.viterbi_decode(docs, *self.parts["tables"])
