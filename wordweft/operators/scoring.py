"""Models from outside: anything with predict(batch) runs on the executors, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer(Protocol):
    """predict maps a batch of inputs to as many outputs of the declared type."""

    def predict(self, batch: list) -> list: ...


def scored(load: Callable[[], Scorer], kind: str, *inputs: Column, batch: int = 64) -> Column:
    """A column of the outputs of a scorer; several inputs reach predict as tuples."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            rows = list(columns[0]) if len(columns) == 1 else list(zip(*columns, strict=True))
            out: list = []
            for i in range(0, len(rows), batch):
                out += list(model.predict(rows[i : i + batch]))
            yield pd.Series(out, dtype=object)

    @F.pandas_udf(kind)
    def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows, out = list(texts), []
            for i in range(0, len(rows), batch):
                out += list(model.predict(rows[i : i + batch]))
            yield pd.Series(out, dtype=object)

    return run_one(*inputs) if len(inputs) == 1 else run(*inputs)


def onnx_scorer(path: str, prepare: Callable[[list], dict], finish: Callable[[list], list]) -> Callable[[], Scorer]:
    """A loader of an ONNX file: prepare makes the inputs of a batch, finish the outputs of it."""

    def load() -> Scorer:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])

        class Held:
            def predict(self, batch: list) -> list:
                return finish(session.run(None, prepare(batch)))

        return Held()

    return load


def by_name(session, feed: dict) -> dict:
    """The outputs of an ONNX session by the names that its graph declares, fed with those of the inputs that it declares."""
    wanted = {i.name for i in session.get_inputs()}
    names = [o.name for o in session.get_outputs()]
    return dict(zip(names, session.run(None, {k: v for k, v in feed.items() if k in wanted}), strict=True))


def has_language_head(session) -> bool:
    """Whether a tagger's graph can tell languages: it gives language logits and can be told that the language is not known."""
    return "lid_logits" in {o.name for o in session.get_outputs()} and "lang_known" in {i.name for i in session.get_inputs()}


def classifier(load: Callable[[], Scorer], text: Column, batch: int = 64) -> Column:
    """Logits of an injected sequence classifier: texts on one line, blank ones as empty texts."""
    return scored(load, "array<double>", F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")), batch=batch)


def embed(load: Callable[[], Scorer], text: Column, batch: int = 64) -> Column:
    """Vectors of an injected encoder; null texts have none."""
    return F.when(text.isNotNull(), scored(load, "array<float>", text, batch=batch))
