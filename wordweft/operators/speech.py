"""The front end of speech synthesis: texts spoken out and their marks restored, and the places where an acoustic model and a vocoder plug in."""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweft.functions import spoken


class ExperimentalWarning(UserWarning):
    """Said when somebody builds on an interface that no model is shipped for."""


class _Part(ABC):
    def __init_subclass__(cls, **kwargs) -> None:
        super().__init_subclass__(**kwargs)
        if cls.__module__ != __name__:
            warnings.warn(f"{cls.__name__} builds on an experimental interface", ExperimentalWarning, stacklevel=2)

    @abstractmethod
    def load_weights(self, path: str) -> None: ...


class AcousticModel(_Part):
    @abstractmethod
    def forward(self, text: str) -> np.ndarray:
        """A spectrogram of a text."""


class Vocoder(_Part):
    @abstractmethod
    def generate(self, spectrogram: np.ndarray) -> np.ndarray:
        """The samples of a spectrogram."""


#: What the status says.
DONE, NO_MODEL = "Success", "Acoustic model or Vocoder not provided."


def synthesize(docs: DataFrame, lang: str, restore: Callable[[DataFrame], DataFrame] | Callable[[Column], Column], acoustic: Callable[[], AcousticModel] | None = None, vocoder: Callable[[], Vocoder] | None = None, in_row: bool = False) -> DataFrame:
    """(doc_id, normalized_text, diacritized_text, audio, status) of texts (doc_id, text).

    restore maps (doc_id, text) to (doc_id, restored), or with in_row a text column to a restored one, which needs no join. acoustic and vocoder load their models, once a worker; without both there is no audio.
    """
    said = docs.select("doc_id", spoken.speak(F.col("text"), lang).alias("text"))
    named = said.withColumnRenamed("text", "normalized_text")
    both = named.withColumn("diacritized_text", restore(F.col("normalized_text"))) if in_row else named.join(restore(said), "doc_id").withColumnRenamed("restored", "diacritized_text")
    if acoustic is None or vocoder is None:
        return both.select("doc_id", "normalized_text", "diacritized_text", F.lit(None).cast("array<double>").alias("audio"), F.lit(NO_MODEL).alias("status"))

    @F.pandas_udf("array<double>")
    def audio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first, second = acoustic(), vocoder()
        for texts in batches:
            yield pd.Series([np.asarray(second.generate(first.forward(t)), dtype=float).tolist() if t is not None else None for t in texts], dtype=object)

    return both.select("doc_id", "normalized_text", "diacritized_text", audio("diacritized_text").alias("audio"), F.lit(DONE).alias("status"))
