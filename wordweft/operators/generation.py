"""Generation by language models from outside: message lists in, texts out, with retries only where waiting can help.

A transport is anything with complete(messages, params) -> str, or with stream(messages, params) that yields pieces; it is loaded once a worker.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweft.functions import prompts

#: What sampling starts from; a call's own parameters go before.
DEFAULTS = {"temperature": 0.7, "top_p": 0.95, "min_p": 0.05, "repetition_penalty": 1.5, "max_new_tokens": 1024}
#: A passage of fewer characters gives poor questions.
SHORT_PASSAGE = 20


class Busy(Exception):
    """The server has no capacity now; the same call can succeed later."""


class Transport(Protocol):
    def complete(self, messages: list[dict], params: dict) -> str: ...


def parameters(hosted: bool, **own) -> dict:
    """Defaults with a call's own parameters; hosted servers know a frequency penalty, what the repetition penalty has above 1."""
    out = {**DEFAULTS, **own}
    if hosted:
        out["frequency_penalty"] = max(0.0, out.pop("repetition_penalty") - 1.0)
    return out


def with_retries(call: Callable[[], str], tries: int = 3, delay: float = 5.0, wait: Callable[[float], None] = time.sleep) -> str:
    """call(), again after delay, 2 delay, ... while the server is busy; any other error, and the last busy one, is the caller's."""
    for n in range(1, max(1, tries) + 1):
        try:
            return call()
        except Busy:
            if n >= max(1, tries):
                raise
            wait(delay * n)
    raise AssertionError("unreachable")


def stream(transport, messages: list[dict], **own) -> Iterator[str]:
    """The pieces of one answer as they come, for a caller on the driver."""
    yield from (piece for piece in transport.stream(messages, parameters(True, **own)) if piece)


def chat(conversations: DataFrame, load: Callable[[], Transport], hosted: bool = True, tries: int = 3, delay: float = 5.0, **own) -> DataFrame:
    """conversations with `answer` to the column messages (role, content); null where a message list is null."""
    params = parameters(hosted, **own)

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transport = load()
        for rows in batches:
            out = []
            for m in rows:
                said = None if m is None else [{"role": x["role"], "content": x["content"]} for x in m]
                out.append(None if said is None else with_retries(lambda said=said: transport.complete(said, params), tries, delay))
            yield pd.Series(out, dtype=object)

    return conversations.withColumn("answer", answers("messages"))


def system_and_user(prompt: Column, system: str) -> Column:
    """The message list of a single prompt."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", prompt))


def generate(docs: DataFrame, load: Callable[[], Transport], system: str, **own) -> DataFrame:
    """docs (..., text) with `answer` to each text as a prompt."""
    return chat(docs.withColumn("messages", F.when(F.col("text").isNotNull(), system_and_user(F.col("text"), system))), load, **own).drop("messages")


def questions(passages: DataFrame, load: Callable[[], Transport], n: int = 3, language: str = "English", max_new_tokens: int = 250) -> DataFrame:
    """passages (..., text) with `questions`, up to n of each, greedily decoded, and `warnings`: short passages; null for an empty passage."""
    code, name = prompts.question_language(language)
    if code in prompts.WEAK_LANGUAGES:
        warnings.warn(f"questions in {name} are less reliable", stacklevel=2)
    asked = passages.withColumn("messages", prompts.question_messages(F.col("text"), n, language))
    done = chat(asked, load, hosted=False, temperature=0.0, max_new_tokens=max_new_tokens)
    short = F.when(F.length(F.trim("text")) < SHORT_PASSAGE, F.array(F.lit("short passage"))).otherwise(F.array().cast("array<string>"))
    return done.withColumn("questions", F.when(F.col("answer").isNotNull(), prompts.parse_questions(F.col("answer"), n))).withColumn("warnings", short).drop("messages", "answer")
