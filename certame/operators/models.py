"""Calls of language and vision models, as a function that the caller brings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certame.functions.text import prompt, skill_in
from certame.operators.changes import upsert
from certame.operators.search import unclassified

Model = Callable[[str], str]


class Limited(Exception):
    """The service asks to wait."""


# Seconds to wait after a limit, and between calls.
LIMIT_WAITS, PACE = (65, 120), 2.5


def patient(model: Model, tries: int = 3, sleep: Callable[[float], None] = time.sleep, pace: float = 0.0) -> Model:
    """Calls again after a limit (65, then 120 seconds) or another failure (10 seconds more each time); None after the last try."""

    def call(text: str) -> str | None:
        for n in range(tries):
            try:
                answer = model(text)
                sleep(pace)
                return answer
            except Limited:
                wait = LIMIT_WAITS[min(n, len(LIMIT_WAITS) - 1)]
            except Exception:
                wait = 10 * (n + 1)
            if n + 1 < tries:
                sleep(wait)
        return None

    return call


def first_of(*models: Model) -> Model:
    """L1: the next model where one fails or says nothing."""

    def call(text: str) -> str | None:
        for m in models:
            try:
                if answer := m(text):
                    return answer
            except Exception:
                continue
        return None

    return call


def asked(rows: DataFrame, question: str, answer: str, make: Callable[[], Model]) -> DataFrame:
    """Adds a model's answer to a column of prompts. make() opens the client in the task, once for each partition; columns stay."""
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            yield f.assign(**{answer: [None if q is None else model(q) for q in f[question]]})

    return rows.mapInPandas(run, schema)


def classify_skills(questions: DataFrame, make: Callable[[], Model], skills: dict[str, str], again: bool = False, limit: int | None = None) -> DataFrame:
    """L2: questions with the skill that a model names; done ones are skipped, so a second run goes on where one ended."""
    todo = unclassified(questions, again).select("id", prompt(F.col("area"), F.col("enunciado"), F.col("comando"), skills).alias("__q"))
    todo = todo.orderBy("id").limit(limit) if limit else todo
    told = asked(todo, "__q", "__a", make).select("id", skill_in(F.col("__a")).alias("competencia")).where("competencia is not null")
    return upsert(questions, told, ("id",))
