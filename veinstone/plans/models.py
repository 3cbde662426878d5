"""Model interfaces, with deterministic stand-ins that need no network.

A model is a function of a batch of requests; it runs in Arrow batches on the executors, is made once
in each Python worker, and returns an error as a value, so that one failed call never fails a task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import structure
from ..sources import retry
from ..sources.retry import TransientError  # noqa: F401 - what a model raises

RESPONSE = "struct<content:string,prompt_tokens:long,completion_tokens:long,error:string>"


class Response(NamedTuple):
    content: str | None
    prompt_tokens: int = 0
    completion_tokens: int = 0
    error: str | None = None


class Model(Protocol):
    def __call__(self, prompts: list[str]) -> list[Response]: ...


def with_retries(model: Model, attempts: int = 3, base_s: float = 0.5, sleep: Callable[[float], None] = time.sleep, most_s: float = 20.0) -> Model:
    """The model with further attempts where they may help; a failure that stays becomes error values."""

    def call(prompts: list[str]) -> list[Response]:
        try:
            return retry.attempted(lambda: model(prompts), attempts, base_s, most_s, sleep)
        except Exception as error:  # noqa: BLE001 - becomes a value
            return [Response(None, error=f"{type(error).__name__}: {error}") for _ in prompts]

    return call


def words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.lower())


class Extractive:
    """The offline model: the sentences of a text nearest to a question, and their overlap as a score from 0 to 10.

    A request is JSON with question and text; the reply is JSON with summary and relevance_score. It is
    a stand-in for a language model: it neither reasons nor writes.
    """

    def __call__(self, prompts: list[str]) -> list[Response]:
        out = []
        for p in prompts:
            try:
                ask = json.loads(p)
                asked = set(words(ask["question"]))
                scored = sorted(((len(asked & set(words(s))), -k, s) for k, s in enumerate(structure.sentences(ask["text"]))), reverse=True)[:2]
                score = min(10, round(10 * max((n for n, _, _ in scored), default=0) / max(1, len(asked))))
                reply = json.dumps({"summary": " ".join(s for _, _, s in sorted(scored, key=lambda x: -x[1])), "relevance_score": score}, ensure_ascii=False)
                out.append(Response(reply, len(p) // 4, len(reply) // 4))
            except (ValueError, KeyError, TypeError) as error:
                out.append(Response(None, error=f"{type(error).__name__}: {error}"))
        return out


def complete(requests: DataFrame, prompt: str, make: Callable[[], Model] = Extractive, out: str = "response") -> DataFrame:
    """`requests` with the model's response to column `prompt`; concurrency is that of the partitions."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = with_retries(make())
        for batch in batches:
            yield pd.DataFrame([r._asdict() for r in model(batch.tolist())], columns=list(Response._fields))

    return requests.withColumn(out, F.pandas_udf(run, RESPONSE)(F.col(prompt)))
