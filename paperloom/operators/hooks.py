"""Model calls supplied by the caller.

Each hook is a plain function over a batch; Spark decides where the batches run.  A failed call is retried a few times,
then its batch is halved until the rows that fail stand alone.  Those get NULL and the reason in ``<out>_error``, so that
one bad row neither fails a job that has paid for millions of good ones nor goes unnoticed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def __call__(self, prompts: list[str]) -> list[str | None]: ...


class Reranker(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class ContextSource(Protocol):
    """A tool: from a question table (query_id, query) to a context table (query_id, content, source, similarity)."""

    def __call__(self, questions: DataFrame) -> DataFrame: ...


def attempt(fn: Callable, batch: list, tries: int, wait: float) -> tuple[list, list]:
    """(values, errors) of a batch."""
    reason = None
    for n in range(tries):
        try:
            values = list(fn(batch))
            if len(values) != len(batch):
                raise ValueError(f"{len(values)} values for {len(batch)} rows")
            return values, [None] * len(batch)
        except Exception as e:  # whatever the caller's function raises
            reason = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    if len(batch) <= 1:
        return [None] * len(batch), [reason] * len(batch)
    half = len(batch) // 2
    (a, x), (b, y) = attempt(fn, batch[:half], 1, wait), attempt(fn, batch[half:], 1, wait)
    return a + b, x + y


def map_batches(df: DataFrame, out: T.StructField, fn: Callable, args: Callable[[pd.DataFrame], list], batch: int, tries: int, wait: float) -> DataFrame:
    """Add ``out`` and ``<out>_error``."""
    failed = f"{out.name}_error"
    schema = T.StructType(df.schema.fields + [out, T.StructField(failed, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                values, errors = attempt(fn, args(part), tries, wait)
                yield part.assign(**{out.name: values, failed: errors})

    return df.mapInPandas(run, schema)


def ask(df: DataFrame, model: LanguageModel, prompt: str = "prompt", out: str = "response", batch: int = 64, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Add the model's answer to every prompt.  Filter before asking: no filter is pushed below a model call."""
    return map_batches(df, T.StructField(out, T.StringType()), model, lambda p: p[prompt].tolist(), batch, tries, wait)


def rerank(df: DataFrame, model: Reranker, query: str = "query", content: str = "content", out: str = "rerank_score", batch: int = 256, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Add a relevance score to every (question, passage) row; rows of one question need not meet in one task."""
    return map_batches(df, T.StructField(out, T.DoubleType()), model, lambda p: list(zip(p[query], p[content])), batch, tries, wait)
