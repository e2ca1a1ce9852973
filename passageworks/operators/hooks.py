"""Plugged-in models and parsers.

Each hook gets a factory that runs once per Python worker batch stream, where
it can load a model, and returns the function applied to Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_with(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list[list[float]]]],
    text: str = "text",
    output: str = "embedding",
) -> DataFrame:
    """Add the vectors that an encoder gives for ``text``."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(list(texts))])

    return df.withColumn(output, encode(text))


def generate_with(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list[str]]],
    prompt: str = "prompt",
    output: str = "generated",
) -> DataFrame:
    """Add the text that a generator gives for ``prompt``; parse it with E5.

    A failing batch is retried row by row, so that ``error`` marks only the
    prompts that fail themselves (E10).
    """

    @F.pandas_udf(f"{output} string, error string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for prompts in batches:
            rows = _isolated(model, list(prompts))
            yield pd.DataFrame(rows, columns=[output, "error"])

    return df.withColumn("_made", generate(prompt)).select(*df.columns, "_made.*")


def _isolated(model, items: list) -> list[tuple]:
    try:
        return [(out, None) for out in model(items)]
    except Exception:
        rows = []
        for item in items:
            try:
                rows.append((model([item])[0], None))
            except Exception as failure:
                rows.append((None, str(failure) or type(failure).__name__))
        return rows


def extract_with(load: Callable[[], Callable[[bytes], str]]):
    """A column function from bytes to ``struct(text, error)`` for ``load_documents``."""

    @F.pandas_udf("text string, error string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parse = load()
        for contents in batches:
            rows = []
            for content in contents:
                try:
                    rows.append((None, None) if content is None else (parse(bytes(content)), None))
                except Exception as failure:
                    rows.append((None, str(failure) or type(failure).__name__))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return extract
