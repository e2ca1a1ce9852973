"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from types import ModuleType
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import fits, scratch_dir

T = TypeVar("T")

#: The white space that separates words, as a character class of a pattern.
SPACE = r"\x20\x09-\x0D"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again; cuts its lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def watched(df: DataFrame, **sums: Column) -> tuple[DataFrame, Observation]:
    """``df``, of which the job that stores it notes ``rows`` and further aggregates on the way.

    Spares a job that reads the table again; the driver keeps a plan and its metrics for every job.
    """
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in sums.items())), seen


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for broadcast if it was counted to have at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if fits(df, rows) else df


def within(df: DataFrame, most: int, rows: int) -> DataFrame:
    """``small`` of a table that is known to have at most ``most`` rows; counts it only if that is too many."""
    return F.broadcast(df) if most <= rows else small(df, rows)


def per_worker(key: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once per Python worker process and shared by its tasks.

    For models and caches of bounded size that do not change results. ``key`` names the model's
    content and parameters. A worker keeps the last few.
    """
    held = sys.modules.setdefault("_passageworks_worker", ModuleType("_passageworks_worker")).__dict__.setdefault("held", {})
    if key not in held:
        while len(held) >= 3:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def fold(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def words(text: Column) -> Column:
    """Words of a text (runs without ASCII white space); none for a null text."""
    found = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(found, lambda w: w != "")
