"""Daily history of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.answering import render_history


def write_history(pairs: DataFrame, path: str, day: Column | None = None) -> None:
    """Append rendered exchanges to the folder of their day."""
    dated = pairs.withColumn("day", day) if day is not None else pairs
    render_history(dated).withColumn("day", F.date_format("day", "yyyy-MM-dd")).write.mode(
        "append"
    ).partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
