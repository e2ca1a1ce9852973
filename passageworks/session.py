"""Scratch locations and size checks shared by the jobs."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Largest side, in rows, that a job may broadcast after counting it.
BROADCAST_ROWS = 200_000


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="passageworks-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back on a folder of this machine, because
    there driver and executors share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = _local_scratch()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores if it is too small to be cut into that many splits.

    Scans of large tables pass unchanged; a table that sits in one or two row
    groups is dealt out before per-row work. Looks at size estimates only.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < split * cores else df
