"""Snapshot comparison and manifest maintenance.

All operators work on the key and hash columns only; file contents never take
part in a join. Paths are the keys of both tables, so no key is hot, and no
side is hinted for broadcast: Spark chooses from the sizes it measures.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "file_path"


def listing(corpus: DataFrame) -> DataFrame:
    """``(file_path, content_hash, modified_at)`` of a corpus table."""
    from ..functions.text import content_hash

    return corpus.select(KEY, content_hash(F.col("content")).alias("content_hash"), "modified_at")


def new_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed now, not in the manifest."""
    return current.select(KEY).join(manifest.select(KEY), KEY, "left_anti")


def deleted_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """In the manifest, not listed now."""
    return manifest.select(KEY).join(current.select(KEY), KEY, "left_anti")


def modified_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """In both, with another hash. Modification times are not compared."""
    last = manifest.select(KEY, F.col("content_hash").alias("last_hash"))
    return (
        current.select(KEY, "content_hash")
        .join(last, KEY)
        .filter(F.col("content_hash") != F.col("last_hash"))
    )


def snapshot_diff(current: DataFrame, manifest: DataFrame, root: str | None = None) -> DataFrame:
    """One row per path with ``status`` new, modified, deleted or unchanged.

    The manifest covers every scanned folder, so files of other folders count
    as deleted; ``root`` restricts the comparison to paths below one folder.
    """
    if root is not None:
        manifest = manifest.filter(F.col(KEY).startswith(root.rstrip("/") + "/"))
    last = manifest.select(KEY, F.col("content_hash").alias("last_hash"))
    extra = [c for c in current.columns if c not in (KEY, "content_hash")]
    status = (
        F.when(F.col("last_hash").isNull(), "new")
        .when(F.col("content_hash").isNull(), "deleted")
        .when(F.col("content_hash") != F.col("last_hash"), "modified")
        .otherwise("unchanged")
    )
    return current.join(last, KEY, "full_outer").select(
        KEY, "content_hash", "last_hash", *extra, status.alias("status")
    )


def ingest_report(diff: DataFrame) -> DataFrame:
    """A1: number of paths per status."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def manifest_upsert(
    manifest: DataFrame, delta: DataFrame, now: datetime | Column, order: str | None = None
) -> DataFrame:
    """Replace or add the rows of ``delta``; replaced rows get a new ``created_at``.

    When ``delta`` holds a path several times, the row with the largest
    ``order`` wins. The choice is an aggregate, so it combines before the
    shuffle even if one path fills most of the delta.
    """
    row = F.struct("content_hash", "last_modified")
    rank = F.struct(order or "last_modified", "content_hash")
    created = now if isinstance(now, Column) else F.lit(now)
    latest = (
        delta.groupBy(KEY)
        .agg(F.max_by(row, rank).alias("row"))
        .select(KEY, "row.content_hash", "row.last_modified", created.alias("created_at"))
    )
    return manifest_delete(manifest, latest).unionByName(latest)


def manifest_delete(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """The manifest without ``paths``."""
    return manifest.join(paths.select(KEY), KEY, "left_anti")


def lookup(manifest: DataFrame, paths: DataFrame, columns: list[str]) -> DataFrame:
    """Manifest columns for a table of paths; null for an unknown path."""
    return paths.select(KEY).join(manifest.select(KEY, *columns), KEY, "left")
