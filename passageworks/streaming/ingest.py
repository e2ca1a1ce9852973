"""Continuous ingest from a log of document versions (T4).

A folder stream never reads a rewritten file again and cannot see a deletion,
so the input is a stream of versions ``(file_path, op, content, modified_at)``
with ``op`` upsert or delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import apply_changes
from ..schemas import Options
from ..session import delete_path
from ..sources.state import Collection
from ..functions.text import content_hash


def latest_versions(versions: DataFrame) -> DataFrame:
    """``(file_path, modified_at, op, content_hash)`` of the last version per path.

    Of versions of one time an upsert beats a delete and the larger hash beats the
    smaller, so the choice does not depend on the order of arrival. Contents stay
    out of the shuffle.
    """
    hashed = versions.select("file_path", _version().alias("_row"))
    return hashed.groupBy("file_path").agg(F.max("_row").alias("_row")).select("file_path", "_row.*")


def _version() -> Column:
    hashed = F.when(F.col("op") == "upsert", content_hash(F.col("content")))
    return F.struct("modified_at", "op", hashed.alias("content_hash"))


def version_diff(latest: DataFrame, manifest: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Status of each path of a batch of latest versions against the manifest.

    ``seen`` holds the newest version handled per path; versions that come before it,
    in the order of ``latest_versions``, arrive late and are left out. So the result does not depend on
    how versions are cut into batches.
    """
    last = manifest.select("file_path", F.col("content_hash").alias("last_hash"))
    if seen is not None:
        version = F.struct("modified_at", "op", "content_hash")
        latest = latest.join(seen, "file_path", "left").filter(F.col("seen").isNull() | (version > F.col("seen"))).drop("seen")
    status = (
        F.when((F.col("op") == "delete") & F.col("last_hash").isNull(), "unchanged")
        .when(F.col("op") == "delete", "deleted")
        .when(F.col("last_hash").isNull(), "new")
        .when(F.col("content_hash") != F.col("last_hash"), "modified")
        .otherwise("unchanged")
    )
    return latest.join(last, "file_path", "left").select(
        "file_path", "op", "content_hash", "last_hash", "modified_at", status.alias("status")
    )


def streaming_ingest(
    spark: SparkSession,
    versions: DataFrame,
    state_dir: str,
    checkpoint: str,
    options: Options = Options(),
    extractor=None,
    encoder=None,
) -> StreamingQuery:
    """T4: apply the stream to the collection and stop when all input is read.

    Every micro-batch is one run of the collection. Its number is stored with
    the commit, so a batch that is delivered again after a failure is skipped.
    """
    def apply(batch: DataFrame, number: int) -> None:
        state = Collection(batch.sparkSession, state_dir)
        name = f"{checkpoint}#{number}"
        if state.committed_batch(name):
            return
        run = state.last_run() + 1
        diff = version_diff(latest_versions(batch), state.manifest(), state.last_seen())
        state.write("incoming", run, diff)
        diff = state.read_run("incoming", run)
        # the contents of the chosen versions, read once and without their rivals
        changed = diff.filter(F.col("status").isin("new", "modified")).select("file_path", "modified_at", "content_hash")
        hashed = batch.filter(F.col("op") == "upsert").withColumn("content_hash", content_hash(F.col("content")))
        chosen = hashed.join(changed, ["file_path", "modified_at", "content_hash"], "left_semi")
        state.write("contents", run, chosen.dropDuplicates(["file_path"]))
        contents = state.place("contents", run)
        apply_changes(state, diff, state.read_run("contents", run), options, batch=name, extractor=extractor, encoder=encoder, seen=diff)
        delete_path(batch.sparkSession, contents)

    return (
        versions.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
