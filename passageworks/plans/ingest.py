"""Incremental ingest."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_text
from ..operators.diff import ingest_report, listing, snapshot_diff
from ..operators.embedding import postings
from ..schemas import COUNTS, Options
from ..session import fits
from ..sources.files import Folder, load_documents, quarantine
from ..sources.state import STORED, Collection


def _only(corpus: DataFrame | Folder, paths: DataFrame) -> DataFrame:
    """The rows of the given paths; of a folder, no other file is read if they are few.

    Contents of a table are read for no path at all if there is none, and move only
    for more paths than may be sent to them.
    """
    if isinstance(corpus, Folder):
        return corpus.only(paths)
    paths = paths.select("file_path")
    if paths.isEmpty():
        return corpus.limit(0)
    return corpus.join(F.broadcast(paths) if fits(paths) else paths, "file_path", "left_semi")


def _width(state: Collection, run: int, dims: int | None) -> int | None:
    """The width of the run's vectors, ``dims`` if it hashed them; an error if it is not that of all vectors."""
    widths = {dims}
    if dims is None:
        width = F.size("embedding").alias("width")
        widths = {r["width"] for r in state.read_run("vectors", run).select(width).distinct().limit(2).collect()}
    widths |= {state.width()} - {None}
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    return next(iter(widths), None)


def apply_changes(
    state: Collection,
    diff: DataFrame,
    corpus: DataFrame | Folder,
    options: Options = Options(),
    now: datetime | Column | None = None,
    batch: str = "",
    extractor=None,
    encoder=None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Load, chunk, embed and store the changed paths of ``diff`` as one run.

    ``corpus`` holds the contents. A new file that fails to load is not
    recorded, so it is new again next time. A modified file that fails loses its
    chunks and keeps its manifest entry, so it stays modified. ``seen`` holds the versions
    ``(file_path, op, content_hash, modified_at)`` that a stream has handled with this run.
    Returns the run's ``(status, n, loaded)``.
    """
    # The comparison is stored before anything else: the steps below, and a retry
    # of any of them, work on one recorded set of paths.
    run = state.last_run() + 1
    now = datetime.now(timezone.utc) if now is None else now
    state.write("diff", run, diff.filter(F.col("status") != "unchanged"))
    diff = state.read_run("diff", run)
    if diff.isEmpty() and (seen is None or seen.isEmpty()):
        return ingest_report(diff).withColumn("loaded", F.lit(0).cast("bigint"))
    changed = diff.filter(F.col("status").isin("new", "modified"))
    if run == 1:
        read = corpus.rows() if isinstance(corpus, Folder) else corpus
    else:
        read = _only(corpus, changed)
    loaded = load_documents(read, extractor)
    chunks = chunk_text(
        loaded, chunk_size=options.chunk_size, overlap=options.chunk_overlap
    )
    if encoder is None:
        # word counts are stored; the weights follow from the counters of all runs when they are read
        rows = chunks.withColumn("counts", postings(F.col("text"), options.dims)).withColumn("embedding", F.lit(None).cast("array<float>"))
    else:
        rows = encoder(chunks).withColumn("counts", F.lit(None).cast(COUNTS))
    state.write("vectors", run, rows.select(STORED.fieldNames()))
    width = _width(state, run, options.dims if encoder is None else None)
    state.count(run, diff.filter(F.col("status") != "new"))

    stored = state.read_run("vectors", run).filter(F.col("chunk_no") == 0).select(
        "file_path", F.lit(True).alias("loaded")
    )
    outcome = diff.join(stored, "file_path", "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))
    op = (
        F.when(F.col("status") == "deleted", "delete")
        .when(F.col("loaded"), "upsert")
        .when(F.col("status") == "modified", "drop_chunks")
    )
    log = outcome.withColumn("op", op).filter(F.col("op").isNotNull())
    none = F.lit(None).cast("string")
    entries = log.select(
        "file_path", "op", "content_hash", F.col("modified_at").alias("last_modified"),
        F.lit(now).alias("created_at"), (F.col("status") != "new").alias("supersedes"), none.alias("version_op"),
    )
    if seen is not None:
        entries = entries.unionByName(seen.select(
            "file_path", F.lit("seen").alias("op"), "content_hash", F.col("modified_at").alias("last_modified"),
            F.lit(None).cast("timestamp").alias("created_at"), F.lit(False).alias("supersedes"), F.col("op").alias("version_op"),
        ))
    state.write("log", run, entries)
    failed = outcome.filter((F.col("status") != "deleted") & ~F.col("loaded"))
    state.write("quarantine", run, quarantine(load_documents(_only(corpus, failed), extractor, texts=False)))
    state.commit(run, batch, width=width)
    return outcome.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if("loaded").alias("loaded")
    )


def incremental_ingest(
    spark: SparkSession,
    corpus: DataFrame | Folder,
    state_dir: str,
    options: Options = Options(),
    root: str | None = None,
    now: datetime | Column | None = None,
    extractor=None,
    encoder=None,
) -> DataFrame:
    """Bring the collection at ``state_dir`` in line with ``corpus``.

    Only hashes take part in the comparison; contents are read again for changed
    paths alone, and of a ``Folder``, which is listed once, no other file is opened for that. Without changes
    nothing is committed.
    """
    state = Collection(spark, state_dir)
    if isinstance(corpus, Folder):
        corpus = corpus.listed()
    rows = corpus.rows() if isinstance(corpus, Folder) else corpus
    diff = snapshot_diff(listing(rows), state.manifest(), root)
    return apply_changes(state, diff, corpus, options, now, "", extractor, encoder)
