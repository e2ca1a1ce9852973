"""Collection state on shared storage.

A collection is a folder of append-only Parquet tables, one sub-folder
``ingest=N/attempt=ID`` per run:

* ``vectors``: chunk rows with the word counts of their hashed vector, or with the
  vector of an outside encoder,
* ``log``: what a run did to each path it touched (``upsert``, ``delete``, ``drop_chunks``, or
  ``seen`` for a version that changed nothing) with the new manifest values,
* ``diff``, ``quarantine``: the run's comparison result and failed files,
* ``counters``: by how much the run changed the document frequency of each bucket,
* ``commits``: one row per finished run, written last, with the oldest run whose
  tables are still needed and the width of the vectors.

Every attempt at a run has an id of its own, and readers look only at attempts
with a commit row, so whatever a dead one left, under any number, is never read.
The table of all vectors is not rewritten by an ingest. Reading leaves out
superseded rows by an anti join; ``compact`` writes the live rows, the last log
entry of each path, the quarantine and the counters as one run, after which older
folders are no longer read.

Counters of runs add up, so hashed vectors are weighed when they are read, by the
document frequencies of the whole live collection, whatever runs brought it in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.embedding import IdfModel, counters, dense, model_of, weigh
from ..schemas import CHUNKS, COUNTS, MANIFEST, VECTORS
from ..session import path_exists

RUN = [T.StructField("ingest", T.LongType()), T.StructField("attempt", T.StringType())]
LOG = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("supersedes", T.BooleanType()),
    T.StructField("version_op", T.StringType()),
])
QUARANTINE = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("load_error", T.StringType()),
])
COUNTERS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
STORED = T.StructType([*VECTORS.fields, T.StructField("counts", COUNTS)])
COMMITS = T.StructType([
    T.StructField("batch", T.StringType()), T.StructField("base", T.LongType()), T.StructField("width", T.IntegerType()),
])


class Collection:
    """Reader and writer of one collection folder.

    Sees the runs committed at its first read, and its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._head: tuple[int, int, int | None] | None = None
        self._attempt = uuid.uuid4().hex
        self._model: IdfModel | None = None

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        full = T.StructType(schema.fields + RUN)
        where = f"{self.path}/{name}"
        if not path_exists(self.spark, where):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", where).parquet(where)

    def write(self, name: str, run: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.place(name, run))

    def read_run(self, name: str, run: int) -> DataFrame:
        """What this attempt wrote."""
        return self.spark.read.parquet(self.place(name, run))

    def place(self, name: str, run: int) -> str:
        """The folder that this attempt writes."""
        return f"{self.path}/{name}/ingest={run}/attempt={self._attempt}"

    def _commit(self) -> tuple[int, int, int | None]:
        """Last committed run, the oldest run whose vectors are live, and the width of the vectors."""
        if self._head is None:
            row = self._table("commits", COMMITS).agg(F.max(F.struct("ingest", "base", "width"))).first()[0]
            self._head = (row["ingest"], row["base"], row["width"]) if row else (0, 0, None)
        return self._head

    def last_run(self) -> int:
        return self._commit()[0]

    def committed_batch(self, batch: str) -> bool:
        return not self._table("commits", COMMITS).filter(F.col("batch") == batch).isEmpty()

    def commit(self, run: int, batch: str = "", base: int | None = None, width: int | None = None) -> None:
        _, old_base, old_width = self._commit()
        self._head, self._model = (run, old_base if base is None else base, old_width if width is None else width), None
        self.write("commits", run, self.spark.createDataFrame([(batch, *self._head[1:])], COMMITS).coalesce(1))
        self._attempt = uuid.uuid4().hex

    def _committed(self, name: str, schema: T.StructType) -> DataFrame:
        """Rows of the committed attempts from the base on, without the attempt."""
        last, base, _ = self._commit()
        live = F.col("ingest").between(base, last)
        done = self._table("commits", COMMITS).filter(live).select("ingest", "attempt")
        return self._table(name, schema).filter(live).join(done, ["ingest", "attempt"], "left_semi").drop("attempt")

    def _last_entries(self) -> DataFrame:
        """The last log entry per path that says whether it is tracked."""
        log = self._committed("log", LOG).filter(~F.col("op").isin("drop_chunks", "seen"))
        row = F.struct("op", "content_hash", "last_modified", "created_at")
        return log.groupBy("file_path").agg(F.max_by(row, "ingest").alias("row")).select("file_path", "row.*")

    def manifest(self) -> DataFrame:
        """All tracked files, the last entry per path; empty if there is none."""
        return self._last_entries().filter(F.col("op") == "upsert").drop("op")

    def last_seen(self) -> DataFrame:
        """``(file_path, seen)``: the newest version handled per path, as ``(modified_at, op, content_hash)``.

        Deletions and versions that changed nothing count.
        """
        log = self._committed("log", LOG).filter(F.col("last_modified").isNotNull())
        op = F.coalesce("version_op", F.when(F.col("op") == "delete", "delete").otherwise("upsert"))
        version = F.struct(F.col("last_modified").alias("modified_at"), op.alias("op"), "content_hash")
        return log.groupBy("file_path").agg(F.max(version).alias("seen"))

    def vectors(self) -> DataFrame:
        """Live chunk rows with their vectors; hashed ones by the weights of the whole live collection."""
        rows, model = self.stored(), self.idf()
        if model is None:
            return rows
        hashed = F.when(F.col("counts").isNotNull(), dense(weigh(F.col("counts"), model), model.dims))
        return rows.withColumn("embedding", F.coalesce("embedding", hashed))

    def stored(self) -> DataFrame:
        """Live chunk rows as they are stored: those not superseded by a later run."""
        base = self._commit()[1]
        rows = self._committed("vectors", STORED)
        later = self._committed("log", LOG).filter(F.col("supersedes") & (F.col("ingest") > base)).select(
            F.col("file_path").alias("_path"), F.col("ingest").alias("_run")
        )
        gone = (rows["file_path"] == later["_path"]) & (later["_run"] > rows["ingest"])
        return rows.join(later, gone, "left_anti").drop("ingest")

    def count(self, run: int, replaced: DataFrame) -> None:
        """Write by how much this run changes the counters: its rows against the live chunks of ``replaced``."""
        gone = self.stored().join(replaced.select("file_path").distinct(), "file_path", "left_semi")
        sides = (self.read_run("vectors", run), 1), (gone, -1)
        change = [counters(df.where("counts IS NOT NULL"), F.col("counts.buckets")).select("bucket", (F.col("n") * sign).alias("n")) for df, sign in sides]
        total = change[0].unionByName(change[1]).groupBy("bucket").agg(F.sum("n").alias("n"))
        self.write("counters", run, total.select(COUNTERS.fieldNames()).coalesce(1))

    def _edit(self, rows: DataFrame, replaced: DataFrame) -> None:
        """Commit a run of ``rows`` that supersede all chunks of the paths ``replaced``."""
        run = self.last_run() + 1
        self.write("vectors", run, rows)
        self.count(run, replaced)
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in LOG.fields[2:5]]
        self.write("log", run, replaced.select("file_path").distinct().select(
            "file_path", F.lit("drop_chunks").alias("op"), *none, F.lit(True).alias("supersedes"), F.lit(None).cast("string").alias("version_op")
        ))
        self.commit(run)

    def delete_by_file(self, paths: DataFrame) -> None:
        """J8 as a run: drop all chunks of the given ``file_path`` rows; the files stay tracked."""
        live = self.stored()
        hit = live.join(paths.select("file_path").distinct(), "file_path", "left_semi")
        self._edit(live.limit(0), hit)

    def delete_by_id(self, ids: DataFrame) -> None:
        """J7 as a run: drop the given ``chunk_id`` rows; what remains of their files is written anew."""
        live = self.stored()
        hit = live.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("file_path").distinct()
        self._edit(live.join(hit, "file_path", "left_semi").join(ids.select("chunk_id"), "chunk_id", "left_anti"), hit)

    def append(self, rows: DataFrame) -> None:
        """S8 as a run: add prepared chunk rows, one per id that is not stored yet.

        Rows with ``counts`` are weighed with the collection; others keep their vector.
        """
        live = self.stored()
        none = F.lit(None)
        counts = F.col("counts") if "counts" in rows.columns else none.cast(COUNTS)
        vector = F.when(counts.isNull(), F.col("embedding")).cast("array<float>")
        new = rows.withColumn("embedding", vector).withColumn("counts", counts).select(STORED.fieldNames())
        self._edit(new.dropDuplicates(["chunk_id"]).join(live.select("chunk_id"), "chunk_id", "left_anti"), live.limit(0))

    def compact(self) -> None:
        """Write the live state as a run of its own and read from there on."""
        run = self.last_run() + 1
        self.write("vectors", run, self.stored())
        # the newest time seen stays, so that late versions stay late
        kept = self._last_entries().withColumn("supersedes", F.lit(False)).withColumn("version_op", F.lit(None).cast("string"))
        none = F.lit(None).cast("timestamp")
        seen = self.last_seen().select(
            "file_path", F.lit("seen").alias("op"), "seen.content_hash", F.col("seen.modified_at").alias("last_modified"),
            none.alias("created_at"), F.lit(False).alias("supersedes"), F.col("seen.op").alias("version_op"),
        )
        self.write("log", run, kept.select(LOG.fieldNames()).unionByName(seen))
        self.write("quarantine", run, self.quarantine())
        self.write("counters", run, self._counters().select(COUNTERS.fieldNames()).coalesce(1))
        self.commit(run, base=run)

    def chunks(self) -> DataFrame:
        """Live chunk rows without their vectors."""
        return self.stored().select(CHUNKS.fieldNames())

    def quarantine(self) -> DataFrame:
        """The last failure per path, for paths that were not loaded or deleted since."""
        last = self._committed("quarantine", QUARANTINE).groupBy("file_path").agg(
            F.max_by("load_error", "ingest").alias("load_error"), F.max("ingest").alias("_failed")
        )
        log = self._committed("log", LOG).filter(~F.col("op").isin("drop_chunks", "seen"))
        done = log.groupBy(F.col("file_path").alias("_path")).agg(F.max("ingest").alias("_done"))
        settled = (F.col("file_path") == F.col("_path")) & (F.col("_done") > F.col("_failed"))
        return last.join(done, settled, "left_anti").select("file_path", "load_error")

    def ensure_index(self) -> DataFrame:
        """The vector table, created empty if there is none."""
        where = f"{self.path}/vectors"
        if not path_exists(self.spark, where):
            self.write("vectors", 0, self.spark.createDataFrame([], STORED))
        return self.vectors()

    def _counters(self) -> DataFrame:
        return self._committed("counters", COUNTERS).groupBy("bucket").agg(F.sum("n").alias("n"))

    def width(self) -> int | None:
        """Width of the vectors; None before the first."""
        return self._commit()[2]

    def idf(self) -> IdfModel | None:
        """Weights over all live chunks, from the counters of the committed runs; None if no run made hashed vectors."""
        if self._model is None and self.width() is not None:
            counted = self._counters().collect()
            if counted:
                self._model = model_of({r["bucket"]: r["n"] for r in counted}, self.width())
        return self._model


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of the collection at ``path`` (M3)."""
    return Collection(spark, path).manifest().select(MANIFEST.fieldNames())


def ensure_index(spark: SparkSession, path: str) -> DataFrame:
    """Vector table of the collection at ``path``."""
    return Collection(spark, path).ensure_index()
