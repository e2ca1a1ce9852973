"""Approximate top-k through a stored index of cells.

``build`` trains centres on a bounded sample and writes every vector into the cell of its
nearest centre. The cell is the partition column of the stored table, so a question
opens the folders of its own cells and no others. Distances inside a cell are exact.

* *Training.* The centres start as the vectors whose ids have the least MD5, and move ``ROUNDS`` times
  to the mean direction of the sample vectors nearest to them. The sample is the
  ``SAMPLE_PER_CELL`` least MD5 values per cell, at most ``SAMPLE_ROWS`` rows; every row is indexed.
* *Size.* There are as many cells as the square root of the rows, at most ``MAX_CELLS``.
  A cell is cut into parts of about ``PART_ROWS`` rows, so neither a file nor a group grows with
  the table, however many rows one cell holds.
* *Search.* A question visits its nearest cells, and further ones until they hold ``k`` rows. With all
  cells visited the answer is exact, at any number of cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import BLOCK_BYTES, _Best, _Block, _block_of, _deal, _directed, _hit_schema, _late, _matrix, _present, _rank, _score_groups, _slot, _unit

#: Most cells, most rows of the training sample and its rows per cell, moves of the centres.
MAX_CELLS, SAMPLE_ROWS, SAMPLE_PER_CELL, ROUNDS = 4096, 65_536, 64, 2
#: Rows in a part of a cell.
PART_ROWS = 50_000
#: Share of all cells that a question visits unless told otherwise.
SHARE = 0.75


def train(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres; the first rows of ``sample`` (unit vectors) are where they start."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        for cell in range(len(centres)):
            mean = sample[near == cell].mean(axis=0) if (near == cell).any() else centres[cell]
            length = np.linalg.norm(mean)
            if length > 0:
                centres[cell] = mean / length
    return centres


def _assign(vectors: DataFrame, vec_col: str, centres: np.ndarray) -> DataFrame:
    """The rows that have a direction, with the ``cell`` of their nearest centre."""
    schema = T.StructType(vectors.schema.fields + [T.StructField("cell", T.IntegerType())])
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            part = _present(batch, vec_col)
            unit, alive = _unit(_matrix(part.column(part.schema.get_field_index(vec_col)), shared.value.shape[1]))
            cells = np.argmax(unit @ shared.value.T, axis=1).astype(np.int32)
            yield part.filter(pa.array(alive)).append_column("cell", pa.array(cells))

    return vectors.mapInArrow(assign, schema)


class CellIndex:
    """A stored index: ``centres`` (one small row per cell) and ``rows`` by ``cell``."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "chunk_id", vec_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vec_col = spark, path, id_col, vec_col
        self._centres: np.ndarray | None = None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "chunk_id", vec_col: str = "embedding", cells: int | None = None) -> CellIndex:
        """Train on a sample of ``vectors`` and write all of them to a new folder."""
        index = cls(vectors.sparkSession, path, id_col, vec_col)
        if cells is None:
            cells = min(MAX_CELLS, math.ceil(math.sqrt(vectors.count())))
        lot = vectors.select(F.md5(F.col(id_col).cast("string")).alias("_lot"), vec_col)
        sample = lot.orderBy("_lot").limit(min(SAMPLE_ROWS, SAMPLE_PER_CELL * max(1, cells))).select(vec_col).toArrow()
        sample = _present(sample, vec_col)
        unit = _unit(_matrix(sample.column(vec_col), None))[0]
        centres = train(unit, max(1, cells)) if len(unit) else np.zeros((1, 1))
        schema = "cell INT, centre ARRAY<DOUBLE>"
        index.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], schema).coalesce(1).write.parquet(f"{path}/centres")
        empty = vectors.limit(0).withColumn("part", F.lit(0)).withColumn("cell", F.lit(0))
        empty.write.parquet(f"{path}/shape")
        index.add(vectors)
        return index

    def centres(self) -> np.ndarray:
        if self._centres is None:
            rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
            self._centres = np.array([r["centre"] for r in rows])
        return self._centres

    def add(self, vectors: DataFrame) -> None:
        """Append rows to the cells that the stored centres give them."""
        placed = _assign(vectors, self.vec_col, self.centres())
        # cells are dealt by size: the counts are one number per cell, and the second reading
        # of the source costs less than shuffling a crowded cell into one file
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        parts = self.spark.createDataFrame([(c, _deal(n, PART_ROWS)) for c, n in sizes.items()], "cell INT, parts INT")
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(self.id_col), F.col("parts")).cast("int")).drop("parts")
        dealt.repartition("cell", "part").write.partitionBy("cell").mode("append").parquet(f"{self.path}/rows")
        counts = self.spark.createDataFrame(list(sizes.items()), "cell INT, n LONG")
        counts.coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The stored rows of some cells; other cells are not listed or read."""
        stored = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/shape").schema).parquet(f"{self.path}/rows")
        return stored if cells is None else stored.where(F.col("cell").isin(cells))

    def _sizes(self) -> np.ndarray:
        out = np.zeros(len(self.centres()), np.int64)
        for r in self.spark.read.parquet(f"{self.path}/sizes").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r["cell"]] = r["n"]
        return out

    def search(
        self, queries: DataFrame, k: int = 4, visits: int | None = None, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES,
    ) -> DataFrame:
        """``(query_id, rank, id, *carry, distance)`` of the best ``k`` rows in the cells that a question visits.

        ``visits`` is the least number of cells; all cells make the answer exact.
        """
        centres, sizes, id_col, vec_col = self.centres(), self._sizes(), self.id_col, self.vec_col
        visits = math.ceil(SHARE * len(centres)) if visits is None else min(visits, len(centres))
        queries = queries.select("query_id", vec_col)
        if not sizes.any():
            queries = queries.limit(0)
        schema = _hit_schema(self.rows(), queries, id_col)
        width = centres.shape[1]

        def opened(unit: np.ndarray) -> np.ndarray:
            """Which cells each question visits."""
            order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            use = (np.arange(len(centres)) < visits) | (before < k)
            out = np.zeros(use.shape, bool)
            np.put_along_axis(out, order, use, axis=1)
            return out & (sizes > 0)

        most = max(1, block_bytes // (8 * width))
        head = queries.limit(most + 1).toArrow()
        if head.num_rows <= most:
            block = _block_of(head, vec_col, width) if head.num_rows else _Block(pa.array([], head.schema.field("query_id").type), np.empty((0, width)))
            open_cells = opened(block.unit)
            wanted = np.flatnonzero(open_cells.any(axis=0)).tolist()
            shared = self.spark.sparkContext.broadcast((block.ids, block.unit, open_cells))

            def score(batches):
                ids, unit, open_cells = shared.value
                best = _Best(_Block(ids, unit), k, id_col)
                for rows, vectors in _directed(batches, vec_col, width):
                    cells = rows.column("cell").to_numpy()
                    rows = rows.drop_columns(["cell"])
                    for cell in np.unique(cells):
                        here = np.flatnonzero(cells == cell)
                        best.add(rows.take(pa.array(here)), vectors[here], np.flatnonzero(open_cells[:, cell]))
                yield from best.batches()

            partial = self.rows(wanted).select(id_col, vec_col, "cell").mapInArrow(score, schema)
        else:
            visited = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])

            def visit(batches):
                for batch in batches:
                    part = _present(batch, vec_col)
                    unit, alive = _unit(_matrix(part.column(part.schema.get_field_index(vec_col)), width))
                    at, cell = np.nonzero(opened(unit))
                    yield part.filter(pa.array(alive)).take(pa.array(at)).append_column("cell", pa.array(cell.astype(np.int32)))

            # every part of a cell meets every part of the questions that visit it
            q_parts = _deal(queries.count(), most)
            asked = queries.mapInArrow(visit, visited).withColumn("_q", _slot(q_parts, "query_id"))
            stored = self.rows().select(id_col, vec_col, "cell", F.col("part").alias("_v"))
            places = self.rows().select("cell", F.col("part").alias("_v")).distinct()
            left = stored.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
            partial = _score_groups(left, asked.join(places, "cell"), ["cell", "_v", "_q"], k, id_col, vec_col, width, schema)
        return _late(_rank(partial, id_col, k), self.rows(), id_col, carry)


def approx_topk(vectors: DataFrame, queries: DataFrame, path: str, k: int = 4, visits: int | None = None, id_col: str = "chunk_id", vec_col: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """Index ``vectors`` at ``path`` and answer ``queries`` from there."""
    return CellIndex.build(vectors, path, id_col, vec_col).search(queries, k, visits, carry)
