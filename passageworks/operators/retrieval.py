"""Top-k retrieval by cosine distance.

Question-chunk pairs never become rows. Tasks multiply a slice of chunk
vectors with a block of question vectors and keep the best ``k`` chunks per
question; only those partial winners are shuffled and ranked.

* Few questions (their matrix is counted and measured first): the block is
  broadcast and the chunk table is scanned in place, without a shuffle.
* More questions: chunks and questions are dealt into blocks of bounded size
  and every block pair is scored by one cogroup.

Only ids and distances are scored, shuffled and ranked: first among the winners
of a group of tasks, then per question, so no task ranks what all tasks found for a
question. Other columns of a hit are joined to the final ``k`` rows.

Distances are compared in steps of 1e-9 with the chunk id as tie-break, so the
ranking does not depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine_distance
from .embedding import IdfModel, hashed_embedding, hashed_features

#: Bytes of question vectors that one task may hold.
BLOCK_BYTES = 32 << 20
#: Chunk vectors per group where both sides are dealt into blocks.
GROUP_ROWS = 50_000
#: Blocks that a side is cut into before they grow, up to the two sizes above. With small blocks of a
#: fixed size every row would be sent to as many groups as the other side has blocks.
MOST_BLOCKS = 16
#: Scores computed at a time in a task.
SCORE_CELLS = 4_000_000
#: Marks a question without ``k`` rows so far.
UNKNOWN = np.iinfo(np.int64).max
#: Groups of tasks whose winners are ranked before all of a question's are.
RANK_GROUPS = 64
#: Steps per unit of distance in comparisons.
STEPS = 1_000_000_000


@dataclass
class _Block:
    """Question ids and their unit vectors."""

    ids: pa.Array
    unit: np.ndarray


def _matrix(column: pa.Array, dims: int | None) -> np.ndarray:
    """Vectors of an Arrow column: dense lists, or structs of buckets and weights."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if pa.types.is_struct(column.type):
        buckets, weights = column.field("buckets"), column.field("weights")
        if column.offset:
            buckets, weights = buckets.slice(column.offset, n), weights.slice(column.offset, n)
        out = np.zeros((n, dims))
        rows = np.repeat(np.arange(n), pc.list_value_length(buckets).to_numpy(zero_copy_only=False))
        out[rows, buckets.flatten().to_numpy(zero_copy_only=False)] = weights.flatten().to_numpy(
            zero_copy_only=False
        )
        return out
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = dims or (len(flat) // n if n else 0)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if n and not (lengths == width).all():
        raise ValueError(f"expected vectors of width {width}")
    return flat.reshape(n, width)


def _present(rows, vec_col: str):
    """Rows that have a vector."""
    column = rows.column(rows.schema.get_field_index(vec_col))
    return rows.filter(pc.is_valid(column)) if column.null_count else rows


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to unit length, and which rows had a length."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    alive = length > 0
    return matrix[alive] / length[alive, None], alive


class _Best:
    """The best ``k`` rows per question seen so far in a task.

    Rows that cannot enter the ranking any more are not even copied, so most
    batches of a long scan add little: once every question has ``k`` rows, only scores
    that reach the last of them are ranked. Memory is bounded by the block.
    """

    def __init__(self, block: _Block, k: int, id_col: str):
        self.block, self.k, self.id_col = block, k, id_col
        self.kept: list[pa.Table] = []
        self.pending = 0
        self.limit = 4 * k * len(block.ids) + 10_000
        self.worst = np.full(len(block.ids), UNKNOWN)

    def add(self, rows: pa.Table, unit: np.ndarray, asked: np.ndarray) -> None:
        """Score ``rows``, whose unit vectors are given, for the questions ``asked``."""
        order = pc.sort_indices(rows.column(0)).to_numpy()
        n = len(order)
        ordered = unit[order].T
        at_once = max(1, SCORE_CELLS // n)
        for start in range(0, len(asked), at_once):
            some = asked[start:start + at_once]
            q, at, reached = self._near(self.block.unit[some] @ ordered, self.worst[some], some)
            if not len(q):
                continue
            part = rows.take(pa.array(order[at])).append_column("_q", pa.array(some[q]))
            self.kept.append(part.append_column("_steps", pa.array(reached)))
            self.pending += part.num_rows
            if self.pending > self.limit:
                self._shrink()

    def _near(self, score: np.ndarray, worst: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """Question, row and steps of the scores that may be among the best; at least all that are."""
        n = score.shape[1]
        if n >= 32 * self.k and (worst == UNKNOWN).any():
            # the k-th best of a part of the rows bounds the k-th best of all
            part = n // 4
            last = np.partition(score[:, :part], part - self.k, axis=1)[:, part - self.k]
            worst = np.minimum(worst, np.rint((1.0 - last) * STEPS).astype(np.int64))
            self.worst[some] = worst
        if (worst < UNKNOWN).all():
            # a step more than needed, for what rounding may take away
            hit = ~(score < (1.0 - (worst + 1) / STEPS)[:, None])
            if np.count_nonzero(hit) <= 8 * self.k * len(some):
                q, at = np.nonzero(hit)
                steps = np.rint((1.0 - score[q, at]) * STEPS).astype(np.int64)
                use = steps <= worst[q]
                return q[use], at[use], steps[use]
        steps = np.rint((1.0 - score) * STEPS).astype(np.int64)
        if self.k < n:
            # position in id order breaks ties; it makes every key of a question distinct
            top = np.argpartition(steps * n + np.arange(n), self.k - 1, axis=1)[:, :self.k]
        else:
            top = np.broadcast_to(np.arange(n), steps.shape)
        reached = np.take_along_axis(steps, top, axis=1)
        if self.k <= n:
            self.worst[some] = np.minimum(worst, reached.max(axis=1))
        use = reached <= worst[:, None]
        return np.nonzero(use)[0], top[use], reached[use]

    def _shrink(self) -> None:
        table = pa.concat_tables(self.kept).sort_by(
            [("_q", "ascending"), ("_steps", "ascending"), (self.id_col, "ascending")]
        )
        q = table.column("_q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = place == self.k - 1
        self.worst[q[last]] = table.column("_steps").to_numpy()[last]
        self.kept = [table.filter(pa.array(place < self.k))]
        self.pending = self.kept[0].num_rows

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.kept:
            return
        self._shrink()
        best = self.kept[0].combine_chunks()
        ids = self.block.ids.take(pa.array(best.column("_q").to_numpy()))
        distance = pa.array(best.column("_steps").to_numpy() / STEPS)
        best = best.drop_columns(["_q", "_steps"])
        yield from best.append_column("query_id", ids).append_column("distance", distance).to_batches()


def _directed(
    batches: Iterator[pa.RecordBatch], vec_col: str, dims: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that have a direction, without their vector, and their unit vectors."""
    for batch in batches:
        part = _present(batch, vec_col)
        unit, alive = _unit(_matrix(part.column(part.schema.get_field_index(vec_col)), dims))
        rows = pa.Table.from_batches([part]).drop_columns([vec_col]).filter(pa.array(alive))
        if rows.num_rows:
            yield rows, unit


def _winners(
    batches: Iterator[pa.RecordBatch], block: _Block, k: int, id_col: str, vec_col: str
) -> Iterator[pa.RecordBatch]:
    """Partial top-k of a stream of chunk rows for all questions of the block."""
    best = _Best(block, k, id_col)
    everyone = np.arange(len(block.ids))
    for rows, unit in _directed(batches, vec_col, block.unit.shape[1]):
        best.add(rows, unit, everyone)
    yield from best.batches()


def _block_of(table: pa.Table, vec_col: str, dims: int | None) -> _Block:
    table = _present(table, vec_col)
    ids = table.column("query_id").combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], ids.type)
    unit, alive = _unit(_matrix(table.column(vec_col), dims))
    return _Block(ids.filter(pa.array(alive)), unit)


def _rank(partial: DataFrame, id_col: str, k: int) -> DataFrame:
    """K2: rank per question over the partial winners, in two levels."""
    group = F.pmod(F.spark_partition_id(), F.lit(RANK_GROUPS))

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("distance", id_col)
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    some = ranked(partial.withColumn("_group", group), "query_id", "_group").drop("rank", "_group")
    return ranked(some, "query_id").select("query_id", "rank", id_col, "distance")


def _late(hits: DataFrame, table: DataFrame, id_col: str, carry: tuple[str, ...]) -> DataFrame:
    """The hits with the columns ``carry`` of the table they were found in.

    Of rows that share an id, each gives a hit.
    """
    extra = [c for c in dict.fromkeys(carry) if c != id_col]
    if not extra:
        return hits
    return hits.join(table.select(id_col, *extra), id_col).select("query_id", "rank", id_col, *extra, "distance")


def _hit_schema(vectors: DataFrame, queries: DataFrame, id_col: str) -> T.StructType:
    question = T.StructField("query_id", queries.schema["query_id"].dataType)
    return T.StructType([vectors.schema[id_col], question, T.StructField("distance", T.DoubleType())])


def _width(vectors: DataFrame, vec_col: str) -> int:
    """Width of the first vector; stops at the first row that has one."""
    first = vectors.select(F.size(vec_col).alias("n")).filter("n > 0").first()
    return first["n"] if first else 1


def topk_batch(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 4,
    where=None,
    id_col: str = "chunk_id",
    vec_col: str = "embedding",
    carry: tuple[str, ...] = (),
    dims: int | None = None,
    block_bytes: int = BLOCK_BYTES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """K2: the ``k`` nearest rows of ``vectors`` for each row of ``queries``.

    ``queries`` has ``query_id`` and ``vec_col``. ``where`` (P5) is a predicate
    on the vector table and reaches its scan. ``carry`` (P7) names the columns
    returned with a hit; the vector never leaves the task that scored it.
    ``dims`` is needed for sparse features only. Ids are the key of the table.

    Counts the questions once to choose between a broadcast block and blocks on
    both sides. Those have ``block_bytes / 2`` of question vectors and ``group_rows`` rows;
    where that makes more than ``MOST_BLOCKS`` of them, they grow up to the default sizes.
    """
    if where is not None:
        vectors = vectors.filter(where)
    # missing vectors are dropped in the tasks: a filter on a computed vector
    # would be pushed below the steps that compute it and repeat all of them
    table, vectors = vectors, vectors.select(id_col, vec_col)
    queries = queries.select("query_id", vec_col)
    schema = _hit_schema(vectors, queries, id_col)

    width = dims or _width(queries, vec_col)
    most = max(1, block_bytes // (8 * width))
    head = queries.limit(most + 1).toArrow()
    if head.num_rows <= most:
        block = _block_of(head, vec_col, width)
        # plain arrays: a broadcast value cannot carry classes to the workers
        shared = vectors.sparkSession.sparkContext.broadcast((block.ids, block.unit))

        def score(batches):
            block = _Block(*shared.value)
            if len(block.ids):
                yield from _winners(batches, block, k, id_col, vec_col)
            else:
                for _ in batches:
                    pass

        partial = vectors.mapInArrow(score, schema)
    else:
        partial = _score_blocks(vectors, queries, k, id_col, vec_col, width, schema, most, group_rows)
    return _late(_rank(partial, id_col, k), table, id_col, carry)


def _score_groups(vectors, queries, cell, k, id_col, vec_col, width, schema, winners=_winners) -> DataFrame:
    """Score the rows of both sides that share the columns ``cell``."""

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.name for f in schema.fields]
        out = []
        if left.num_rows and right.num_rows:
            block = _block_of(right, vec_col, width)
            if len(block.ids):
                batches = left.drop_columns(cell).to_batches()
                out = list(winners(iter(batches), block, k, id_col, vec_col))
        if out:
            return pa.Table.from_batches(out).select(names)
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})

    # both sides may come from one table: new names for its columns keep them apart in the plan
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))
    return vectors.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(score, schema)


def _deal(rows: int, per_group: int) -> int:
    return max(1, -(-rows // per_group))


def _blocks(rows: int, size: int, bound: int) -> int:
    """Blocks of ``size`` rows; of more, up to ``bound``, where these would be many."""
    return _deal(rows, max(size, min(bound, _deal(rows, MOST_BLOCKS))))


def _slot(n: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _score_blocks(vectors, queries, k, id_col, vec_col, width, schema, most, group_rows, winners=_winners, bound=GROUP_ROWS) -> DataFrame:
    """Every block of chunks meets every block of questions in one group.

    The scores are as many as pairs, but rows move to a bounded number of groups until blocks have their full size.
    """
    v_blocks = _blocks(vectors.count(), group_rows, bound)
    q_blocks = _blocks(queries.count(), max(1, most // 2), BLOCK_BYTES // (16 * width))
    left = vectors.withColumn("_v", _slot(v_blocks, id_col)).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    right = queries.withColumn("_q", _slot(q_blocks, "query_id")).withColumn(
        "_v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))
    )
    return _score_groups(left, right, ["_v", "_q"], k, id_col, vec_col, width, schema, winners)


def topk_by_vector(
    vectors: DataFrame,
    vector: list[float],
    k: int = 4,
    id_col: str = "chunk_id",
    vec_col: str = "embedding",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """K1: the ``k`` rows nearest to one vector, without a full sort."""
    distance = F.round(cosine_distance(F.col(vec_col), F.lit([float(x) for x in vector])), 9) + F.lit(0.0)
    scored = vectors.select(id_col, *carry, distance.alias("distance"))
    return scored.filter("distance IS NOT NULL").orderBy("distance", id_col).limit(k)


def topk_by_text(
    vectors: DataFrame, questions: DataFrame, model: IdfModel, k: int = 4, carry: tuple[str, ...] = ()
) -> DataFrame:
    """K3: like ``topk_batch`` for questions given as ``(query_id, text)``."""
    return topk_batch(vectors, hashed_embedding(questions, model), k, carry=carry)


def topk_by_features(
    chunks: DataFrame,
    questions: DataFrame,
    model: IdfModel,
    k: int = 4,
    carry: tuple[str, ...] = (),
    feature_col: str = "features",
) -> DataFrame:
    """K3 for chunks with sparse features ``(buckets, weights)``, scored during their scan."""
    asked = hashed_features(questions, model, output=feature_col)
    return topk_batch(chunks, asked, k, carry=carry, vec_col=feature_col, dims=model.dims)


def delete_chunks_by_id(vectors: DataFrame, ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The vector table without the given chunk ids; unknown ids change nothing."""
    return vectors.join(ids.select(id_col), id_col, "left_anti")


def delete_chunks_by_file(vectors: DataFrame, paths: DataFrame, key: str = "file_path") -> DataFrame:
    """The vector table without all chunks of the given files.

    The anti join keeps the chunk side as its streamed side, which adaptive
    execution may split when one file holds a large share of all chunks.
    """
    return vectors.join(paths.select(key), key, "left_anti")


def vector_append(vectors: DataFrame, new: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Add rows whose id is not present yet, so that a repeated append changes nothing.

    Of several new rows with one id one is added.
    """
    added = new.dropDuplicates([id_col]).join(vectors.select(id_col), id_col, "left_anti")
    return vectors.unionByName(added.select(vectors.columns))


def replace_chunks(vectors: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """The chunks of every file in ``new`` replaced by those of ``new``."""
    paths = new.select(key).distinct()
    return delete_chunks_by_file(vectors, paths, key).unionByName(new.select(vectors.columns))
