"""Exact top-k through a stored posting table with block maxima.

Chunks that lie side by side form blocks of ``BLOCK`` chunks. A stored row is one block: its postings by
bucket (which chunks of the block have the bucket, with what weight) and, per bucket, the
largest of these weights. The sum of a question's weights times the maxima bounds the score of every
chunk in the block, so a question opens a block, and looks at single postings, only
if that bound reaches the ``k``-th best score it has found so far.

A bucket that every chunk has lies in all blocks and not in one list, so there is no hot
bucket: blocks are rows, and Spark deals rows. Nothing is emitted per bucket and pair of chunk and
question; a task emits its best ``k`` per question. Hashed features fill a fifth of the buckets, which makes
maxima of large blocks useless; with four chunks a block about half of the pairs stay shut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embedding import IdfModel, hashed_features
from .retrieval import BLOCK_BYTES, GROUP_ROWS, STEPS, _Block, _block_of, _late, _matrix, _rank, _score_blocks, _unit

#: Chunks in a block.
BLOCK = 4
#: Blocks that are bounded at a time; thresholds rise in between.
AT_ONCE = 256
#: Bounds and scores are sums in different order; this is far above what that can change.
SLACK = 1e-8
POSTING = "array<struct<bucket: int, top: double, slots: array<int>, weights: array<double>>>"


def _flat(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _as_blocks(ids: pa.Array, features: pa.Array) -> pa.RecordBatch:
    """Blocks of ``BLOCK`` neighbouring chunks each; chunks without words are left out."""
    lengths = np.diff(features.field("buckets").offsets.to_numpy())
    ids, features = ids.filter(pa.array(lengths > 0)), features.filter(pa.array(lengths > 0))
    unit = _unit(_matrix(features, int(max(features.field("buckets").flatten().to_numpy(), default=0)) + 1))[0]
    rows, bucket = np.nonzero(unit)
    order = np.lexsort((rows, bucket, rows // BLOCK))
    rows, bucket = rows[order], bucket[order]
    weight = unit[rows, bucket]
    block = rows // BLOCK
    starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(bucket) != 0)]) if len(rows) else np.empty(0, np.int64)
    ends = np.r_[starts, len(rows)].astype(np.int32)
    n = -(-len(ids) // BLOCK)
    entries = pa.StructArray.from_arrays(
        [
            pa.array(bucket[starts].astype(np.int32)), pa.array(np.maximum.reduceat(weight, starts) if len(starts) else weight),
            pa.ListArray.from_arrays(pa.array(ends), pa.array((rows % BLOCK).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(weight)),
        ],
        names=["bucket", "top", "slots", "weights"],
    )
    cuts = np.r_[np.searchsorted(block[starts], np.arange(n)), len(starts)].astype(np.int32)
    names = np.minimum(np.arange(n + 1) * BLOCK, len(ids)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(names), ids), pa.ListArray.from_arrays(pa.array(cuts), entries)], names=["ids", "postings"])


class _Blocks:
    """The blocks of some rows: bucket maxima as a matrix, postings as flat arrays."""

    def __init__(self, ids: pa.Array, postings: pa.Array, dims: int):
        self.ids, self.dims = ids, dims
        per_block = np.diff(postings.offsets.to_numpy())
        entries = postings.flatten()
        self.block = np.repeat(np.arange(len(per_block)), per_block)
        self.bucket = entries.field("bucket").to_numpy(zero_copy_only=False)
        self.tops = np.zeros((len(per_block), dims))
        self.tops[self.block, self.bucket] = entries.field("top").to_numpy(zero_copy_only=False)
        slots = entries.field("slots")
        sizes = np.diff(slots.offsets.to_numpy())
        self.slot = slots.flatten().to_numpy(zero_copy_only=False)
        self.weight = entries.field("weights").flatten().to_numpy(zero_copy_only=False)
        self.posting_block = np.repeat(self.block, sizes)
        self.posting_bucket = np.repeat(self.bucket, sizes)
        self.first = ids.offsets.to_numpy() - ids.offsets.to_numpy()[0]

    def opened(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each chunk of the given blocks, its block's place in ``blocks``, and its weights by bucket."""
        sizes = np.diff(self.first)[blocks]
        start = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(blocks)), sizes)
        place = self.first[blocks][of] + np.arange(len(of)) - start[of]
        where = np.full(len(self.tops), -1)
        where[blocks] = np.arange(len(blocks))
        mine = where[self.posting_block] >= 0
        weights = np.zeros((len(of), self.dims))
        weights[start[where[self.posting_block[mine]]] + self.slot[mine], self.posting_bucket[mine]] = self.weight[mine]
        return place, of, weights


def _scores(weights: np.ndarray, question: np.ndarray) -> np.ndarray:
    """Scores of opened chunks for one question."""
    return weights @ question


def _winners(batches: Iterator[pa.RecordBatch], block: _Block, k: int, id_col: str, vec_col: str) -> Iterator[pa.RecordBatch]:
    """Partial top-k of a stream of blocks for all questions of the block."""
    n, dims = block.unit.shape
    best: list[tuple[np.ndarray, list]] = [(np.empty(0, np.int64), []) for _ in range(n)]
    reach = np.full(n, -np.inf)
    kind = None
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(first, AT_ONCE)
            ids = _flat(part.column(part.schema.get_field_index(id_col)))
            kind = ids.type.value_type
            blocks = _Blocks(ids, _flat(part.column(part.schema.get_field_index(vec_col))), dims)
            names = ids.flatten()
            open_ = blocks.tops @ block.unit.T >= reach - SLACK
            some = np.flatnonzero(open_.any(axis=1))
            place, of, weights = blocks.opened(some)
            for q in np.flatnonzero(open_.any(axis=0)):
                at = np.flatnonzero(open_[some[of], q])
                steps = np.rint((1.0 - _scores(weights[at], block.unit[q])) * STEPS).astype(np.int64)
                had, named = best[q]
                if len(had) == k:
                    use = steps <= had[-1]
                    at, steps = at[use], steps[use]
                if not len(at):
                    continue
                steps, named = np.concatenate([had, steps]), named + names.take(pa.array(place[at])).to_pylist()
                order = sorted(range(len(named)), key=lambda i: (steps[i], named[i]))[:k]
                best[q] = steps[order], [named[i] for i in order]
                if len(order) == k:
                    # the k-th best distance in steps, as a score that is a little too low
                    reach[q] = 1.0 - (best[q][0][-1] + 1) / STEPS
    if kind is None:
        return
    counts = [len(s) for s, _ in best]
    yield from pa.table({
        id_col: pa.array([i for _, named in best for i in named], kind),
        "query_id": block.ids.take(pa.array(np.repeat(np.arange(n), counts))),
        "distance": pa.array(np.concatenate([s for s, _ in best]) / STEPS if n else np.empty(0)),
    }).to_batches()


class PostingIndex:
    """A stored posting table of chunks with sparse ``features``."""

    def __init__(self, spark: SparkSession, path: str, dims: int, id_col: str = "chunk_id"):
        self.spark, self.path, self.dims, self.id_col = spark, path, dims, id_col

    @classmethod
    def build(cls, chunks: DataFrame, path: str, dims: int, id_col: str = "chunk_id", feature_col: str = "features") -> PostingIndex:
        """Write the blocks of ``chunks`` to a new folder.

        Neighbours in a batch share a block, which needs no shuffle. Chunks without words have no
        direction and are left out.
        """
        rows = chunks.select(id_col, feature_col)
        schema = T.StructType([T.StructField(id_col, T.ArrayType(rows.schema[id_col].dataType)), T.StructField("postings", T._parse_datatype_string(POSTING))])

        def build(batches):
            for batch in batches:
                blocks = _as_blocks(*(batch.column(batch.schema.get_field_index(c)) for c in (id_col, feature_col)))
                yield blocks.rename_columns([id_col, "postings"])

        rows.mapInArrow(build, schema).write.parquet(f"{path}/blocks")
        return cls(chunks.sparkSession, path, dims, id_col)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def search(self, asked: DataFrame, k: int = 4, feature_col: str = "features", block_bytes: int = BLOCK_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
        """``(query_id, rank, id, distance)`` for questions with sparse ``features``."""
        blocks, id_col, width = self.blocks(), self.id_col, self.dims
        asked = asked.select("query_id", F.col(feature_col).alias("postings"))
        kind = blocks.schema[id_col].dataType.elementType
        schema = T.StructType([T.StructField(id_col, kind), asked.schema["query_id"], T.StructField("distance", T.DoubleType())])
        most = max(1, block_bytes // (8 * width))
        head = asked.limit(most + 1).toArrow()
        if head.num_rows <= most:
            block = _block_of(head, "postings", width)
            shared = self.spark.sparkContext.broadcast((block.ids, block.unit))

            def score(batches):
                yield from _winners(batches, _Block(*shared.value), k, id_col, "postings")

            partial = blocks.select(id_col, "postings").mapInArrow(score, schema)
        else:
            rows = blocks.select(id_col, "postings")
            partial = _score_blocks(rows, asked, k, id_col, "postings", width, schema, most, max(1, group_rows // BLOCK), _winners, GROUP_ROWS // BLOCK)
        return _rank(partial, id_col, k)


def inverted_topk(
    chunks: DataFrame, questions: DataFrame, model: IdfModel, path: str, k: int = 4, carry: tuple[str, ...] = (), feature_col: str = "features",
) -> DataFrame:
    """Index ``chunks`` with sparse features at ``path`` and answer ``(query_id, text)`` from there."""
    index = PostingIndex.build(chunks, path, model.dims, feature_col=feature_col)
    hits = index.search(hashed_features(questions, model, output=feature_col), k, feature_col)
    return _late(hits, chunks, "chunk_id", carry)
