"""Exact top-k by inner product: three phases with one threshold for all lists.

A vector's components are cut into ``lists`` runs of neighbours, stored as columns of
their own. The score of a row is the sum of its partial scores in the lists, as if
each list lived on another machine; a phase reads one list at a time.

1. *Gather.* Each list names its ``DEPTH * k`` best rows per query by partial score. Their
   whole scores are resolved; the ``k``-th best of them is a score that the answer must
   reach: ``tau``.
2. *Cut.* A row whose partial scores all lie below ``tau / lists`` has a score below
   ``tau``. So the cutoff goes out with the queries, and every list returns all entries
   at or above it. Entries add up per query and row; what is missing of a row lies below the
   cutoff, which bounds its score from above. The ``k``-th best of the complete rows may
   raise ``tau``, and rows whose bound does not reach it go.
3. *Resolve.* The missing partial scores of the rows left are looked up, and the ``k`` best
   whole scores are the answer.

Nothing is lost at ties: bounds are compared with "at least". Queries meet rows in slices
and blocks of bounded size; no pair of a query and a row exists outside a matrix of
partial scores unless its entry passes the cutoff.

Rows that are equal count once. A row does not answer a query of its own id. Of rows with equal
vectors the ``k + 1`` least ids take part, because the others cannot be among the first ``k``;
so a vector that a third of all rows share does not fill the lists. A null id is a candidate,
after all other ids at a tie, and never a query. Null and empty vectors and those with a null
or non-finite component take no part; other columns are not read. Vectors of different
widths, or scores beyond a long, are errors. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, store
from .vectors import BLOCK_ROWS, CELLS, SLICE_ROWS, dealt, exact_kind, first_copies, integers, matrix, numbers, parts, repeated, whole, width_of

SCORES = "query_id long, rank int, vec_id long, score long"
ENTRY = "_q long, _v long, list int, partial long"
#: Below every score.
LOWEST = -(1 << 62)
#: Times ``k`` that each list names in the first phase; the more, the nearer the cutoff is to the ``k``-th best score.
DEPTH = 12


def _cuts(width: int, lists: int) -> list[tuple[int, int]]:
    """Start and length of each list's run of components."""
    edges = [width * i // lists for i in range(lists + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _with_runs(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """The vector ``x`` as one column for each list."""
    return rows.select(*[c for c in rows.columns if c != "x"], *(F.slice("x", a + 1, n).alias(f"x{g}") for g, (a, n) in enumerate(cuts)))


def _each_list(rows: DataFrame, lists: int, *columns: str) -> DataFrame:
    """One row for each list: reads that list's column only."""
    return reduce(DataFrame.union, (rows.select(F.lit(g).alias("list"), *columns, F.col(f"x{g}").alias("x")) for g in range(lists)))


def _best(partial: np.ndarray, k: int) -> np.ndarray:
    """Which ``k`` entries of each column are best; at ties any."""
    if k >= len(partial):
        return np.broadcast_to(np.arange(len(partial))[:, None], partial.shape)
    return np.argpartition(-partial, k - 1, axis=0)[:k]


def _entries(rows: DataFrame, queries: DataFrame, lists: int, slices: int, blocks: int, cuts, k: int | None) -> DataFrame:
    """Entries of every list: the ``k`` best per query and slice, or all that reach the query's cutoff.

    ``queries`` has ``tau`` where ``k`` is None.
    """
    left = _each_list(rows, lists, "_v", "vec_id", "slice").withColumn("block", repeated(blocks))
    right = _each_list(queries, lists, "_q", "query_id", "block", *([] if k else ["tau"])).withColumn("slice", repeated(slices))

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            width = cuts[asked.column("list")[0].as_py()][1]
            x, y = matrix(rows.column("x"), width), matrix(asked.column("x"), width)
            kind = exact_kind(x, y)
            x, y = x.astype(kind), y.astype(kind)
            v, q, ids = numbers(rows.column("_v")), numbers(asked.column("_q")), numbers(asked.column("query_id"))
            own, named = numbers(rows.column("vec_id").fill_null(0)), numbers(rows.column("vec_id").is_valid())
            tau = np.full(len(y), LOWEST) if k else numbers(asked.column("tau"))
            # the least whole number at or above tau / lists
            cutoff = np.where(tau == LOWEST, LOWEST + 1, tau // lists + (tau % lists != 0))
            at_once = max(1, CELLS // len(x))
            for start in range(0, len(y), at_once):
                some = slice(start, start + at_once)
                partial = (x @ y[some].T).astype(np.int64)
                partial[(own[:, None] == ids[some]) & named[:, None]] = LOWEST
                if k:
                    at = _best(partial, k)
                    col = np.broadcast_to(np.arange(partial.shape[1]), at.shape).ravel()
                    at = at.ravel()
                    use = partial[at, col] > LOWEST
                    at, col = at[use], col[use]
                else:
                    at, col = np.nonzero(partial >= cutoff[some])
                out.append((q[start + col], v[at], partial[at, col]))
        q, v, partial = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
        place = (asked if asked.num_rows else rows).column("list")
        number = np.full(len(q), place[0].as_py() if len(place) else 0, np.int32)
        return pa.table({"_q": pa.array(q, pa.int64()), "_v": pa.array(v, pa.int64()), "list": pa.array(number), "partial": pa.array(partial, pa.int64())})

    keys = ["list", "slice", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, ENTRY)


def _known(entries: DataFrame, lists: int) -> DataFrame:
    """One row for each query and row: the partial score of every list that named it."""
    return entries.groupBy("_q", "_v").agg(*(F.max(F.when(F.col("list") == g, F.col("partial"))).alias(f"s{g}") for g in range(lists)))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def _resolved(known: DataFrame, rows: DataFrame, queries: DataFrame, lists: int) -> DataFrame:
    """``(_q, _v, query_id, vec_id, score)``: with the missing partial scores looked up."""
    asked = queries.select("_q", "query_id", *(F.col(f"x{g}").alias(f"y{g}") for g in range(lists)))
    pairs = known.join(asked, "_q").join(rows.drop("slice"), "_v")
    score = fold([F.coalesce(f"s{g}", _dot(f"x{g}", f"y{g}")) for g in range(lists)])
    return pairs.select("_q", "_v", "query_id", "vec_id", score.alias("score"))


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """The ``k``-th best score of each query that has so many."""
    place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score")))
    return scores.select("_q", "score", place.alias("place")).where(f"place <= {k}").where(f"place = {k}").select("_q", F.col("score").alias(name))


def exact_topk(
    df: DataFrame, queries: Column, k: int = 10, scale: int = 1024, lists: int = 2, id_col: str = "vec_id", vec_col: str = "embedding",
    slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the highest integer inner product.

    ``queries`` says which rows of ``df`` ask. See the module for the method and for
    what counts as a row.
    """
    taken = df.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vec_col).alias("v")).where(whole(F.col("v")))
    distinct = store(taken.select("vec_id", "asks", integers(F.col("v"), scale).alias("x")).groupBy("vec_id", "x").agg(F.max("asks").alias("asks")), "topk-rows")
    n, width = width_of(distinct)
    if not n:
        return df.sparkSession.createDataFrame([], SCORES)
    lists = min(lists, width)
    cuts = _cuts(width, lists)
    slices = parts(n, slice_rows)
    copies = first_copies(distinct.drop("asks"), ["x"], "vec_id", k + 1).withColumn("_v", F.monotonically_increasing_id())
    rows = store(_with_runs(copies.withColumn("slice", dealt(slices, "_v")), cuts), "topk-lists")
    asked = distinct.where("asks AND vec_id IS NOT NULL").select(F.col("vec_id").alias("query_id"), "x")
    blocks = parts(asked.count(), block_rows)
    asked = asked.withColumn("_q", F.monotonically_increasing_id()).withColumn("block", dealt(blocks, "_q"))
    asked = store(_with_runs(asked, cuts), "topk-queries")

    # phase 1: each list's best, resolved, give the cutoff
    deep = DEPTH * k
    local = _entries(rows, asked, lists, slices, blocks, cuts, deep)
    place = F.row_number().over(Window.partitionBy("_q", "list").orderBy(F.desc("partial"), "_v"))
    first = local.withColumn("place", place).where(f"place <= {deep}").drop("place")
    tau = _kth(_resolved(_known(first, lists), rows, asked, lists), k, "tau")
    # a query with fewer than k rows to choose from takes all of them
    cut = store(asked.join(tau, "_q", "left").withColumn("tau", F.coalesce("tau", F.lit(LOWEST))), "topk-cutoffs")

    # phase 2: all entries at or above the cutoff, and bounds of what they add up to
    known = store(_known(_entries(rows, cut, lists, slices, blocks, cuts, None), lists), "topk-entries")
    complete = known.select("_q", fold([F.col(f"s{g}") for g in range(lists)]).alias("score")).where("score IS NOT NULL")
    reach = cut.select("_q", "tau").join(_kth(complete, k, "higher"), "_q", "left").select("_q", "tau", F.greatest("tau", "higher").alias("least"))
    # a missing partial score is a whole number below tau / lists
    below = F.expr(f"CASE WHEN tau > 0 THEN (tau + {lists - 1}) DIV {lists} ELSE tau DIV {lists} END") - 1
    bound = fold([F.coalesce(f"s{g}", below) for g in range(lists)])
    left = known.join(reach, "_q").where((F.col("tau") == LOWEST) | (bound >= F.col("least"))).drop("tau", "least")

    # phase 3: whole scores of what is left
    scores = _resolved(left, rows, asked, lists)
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_v")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")
