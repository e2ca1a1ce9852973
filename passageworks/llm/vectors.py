"""Integer vectors, and meeting every block of queries with every slice of rows.

A vector takes part if it is not null or empty and has finite components only. Its
components become integers, so scores are exact whatever the order of additions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice, and queries of a block, that meet in one task.
SLICE_ROWS, BLOCK_ROWS = 8192, 4096
#: Cells of a score matrix held at a time.
CELLS = 2_000_000


def whole(vector: Column) -> Column:
    """True if a vector has components, all of them finite."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def integers(vector: Column, scale: int, shift: int = 0) -> Column:
    """``floor(scale * c) + shift`` of every component, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))


def width_of(rows: DataFrame, column: str = "x") -> tuple[int, int]:
    """How many rows there are, and the width that all of them have.

    Vectors of different widths have no common scores: they are an error.
    """
    found = rows.select(F.size(column).alias("n")).agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    if found["low"] != found["high"]:
        raise ValueError(f"vector widths differ: {found['low']} to {found['high']}")
    return found["rows"], found["high"] or 0


def first_copies(rows: DataFrame, same: list[str], id_col: str, n: int) -> DataFrame:
    """Of rows equal in ``same``, the ``n`` with the least ids; null ids come last.

    Equal vectors have equal scores, so no ranking of ``n`` by score and id loses a
    row by this. The limit applies on each task before the shuffle, so a vector that
    a third of all rows hold sends ``n`` rows a task.
    """
    order = Window.partitionBy(*same).orderBy(F.asc_nulls_last(id_col))
    return rows.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= n).drop("_copy")


def parts(n: int, most: int) -> int:
    return max(1, -(-n // most))


def dealt(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def repeated(n: int) -> Column:
    """One row for each number below ``n``."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def matrix(column, width: int) -> np.ndarray:
    """A list column as a matrix of longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)


def numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def exact_kind(a: np.ndarray, b: np.ndarray):
    """A type in which all inner products of rows of ``a`` and ``b`` are exact.

    Doubles, which multiply fastest, hold whole numbers up to 2 ** 53. Products that may
    not fit in a long are an error.
    """
    top = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    bound = top(a) * top(b) * a.shape[1]
    if bound >= 1 << 62:
        raise OverflowError("inner products of these vectors do not fit in a long")
    return np.float64 if bound < 1 << 53 else np.int64
