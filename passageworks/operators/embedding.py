"""Hashed TF-IDF vectors.

A text becomes ``dims`` feature buckets by the MD5 of its words. All steps up
to the vector work on one row, so embedding a corpus needs no
shuffle; only fitting the inverse document frequencies aggregates, and that
exchanges at most ``dims + 1`` counters per task.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import bind

#: Distinct words whose buckets a task remembers at most before it starts anew.
CACHE_WORDS = 1 << 18


@dataclass(frozen=True)
class IdfModel:
    """Inverse document frequency per bucket; its size is fixed by the width."""

    n_chunks: int
    weights: tuple[float, ...]

    @property
    def dims(self) -> int:
        return len(self.weights)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(b, w, self.n_chunks) for b, w in enumerate(self.weights)]
        return spark.createDataFrame(rows, "bucket INT, idf DOUBLE, n_chunks BIGINT")

    @classmethod
    def from_df(cls, df: DataFrame) -> "IdfModel":
        rows = df.orderBy("bucket").collect()
        return cls(rows[0]["n_chunks"], tuple(r["idf"] for r in rows))


class WordBuckets(dict):
    """Feature bucket of a word: the first 32 bits of its MD5 modulo ``dims``, computed once while the cache holds it."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % self.dims
        return value


def postings(text: Column, dims: int = 384) -> Column:
    """``struct(buckets, counts)`` of the words of a text, buckets ascending.

    Words are those of ``functions.text.words``. Texts outside of ASCII are put into lower case and have their
    separators replaced before; in the rest every word is a run of ASCII letters and digits.
    """
    # in ASCII alone a text has as many bytes as characters
    lowered = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " ")
    plain = bind(text, lambda t: F.when(F.octet_length(t) > F.length(t), lowered(t)).otherwise(t))
    known = WordBuckets(dims)
    blank = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

    @F.arrow_udf("struct<buckets: array<int>, counts: array<int>>")
    def counted(texts: pa.Array) -> pa.Array:
        found = [t.lower().translate(blank).split() if t is not None else [] for t in texts.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        places = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        cells = np.bincount(np.repeat(np.arange(len(found)), sizes) * dims + places, minlength=1)
        keys = np.flatnonzero(cells)
        counts = cells[keys]
        ends = np.searchsorted(keys, np.arange(len(found) + 1) * dims).astype(np.int32)
        missing = texts.is_null()
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)), mask=missing) for x in (keys % dims, counts)]
        return pa.StructArray.from_arrays(lists, ["buckets", "counts"])

    return counted(plain.cast("binary"))


def counters(rows: DataFrame, buckets: Column) -> DataFrame:
    """``(bucket, n)``: in how many rows each bucket occurs; bucket -1 counts the rows themselves.

    Counters of disjoint tables add up to those of their union.
    """
    marked = rows.select(F.explode(F.array_prepend(buckets, F.lit(-1))).alias("bucket"))
    return marked.groupBy("bucket").agg(F.count("*").alias("n"))


def model_of(seen: dict[int, int], dims: int) -> IdfModel:
    """``ln((n + 1) / (df + 1)) + 1`` per bucket, from counters."""
    n = seen.get(-1, 0)
    return IdfModel(n, tuple(math.log((n + 1) / (seen.get(b, 0) + 1)) + 1.0 for b in range(dims)))


def fit_idf(chunks: DataFrame, text: str = "text", dims: int = 384, counts: str | None = None) -> IdfModel:
    """Fit the weights of a chunk table; one job, like the fit of any estimator.

    ``counts`` names the column of ``postings`` of the same width, if the table has one.
    """
    found = F.col(counts) if counts else postings(F.col(text), dims)
    counted = counters(chunks, found["buckets"]).collect()
    return model_of({r["bucket"]: r["n"] for r in counted}, dims)


def features_of(text: Column, model: IdfModel) -> Column:
    """``struct(buckets, weights)`` of unit length, weights ``(1 + ln tf) * idf``.

    A text without words gets empty arrays, the zero vector.
    """
    return weigh(postings(text, model.dims), model)


def weigh(counts: Column, model: IdfModel) -> Column:
    """The sparse vector of a text from its ``postings``."""
    # one literal instead of one per bucket, which keeps the plan small
    idf = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")

    def weighted(p: Column) -> Column:
        raw = F.zip_with(
            p["buckets"], p["counts"], lambda b, c: (F.log(c.cast("double")) + 1.0) * F.get(idf, b)
        )
        return bind(raw, lambda r: F.struct(p["buckets"].alias("buckets"), _unit(r).alias("weights")))

    return bind(counts, weighted)


def _unit(raw: Column) -> Column:
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return bind(length, lambda n: F.transform(raw, lambda x: (x / n).cast("float")))


def hashed_features(
    df: DataFrame, model: IdfModel, text: str = "text", output: str = "features", counts: str | None = None
) -> DataFrame:
    """Add the sparse vector of ``text``, or of its ``postings`` if a column ``counts`` has them."""
    return df.withColumn(output, weigh(F.col(counts), model) if counts else features_of(F.col(text), model))


def dense(features: Column, dims: int) -> Column:
    """Dense ``ARRAY<FLOAT>`` of sparse features, built from runs of zeros."""
    buckets, weights = features["buckets"], features["weights"]
    zero = F.lit(0.0).cast("float")
    before = F.array_prepend(buckets, F.lit(-1))
    gaps = F.zip_with(before, F.array_append(buckets, F.lit(dims)), lambda a, b: b - a - 1)
    runs = F.zip_with(
        F.transform(gaps, lambda n: F.array_repeat(zero, n)),
        F.transform(weights, lambda w: F.array(w)),
        lambda zeros, one: F.concat(zeros, F.coalesce(one, F.array().cast("array<float>"))),
    )
    return F.flatten(runs)


def hashed_embedding(
    df: DataFrame, model: IdfModel, text: str = "text", output: str = "embedding"
) -> DataFrame:
    """Add the dense vector of ``text``."""
    vector = bind(features_of(F.col(text), model), lambda f: dense(f, model.dims))
    return df.withColumn(output, vector)


def embedding_dimension(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Smallest and largest width; equal in a sound table."""
    width = F.size(col)
    return df.agg(F.min(width).alias("min_dim"), F.max(width).alias("max_dim"))


def require_one_dimension(df: DataFrame, col: str = "embedding") -> int:
    """The width of the vectors, or an error if they differ."""
    row = embedding_dimension(df, col).first()
    if row["min_dim"] != row["max_dim"]:
        raise ValueError(f"vector widths differ: {row['min_dim']} to {row['max_dim']}")
    return row["min_dim"]
