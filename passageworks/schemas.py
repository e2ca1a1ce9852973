"""Table schemas (M1-M12) and the job options.

Every table is an ordinary DataFrame; these are the column layouts the
operators read and write.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("suffix", T.StringType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

DOCUMENTS = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("load_error", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("file_path", T.StringType()),
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

VECTORS = T.StructType(CHUNKS.fields + [
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

COUNTS = T.StructType([
    T.StructField("buckets", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
])

HITS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("distance", T.DoubleType()),
])

ANSWER = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("no_answer", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

FRAGMENTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("piece", T.StringType()),
])

HISTORY = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])


@dataclass(frozen=True)
class AdaptiveOptions:
    """Settings of the token budget controller."""

    # fixed values: defaults of the controller
    latency_target: float = 4.0
    min_new_tokens: int = 64
    max_new_tokens: int = 512
    growth_factor: float = 1.2
    shrink_factor: float = 0.7
    ema_alpha: float = 0.4
    start_tokens: int = 384


@dataclass(frozen=True)
class Options:
    """Parameters of ingest and ask jobs."""

    # fixed values: defaults of the ingest and ask jobs
    chunk_size: int = 1000
    chunk_overlap: int = 200
    top_k: int = 4
    context_max_chars: int | None = 6000
    grounding_threshold: float = 0.55
    dims: int = 384
    adaptive: AdaptiveOptions = field(default_factory=AdaptiveOptions)
