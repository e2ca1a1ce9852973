"""Overlapping, word-trimmed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ends_in_whitespace


def boundary_trim(chunk: Column) -> Column:
    """K4: cut at the last plain space unless it is missing or the first character."""
    cut = F.length(chunk) - F.length(F.substring_index(chunk, " ", -1)) - 1
    return F.when(cut > 0, F.substring(chunk, F.lit(1), cut)).otherwise(chunk)


def nonempty(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with any text; whitespace alone counts as text."""
    return docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def chunk_text(
    docs: DataFrame,
    key: str = "file_path",
    text: str = "text",
    chunk_size: int = 1000,
    overlap: int = 200,
) -> DataFrame:
    """One row per chunk ``(chunk_id, <key>, chunk_no, start, text)``.

    Starts are multiples of ``chunk_size - overlap``. A chunk that stops inside
    the text and inside a word is cut back to its last space, whatever the
    next start is: a word longer than the overlap can fall between two chunks.

    The text is cut once into pieces of one stride and each chunk is put
    together from its neighbouring pieces, so the work is linear in the length
    of the text however long it is, needs no shuffle, and does not copy the
    text per chunk.
    """
    if chunk_size <= 0 or overlap < 0 or overlap >= chunk_size:
        raise ValueError("0 <= overlap < chunk_size is required")
    step = chunk_size - overlap
    per_chunk = -(-chunk_size // step)

    # an empty text has no pieces and so no row; no filter is needed
    pieces = docs.select(
        F.col(key),
        F.length(text).alias("n"),
        F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("pieces"),
    )
    raw = pieces.select(
        key,
        "n",
        F.posexplode(
            F.transform(
                "pieces",
                lambda _, i: F.substring(
                    F.array_join(F.slice("pieces", i + 1, F.lit(per_chunk)), ""), 1, chunk_size
                ),
            )
        ).alias("chunk_no", "raw"),
    )
    start = F.col("chunk_no") * step
    inside = (start + chunk_size < F.col("n")) & ~ends_in_whitespace(F.col("raw"))
    return raw.select(
        chunk_id(F.col(key), F.col("chunk_no")).alias("chunk_id"),
        key,
        "chunk_no",
        start.alias("start"),
        F.when(inside, boundary_trim(F.col("raw"))).otherwise(F.col("raw")).alias("text"),
    )


def chunk_id(path: Column, number: Column) -> Column:
    """``path::number``."""
    return F.concat_ws("::", path, number.cast("string"))
