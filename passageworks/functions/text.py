"""String expressions: whitespace, tokens, suffixes, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges that count as whitespace when a text is
# stripped or a chunk end is tested. Spark's own trim() removes only U+0020.
WHITESPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITESPACE = "".join(
    r"\x{%x}-\x{%x}" % (low, high) for low, high in WHITESPACE_RANGES
)


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace.

    The lookbehind lets a match of the tail start only at the beginning of a
    run of blanks, which keeps the search linear on texts with long inner runs.
    """
    return F.regexp_replace(col, rf"\A[{WHITESPACE}]+|(?<![{WHITESPACE}])[{WHITESPACE}]+\z", "")


def ends_in_whitespace(col: Column) -> Column:
    return col.rlike(rf"[{WHITESPACE}]\z")


def normalize_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def normalize_tokens(col: Column) -> Column:
    """Lower-cased runs of ``a-z0-9``; every other character separates."""
    flat = F.regexp_replace(F.lower(col), "[^a-z0-9 ]", " ")
    return F.filter(F.split(flat, " +"), lambda t: t != "")


def words(col: Column) -> Column:
    """Lower-cased runs of letters and digits of any script (input of D1)."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_bucket(word: Column, dims: int) -> Column:
    """Feature bucket of a word: the first 32 bits of its MD5 modulo ``dims``."""
    head = F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10)
    return (head.cast("bigint") % F.lit(dims)).cast("int")


def content_hash(col: Column) -> Column:
    """SHA-256 of the raw bytes, empty when the content cannot be read."""
    return F.coalesce(F.sha2(col, 256), F.lit(""))


def suffix(path: Column) -> Column:
    """Lower-cased file suffix with its dot; empty for dot files and bare names."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


# The suffixes that can be loaded.
SUPPORTED = (".txt", ".md", ".pdf", ".csv")


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED)


def sentences(col: Column) -> Column:
    """Stripped sentences of a text; a sentence ends at ``.``, ``!``, ``?`` or a newline."""
    parts = F.regexp_extract_all(col, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: s != "")
