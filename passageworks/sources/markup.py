"""Markdown and HTML as blocks.

Blocks are cut out of the text inside its row, so a large file needs neither a
window nor a shuffle. Markdown blocks are ATX headings, bullet and numbered
items and paragraphs; ``markdown.py`` renders whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = r"(?md)^(#{1,6}[ \t]*[^#\n][^\n]*)$"
ITEM = r"(?md)^((?:[-*+]|[0-9]+\.)[ \t]+[^\n]*)$"
BULLET = r"\A[-*+][ \t]+"
NUMBER = r"\A[0-9]+\.[ \t]+"
# Separates blocks, and a block's tag from its text: control characters that
# do not occur in text files.
MARK, AFTER_TAG = "\x1e", "\x1f"


def _blocks(text: Column) -> Column:
    """Raw blocks of a Markdown text: headings and list items stand alone."""
    alone = F.regexp_replace(text, HEADING, f"{MARK}$1{MARK}")
    alone = F.regexp_replace(alone, ITEM, f"{MARK}$1{MARK}")
    cut = F.regexp_replace(alone, r"\n[ \t]*\n", MARK)
    stripped = F.transform(F.split(cut, MARK), lambda b: F.regexp_replace(b, r"\A[ \t\n]+|[ \t\n]+\z", ""))
    return F.filter(stripped, lambda b: b != "")


def _kind(block: Column) -> Column:
    return (
        F.when(block.rlike(r"\A#{1,6}[ \t]*[^#\n][^\n]*\z"), "heading")
        .when(block.rlike(BULLET + r"[^\n]*\z"), "bullet")
        .when(block.rlike(NUMBER + r"[^\n]*\z"), "number")
        .otherwise("paragraph")
    )


def _level(block: Column) -> Column:
    return F.length(F.regexp_extract(block, r"\A(#{1,6})", 1))


def _body(block: Column, kind: Column) -> Column:
    heading = F.regexp_replace(block, r"\A#{1,6}[ \t]*|[ \t]*#*[ \t]*\z", "")
    return (
        F.when(kind == "heading", heading)
        .when(kind == "bullet", F.regexp_replace(block, BULLET, ""))
        .when(kind == "number", F.regexp_replace(block, NUMBER, ""))
        .otherwise(block)
    )


def _html_blocks(html: Column) -> Column:
    """Text blocks of an HTML page, each led by the tag that opened or closed before it."""
    # fixed values: parts that are not text, tags that end a block
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for hidden in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?is)<{hidden}\b.*?</{hidden}\s*>", "")
    marked = F.regexp_replace(
        bare,
        r"(?i)<(/?(?:h[1-6]|p|li|ul|ol|div|title|article|section|nav|header|footer|body|head|html|table|tr|td|th"
        r"|blockquote|pre|br))\b[^>]*>",
        f"{MARK}$1{AFTER_TAG}",
    )
    return F.split(F.regexp_replace(marked, "<[^>]*>", ""), MARK)


def _unescape(text: Column) -> Column:
    # fixed values: the five basic entities, the ampersand last
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def markup_blocks(
    docs: DataFrame, key: str = "file_path", text: str = "text", flavour: str = "markdown"
) -> DataFrame:
    """``(key, block_no, kind, level, text)``, one row per block in order.

    ``kind`` is heading, bullet, number or paragraph (in HTML every list item is
    a bullet); ``level`` is 0 except for headings.
    """
    if flavour == "markdown":
        blocks = docs.select(key, F.posexplode(_blocks(F.col(text))).alias("block_no", "_raw"))
        kind = _kind(F.col("_raw"))
        return blocks.withColumn("kind", kind).select(
            key, "block_no", "kind",
            F.when(F.col("kind") == "heading", _level(F.col("_raw"))).otherwise(0).alias("level"),
            _body(F.col("_raw"), F.col("kind")).alias("text"),
        )
    if flavour != "html":
        raise ValueError(f"unknown markup: {flavour}")
    parts = F.transform(
        _html_blocks(F.col(text)),
        lambda b: F.struct(
            F.lower(F.regexp_extract(b, f"\\A([^{AFTER_TAG}]*){AFTER_TAG}", 1)).alias("tag"),
            _one_line(_unescape(F.regexp_replace(b, f"\\A[^{AFTER_TAG}]*{AFTER_TAG}", ""))).alias("text"),
        ),
    )
    rows = docs.select(key, F.posexplode(F.filter(parts, lambda b: b["text"] != "")).alias("block_no", "_b"))
    tag = F.col("_b.tag")
    heading = tag.rlike(r"\Ah[1-6]\z")
    return rows.select(
        key, "block_no",
        F.when(heading, "heading").when(tag == "li", "bullet").otherwise("paragraph").alias("kind"),
        F.when(heading, F.try_to_number(F.substring(tag, 2, 1), F.lit("9")).cast("int")).otherwise(0).alias("level"),
        F.col("_b.text").alias("text"),
    )


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
