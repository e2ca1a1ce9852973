"""Line deduplication with a deletion-neighbourhood join.

A line is the list of its words; its place is (id, text hash, line number), and
the earliest line is the one with the least place, a null id coming first (near
lines of one id: by number, then by the hash of their words). Lines
without a word are left alone. A line goes

* if an equal list of words stands at an earlier place, or
* if it has at least ``EDIT_WORDS`` words and some earlier line that has as many
  is one edit away: one word replaced, added or left out.

Near lines are found by their deletion neighbourhoods: every line with each one
of its words left out, and whole, as hashed keys. Two lines are one edit apart if
one is the other's variant, or if both become equal by leaving out the word of
the same place; the place is part of those keys. Under each key the earliest line
is taken by an aggregate that combines before the shuffle, and the others are
paired with it alone, so a key that very many lines share makes no more pairs
than lines. Each pair's edit distance is then checked on the words themselves.

Only variants that can have an equal one are made: one edit leaves the first half
or the rest of the words as they are, so a line whose halves occur in no other
line (of a length that differs by at most one) has none, and a line that shares
one half leaves out words of the other only.

Null and empty texts have no lines and stay as they are. Rows equal in id and
text are one document, and get the same result. Texts of any length are one row,
and what is stored of a line is its hashes. Columns other than id and text pass
unchanged; names that begin with ``_line_`` are reserved. Blank lines stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small, store

#: Words from which a line counts, and from which near lines go: of shorter ones, one word is often all that tells them apart.
MIN_WORDS, EDIT_WORDS = 1, 7
#: Line hashes that may be broadcast after they were counted (eight bytes each).
BROADCAST_LINES = 1_000_000
#: Lines of which variants are made at a time.
VARIANT_ROWS = 500

AT = ("id", "text_hash", "line")
#: The halves of a line: its first and its last words.
SIDES = ("head", "tail")


def split_lines(docs: DataFrame) -> DataFrame:
    """``(id, text_hash, line, body)`` of all lines."""
    return docs.select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line", "body"))


def words_of(body: Column) -> Column:
    return F.split(F.btrim(body, F.lit(" \t\n\x0b\f\r")), f"[{SPACE}]+")


def cut_of(least: Column) -> Column:
    """Number of words in the first half of a line of ``least`` words."""
    return F.floor(least / 2).cast("int")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``(id, text_hash, line, n, h1, h2)`` of the lines that count, and the keys of their halves.

    A pair of lines is keyed by the words of its shorter line, so a line has keys
    as the shorter one (``short_...``) and as the longer one (``long_...``).
    """
    lines = split_lines(docs).withColumn("words", words_of(F.col("body"))).withColumn("n", F.size("words"))
    # a blank line is split into one empty word
    lines = lines.where((F.col("n") >= MIN_WORDS) & (F.get("words", 0) != ""))
    n, words = F.col("n"), F.col("words")

    def half(least: Column, side: str) -> Column:
        cut = cut_of(least)
        part = F.slice(words, F.lit(1), cut) if side == "head" else F.slice(words, n - (least - cut) + 1, least - cut)
        return F.when(n >= EDIT_WORDS, F.xxhash64(least, F.lit(side), part))

    keys = [half(least, side).alias(f"{role}_{side}") for role, least in (("short", n), ("long", n - 1)) for side in SIDES]
    return lines.select(*AT, "n", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), *keys)


def alive_lines(lines: DataFrame) -> DataFrame:
    """``(h1, whole, replace_head, ..., leave_tail)``: distinct lines that can have a near one, and how.

    ``replace_...`` says that a line of as many words has the other half of its words,
    ``leave_...`` that a line with one word less has it, ``whole`` that one with one more has.
    """
    names = [f"{role}_{side}" for role in ("short", "long") for side in SIDES]
    distinct = lines.where(F.col("short_head").isNotNull()).select("h1", *names).distinct()
    rows = [F.struct(F.col(f"{role}_{side}").alias("key"), F.lit(role == "short").alias("short"), F.lit(side).alias("side")) for role in ("short", "long") for side in SIDES]
    keyed = distinct.select("h1", F.inline(F.array(*rows)))
    short = F.when(F.col("short"), F.col("h1"))
    ends = keyed.groupBy("key").agg(F.min(short).alias("a"), F.max(short).alias("b"), F.bool_or(~F.col("short")).alias("longer"))
    ends = ends.where(F.col("a").isNotNull() & ((F.col("a") != F.col("b")) | F.col("longer")))
    both = keyed.join(ends, "key")
    flags = [F.bool_or(F.col("short") & F.col("longer")).alias("whole")]
    for side, edited in zip(SIDES, SIDES[::-1]):
        # a shared head means that the edit is in the tail
        flags.append(F.bool_or((F.col("side") == side) & F.col("short") & (F.col("a") != F.col("b"))).alias(f"replace_{edited}"))
        flags.append(F.bool_or((F.col("side") == side) & ~F.col("short")).alias(f"leave_{edited}"))
    found = both.groupBy("h1").agg(*flags)
    return found.where("whole OR replace_head OR replace_tail OR leave_head OR leave_tail")


def variants(lines: DataFrame) -> DataFrame:
    """``(at, key, whole)``: the hashed keys of each line of ``(id, line, h1, words, flags)``."""
    flags = ("whole", "replace_head", "replace_tail", "leave_head", "leave_tail")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(1 << 10, base, np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, VARIANT_ROWS):
                piece = batch.slice(at, VARIANT_ROWS)
                found, wholes = [], []
                for words, *asked in zip(*(piece.column(c).to_pylist() for c in ("words", *flags))):
                    whole, replace_head, replace_tail, leave_head, leave_tail = asked
                    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
                    n = len(h)
                    if n >= len(power):
                        power = np.cumprod(np.full(2 * n, base, np.uint64))
                    # the word at place i counts h * base ** (i + 1); words behind the one left out move up
                    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])
                    moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[1:] * power[: n - 1])])
                    without = before[:n] + (moved[-1] - moved)
                    place = (without ^ np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
                    place ^= place >> np.uint64(32)
                    # one word more on either side of the cut, since cuts of neighbouring lengths differ
                    head, tail = slice(0, n // 2 + 1), slice(max(0, (n - 1) // 2 - 1), n)
                    parts = [before[n:] if whole else before[:0]]
                    for values, on_head, on_tail in ((without, leave_head, leave_tail), (place, replace_head, replace_tail)):
                        parts.append(values if on_head and on_tail else values[head] if on_head else values[tail] if on_tail else values[:0])
                    found.append(np.concatenate(parts))
                    wholes.append(bool(whole))
                counts = np.fromiter(map(len, found), np.int64, len(found))
                rows = pa.array(np.repeat(np.arange(len(found)), counts))
                is_whole = np.zeros(int(counts.sum()), bool)
                is_whole[(np.cumsum(counts) - counts)[np.array(wholes, bool)]] = True
                columns = [piece.column(c).take(rows) for c in ("id", "line", "h1")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found).view(np.int64)), pa.array(is_whole)], ["id", "line", "h1", "key", "whole"])

    made = lines.select("id", "line", "h1", "words", *flags).mapInArrow(keys, "id BIGINT, line INT, h1 BIGINT, key BIGINT, whole BOOLEAN")
    return made.select(F.struct("id", "line", "h1").alias("at"), "key", "whole")


def one_edit(a: Column, b: Column) -> Column:
    """True if one word replaced, added or left out turns the one list into the other."""

    def longer(short: Column, long: Column) -> Column:
        # leaving out the first word of the longer one that differs must make them equal
        place = F.array_position(F.transform(short, lambda w, i: w == F.get(long, i)), F.lit(False)).cast("int")
        cut = F.when(place > 0, place).otherwise(F.size(short) + 1)
        rest = F.concat(F.slice(long, F.lit(1), cut - 1), F.slice(long, cut + 1, F.size(long)))
        return rest == short

    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)) <= 1
    gap = F.size(a) - F.size(b)
    return F.when(gap == 0, same).when(gap == -1, longer(a, b)).when(gap == 1, longer(b, a)).otherwise(False)


def near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(h1, h2)`` of the lines that have an earlier line one edit away."""
    alive = store(firsts.join(alive_lines(lines), "h1").select("h1", "h2", "at.*", "whole", "replace_head", "replace_tail", "leave_head", "leave_tail"), "alive")
    known = small(alive.withColumnRenamed("id", "_id"), BROADCAST_LINES)
    chosen = store(_chosen(docs, known), "near")
    keyed = variants(chosen)
    least = keyed.groupBy("key").agg(F.min(F.when(F.col("whole"), F.col("at"))).alias("whole_at"), F.min(F.when(~F.col("whole"), F.col("at"))).alias("variant_at"))
    # a line is alone under most of its keys
    least = least.where(F.col("variant_at").isNotNull())
    both = keyed.join(least, "key")
    others = F.array(F.when(~F.col("whole"), F.col("whole_at")), F.col("variant_at"))
    pairs = both.select("at", F.explode(others).alias("other")).where("other < at").distinct()
    mine = chosen.select(F.struct("id", "line", "h1").alias("at"), "h1", "h2", "words")
    theirs = chosen.select(F.struct("id", "line", "h1").alias("other"), F.col("words").alias("other_words"))
    checked = pairs.join(mine, "at").join(theirs, "other").where(one_edit(F.col("words"), F.col("other_words")))
    return checked.select("h1", "h2").distinct()


def _chosen(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The words of the lines at the given places, one row for each."""
    rows = split_lines(docs).withColumnsRenamed({"id": "_doc", "text_hash": "_text", "line": "_line"})
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("text_hash")) & (F.col("_line") == F.col("line"))
    found = rows.join(places, same).withColumnRenamed("_id", "id").withColumn("words", words_of(F.col("body")))
    # rows equal in id and text hold the same lines
    return found.drop("_doc", "_text", "_line", "body").dropDuplicates(["h1", "h2"])


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(id, text_hash, gone)``: numbers of the lines that go, for texts that lose any."""
    lines = store(hashed_lines(docs), "lines")
    firsts = store(lines.groupBy("h1", "h2").agg(F.min(F.struct(*AT)).alias("at")), "firsts")
    near = near_lines(docs, lines, firsts).withColumn("near", F.lit(True))
    judged = firsts.join(near, ["h1", "h2"], "left")
    places = lines.select(*AT, "h1", "h2").join(judged, ["h1", "h2"])
    gone = places.where(F.coalesce("near", F.lit(False)) | (F.struct(*AT) != F.col("at")))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts cleared, and ``_line_all``, ``_line_gone``: how many lines there were, how many went."""
    keys = F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    gone = dropped_lines(docs.select(*keys).where(F.col(text_col).isNotNull())).withColumnsRenamed({"id": "_line_id", "text_hash": "_line_hash", "gone": "_line_set"})
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_line_id")) & (F.xxhash64(F.col(text_col)) == F.col("_line_hash"))
    joined = docs.join(gone, same, "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_line_set")), lambda i: F.get(lines, i))
    text = F.when(F.col("_line_set").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    counted = joined.withColumn("_line_all", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("_line_gone", F.coalesce(F.size("_line_set"), F.lit(0)).cast("long"))
    return counted.withColumn(text_col, text).drop("_line_id", "_line_hash", "_line_set")
