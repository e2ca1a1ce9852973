"""One-permutation MinHash fingerprints of texts, as column expressions.

The distinct runs of five words of a lower-cased text are hashed once. The top
bits of a hash name one of ``BINS`` bins, and each bin keeps its least hash. An
empty bin takes the value of the bin that a hash of (bin, attempt) points at,
the first attempt that meets a filled bin counting (optimal densification); after
``ATTEMPTS`` misses, which need nearly empty fingerprints, the filled bin with
the least hash of (bin, other bin) is taken, so every bin ends up filled. Of each
value ``BITS`` low bits are stored. Two unrelated values agree by chance once in
``2 ** BITS``, and the likeness corrects for it.

A text with fewer than five words is one shingle. A null, empty or blank text has
no shingle: its fingerprint is zero throughout, and it is like such texts only.
Everything is an expression on one row, with no Python and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from .common import words

SHINGLE = 5
BIN_BITS, BITS, ATTEMPTS = 8, 8, 24
BINS = 1 << BIN_BITS


def shingle_hashes(found: Column) -> Column:
    """Hashes of all runs of five words, their lowest bit set; empty without words."""

    def runs(h: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
        return F.when(F.size(h) >= SHINGLE, run).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    hashed = bind(F.transform(found, lambda w: F.xxhash64(w)), runs)
    return F.transform(hashed, lambda h: h.bitwiseOR(F.lit(1)))


def fingerprint(text: Column) -> Column:
    """``ARRAY<SMALLINT>`` of ``BINS`` low parts, or null for a text without words."""
    # an even number opens each bin, so that after sorting the bin's least hash follows it
    opening = F.transform(F.sequence(F.lit(-(BINS // 2)).cast("long"), F.lit(BINS // 2 - 1).cast("long")), lambda b: F.shiftleft(b, 64 - BIN_BITS))

    def even(x: Column) -> Column:
        return x.bitwiseAND(F.lit(1)) == 0

    def least(ordered: Column) -> Column:
        follows = lambda i: F.get(ordered, i + 1)
        value = lambda x, i: F.when(even(x), F.when(even(F.coalesce(follows(i), F.lit(0))), F.lit(0)).otherwise(follows(i)))
        return F.array_compact(F.transform(ordered, value))  # in order of bins; zero: empty

    def densified(least: Column) -> Column:
        def filled(b: Column) -> Column:
            tries = [F.nullif(F.get(least, F.pmod(F.xxhash64(b, F.lit(a)), F.lit(BINS)).cast("int")), F.lit(0)) for a in range(ATTEMPTS)]
            others = F.filter(F.transform(least, lambda v, j: F.struct(F.xxhash64(b, j).alias("rank"), v.alias("value"))), lambda x: x["value"] != 0)
            return F.coalesce(*tries, F.array_min(others)["value"])

        low = lambda v: F.shiftright(v, 1).bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint")
        return F.transform(least, lambda v, b: low(F.when(v != 0, v).otherwise(filled(b))))

    hashes = shingle_hashes(words(F.lower(text)))
    whole = lambda h: bind(bind(F.array_sort(F.concat(h, opening)), least), densified)
    return bind(hashes, lambda h: F.when(F.size(h) > 0, whole(h)))


def packed(parts: Column) -> Column:
    """A fingerprint as hexadecimal digits; zeros for a text without words."""
    digits = F.array_join(F.transform(parts, lambda v: F.lower(F.lpad(F.hex(v), BITS // 4, "0"))), "")
    return F.coalesce(digits, F.lit("0" * (BINS * BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance, from 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    near = F.greatest(F.lit(0.0), (equal - F.lit(chance)) / F.lit(1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(near)


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint of each text; other columns pass unchanged."""
    return docs.withColumn(into, packed(fingerprint(F.col(text_col))))
