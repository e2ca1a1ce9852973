"""Quality rules whose cutoffs are certified on labelled documents.

``statistics`` measures every whole text. A base rule rejects short and highly
repetitive texts. The other rules compare a rate (per 1,000 words, lines or
characters) with a cutoff. For each stratum, rule and cutoff of a fixed grid, the
good labelled documents that the rule would reject are counted, and the cutoff is
certified if an exact binomial bound says that the rule rejects at most
``risk / number of rules`` of the stratum's good documents. The level of each
test is ``error`` divided by the number of all tests (Bonferroni), so with
probability ``1 - error`` no stratum loses more than ``risk`` of its good
documents. Of the certified cutoffs of a rule the one that rejects most bad
labelled documents is taken, the most lenient of equals. A rule without one, or
a stratum without labels, rejects nothing.

Null texts have no words and fail the base rule; a null stratum is one of its
own; a document labelled more than once counts once per label, labels that are
null or without a document do not count; repeated rows get equal verdicts; an
empty table gives an empty result. Other columns pass unchanged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from .common import SPACE, store, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a stratum's good documents that all rules may reject, and the chance to be wrong.
RISK, ERROR = 0.05, 0.05

#: Rate of each rule, and its grid of cutoffs; a text is rejected if the rate is above.
RATES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "long_words": ("word_chars", "n_words"),
}
GRID = {
    "symbols": (50, 100, 200, 300, 400, 600, 800, 1000, 1500, 2000),
    "dup_lines": (100, 200, 300, 400, 500, 600, 700, 800),
    "repeats": (100, 150, 200, 250, 300, 350, 400, 450),
    "capitals": (50, 100, 150, 200, 300, 400, 500, 600, 700),
    "long_words": (7000, 8000, 9000, 10000, 12000, 15000, 20000),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def repeated_words(found: Column) -> Column:
    """Number of words that lie in a run of three words found twice or more in the list.

    The start of a run is packed into the low bits of its hash, as many as the
    list needs, so that sorting numbers brings equal runs together; neighbours
    with equal hashes are then compared word by word.
    """

    def counted(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def starts(m: Column) -> Column:
            keyed = F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")),
            )

            def twice(ordered: Column) -> Column:
                def same(x: Column, y: Column) -> Column:
                    p, q = (v.bitwiseAND(m).cast("int") for v in (x, y))
                    equal = [F.get(w, p + k) == F.get(w, q + k) for k in range(3)]
                    return F.coalesce((F.bitwise_not(m).bitwiseAND(x) == F.bitwise_not(m).bitwiseAND(y)) & equal[0] & equal[1] & equal[2], F.lit(False))

                again = F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)))
                return F.array_sort(F.transform(again, lambda x: x.bitwiseAND(m)))

            return bind(F.array_sort(keyed), twice)

        def covered(at: Column) -> Column:
            # a run covers three words, or as many as there are up to the next run
            gaps = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(bind(bind(mask, starts), covered))

    return bind(found, counted)


def statistics(text: Column) -> Column:
    """``STRUCT`` of the counts named in ``COUNTS``, all ``BIGINT``."""
    whole = F.coalesce(text, F.lit(""))

    def measured(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
            number = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
            letters = F.array_join(w, "")
            return bind(number, lambda n: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(letters).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                n["all"].alias("n_lines"),
                n["again"].alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.regexp_count(t, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
            ))

        return bind(words(t), of_words)

    return bind(whole, measured)


def rate(rule: str) -> Column:
    """The rule's rate in whole thousandths; zero where nothing is counted."""
    part, whole = RATES[rule]
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(F.lit(0).cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def log_binomial(k: Column, n: Column, p: float) -> Column:
    """Natural logarithm of the chance of at most ``k`` of ``n`` at rate ``p``, summed term by term."""
    odds = math.log(p / (1 - p))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["total"] - top) + F.exp(term - top))).alias("total"))

    first = n * F.lit(math.log(1 - p))
    some = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), F.struct(first.alias("term"), first.alias("total")), step, lambda a: a["total"])
    return F.when(k > 0, some).otherwise(first)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``_s`` of its counts."""
    return docs.withColumn("_s", statistics(F.col(text_col).cast("string")))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """``(stratum, rule, cutoff)``; at most one row per stratum and rule.

    Labelled documents become one row per rule with their rate; what leaves that
    is one counter per stratum, rule and cutoff.
    """
    n_rules, n_grid = len(GRID), sum(map(len, GRID.values()))
    counts = [F.col("_s")[c].alias(c) for c in COUNTS]
    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_quality")).where(F.col("_quality").isNotNull())
    rated = measured.select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), *counts)
    rated = rated.where(~base_failed()).join(known, "_id")
    per_rule = rated.select("stratum", (F.col("_quality") > 0).alias("good"), F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), rate(r).alias("rate"), F.array(*map(F.lit, GRID[r])).alias("grid")) for r in GRID))).alias("x"))
    per_rule = per_rule.select("stratum", "good", "x.rule", F.explode("x.grid").alias("cutoff"), F.col("x.rate").alias("rate"))
    over = F.col("rate") > F.col("cutoff")
    counted = per_rule.groupBy("stratum", "rule", "cutoff").agg(
        F.count_if("good").alias("n"), F.count_if(F.col("good") & over).alias("k"), F.count_if(~F.col("good") & over).alias("caught")
    )
    strata = counted.agg(F.countDistinct("stratum").alias("strata"))
    allowed = F.log(F.lit(error) / (F.col("strata") * n_grid))
    # a rate above the risk itself is never certified, so its long sum is left out
    sure = F.when((F.col("n") > 0) & (F.col("k") <= F.col("n") * (risk / n_rules)), log_binomial(F.col("k"), F.col("n"), risk / n_rules) <= allowed)
    certified = counted.join(F.broadcast(strata)).where(F.coalesce(sure, F.lit(False)))  # one row
    best = F.max(F.struct("caught", "cutoff")).alias("best")
    return certified.groupBy("stratum", "rule").agg(best).select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def apply_cutoffs(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with its counts as columns, ``base_failed`` and ``kept`` (columns of these names are replaced)."""
    # one row per stratum, with at most one entry per rule
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    joined = measured.withColumn("_stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(by_stratum, "_stratum", "left")
    own = [c for c in measured.columns if c not in (*COUNTS, "base_failed", "kept", "_s")]
    flat = joined.select(*(F.col(f"`{c}`") for c in own), "_cutoffs", *(F.col("_s")[c].alias(c) for c in COUNTS))
    broken = [F.coalesce(rate(r) > F.element_at("_cutoffs", F.lit(r)), F.lit(False)) for r in GRID]
    rejected = reduce(lambda a, b: a | b, broken, base_failed())
    return flat.withColumn("base_failed", base_failed()).withColumn("kept", ~rejected).drop("_cutoffs")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept``; texts are measured once, stored with their counts and not shuffled."""
    measured = store(measure(docs, text_col), "measured")
    return apply_cutoffs(measured, certified_cutoffs(measured, labels, risk, error, id_col, stratum_col), stratum_col)
