"""From hits or generated text to answers.

Groups built here are bounded: a question has at most ``k`` hits, and fragments
are concatenated in runs before the runs of a request are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import (
    FAILED, NOT_ANSWERED, NOTHING_FOUND, best_sentence, grounding, parse_generated, truncate_context,
)
from ..functions.binding import bind


def context_assembly(hits: DataFrame, max_chars: int | None = 6000) -> DataFrame:
    """``(query_id, context, sources)`` from ranked hits.

    Chunk texts are joined by a blank line in rank order and then cut; the
    sources list every hit, also one that was cut off.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    joined = F.array_join(F.transform(ordered, lambda h: h["text"]), "\n\n")
    return hits.groupBy("query_id").agg(
        truncate_context(joined, max_chars).alias("context"),
        F.array_sort(F.collect_set("file_path")).alias("sources"),
    )


def distinct_sources(hits: DataFrame) -> DataFrame:
    """The file paths behind each question's hits, sorted."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_set("file_path")).alias("sources"))


def fragment_assembly(
    fragments: DataFrame, key: str = "request_id", seq: str = "seq", piece: str = "piece", run: int = 1024
) -> DataFrame:
    """A3: ``(key, text)``, the pieces of a request in sequence order.

    Runs of ``run`` consecutive sequence numbers are concatenated first, each in
    its own group, so that a request with very many pieces is spread over tasks.
    """
    def join(order: str, text: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
        return F.array_join(F.transform(ordered, lambda p: p[text]), "")

    runs = (
        fragments.withColumn("_run", F.col(seq) - F.pmod(seq, F.lit(run)))
        .groupBy(key, "_run")
        .agg(join(seq, piece).alias("_text"))
    )
    return runs.groupBy(key).agg(join("_run", "_text").alias("text"))


def extractive_answer(
    df: DataFrame, question: str = "question", context: str = "context"
) -> DataFrame:
    """Add ``answer`` and ``no_answer``, using sentences of the context only."""
    best = best_sentence(F.col(question), F.coalesce(F.col(context), F.lit("")))
    scored = df.withColumn("_best", best)
    return (
        scored.withColumn("no_answer", F.col("_best.score") == 0)
        .withColumn("answer", F.when(F.col("no_answer"), "").otherwise(F.col("_best.sentence")))
        .drop("_best")
    )


def post_process(df: DataFrame, generated: str = "generated") -> DataFrame:
    """E5: add ``answer`` and ``no_answer`` parsed from a generated text."""
    return (
        df.withColumn("_parsed", parse_generated(F.coalesce(F.col(generated), F.lit(""))))
        .withColumn("answer", F.col("_parsed.answer"))
        .withColumn("no_answer", F.col("_parsed.no_answer"))
        .drop("_parsed")
    )


def grounding_check(
    df: DataFrame, answer: str = "answer", context: str = "context", threshold: float = 0.55
) -> DataFrame:
    """Add ``hits``, ``total``, ``ratio`` and ``grounded``."""
    checked = df.withColumn("_check", grounding(F.col(answer), F.col(context), threshold))
    return checked.select(*df.columns, "_check.*")


def resolve_answer(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Final ``status``, ``answer``, ``reply`` and ``sources``.

    Needs ``answer``, ``no_answer``, ``context`` and ``sources``; a non-null
    ``error`` column marks a failed generation. An ungrounded answer is blanked.
    """
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    grounded = grounding(F.col("answer"), F.col("context"), threshold)["grounded"]
    status = (
        F.when(F.coalesce(F.size("sources"), F.lit(0)) == 0, "no_context")
        .when(error.isNotNull(), "error")
        .when(F.col("no_answer") | ~grounded, "no_answer")
        .otherwise("answered")
    )

    def settle(status: Column) -> Column:
        answered = status == "answered"
        reply = F.when(status == "no_context", NOTHING_FOUND).otherwise(NOT_ANSWERED)
        return F.struct(
            status.alias("status"),
            F.when(answered, F.col("answer")).otherwise("").alias("answer"),
            F.when(answered, F.col("answer")).otherwise(reply).alias("reply"),
            F.when(answered, F.col("sources")).otherwise(F.array().cast("array<string>")).alias("sources"),
        )

    kept = [c for c in df.columns if c not in ("answer", "no_answer", "sources")]
    return df.withColumn("_done", bind(status, settle)).select(*kept, "_done.*")


def resolve_streamed(
    fragments: DataFrame, contexts: DataFrame, threshold: float = 0.55
) -> DataFrame:
    """``(request_id, raw, final, status, sources)`` from recorded fragments.

    ``contexts`` has ``request_id, context, sources`` and optionally ``error``.
    ``raw`` is the joined text as it was streamed; ``final`` is empty when there
    is no answer, and a message when nothing was retrieved or the stream broke.
    """
    raw = fragment_assembly(fragments).withColumnRenamed("text", "raw")
    asked = contexts.join(raw, "request_id", "left").withColumn("raw", F.coalesce("raw", F.lit("")))
    done = resolve_answer(post_process(asked, "raw"), threshold)
    final = (
        F.when(F.col("status") == "no_context", NOTHING_FOUND)
        .when(F.col("status") == "error", FAILED)
        .otherwise(F.col("answer"))
    )
    # nothing is generated without a context, so nothing was streamed either
    streamed = F.when(F.col("status") == "no_context", "").otherwise(F.col("raw"))
    return done.select(
        "request_id", streamed.alias("raw"), final.alias("final"), "status", "sources"
    )


def render_sources(sources: Column) -> Column:
    """Bulleted list of sources."""
    return F.array_join(F.transform(sources, lambda s: F.concat(F.lit("• "), s)), "\n")


def render_history(pairs: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Add ``entry``, the text block of one exchange."""
    # fixed values: the layout of a history entry
    entry = F.concat(
        F.lit("User: "), F.col(question), F.lit("\nAI: "), F.col(answer), F.lit("\n\n"),
        F.repeat(F.lit("-"), 40), F.lit("\n"),
    )
    return pairs.withColumn("entry", entry)
