"""Answering a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import build_prompt
from ..operators.answering import (
    context_assembly, extractive_answer, post_process, resolve_answer,
)
from ..operators.embedding import IdfModel
from ..operators.retrieval import topk_batch, topk_by_features, topk_by_text
from ..schemas import Options


def retrieve(
    questions: DataFrame, vectors: DataFrame, model: IdfModel | None = None, k: int = 4
) -> DataFrame:
    """Ranked hits with text and source for ``(query_id, text)``.

    Takes a vector table with sparse ``features`` or a dense ``embedding``;
    questions that bring their own ``embedding`` need no model. Texts are joined
    to the final hits and take no part in scoring.
    """
    carry = ("file_path", "text")
    if "embedding" in questions.columns:
        return topk_batch(vectors, questions, k, carry=carry)
    if "features" in vectors.columns:
        return topk_by_features(vectors, questions, model, k, carry)
    return topk_by_text(vectors, questions, model, k, carry)


def contexts(
    questions: DataFrame, vectors: DataFrame, model: IdfModel | None = None, options: Options = Options()
) -> DataFrame:
    """``(query_id, question, context, sources)`` for every question, found or not."""
    hits = retrieve(questions, vectors, model, options.top_k)
    found = context_assembly(hits, options.context_max_chars)
    asked = questions.select("query_id", F.col("text").alias("question"))
    return asked.join(found, "query_id", "left")


def prompts(asked: DataFrame) -> DataFrame:
    """Add ``prompt`` to a table of contexts."""
    return asked.withColumn("prompt", build_prompt(F.coalesce("context", F.lit("")), F.col("question")))


def rag_batch(
    questions: DataFrame,
    vectors: DataFrame,
    model: IdfModel | None = None,
    options: Options = Options(),
    generated: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, question, context, answer, reply, status, sources)``.

    ``generated`` holds ``(query_id, generated[, error])`` of an outside model;
    without it the answer is the best sentence of the context.
    """
    asked = contexts(questions, vectors, model, options)
    if generated is None:
        answered = extractive_answer(asked)
    else:
        answered = post_process(asked.join(generated, "query_id", "left")).drop("generated")
    done = resolve_answer(answered, options.grounding_threshold)
    return done.select("query_id", "question", "context", "answer", "reply", "status", "sources")
