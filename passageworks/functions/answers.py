"""Expressions that turn generated text and context into an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind
from .text import normalize_tokens, sentences, strip

NOTHING_FOUND = "No passage in the collection is related to this question."
NOT_ANSWERED = "The collection does not contain an answer to this question."
FAILED = "The answer could not be generated."

GUIDE = (
    "Answer from the passages below and from nothing else. Reply with one line of JSON holding "
    'two keys: "answer" (text) and "no_answer" (true when the passages do not settle the question).'
)

# Fixed value: marks a refusal in plain text.
REFUSAL = "[NO_ANSWER]"


def build_prompt(context: Column, question: Column) -> Column:
    """Instructions, context, question and answer cue."""
    return F.concat(
        F.lit(GUIDE + "\n\nPassages:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nReply: "),
    )


def truncate_context(context: Column, max_chars: int | None) -> Column:
    """The first ``max_chars`` code points; 0 or None keeps everything."""
    return F.substring(context, 1, max_chars) if max_chars else context


def parse_generated(generated: Column) -> Column:
    """E5: ``struct(answer, no_answer)`` from generated text.

    The span from the first ``{`` to the last ``}`` counts if it is a JSON
    object with both keys; otherwise the stripped text is the answer unless it
    is shorter than two characters or carries the refusal mark.
    """
    plain = bind(
        strip(generated),
        lambda p: bind(
            (F.length(p) < 2) | F.contains(F.upper(p), F.lit(REFUSAL)),
            lambda refused: _answer(F.when(refused, F.lit("")).otherwise(p), refused),
        ),
    )
    # the parser ignores what follows the first value; inside an array it cannot
    span = F.regexp_extract(generated, r"(?s)\{.*\}", 0)
    listed = F.try_parse_json(F.when(span != "", F.concat(F.lit("["), span, F.lit("]"))))

    def read(json: Column) -> Column:
        alone = F.try_variant_get(json, "$[1]", "variant").isNull()
        keys = F.json_object_keys(F.when(json.isNotNull() & alone, span))
        both = F.array_contains(keys, "answer") & F.array_contains(keys, "no_answer")
        return F.when(both, _answer(strip(_as_text(json, "$[0].answer")), _truthy(json, "$[0].no_answer")))

    return F.coalesce(bind(listed, read), plain)


def _answer(text: Column, refused: Column) -> Column:
    return F.struct(text.alias("answer"), refused.alias("no_answer"))


def _kind(parsed: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))


def _as_text(json: Column, path: str) -> Column:
    """Text form of a JSON scalar: ``None``, ``True`` and ``False`` for literals."""
    def render(kind: Column) -> Column:
        flag = F.when(F.try_variant_get(json, path, "boolean"), F.lit("True")).otherwise(F.lit("False"))
        number = F.try_variant_get(json, path, "double").cast("string")
        return (
            F.when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", flag)
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number)
            .otherwise(F.try_variant_get(json, path, "string"))
        )

    return bind(_kind(json, path), render)


def _truthy(json: Column, path: str) -> Column:
    """Truth value of a JSON value: any non-empty string is true, also ``"false"``."""
    def judge(kind: Column) -> Column:
        text = F.try_variant_get(json, path, "string")
        return (
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "BOOLEAN", F.try_variant_get(json, path, "boolean"))
            .when(kind == "STRING", text != "")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
            .otherwise(F.try_variant_get(json, path, "double") != 0.0)
        )

    return bind(_kind(json, path), judge)


def grounding(answer: Column, context: Column, threshold: float = 0.55) -> Column:
    """``struct(hits, total, ratio, grounded)``.

    ``total`` counts answer tokens longer than three characters and ``hits``
    those found in the context, repeated tokens each time. Without such tokens
    the ratio is 1. A blank answer is never grounded. ``array_intersect`` hashes
    the long context once; only the few matched tokens are searched per token.
    """
    long = F.filter(normalize_tokens(answer), lambda t: F.length(t) > 3)
    seen = normalize_tokens(F.coalesce(context, F.lit("")))

    def count(tokens: Column) -> Column:
        return bind(
            F.array_intersect(tokens, seen),
            lambda found: F.struct(
                F.size(F.filter(tokens, lambda t: F.array_contains(found, t))).alias("hits"),
                F.size(tokens).alias("total"),
            ),
        )

    def judge(c: Column) -> Column:
        ratio = F.when(c["total"] == 0, F.lit(1.0)).otherwise(c["hits"] / F.greatest(c["total"], F.lit(1)))
        grounded = F.coalesce((strip(answer) != "") & (ratio >= threshold), F.lit(False))
        return F.struct(c["hits"], c["total"], ratio.alias("ratio"), grounded.alias("grounded"))

    return bind(bind(long, count), judge)


def grounding_ratio(answer: Column, context: Column) -> Column:
    return grounding(answer, context)["ratio"]


def is_grounded(answer: Column, context: Column, threshold: float = 0.55) -> Column:
    return grounding(answer, context, threshold)["grounded"]


def best_sentence(question: Column, context: Column) -> Column:
    """``struct(score, sentence)`` of the context sentence covering most question words.

    The earliest sentence wins a tie. A context is bounded by its truncation,
    so the whole choice is made inside the row.
    """
    def score(asked: Column) -> Column:
        return F.array_max(F.transform(
            sentences(context),
            lambda s, i: F.struct(
                F.size(F.array_intersect(asked, normalize_tokens(s))).alias("score"),
                (-i).alias("earlier"),
                s.alias("sentence"),
            ),
        ))

    return bind(
        bind(F.array_distinct(normalize_tokens(question)), score),
        lambda best: F.struct(
            F.coalesce(best["score"], F.lit(0)).alias("score"),
            F.coalesce(best["sentence"], F.lit("")).alias("sentence"),
        ),
    )
