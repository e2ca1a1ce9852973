"""Conversation turns: intake rules and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Inputs that end a session.
ENDINGS = ("exit", "quit")


def question_intake(
    turns: DataFrame, session: str = "session_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """Stripped, non-empty questions before the first ``exit`` or ``quit`` of a session.

    The end of a session is a minimum, which combines before the shuffle; a
    running window would put all turns of a long session into one task.
    """
    asked = turns.withColumn(text, strip(F.col(text)))
    ends = (
        asked.filter(F.lower(text).isin(*ENDINGS))
        .groupBy(session)
        .agg(F.min(order).alias("_end"))
    )
    open_turns = asked.join(ends, session, "left").filter(
        F.col("_end").isNull() | (F.col(order) < F.col("_end"))
    )
    return open_turns.filter(F.col(text) != "").drop("_end").select(turns.columns)


def pair_turns(
    turns: DataFrame,
    session: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    run: int = 4096,
) -> DataFrame:
    """Each user turn with the assistant turn that directly follows it.

    ``lead`` runs within stretches of ``run`` turn numbers, so a conversation of
    any length is spread over tasks. Only the last turn of a stretch looks
    further: to the first turn of the next stretch, one row per stretch.
    """
    row = F.struct(F.col(order), F.col(role), F.col(text))
    cut = turns.select(session, order, role, text).withColumn(
        "_run", F.col(order) - F.pmod(order, F.lit(run))
    )
    within = Window.partitionBy(session, "_run").orderBy(order)
    led = cut.withColumn("_next", F.lead(row).over(within))
    heads = cut.groupBy(session, "_run").agg(F.min(row).alias("_head"))
    across = Window.partitionBy(session).orderBy("_run")
    heads = heads.select(session, "_run", F.lead("_head").over(across).alias("_head"))

    # the last turn of a stretch is the one row of it without a successor
    nearby = led.join(heads, [session, "_run"], "left")
    pairs = nearby.withColumn("_next", F.coalesce("_next", "_head"))
    answered = (F.col(role) == "user") & (F.col(f"_next.{role}") == "assistant")
    return pairs.filter(answered).select(
        session, order, F.col(text).alias("question"), F.col(f"_next.{text}").alias("answer")
    )
