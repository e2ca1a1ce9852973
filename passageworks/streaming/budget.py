"""Token budget controller on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.adaptive import _Steps, averages, measured
from ..schemas import AdaptiveOptions


def budget_controller_stream(
    events: DataFrame,
    key: str,
    order: list[str],
    value: str,
    options: AdaptiveOptions = AdaptiveOptions(),
    delay: str = "1 hour",
) -> DataFrame:
    """Streaming ``(key, n, ema, budget)``, one row per key and micro-batch.

    ``order`` is a timestamp and a number. Events that are not older than the watermark, which
    follows the latest event by ``delay``, wait in a buffer in event-time order; older ones are folded
    for good into three numbers. A row shows the state after the buffered events too. So the
    result does not depend on how the log is cut into batches, as long as no event is later than
    ``delay``; one that is counts as the next after those folded. State per key is bounded by the events
    of one ``delay``, and a group by the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``; set one of them.
    Events without a number are left out. Use update output mode and keep the row
    with the largest ``n``.
    """
    steps = _Steps(options)
    output = T.StructType([
        events.schema[key],
        T.StructField("n", T.LongType()),
        T.StructField("ema", T.DoubleType()),
        T.StructField("budget", T.IntegerType()),
    ])
    waiting = [T.StructField("at", T.ArrayType(T.LongType())), T.StructField("tie", T.ArrayType(T.LongType())), T.StructField("x", T.ArrayType(T.DoubleType()))]
    state_type = T.StructType([*output.fields[1:], *waiting])

    def after(folded: tuple, x: np.ndarray) -> tuple:
        if not len(x):
            return folded
        n, ema, budget = folded
        passed = averages(x.tolist(), ema, steps.alpha)
        return n + len(passed), passed[-1], int(steps.after(budget - steps.low, passed)) + steps.low

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema, budget, *held = state.get if state.exists else (0, None, options.start_tokens, [], [], [])
        cols = [[p[c].to_numpy() for p in parts_] for parts_ in [list(parts)] for c in ("_at", "_tie", "_x")]
        at, tie, x = (np.concatenate([np.asarray(h, c[0].dtype), *c]) for h, c in zip(held, cols))
        placed = np.lexsort((tie, at))
        at, tie, x = at[placed], tie[placed], x[placed]
        done = int(np.searchsorted(at, state.getCurrentWatermarkMs() * 1000))
        folded = after((n, ema, budget), x[:done])
        state.update((*folded, at[done:].tolist(), tie[done:].tolist(), x[done:].tolist()))
        yield pd.DataFrame([(*group, *after(folded, x[done:]))], columns=output.names)

    # whole microseconds keep the order exact in Python
    when = F.col(order[0]).cast("timestamp")
    rows = measured(events, value).withColumn("_when", when).withWatermark("_when", delay).select(
        key, "_when", F.unix_micros("_when").alias("_at"), F.col(order[1]).cast("long").alias("_tie"), F.col(value).cast("double").alias("_x")
    )
    return rows.groupBy(key).applyInPandasWithState(
        fold, output, state_type, "update", GroupStateTimeout.NoTimeout
    )


def latest_budgets(updates: DataFrame, key: str) -> DataFrame:
    """The last state per key of the written updates."""
    return updates.groupBy(key).agg(
        F.max("n").alias("n"), F.max_by("ema", "n").alias("ema"), F.max_by("budget", "n").alias("budget")
    )
