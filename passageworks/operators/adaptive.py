"""Ordered state per key: moving average and token budget.

Both are folds over a key's events in time order. Every key's events are numbered in that
order and cut into stretches of ``STRETCH`` events; a key's last stretch may be shorter, and most
keys have only one. Tasks fold stretches:

1. With its first value as the average before it, a stretch ends in an average ``e``. From any
   other average ``a`` it ends in ``e + p * (a - first)``, where ``p`` is ``1 - alpha`` to the number of its
   events. Chaining these gives the average at the start of every stretch.
2. With that start, a stretch is a fixed map from the budget before it to the
   budget after it. Budgets lie in a small range, so the map is a short array.
   The first stretch of a key starts from a known budget and needs no map.
3. Chaining the stretches of a key gives the final budget.

The cut depends on an event's number only, so every key gets the same arithmetic, whatever
its size and however the table is partitioned; a key of one stretch gets that of the plain
loop. Numbers of large keys come from ranges of the sorted events (rows before the range plus the
place in it), so no task sorts a large key. Chains run over groups of ``GROUP`` stretches, then over
groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AdaptiveOptions
from ..session import fits, scratch_dir

# Latency bounds of the controller, as shares of the target.
SLOW, FAST = 1.1, 0.5

#: Events in a stretch, and stretches that one task chains.
STRETCH, GROUP = 4096, 1024


def measured(events: DataFrame, value: str) -> DataFrame:
    """The events that carry a number; batch and stream leave out the same ones."""
    x = F.col(value).cast("double")
    return events.filter(x.isNotNull() & ~F.isnan(x))


def unmeasured(events: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n)``: how many events per key carry no number and are left out."""
    x = F.col(value).cast("double")
    return events.filter(x.isNull() | F.isnan(x)).groupBy(key).agg(F.count("*").alias("n"))


def _numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_number``, the place of a row among those of its key.

    Rows are dealt by ranges of key and order. Ranges are drawn from a sample, so they are
    stored before rows are counted in them.
    """
    place = scratch_dir(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(place)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(place)
    sizes = dealt.groupBy(key, "_range").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_place"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1)
    joined = inside.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_place")))
    return joined.withColumn("_number", F.col("_before") + F.col("_inside")).select(*rows.columns, "_number")


def _cut(events: DataFrame, key: str, order: list[str], value: str, stretch: int) -> tuple[DataFrame, bool]:
    """Events with their stretch ``_seg``, and whether any key has more than one.

    Keys of one stretch are not numbered. Counting combines before the shuffle.
    """
    rows = measured(events, value).select(F.col(key), *order, F.col(value).cast("double").alias("_x"))
    large = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter(F.col("_n") > stretch).select("_key")
    if large.isEmpty():
        return rows.withColumn("_seg", F.lit(0).cast("long")), False
    large = F.broadcast(large) if fits(large) else large
    same = F.col(key).eqNullSafe(F.col("_key"))
    numbered = _numbered(rows.join(large, same, "left_semi"), key, order)
    cut = numbered.withColumn("_seg", F.floor(F.col("_number") / stretch)).drop("_number")
    return cut.unionByName(rows.join(large, same, "left_anti").withColumn("_seg", F.lit(0).cast("long"))), True


def _head(batch: pd.DataFrame, keys: list[str], at: int) -> tuple:
    """The group of a row, with None for missing values (NaN would differ from itself)."""
    cells = (batch[k].iloc[[at]] for k in keys)
    return tuple(None if c.isna().iloc[0] else c.tolist()[0] for c in cells)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each group, for rows that come sorted by ``keys``; a group may span batches."""
    open_: list[pd.DataFrame] = []
    here: tuple = ()
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for k in keys:
            column, before = batch[k], batch[k].shift()
            new |= ((column != before) & ~(column.isna() & before.isna())).fillna(False).to_numpy(bool)
        head = _head(batch, keys, 0)
        new[0] = bool(open_) and head != here
        here = here if open_ else head
        start = 0
        for edge in np.flatnonzero(new).tolist():
            open_ += [batch.iloc[start:edge]] if edge > start else []
            yield here, pd.concat(open_) if len(open_) > 1 else open_[0]
            open_, here, start = [], _head(batch, keys, edge), edge
        open_.append(batch.iloc[start:])
    if open_:
        yield here, pd.concat(open_) if len(open_) > 1 else open_[0]


def averages(x: list[float], start: float | None, alpha: float) -> list[float]:
    """The average after each value; without a start the first value is the first average."""
    step = lambda a, v: alpha * v + (1.0 - alpha) * a
    return list(accumulate(x, step)) if start is None else list(accumulate(x, step, initial=start))[1:]


class _Steps:
    """What runs of slow or fast averages do to a budget, for every budget in range."""

    def __init__(self, options: AdaptiveOptions):
        low = min(options.min_new_tokens, options.start_tokens)
        high = max(options.max_new_tokens, options.start_tokens)
        budgets = range(low, high + 1)
        self.low = low
        self.same = np.arange(len(budgets))
        shrink = np.array([
            max(options.min_new_tokens, int(b * options.shrink_factor)) if b > options.min_new_tokens else b
            for b in budgets
        ]) - low
        grow = np.array([
            min(options.max_new_tokens, int(b * options.growth_factor)) if b < options.max_new_tokens else b
            for b in budgets
        ]) - low
        self.powers = {1: self._powers(shrink), -1: self._powers(grow)}
        self.slow, self.fast = options.latency_target * SLOW, options.latency_target * FAST
        self.alpha = options.ema_alpha

    @staticmethod
    def _powers(step: np.ndarray) -> list[np.ndarray]:
        """The step taken 1, 2, ... times, until once more changes nothing."""
        out = [step]
        while not np.array_equal(out[-1], step[out[-1]]) and len(out) < len(step):
            out.append(step[out[-1]])
        return out

    def after(self, change, ema: list[float]):
        """A budget, or a map of all budgets, after these averages: one step per run on one side of the bounds."""
        e = np.array(ema)
        side = np.where(e > self.slow, 1, np.where(e < self.fast, -1, 0))
        starts = np.flatnonzero(np.r_[True, np.diff(side) != 0]) if len(side) else []
        for at, end in zip(starts, [*starts[1:], len(side)]):
            if side[at]:
                powers = self.powers[int(side[at])]
                change = powers[min(end - at, len(powers)) - 1][change]
        return change


def _ends(cut: DataFrame, key: str, order: list[str], alpha: float) -> DataFrame:
    """``(key, _seg, _n, _first, _end)``: a stretch's size, first value, and average after it when that came before it."""
    kind = T.StructType([
        cut.schema[key], cut.schema["_seg"], T.StructField("_n", T.LongType()),
        T.StructField("_first", T.DoubleType()), T.StructField("_end", T.DoubleType()),
    ])

    def fold(batches):
        out = []
        for (k, seg), rows in _runs(batches, [key, "_seg"]):
            x = rows["_x"].tolist()
            out.append((k, seg, len(x), x[0], averages(x, None, alpha)[-1]))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=kind.names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=kind.names)

    return cut.repartition(key, "_seg").sortWithinPartitions(key, "_seg", *order).mapInPandas(fold, kind)


def _starts(ends: DataFrame, key: str, alpha: float, group: int) -> DataFrame:
    """``(key, _seg, _start)``: the average before each stretch but the first of a key."""
    key_field, seg_field = ends.schema[key], ends.schema["_seg"]
    double = lambda name: T.StructField(name, T.DoubleType())
    ends = ends.withColumn("_share", F.pow(F.lit(1.0 - alpha), F.col("_n"))).withColumn("_grp", F.floor(F.col("_seg") / group))
    maps = T.StructType([key_field, T.StructField("_grp", T.LongType()), double("_first"), double("_end"), double("_share")])

    def compose(batches):
        out = []
        for (k, grp), rows in _runs(batches, [key, "_grp"]):
            first, end, share = None, None, 1.0
            for f, e, p in zip(rows["_first"].tolist(), rows["_end"].tolist(), rows["_share"].tolist()):
                first, end = (f, e) if first is None else (first, e + p * (end - f))
                share *= p
            out.append((k, grp, first, end, share))
        if out:
            yield pd.DataFrame(out, columns=maps.names)

    def chain(place: str, kind: T.StructType):
        def run(batches):
            for (k, *_), rows in _runs(batches, [key] if place == "_grp" else [key, "_grp"]):
                at, out = None, []
                for number, opens, f, e, p in zip(rows[place].tolist(), rows["_opens"].tolist(), rows["_first"].tolist(), rows["_end"].tolist(), rows["_share"].tolist()):
                    if opens:
                        at = f
                        continue
                    if at is not None:
                        out.append((k, number, at))
                    at = e if at is None else e + p * (at - f)
                if out:
                    yield pd.DataFrame(out, columns=kind.names)

        return run

    closed = F.lit(False).alias("_opens")
    by_group = ends.repartition(key, "_grp").sortWithinPartitions(key, "_grp", "_seg")
    groups = by_group.select(key, "_grp", "_first", "_end", "_share").mapInPandas(compose, maps)
    opening = T.StructType([key_field, T.StructField("_grp", T.LongType()), double("_start")])
    group_starts = groups.select("*", closed).repartition(key).sortWithinPartitions(key, "_grp").mapInPandas(chain("_grp", opening), opening)
    # the average before a group sorts as its first row, which saves a join
    none = F.lit(None).cast("double")
    rows = ends.select(key, "_grp", "_seg", closed, "_first", "_end", "_share").unionByName(
        group_starts.select(key, "_grp", F.lit(-1).cast("long").alias("_seg"), F.lit(True).alias("_opens"), F.col("_start").alias("_first"), none.alias("_end"), none.alias("_share"))
    )
    starts = T.StructType([key_field, seg_field, double("_start")])
    return rows.repartition(key, "_grp").sortWithinPartitions(key, "_grp", "_seg").mapInPandas(chain("_seg", starts), starts)


def _folded(events: DataFrame, key: str, order: list[str], value: str, options: AdaptiveOptions, stretch: int, group: int) -> DataFrame:
    """``(key, n, ema, budget)`` after all events of a key."""
    cut, several = _cut(events, key, order, value, stretch)
    steps = _Steps(options)
    kind = T.StructType([
        cut.schema[key], T.StructField("_seg", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ema", T.DoubleType()),
        T.StructField("budget", T.IntegerType()), T.StructField("_map", T.ArrayType(T.IntegerType())),
    ])
    rows = cut.withColumn("_opens", F.lit(False))
    if several:
        starts = _starts(_ends(cut, key, order, options.ema_alpha), key, options.ema_alpha, group)
        rows = rows.unionByName(starts.select(key, "_seg", F.col("_start").alias("_x"), F.lit(True).alias("_opens")), allowMissingColumns=True)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=kind.names).astype({"budget": "Int32", "_seg": "Int64"})

    def fold(batches):
        out = []
        for (k, seg), rows in _runs(batches, [key, "_seg"]):
            x, known = rows["_x"].tolist(), not seg
            start = None if known else x.pop(0)
            ema = averages(x, start, steps.alpha)
            change = steps.after(options.start_tokens - steps.low if known else steps.same, ema)
            out.append((k, seg, len(x), ema[-1], int(change) + steps.low if known else None, None if known else change.tolist()))
            if len(out) >= 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    states = rows.repartition(key, "_seg").sortWithinPartitions(key, "_seg", F.col("_opens").desc(), *order).mapInPandas(fold, kind)
    if several:
        def chain(batches):
            out = []
            for (k, place), rows in _runs(batches, [key, "_grp"]):
                known = rows["_map"].iloc[0] is None
                at = int(rows["budget"].iloc[0]) - steps.low if known else np.array(rows["_map"].iloc[0])
                for change in rows["_map"].iloc[1:]:
                    at = np.asarray(change)[at]
                out.append((k, place, int(rows["n"].sum()), rows["ema"].iloc[-1], int(at) + steps.low if known else None, None if known else at.tolist()))
            if out:
                yield frame(out)

        for by in (F.floor(F.col("_seg") / group), F.lit(0).cast("long")):
            grouped = states.withColumn("_grp", by).repartition(key, "_grp").sortWithinPartitions(key, "_grp", "_seg")
            states = grouped.mapInPandas(chain, kind)
    return states.select(key, "n", "ema", "budget")


def ema_latency(
    events: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.4, stretch: int = STRETCH, group: int = GROUP,
) -> DataFrame:
    """``(key, n, ema)`` after all events of a key; the first value seeds the average."""
    return _folded(events, key, order, value, AdaptiveOptions(ema_alpha=alpha), stretch, group).drop("budget")


def budget_controller(
    events: DataFrame, key: str, order: list[str], value: str, options: AdaptiveOptions = AdaptiveOptions(), stretch: int = STRETCH, group: int = GROUP,
) -> DataFrame:
    """``(key, n, ema, budget)`` after all events of a key.

    An average above 1.1 times the target shrinks the budget, one below half
    the target lets it grow, both truncated to whole tokens and clamped.
    """
    return _folded(events, key, order, value, options, stretch, group)
