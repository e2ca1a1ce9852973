import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from passageworks.operators import adaptive, sessions
from passageworks.schemas import AdaptiveOptions
from passageworks.streaming.budget import budget_controller_stream, latest_budgets

START = dt.datetime(2024, 1, 1)
SCHEMA = "key LONG, ts TIMESTAMP, id LONG, value DOUBLE"


#: Latencies of one key, options, and what is left after the last of them, worked out by hand.
CASES = [
    # the first latency is the first average; above 4.4 the budget shrinks to the whole part of 0.7 times itself
    ([4.5], {}, (4.5, 268)),
    ([4.5, 4.5], {}, (4.5, 187)),
    # below 2.0 it grows to the whole part of 1.2 times itself
    ([1.9], {}, (1.9, 460)),
    # the bounds themselves change nothing
    ([4.0 * 1.1], {}, (4.4, 384)),
    ([2.0], {}, (2.0, 384)),
    # clamps
    ([9.0] * 20, {}, (9.0, 64)),
    ([0.5] * 20, {}, (0.5, 512)),
    ([0.5], {"start_tokens": 500}, (0.5, 512)),
    # outside its range a budget moves towards the range only
    ([0.5], {"start_tokens": 900}, (0.5, 900)),
    ([9.0], {"start_tokens": 900}, (9.0, 630)),
    ([9.0], {"start_tokens": 10}, (9.0, 10)),
    ([0.5], {"start_tokens": 10}, (0.5, 12)),
    # the average: 0.4 * 10 + 0.6 * 1 = 4.6, then 0.4 * 0 + 0.6 * 4.6 = 2.76; one growth, one shrink, nothing
    ([1.0, 10.0, 0.0], {}, (2.76, 322)),
    ([1.0, 10.0], {"latency_target": 40.0, "ema_alpha": 0.5}, (5.5, 512)),
]


def check(df, want):
    """``want`` holds ``(n, ema, budget)`` by key."""
    got = {r.key: (r.n, r.ema, r.budget) for r in df.collect()}
    assert got.keys() == want.keys()
    for key, (n, ema, budget) in want.items():
        assert got[key][0] == n and got[key][2] == budget
        assert got[key][1] == pytest.approx(ema, rel=1e-9)


def uncut(spark, rows, options=AdaptiveOptions()):
    """Every key as one stretch."""
    found = adaptive.budget_controller(events(spark, rows), "key", ["ts", "id"], "value", options, stretch=10**6)
    return {r.key: (r.n, r.ema, r.budget) for r in found.collect()}


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def random_rows(seed, n=3000):
    """One key holds half of all events, over many hours."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if rng.random() < 0.5 else rng.randrange(2, 40)
        at = START + dt.timedelta(seconds=rng.randrange(0, 5 * 86400))
        rows.append((key, at, i, rng.choice([0.5, 1.0, 3.9, 4.4, 6.0, 20.0]) * rng.random()))
    return rows


@pytest.mark.parametrize("stretch", [1, 2, 4096])
def test_cases(spark, stretch):
    by_options = {}
    for values, options, left in CASES:
        by_options.setdefault(tuple(options.items()), []).append((values, left))
    for options, cases in by_options.items():
        rows = [(k, START + dt.timedelta(seconds=i), i, x) for k, (values, _) in enumerate(cases) for i, x in enumerate(values)]
        found = adaptive.budget_controller(events(spark, rows), "key", ["ts", "id"], "value", AdaptiveOptions(**dict(options)), stretch=stretch, group=3)
        check(found, {k: (len(values), *left) for k, (values, left) in enumerate(cases)})


@pytest.mark.parametrize("options", [
    AdaptiveOptions(), AdaptiveOptions(latency_target=2.0), AdaptiveOptions(min_new_tokens=2, start_tokens=4),
    AdaptiveOptions(start_tokens=900), AdaptiveOptions(start_tokens=10, latency_target=1.0, ema_alpha=0.01),
])
def test_cuts_change_nothing(spark, options):
    """Large keys in stretches of 60 or all keys in stretches of 7, chained in groups of 4."""
    rows = random_rows(options.start_tokens)
    want = uncut(spark, rows, options)
    low, high = min(options.min_new_tokens, options.start_tokens), max(options.max_new_tokens, options.start_tokens)
    assert all(low <= budget <= high for _, _, budget in want.values())
    for stretch in (60, 7):
        found = adaptive.budget_controller(events(spark, rows), "key", ["ts", "id"], "value", options, stretch=stretch, group=4)
        check(found, want)


def test_same_bits_however_the_table_is_dealt(spark):
    rows = random_rows(5)
    bits = set()
    for parts in (1, 4, 9):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        found = adaptive.budget_controller(df, "key", ["ts", "id"], "value", stretch=100, group=3)
        bits.add(frozenset((r.key, r.ema.hex(), r.budget) for r in found.collect()))
    assert len(bits) == 1


def test_numbers_of_a_large_key(spark):
    """Numbered by ranges: no window over the whole key."""
    rows = [(1, START + dt.timedelta(seconds=(i * 37) % 1000), i, 1.0) for i in range(1000)] + [(None, START, i, 1.0) for i in range(50)]
    got = adaptive._numbered(events(spark, rows), "key", ["ts", "id"]).collect()
    for key, n in ((1, 1000), (None, 50)):
        mine = sorted((r.ts, r.id, r._number) for r in got if r.key == key)
        assert [m[2] for m in mine] == list(range(n))


def test_average_is_the_controllers(spark):
    rows = random_rows(11)
    want = uncut(spark, rows)
    for stretch in (10**6, 60):
        got = {r.key: (r.n, r.ema) for r in adaptive.ema_latency(events(spark, rows), "key", ["ts", "id"], "value", stretch=stretch).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == n and got[k][1] == pytest.approx(ema, rel=1e-9) for k, (n, ema, _) in want.items())


@pytest.mark.parametrize("stretch", [10**6, 5])
def test_missing_key_is_a_key(spark, stretch):
    rows = [(None, START + dt.timedelta(minutes=i * 7), i, 9.0) for i in range(30)] + [(1, START, 99, 9.0)]
    found = adaptive.budget_controller(events(spark, rows), "key", ["ts", "id"], "value", stretch=stretch)
    assert {r.key: (r.n, r.budget) for r in found.collect()} == {None: (30, 64), 1: (1, 268)}


def test_a_constant_on_a_bound_stays_there(spark):
    """Chaining gives the average of a constant exactly, so no last digit crosses the bound."""
    o = AdaptiveOptions()
    rows = [(k, START + dt.timedelta(seconds=i), i, x) for k, x in ((1, o.latency_target * 1.1), (2, o.latency_target * 0.5)) for i in range(500)]
    found = adaptive.budget_controller(events(spark, rows), "key", ["ts", "id"], "value", o, stretch=20, group=4)
    plain = uncut(spark, rows, o)
    assert {r.key: r.budget for r in found.collect()} == {k: b for k, (_, _, b) in plain.items()}


def test_groups_across_batches():
    import pandas as pd

    rows = pd.DataFrame({"a": [1, 1, None, None, 2, 2, 2, 3], "b": range(8)})
    for cuts in ([8], [1, 7], [3, 3, 2], [1] * 8, [0, 5, 0, 3]):
        at, batches = 0, []
        for n in cuts:
            batches.append(rows.iloc[at:at + n].reset_index(drop=True))
            at += n
        got = [(k, g["b"].tolist()) for k, g in adaptive._runs(iter(batches), ["a"])]
        assert got == [((1.0,), [0, 1]), ((None,), [2, 3]), ((2.0,), [4, 5, 6]), ((3.0,), [7])]


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(random_rows(13, 900), key=lambda r: (r[1], r[2]))
    for part in range(3):
        df = spark.createDataFrame(rows[part * 300:(part + 1) * 300], SCHEMA)
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    out = tmp_path / "out"
    # one part after the other, each in its own run: state survives in the checkpoint
    source = tmp_path / "feed"
    source.mkdir()
    for part in range(3):
        for f in (tmp_path / "in" / f"{part}").glob("*.parquet"):
            (source / f"{part}.parquet").write_bytes(f.read_bytes())
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        updates = budget_controller_stream(stream, "key", ["ts", "id"], "value")
        updates.writeStream.outputMode("update").foreachBatch(
            lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
        ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    check(latest_budgets(spark.read.parquet(str(out)), "key"), uncut(spark, rows))


def test_any_split_of_the_log_gives_the_same_budgets(spark, tmp_path):
    """Events up to an hour late, in batches cut anywhere."""
    rng = random.Random(17)
    rows = [(rng.randrange(3), START + dt.timedelta(minutes=i), i, rng.choice([0.5, 3.9, 4.4, 9.0]) * rng.random()) for i in range(300)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(50))
    for nth, cuts in enumerate(([300], [7, 100, 193])):
        feed, out, at = tmp_path / f"feed{nth}", tmp_path / f"out{nth}", 0
        feed.mkdir()
        for part, size in enumerate(cuts):
            made = tmp_path / f"made{nth}-{part}"
            spark.createDataFrame(arrival[at:at + size], SCHEMA).coalesce(1).write.parquet(str(made))
            for f in made.glob("*.parquet"):
                (feed / f"{part}.parquet").write_bytes(f.read_bytes())
            at += size
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(feed))
            budget_controller_stream(stream, "key", ["ts", "id"], "value", delay="2 hours").writeStream.outputMode("update").foreachBatch(
                lambda b, n, out=out: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
            ).option("checkpointLocation", str(tmp_path / f"cp{nth}")).trigger(availableNow=True).start().awaitTermination()
        check(latest_budgets(spark.read.parquet(str(out)), "key"), uncut(spark, rows))


def test_question_intake(spark):
    turns = [(1, 0, "  hello \n"), (1, 1, "　 "), (1, 2, " EXIT "), (1, 3, "late"), (2, 0, "exit now"), (2, 1, "Quit")]
    df = spark.createDataFrame(turns, "session_id LONG, turn INT, text STRING")
    rows = [tuple(r) for r in sessions.question_intake(df).collect()]
    assert sorted(rows) == [(1, 0, "hello"), (2, 0, "exit now")]


def test_pairs_across_stretches(spark):
    """Gaps in the numbering, and a conversation much longer than a stretch."""
    rng = random.Random(4)
    turns, at = [], 0
    for i in range(2000):
        at += rng.choice([1, 1, 2, 40])
        turns.append((1 if i % 3 else i, at, rng.choice(["user", "assistant", "system"]), f"t{i}"))
    want = []
    by = {}
    for c, t, role, text in sorted(turns):
        by.setdefault(c, []).append((t, role, text))
    for c, items in by.items():
        for (t, r, x), (_, r2, y) in zip(items, items[1:]):
            if r == "user" and r2 == "assistant":
                want.append((c, t, x, y))
    df = spark.createDataFrame(turns, "conv_id LONG, turn LONG, role STRING, text STRING")
    assert sorted(tuple(r) for r in sessions.pair_turns(df, run=16).collect()) == sorted(want)


@pytest.mark.parametrize("stretch", [10**6, 9])
def test_events_without_a_number_are_left_out(spark, stretch):
    rows = random_rows(21, 400)
    odd = [(r[0], r[1], 10_000 + r[2], x) for r, x in zip(rows, [None, float("nan")] * 200)]
    both, want = events(spark, rows + odd), uncut(spark, rows)
    check(adaptive.budget_controller(both, "key", ["ts", "id"], "value", stretch=stretch), want)
    assert sum(r.n for r in adaptive.unmeasured(both, "key", "value").collect()) == 400
