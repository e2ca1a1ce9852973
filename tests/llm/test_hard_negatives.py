import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passageworks.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int, codes string"


def whole(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def by_rule(rows, every, n_pos=5, n_neg=3, window=(50, 95), scale=256):
    items = sorted({(i, y, tuple(math.floor(scale * c) for c in v)) for i, y, v in rows if whole(v) and y is not None}, key=repr)
    out = set()
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, label, x in items:
        if a is None or a % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, z)), i, y == label) for i, y, z in items if i != a]
        for s, p, _ in sorted((s for s in scored if s[2]), key=order)[:n_pos]:
            fit = [t for t in scored if not t[2] and window[0] * s <= 100 * t[0] <= window[1] * s]
            out |= {(a, p, r, t[1], s, t[0]) for r, t in enumerate(sorted(fit, key=order)[:n_neg], 1)}
    return out


def mined(spark, rows, every=4, **options):
    df = spark.createDataFrame([(i, v, y, "clash") for i, y, v in rows], KIND)
    return [tuple(r) for r in hn.mine_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **options).collect()]


def clustered(rng, n, width, labels):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        y = rng.randrange(labels)
        out.append((i, y, [float(np.float32(0.6 * c + 0.4 * d + rng.gauss(0, 0.5))) for c, d in zip(centres[y], centres[0])]))
    return out


@pytest.mark.parametrize("width, levels", [(5, 6), (64, 6), (70, 2), (64, 1)])
def test_against_all_pairs(spark, width, levels):
    rows = clustered(random.Random(width + levels), 150, width, 4)
    got = mined(spark, rows, levels=levels, slice_rows=40, block_rows=9)
    want = by_rule(rows, 4)
    assert len(want) > 100 and len(got) == len(want) and set(got) == want


def test_ties_copies_nulls_and_odd_rows(spark):
    rng = random.Random(8)
    rows = clustered(rng, 60, 4, 3)
    common = [0.5, 0.25, 0.75, 0.5]
    rows += [(i, i % 3, common) for i in range(60, 120)] + [(120 + i, 1, [c * 0.7 for c in common]) for i in range(8)]
    rows += rows[60:64] + [(200, None, common), (204, 1, None), (208, 1, [1.0, None, 0.0, 0.0]), (212, 2, [float("nan")] * 4), (216, 0, [])]
    rows += [(None, 1, common), (None, 2, [c * 0.8 for c in common]), (220, 5, [0.0] * 4), (224, 1, [-1.0, -1.0, -1.0, -1.0]), (228, 9, common)]
    got, want = mined(spark, rows, slice_rows=30, block_rows=8), by_rule(rows, 4)
    assert len(got) == len(want) and set(got) == want


def test_other_counts_and_windows(spark):
    rows = clustered(random.Random(2), 90, 6, 2)
    got = mined(spark, rows, n_positives=2, n_negatives=7, window=(10, 150), scale=16)
    assert set(got) == by_rule(rows, 4, 2, 7, (10, 150), 16)


def test_empty_table_one_label_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, 1, [1.0, float(i)]) for i in range(9)]) == []
    assert mined(spark, [(1, 1, [1.0, 0.5]), (3, 2, [1.0, 0.4])]) == []
    assert mined(spark, [(0, 1, [1.0, 0.5]), (3, 2, [1.0, 0.4])]) == []


def coded_table(x):
    codes, aligned, part, residual = hn.coded(x.astype(float))
    return pa.table({
        "x": pa.array(x.tolist(), pa.list_(pa.int64())), "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
        "aligned": pa.array(aligned.tolist()), "part": pa.array(part), "residual": pa.array(residual),
    })


@pytest.mark.parametrize("width", [3, 64, 100])
def test_intervals_hold_and_narrow(width):
    rng = np.random.default_rng(5)
    x, y = rng.integers(-200, 200, (400, width)), rng.integers(-200, 200, (30, width))
    x[0], x[1], y[0] = 0, 150, 0
    low, high = hn.intervals(hn.Coded(coded_table(x), width), hn.Asked(coded_table(y), width), slice(None), slice(None))
    true = x @ y.T
    assert (low <= true).all() and (true <= high).all()
    # the codes leave a few hundredths of a vector, so intervals are short against the scores' range
    scale = np.linalg.norm(x, axis=1)[1:, None] * np.linalg.norm(y, axis=1)[1:]
    assert ((high - low)[1:, 1:] / scale).mean() < 0.25


def test_rotation_keeps_lengths_and_products():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 70))
    z = hn.rotated(x)
    assert z.shape == (20, 128) and np.allclose(z @ z.T, x @ x.T)


def test_few_rows_are_scored_in_full(spark, monkeypatch):
    """The intervals turn most pairs away before integer scoring."""
    counts = spark.sparkContext.accumulator(0)
    real = hn.scores_of

    def counted(rows, asked, at, who):
        counts.add(len(at))
        return real(rows, asked, at, who)

    monkeypatch.setattr(hn, "scores_of", counted)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    hn.mine_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect()
    assert 0 < counts.value < 0.2 * 40 * df.count()
