import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageworks.llm import mixing, queries

LABELS = "doc_id LONG, quality INT, toxic INT"


def fixture(spark, n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        domain = 0 if i % 10 < 6 else 1 if i % 10 < 8 else 2
        own = ["fine", "vile", "menu"][domain]
        words = [rng.choice([own + str(rng.randint(0, 20)), "the", "of", f"w{rng.randint(0, 3000)}"]) for _ in range(rng.randint(20, 90))]
        rows.append((i, " ".join(words), "x"))
        if i % 3 == 0:
            labels.append((i, int(domain != 2), int(domain == 1)))
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING"), spark.createDataFrame(labels, LABELS)


def test_posteriors_on_held_out_documents(spark):
    docs, labels = fixture(spark)
    rows = mixing.measure(docs, labels, mixing.domain_of(), 3).collect()
    held = [r for r in rows if r["_mix_id"] % 3]
    right = [int(np.argmax(r["_mix_p"])) == (0 if r["_mix_id"] % 10 < 6 else 1 if r["_mix_id"] % 10 < 8 else 2) for r in held]
    assert np.mean(right) > 0.95 and all(abs(sum(r["_mix_p"]) - 1) < 1e-9 for r in rows)


@pytest.mark.parametrize("weights", [[0.5, 0.2, 0.3], [0.9, 0.0, 0.1], [0.3, 0.6, 0.1]])
def test_totals_meet_the_targets(spark, weights):
    docs, labels = fixture(spark)
    measured = mixing.measure(docs, labels, mixing.domain_of(), 3)
    y, shares = mixing.fit_rates(measured, weights)
    rows = measured.withColumn("r", mixing.rate(F.col("_mix_p"), y)).collect()
    t, p, r = (np.array([x[c] for x in rows]) for c in ("_mix_tokens", "_mix_p", "r"))
    totals = (t * r) @ p / t.sum()
    assert (r >= 0).all() and np.allclose(totals, shares) and np.abs(totals - weights).max() < 0.01


def newton(t, p, weights, ridge):
    """Rates of the least-squares problem, by Newton steps on its dual."""
    share, y = t / t.sum(), np.zeros(p.shape[1])
    value = lambda y: (share * np.maximum(0, 1 + p @ y) ** 2).sum() / 2 + ridge * (y @ y) / 2 - weights @ y
    for _ in range(300):
        r = np.maximum(0, 1 + p @ y)
        slope = (share * r) @ p + ridge * y - weights
        if np.abs(slope).max() < 1e-13:
            break
        way = -np.linalg.solve((p[r > 0] * share[r > 0, None]).T @ p[r > 0] + ridge * np.eye(len(y)), slope)
        size = 1.0
        while value(y + size * way) > value(y) + 1e-4 * size * (slope @ way) + 1e-15 and size > 1e-9:
            size /= 2
        y = y + size * way
    return np.maximum(0, 1 + p @ y)


@pytest.mark.parametrize("weights", [[0.7, 0.05, 0.25], [0.1, 0.1, 0.8], [0.99, 0.0, 0.01]])
def test_rates_are_the_least_squares_solution(spark, weights):
    """Held against Newton steps, and against plain projected gradient on the rates themselves."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    t = rng.integers(0, 50, 200)
    measured = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "_mix_tokens LONG, _mix_p ARRAY<DOUBLE>")
    weights, ridge = np.array(weights), 0.01
    y, _ = mixing.fit_rates(measured, weights.tolist(), ridge)
    got = np.maximum(0, 1 + p @ np.array(y))
    assert np.abs(got - newton(t, p, weights, ridge)).max() < 1e-6
    share, r = t / t.sum(), np.ones(200)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * (p @ ((share * r) @ p - weights) + ridge * (r - 1)))
    assert np.abs(got - r)[t > 0].max() < 0.05


def test_query_against_newton_and_fair_to_short_texts(spark):
    """Rates of all documents of sf0.1; targets are met; labelled good texts of any length get alike rates."""
    folder = "/root/testdata/sf0.1"
    rows = queries.op7_source_mixing(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    t, r = (np.array([x[c] for x in rows], float) for c in ("n_tokens", "rate"))
    p = np.array([[x[f"p_{d}"] for d in mixing.DOMAINS] for x in rows])
    weights = np.array([queries.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(newton(t, p, weights, mixing.RIDGE) - r).max() < 1e-5
    assert np.abs((t * r) @ p / t.sum() - weights).max() < mixing.MISSED
    assert all(int(x["rate"]) <= x["copies"] <= int(x["rate"]) + 1 for x in rows)
    good = {x["doc_id"] for x in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    of = [(x["n_tokens"], x["rate"]) for x in rows if x["doc_id"] in good]
    means = [np.mean([v for n, v in of if a <= n < b]) for a, b in ((1, 50), (50, 100), (100, 200), (200, 500), (500, 2000), (2000, 10**9))]
    assert max(means) < 2 * min(means) and sum(x["copies"] == 0 for x in rows if x["doc_id"] in good) < 0.1 * len(of)


def test_copies_follow_the_rates(spark):
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), (F.col("id") % 4 * 0.7).alias("r"))
    got = df.withColumn("c", mixing.copies(F.col("r"), F.col("id"), F.col("h"))).groupBy("r").agg(F.avg("c"), F.min("c"), F.max("c")).collect()
    assert all(abs(r[1] - r["r"]) < 0.03 and r[2] >= int(r["r"]) and r[3] <= int(r["r"]) + 1 for r in got)


def test_mixed_rows_and_odd_input(spark):
    docs, labels = fixture(spark, 300)
    docs = docs.union(spark.createDataFrame([(None, None, None), (5000, "", "y"), (5001, "x " * 50_000, "z"), (5001, "x " * 50_000, "z")], docs.schema))
    rated = {(r["_mix_id"], r["_mix_hash"]): r["_mix_copies"] for r in mixing.rated(docs, labels, mixing.domain_of(), [0.8, 0.1, 0.1]).collect()}
    got = mixing.mixed(docs, labels, mixing.domain_of(), [0.8, 0.1, 0.1])
    assert got.columns == docs.columns
    counts = {(r["doc_id"], r["h"]): r["count"] for r in got.groupBy("doc_id", F.xxhash64("text").alias("h")).count().collect()}
    twice = {k: n * (2 if k[0] == 5001 else 1) for k, n in rated.items() if n}
    assert counts == twice


def test_no_labels_and_empty_table(spark):
    docs, labels = fixture(spark, 30)
    none = mixing.rated(docs, labels.limit(0), mixing.domain_of(), [0.8, 0.1, 0.1]).collect()
    assert len(none) == 30 and all(np.allclose(r["_mix_p"], 1 / 3) for r in none)
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (77777, 0, 1)], LABELS)
    assert mixing.rated(docs, odd, mixing.domain_of(), [0.8, 0.1, 0.1]).count() == 30
    assert mixing.rated(docs.limit(0), labels, mixing.domain_of(), [0.8, 0.1, 0.1]).count() == 0
    assert mixing.mixed(docs.limit(0), labels, mixing.domain_of(), [0.8, 0.1, 0.1]).count() == 0


def test_fit_converges_on_the_real_tables(spark):
    folder, weights = "/root/testdata/sf0.1", np.array([0.95, 0.02, 0.03])
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    measured = mixing.measure(docs, labels, mixing.domain_of(), 3)
    y, shares = mixing.fit_rates(measured, weights.tolist())
    rows = measured.collect()
    t, p = (np.array([r[c] for r in rows]) for c in ("_mix_tokens", "_mix_p"))
    totals = (t * np.maximum(0, 1 + p @ np.array(y))) @ p / t.sum()
    assert np.allclose(totals, shares) and np.abs(totals + mixing.RIDGE * np.array(y) - weights).max() < 1e-8
    assert np.abs(totals - weights).max() < mixing.MISSED


def test_missed_targets_are_told(spark, caplog):
    docs, labels = fixture(spark, 60)
    mixing.rated(docs, labels.limit(0), mixing.domain_of(), [0.8, 0.1, 0.1])
    assert "targets [0.8, 0.1, 0.1]" in caplog.text
    measured = mixing.measure(docs, labels, mixing.domain_of(), 3)
    with pytest.raises(RuntimeError, match="not fitted"):
        mixing.fit_rates(measured, [0.3, 0.6, 0.1], steps=0)
