import random
from math import comb

from brute import base_failed, counts
from pyspark.sql import functions as F

from passageworks.llm import quality, queries

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a a a", "a a a a a", "a b c a b c", "a b c x a b c a b c", "x y z\nx y z\n\n x y z", "é|ñ # & <> $%*", "a b c d",
    "to be or not to be or not to be", "q " * 5000, "A B c\nA B c\n" * 40, "\nz\n\nz\n", "a b a b a b a b",
]


def measured(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    return {r["doc_id"]: r["_s"].asDict() for r in quality.measure(df).collect()}


def test_counts_of_odd_texts(spark):
    got = measured(spark, ODD)
    for i, t in enumerate(ODD):
        assert got[i] == counts(t), t


def test_counts_of_random_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "\nA"]) for _ in range(200)]
    got = measured(spark, texts)
    assert all(got[i] == counts(t) for i, t in enumerate(texts))


def test_long_text(spark):
    words = [f"w{i % 30_000}" for i in range(45_000)]
    got = measured(spark, [" ".join(words)])[0]
    assert got["n_words"] == 45_000 and got["n_repeat_words"] == counts(" ".join(words))["n_repeat_words"]


def test_binomial_bound_is_exact(spark):
    cases = [(0, 10), (1, 10), (3, 50), (7, 400), (40, 400), (0, 1)]
    df = spark.createDataFrame(cases, "k LONG, n LONG")
    for p in (0.01, 0.2):
        for r in df.withColumn("x", F.exp(quality.log_binomial(F.col("k"), F.col("n"), p))).collect():
            exact = sum(comb(r["n"], j) * p**j * (1 - p) ** (r["n"] - j) for j in range(r["k"] + 1))
            assert abs(r["x"] - exact) < 1e-9


def fixture(spark, n=4000):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"w{rng.randint(0, 10**6)}" + ("***" if bad or rng.random() < 0.01 else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i % 10 else "xx"))
        if i % 2 == 0 or i % 4 == 1:
            labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), spark.createDataFrame(labels, "doc_id LONG, quality INT")


def test_cutoffs_are_certified_and_catch_bad_texts(spark):
    docs, labels = fixture(spark)
    cut = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.certified_cutoffs(quality.measure(docs), labels).collect()}
    assert ("en", "symbols") in cut and not any(s == "xx" for s, _ in cut)  # too few labels there
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    good = [r["kept"] for i, r in rows.items() if i % 4 and i % 10]
    bad = [r["kept"] for i, r in rows.items() if i % 4 == 0 and i % 10]
    assert sum(good) >= (1 - quality.RISK) * len(good) and not any(bad)
    assert all(r["kept"] for i, r in rows.items() if i % 10 == 0)


def test_exact_test_against_plain_version(spark):
    docs, labels = fixture(spark)
    per_rule, n_tests = quality.RISK / len(quality.GRID), 2 * sum(map(len, quality.GRID.values()))
    texts = {r["doc_id"]: r for r in docs.collect()}
    seen: dict = {}
    for r in labels.collect():
        c = counts(texts[r["doc_id"]]["text"])
        for rule, grid in quality.GRID.items():
            part, whole = quality.RATES[rule]
            rate = c[part] * 1000 // c[whole] if c[whole] else 0
            for cutoff in grid:
                x = seen.setdefault((texts[r["doc_id"]]["lang"], rule, cutoff), [0, 0, 0])
                x[0] += r["quality"]
                x[1] += r["quality"] and rate > cutoff
                x[2] += not r["quality"] and rate > cutoff
    best: dict = {}
    for (stratum, rule, cutoff), (n, k, caught) in seen.items():
        if sum(comb(n, j) * per_rule**j * (1 - per_rule) ** (n - j) for j in range(k + 1)) <= quality.ERROR / n_tests:
            best[stratum, rule] = max(best.get((stratum, rule), (-1, -1)), (caught, cutoff))
    got = quality.certified_cutoffs(quality.measure(docs), labels).collect()
    assert {(r["stratum"], r["rule"]): r["cutoff"] for r in got} == {s: c for s, (_, c) in best.items()}


def test_nulls_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None, "x"), (1, "a " * 20 + "b", "en", "y")], "doc_id LONG, text STRING, lang STRING, n_words STRING")
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id LONG, quality INT")
    got = quality.judge(docs, labels).collect()
    assert sorted(r["n_words"] for r in got) == [0, 21] and not any(r["kept"] for r in got)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).count() == 2


def test_query_against_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = counts(texts[r["doc_id"]])
        assert all(r[k] == c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == base_failed(c) and not (r["base_failed"] and r["kept"])
