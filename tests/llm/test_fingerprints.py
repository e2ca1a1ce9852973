import random

import numpy as np
from brute import jaccard, runs, sha
from pyspark.sql import functions as F

from passageworks.llm import fingerprints as fp
from passageworks.llm import queries

SF = "/root/testdata/sf0.001"


def likeness(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    near = fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))
    return [r[0] for r in df.orderBy("i").select(near).collect()]


def test_estimates_have_the_expected_error(spark):
    rng = random.Random(1)
    pairs, truth = [], []
    for i in range(300):
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice((8, 20, 60, 200, 900)))]
        b = a[: int(len(a) * rng.random())] + [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))]
        pairs.append((" ".join(a), " ".join(b)))
        truth.append(jaccard(runs(pairs[-1][0]), runs(pairs[-1][1])))
    error = np.array(likeness(spark, pairs)) - truth
    spread = np.sqrt(np.mean(error**2) / np.mean([t * (1 - t) / fp.BINS for t in truth]))
    # texts of few runs fill most bins by densification, which adds to the error
    assert abs(error.mean()) < 0.02 and np.abs(error).max() < 0.35 and spread < 3


def test_equal_short_and_empty_texts(spark):
    got = likeness(spark, [(None, ""), ("", " \n"), ("a", None), ("a", "A"), ("a b", "a b"), ("a b", "b a"), ("x " * 50_000, "x " * 9), ("a b c d e", "a b c d e f")])
    assert got[:5] == [1, 1, 0, 1, 1] and got[5] < 0.1 and got[6] == 1 and 0.2 < got[7] < 0.8


def test_one_run_fills_every_bin(spark):
    parts = spark.createDataFrame([("just these words",)], "t STRING").select(fp.fingerprint(F.col("t"))).first()[0]
    assert len(parts) == fp.BINS and len(set(parts)) == 1


def test_packed_form_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "x"), ("some text", None)], "text STRING, parts STRING")
    rows = [r["fingerprint"] for r in fp.fingerprints(df).collect()]
    assert all(len(r) == fp.BINS * fp.BITS // 4 for r in rows) and set(rows[0]) == {"0"}
    assert fp.fingerprints(df.limit(0)).count() == 0


def test_next_documents(spark):
    ids = spark.createDataFrame([(i,) for i in (5, 3, 99, None, -4)], "doc_id LONG")
    got = {r["doc_id"]: r["next_id"] for r in queries.following(ids).collect()}
    assert got == {None: -4, -4: 3, 3: 5, 5: 99, 99: None}
    assert [tuple(r) for r in queries.following(ids.where("doc_id = 3")).collect()] == [(3, 3)]
    assert queries.following(ids.limit(0)).count() == 0
    many = spark.range(0, 5000, 3).withColumnRenamed("id", "doc_id")
    assert queries.following(many).where("next_id = doc_id + 3").count() == many.count() - 1


def test_query_against_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    error = []
    for (d, text), (_, other) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        assert rows[d]["edited_sha256"] == sha(edited) and rows[d]["n_chars"] == len(text)
        error.append(rows[d]["near_edited"] - jaccard(runs(text), runs(edited)))
        assert abs(rows[d]["near_next"] - jaccard(runs(text), runs(other))) < 0.15
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06
