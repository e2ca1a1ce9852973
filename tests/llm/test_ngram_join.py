import random

import pytest
from brute import groups, runs
from pyspark.sql import functions as F

from passageworks.llm import ngram_join as nj
from passageworks.llm.common import store, watched
from passageworks.llm.components import components

SF = "/root/testdata/sf0.001"


def joined(spark, rows, schema="doc_id LONG, text STRING", **more):
    return nj.join_similar(spark.createDataFrame(rows, schema), **more)


def check(spark, rows):
    got = {r["id"]: r for r in joined(spark, rows).collect()}
    want = groups(rows)
    assert {d: r["component"] for d, r in got.items()} == want
    assert all(got[d]["n"] == len(runs(t)) for d, t in rows)
    return want


def test_random_near_copies_against_plain_version(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(3, 60))] for _ in range(25)]

    def near():
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 3)}"
        return " ".join(words).replace("a", rng.choice("aA"))

    want = check(spark, [(i, near()) for i in range(300)])
    assert 25 < len(set(want.values())) < 300


def test_chain_and_common_passages(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each links to the next ones only
        rows.append((i, " ".join(words)))
        words = [*words[3:], f"n{i}a", f"n{i}b", f"n{i}c"]
    passage = [" ".join(f"p{k}_{j}" for j in range(30)) for k in range(4)]
    rows += [(100 + i, " ".join(rng.sample(passage, 2))) for i in range(60)]  # nothing but shared passages
    rows += [(200 + i, passage[0] + " " + " ".join(f"o{i}_{j}" for j in range(40))) for i in range(60)]
    check(spark, rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(200), 1 + i % 2):
            words[at] = f"e{i}"
        rows.append((i, " ".join(words)))
    assert set(check(spark, rows).values()) == {0}


def test_family_whose_copies_link_to_their_text_only(spark, monkeypatch):
    """400 copies, edited in 9 places of their own: no two of them link, and the matrix stays small."""
    rows_of = {}

    def spy(df, name, real=nj.store):
        rows_of[name] = real(df, name)
        return rows_of[name]

    rng = random.Random(7)
    rows = []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(500)]
        for i in range(400):
            words = list(base)
            for at in rng.sample(range(500), 9 if i else 0):
                words[at] = f"e{family}_{i}_{at}"
            rows.append((1000 * family + i, " ".join([*words, "passage of many documents that all of them end with"])))
    monkeypatch.setattr(nj, "store", spy)
    assert {r["component"] for r in joined(spark, rows).collect()} == {0, 1000}
    # the square of a family would be 160,000
    assert rows_of["found"].count() < 8000
    a, b = runs(rows[1][1]), runs(rows[2][1])
    assert 100 * len(a & b) < 80 * len(a | b)


def test_family_with_copies_that_link_to_none_of_it(spark, monkeypatch):
    """300 members and 60 copies apart from them, whose edits others share: members do not ask for each of the copies."""
    rows_of = {}

    def spy(df, name, real=nj.store):
        rows_of[name] = real(df, name)
        return rows_of[name]

    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 361):
        words = list(base)
        for at in rng.sample(range(3, 147, 6), 1 if i <= 300 else 4):
            words[at] = f"e{i}" if i <= 300 else f"s{at}"
        # two runs of their own, so that the base comes first among them
        rows.append((i, " ".join(words if i <= 300 else [*words, f"x{i}", f"y{i}"])))
    monkeypatch.setattr(nj, "store", spy)
    want = check(spark, rows)
    assert {want[i] for i in range(301)} == {0} and len(set(want.values())) > 40
    # 300 * 60 if each member asked for each copy
    assert rows_of["found"].count() < 4000


def test_groups_of_other_sizes_are_asked(spark):
    """Copies longer and shorter than the members of a larger group, linked to some of them at their ends only."""
    rng = random.Random(9)
    rows = []
    for family in range(6):
        words, new = [f"f{family}w{i}" for i in range(100)], iter(range(10_000))
        for i in range(30):
            rows.append((100 * family + i, " ".join(words)))
            words = words + [f"f{family}n{next(new)}" for _ in range(rng.randint(1, 9))] if i % 2 else words[rng.randint(0, 12) :]
    check(spark, rows)


def test_short_blank_and_long(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \n\t"), (9, "a b"), (8, "A  B"), (7, "a b c d e"), (6, "a b c d"), (2, long), (10, long + " end"), (11, "é É x y z"), (12, "é é x y z")]
    check(spark, rows)


def test_nulls_repeats_and_empty_table(spark):
    text = "one two three four five six seven"
    got = joined(spark, [(None, text, 1), (3, text, 2), (3, text, 3), (3, "other words here", 4), (None, "alone", 5)], "doc_id LONG, text STRING, cls INT").collect()
    assert sorted((r["id"] or -1, r["component"] or -1, r["n"]) for r in got) == [(-1, -1, 1), (-1, 3, 3), (3, 3, 1), (3, 3, 3), (3, 3, 3)]
    assert joined(spark, []).count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([(2, "a b c"), (1, "A b c"), (3, "x y z"), (None, "q")], "doc_id LONG, text STRING")
    kept = nj.keep_first(df, nj.join_similar(df)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3]


def test_threshold_must_fit_the_sample(spark):
    with pytest.raises(ValueError):
        joined(spark, [(1, "a")], percent=60)


def test_documents_against_plain_version(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (70, 100), (200, 300), (8, 8)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 100: 50, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_few_jobs_for_a_small_table(spark):
    words = [[f"w{(i * 37 + j * j) % 997}" for j in range(60)] for i in range(12)]
    rows = [(i * 10 + e, " ".join([*w[:e], f"edit{e}", *w[e + 1 :]] if e else w)) for i, w in enumerate(words) for e in range(4)]
    docs = store(spark.createDataFrame(rows, "doc_id LONG, text STRING"), "test-jobs")
    spark.sparkContext.setJobGroup("few jobs", "n-gram join")
    try:
        got = {r["id"]: r["component"] for r in nj.join_similar(docs).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == groups(rows) and len(set(got.values())) < len(rows)
    # the driver keeps plan and metrics of each
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) <= 150


def test_counts_of_stored_tables(spark):
    stored, n = nj.counted(spark.range(7), "test-counted")
    assert n == 7 and stored.count() == 7
    noted, seen = watched(spark.range(7).where("id > 7").distinct(), total=F.sum("id"))
    assert store(noted, "test-watched").count() == 0 and seen.get == {"rows": 0, "total": None}
