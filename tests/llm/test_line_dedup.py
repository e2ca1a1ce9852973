import random

import pytest
from brute import WORD, gone_lines, one_edit
from pyspark.sql import functions as F

from passageworks.llm import line_dedup as ld

SF = "/root/testdata/sf0.001"
TEN = "one two three four five six seven eight nine ten"


def cleared(spark, rows, schema="doc_id LONG, text STRING"):
    return ld.dedup_lines(spark.createDataFrame(rows, schema))


def check(spark, rows):
    gone = gone_lines([r for r in rows if r[1] is not None], ld.MIN_WORDS, ld.EDIT_WORDS)
    got = {r["doc_id"]: r for r in cleared(spark, rows).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        lines = None if text is None else text.split("\n")
        left = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone.get(doc, ()))
        assert got[doc]["text"] == left, (doc, text)
        assert (got[doc]["_line_all"], got[doc]["_line_gone"]) == (0 if text is None else len(lines), len(gone.get(doc, ())))


def test_rules(spark):
    other = TEN.replace("four", "FOUR")
    rows = [
        (1, f"{TEN}\n\nshort line\nshort line\nthree word line"), (2, f"{other}\nthree  word\tline\n\n"), (3, f"{TEN} eleven"), (4, TEN[4:] + " eleven twelve"),
        (5, "two one three four five six seven eight nine ten"), (6, None), (7, ""), (8, "\n\n"), (9, f"own line of text here\n{TEN}\n{TEN}"),
        (0, "zero " + TEN), (10, "one two three four five six seven eight nine"),
    ]
    check(spark, rows)


def test_random_lines_against_plain_version(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(2, 16))] for _ in range(40)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            i = rng.randrange(len(words))
            words[i : i + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
        return " ".join(words)

    check(spark, [(i, "\n".join(line() for _ in range(rng.randint(0, 9)))) for i in range(120)])


def test_short_lines(spark):
    rows = [
        (1, "ok\nred fox\n\n \nthe red fox runs very far today"),
        (2, " ok\nnew\n\n \nred\tfox\nthe red fox sits very far today"),
        (3, "\n\nnew\nthe red fox runs far today\nthe old red fox runs very far today"),
    ]
    check(spark, rows)
    got = {r["doc_id"]: r["text"] for r in cleared(spark, rows).collect()}
    assert got == {1: rows[0][1], 2: "new\n\n ", 3: "\n\nthe red fox runs far today"}


def test_one_key_shared_by_many(spark):
    rows = [(i, f"one two three four {'word%d' % i} six seven eight nine ten") for i in range(400)]
    got = cleared(spark, rows)
    assert got.where("_line_gone = 0").select("doc_id").collect() == [(0,)]


def test_long_line_and_long_text(spark):
    words = [f"w{i}" for i in range(20_000)]
    changed = [*words[:9_999], "other", *words[10_000:]]
    many = "\n".join(f"line number {i} of this text" for i in range(20_000))
    got = {r["doc_id"]: r for r in cleared(spark, [(1, " ".join(words)), (2, " ".join(changed)), (3, many), (4, many + "\nand one more line")]).collect()}
    assert got[2]["text"] == "" and got[1]["_line_gone"] == 0 and got[3]["_line_gone"] == 0
    assert got[4]["text"] == "and one more line"


def test_nulls_repeats_clashing_names_and_empty_table(spark):
    rows = [(None, "a b c d", "x"), (1, "a b c d\ne f g h", "y"), (1, "a b c d\ne f g h", "z"), (2, "e f g h", None)]
    got = cleared(spark, rows, "doc_id LONG, text STRING, id STRING").orderBy(F.asc_nulls_first("doc_id"), "id").collect()
    assert [(r["id"], r["text"]) for r in got] == [("x", "a b c d"), ("y", "e f g h"), ("z", "e f g h"), (None, "")]
    assert cleared(spark, [], "doc_id LONG, text STRING, words STRING, n INT, line INT").count() == 0


@pytest.mark.parametrize("a,b", [("a b", "a c"), ("a b", "b a"), ("a", "a b"), ("b", "a b"), ("a c", "a b c"), ("a b", "a b c d"), ("a b", "a b"), ("a b c", "b c a")])
def test_one_edit(spark, a, b):
    for x, y in ((a, b), (b, a)):
        df = spark.createDataFrame([(x.split(), y.split())], "a ARRAY<STRING>, b ARRAY<STRING>")
        assert df.select(ld.one_edit(F.col("a"), F.col("b"))).first()[0] == one_edit(x.split(), y.split())


def test_documents_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows)
    assert any(WORD.search(t) for _, t in rows)
