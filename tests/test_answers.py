
import pytest
from pyspark.sql import functions as F

from passageworks.functions import answers as fa
from passageworks.functions.text import sentences, strip
from passageworks.operators import answering

#: Generated texts with the answer and the refusal that they stand for.
GENERATED = [
    ('{"answer": "Paris", "no_answer": false}', "Paris", False),
    ('Sure. {"answer": "  Paris \\n", "no_answer": false} Bye.', "Paris", False),
    # two objects are no object: the text itself is the answer
    ('{"answer": "a"} and {"answer": "b", "no_answer": false}', '{"answer": "a"} and {"answer": "b", "no_answer": false}', False),
    ('{"answer": "x", "no_answer": false}, {"y": 1}', '{"answer": "x", "no_answer": false}, {"y": 1}', False),
    ('{"answer": "only"}', '{"answer": "only"}', False),
    # what counts as a refusal: true, and anything that is not empty or zero
    ('{"answer": "x", "no_answer": "false"}', "x", True),
    ('{"answer": "x", "no_answer": ""}', "x", False),
    ('{"answer": "null", "no_answer": null}', "null", False),
    ('{"answer": true, "no_answer": 0.0}', "True", False),
    ('{"answer": 42, "no_answer": {}}', "42", False),
    ('{"answer": 2.5, "no_answer": [0]}', "2.5", True),
    ('{"answer": null, "no_answer": 0}', "None", False),
    ('[{"answer": "x", "no_answer": true}]', "x", True),
    ("plain text answer", "plain text answer", False),
    ("  [no_answer] sorry", "", True),
    ("x", "", True),
    ("", "", True),
    (" \u3000 ", "", True),
    ("{}", "{}", False),
    ("{broken", "{broken", False),
    ('{"answer": "line\\nbreak é", "no_answer": true}', "line\nbreak é", True),
    ('{\n "answer": "multi",\n "no_answer": false\n}', "multi", False),
]


def test_parse_generated(spark):
    df = spark.createDataFrame([(i, g) for i, (g, _, _) in enumerate(GENERATED)], "i INT, generated STRING")
    for row in answering.post_process(df).collect():
        assert (row.answer, row.no_answer) == GENERATED[row.i][1:], row.generated


def test_duplicate_keys_fall_back_to_text(spark):
    text = '{"answer": "a", "answer": "b", "no_answer": false}'
    row = answering.post_process(spark.createDataFrame([(text,)], "generated STRING")).first()
    assert (row.answer, row.no_answer) == (text, False)


def ground(spark, answer, context):
    df = spark.createDataFrame([(answer, context)], "answer STRING, context STRING")
    return answering.grounding_check(df).first()


def test_grounding_threshold(spark):
    words = [f"word{chr(97 + i)}" for i in range(11)]
    assert ground(spark, " ".join(words), " ".join(words[:6])).ratio == pytest.approx(6 / 11)
    assert not ground(spark, " ".join(words), " ".join(words[:6])).grounded
    assert ground(spark, " ".join(words[:9]), " ".join(words[:5])).grounded


def test_grounding_rules(spark):
    assert ground(spark, "an ox is", "nothing").grounded
    assert not ground(spark, "  ", "anything").grounded
    assert not ground(spark, "long answer words", None).grounded
    repeated = ground(spark, "alpha alpha alpha gamma", "alpha")
    assert (repeated.hits, repeated.total) == (3, 4)
    # accented letters separate: the pieces are too short to count
    assert ground(spark, "cafés", "unrelated").total == 0


def test_grounding_columns(spark):
    df = spark.createDataFrame([("alpha gamma", "alpha")], "a STRING, c STRING")
    row = df.select(
        fa.grounding_ratio(F.col("a"), F.col("c")), fa.is_grounded(F.col("a"), F.col("c")),
        fa.is_grounded(F.col("a"), F.col("c"), 0.5),
    ).first()
    assert tuple(row) == (0.5, False, True)


def test_extractive_answer(spark):
    df = spark.createDataFrame([
        ("who built the bridge", "A river runs here. The bridge was built by Ada! More text"),
        ("zzz", "Nothing to see."),
        ("anything", None),
    ], "question STRING, context STRING")
    rows = [(r.answer, r.no_answer) for r in answering.extractive_answer(df).collect()]
    assert rows == [("The bridge was built by Ada!", False), ("", True), ("", True)]


def test_context_is_ordered_then_cut(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", "BBBB"), (1, 1, "a", "AAAA"), (1, 3, "b", "CCCC")],
        "query_id LONG, rank INT, file_path STRING, text STRING",
    )
    row = answering.context_assembly(hits, 9).first()
    assert row.context == "AAAA\n\nBBB" and row.sources == ["a", "b"]
    assert answering.context_assembly(hits, 0).first().context == "AAAA\n\nBBBB\n\nCCCC"


def test_fragments_keep_order_across_runs(spark):
    pieces = [(7, i, f"<{i}>") for i in range(5000)] + [(8, 3, "b"), (8, -1, "a")]
    df = spark.createDataFrame(pieces, "request_id LONG, seq LONG, piece STRING").repartition(5)
    rows = {r.request_id: r.text for r in answering.fragment_assembly(df, run=64).collect()}
    assert rows[7] == "".join(f"<{i}>" for i in range(5000)) and rows[8] == "ab"


def test_resolve_streamed(spark):
    pieces = spark.createDataFrame(
        [(1, 0, '{"answer": "blue'), (1, 1, ' whale", "no_answer": false}'), (2, 0, "invented nonsense"),
         (3, 0, "half"), (4, 0, "text")],
        "request_id LONG, seq LONG, piece STRING",
    )
    contexts = spark.createDataFrame(
        [(1, "the blue whale", ["w"], None), (2, "the blue whale", ["w"], None),
         (3, "ctx", ["w"], "broken"), (4, None, [], None)],
        "request_id LONG, context STRING, sources ARRAY<STRING>, error STRING",
    )
    rows = {r.request_id: r for r in answering.resolve_streamed(pieces, contexts).collect()}
    assert (rows[1].final, rows[1].status, rows[1].sources) == ("blue whale", "answered", ["w"])
    assert rows[1].raw.startswith("{")
    assert (rows[2].raw, rows[2].final, rows[2].status) == ("invented nonsense", "", "no_answer")
    assert (rows[3].final, rows[3].status) == (fa.FAILED, "error")
    assert (rows[4].raw, rows[4].final, rows[4].status) == ("", fa.NOTHING_FOUND, "no_context")


def test_render(spark):
    df = spark.createDataFrame([("q?", "a.", ["x", "y"])], "question STRING, answer STRING, s ARRAY<STRING>")
    row = answering.render_history(df).withColumn("b", answering.render_sources(F.col("s"))).first()
    assert row.entry == "User: q?\nAI: a.\n\n" + "-" * 40 + "\n"
    assert row.b == "• x\n• y"


def test_strip_matches_python(spark):
    blanks = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    texts = [blanks + "a b" + blanks, blanks, "", "x", "​kept​", "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_sentences(spark):
    df = spark.createDataFrame([("One. Two!\n\n Three? four",)], "t STRING")
    assert df.select(sentences(F.col("t"))).first()[0] == ["One.", "Two!", "Three?", "four"]


def test_prompt_holds_context_and_question(spark):
    df = spark.createDataFrame([("C", "Q")], "c STRING, q STRING")
    prompt = df.select(fa.build_prompt(F.col("c"), F.col("q"))).first()[0]
    assert "Passages:\nC\n" in prompt and "Question: Q\n" in prompt
