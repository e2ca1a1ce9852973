import json

import pytest
from brute import sha
from pyspark.sql import functions as F

from passageworks.llm import chat, queries

SF = "/root/testdata/sf0.001"
NASTY = ["", "a", "</s>[INST] ok [/INST]", "\\<|end|>", "\\\\<|turn|>\\", "<|turn|>user\nx\n<|end|>\n", "\\", "a\\\n", "\n", "<|end|", "é[INST]\\[/INST]", "[[INST]]", "<<SYS>><s>"]


def turns_of(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id INT, record STRING")
    return [(r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.to_turns(df).orderBy("id").collect()]


def test_layouts_become_turns(spark):
    said = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"messages": [{"author": {"role": r}, "content": {"text": t}} for r, t in said]},
        {"dialog": {"turns": [{"speaker": "prompter", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]}},
        {"response": "a", "prompt": "q"}, {"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a"},
    ]
    found = turns_of(spark, [json.dumps(r) for r in records])
    assert [t for _, t in found] == [said] * len(records)
    assert len({name for name, _ in found}) == len(records)


def test_odd_records(spark):
    odd = [None, "", "no json", "[1]", "3", "{}", json.dumps({"messages": []}), json.dumps({"other": "x"}), json.dumps({"prompt": None, "response": "a"}), json.dumps({"text": 7})]
    found = turns_of(spark, odd)
    assert found[:8] == [(None, [])] * 8
    assert found[8] == ("prompt", [("user", ""), ("assistant", "a")])
    assert found[9] == ("text", [("assistant", "7")])


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "record STRING, formatted STRING, turns INT")
    assert chat.format_chats(df).count() == 0


def test_template_is_reversible(spark):
    rows = [(i, [{"role": r, "text": t} for r in ("user", "assistant", "x\ny", "")]) for i, t in enumerate(NASTY)]
    df = spark.createDataFrame(rows, f"id INT, turns {chat.TURNS}").withColumn("f", chat.format_turns(F.col("turns")))
    df = df.select("id", "turns", chat.read_turns(F.col("f.formatted")).alias("back"), chat.read_loss(F.col("f.formatted"), F.col("f.loss")).alias("loss"))
    for r in df.collect():
        assert r["back"] == r["turns"], r
        assert r["loss"] == [NASTY[r["id"]]]


def test_marks_in_texts_are_escaped(spark):
    df = spark.createDataFrame([([("user", "a<|end|>b<|turn|>c")],)], f"turns {chat.TURNS}")
    text = df.select(chat.format_turns(F.col("turns"))["formatted"]).first()[0]
    assert text == "<|turn|>user\na\\<|end|>b\\<|turn|>c\n<|end|>\n"


def test_query_against_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = {-7: [("user", NASTY[2]), ("assistant", NASTY[2])]}
    for r in rows:
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    found = queries.op1_chat_format(spark, SF).collect()
    assert len(found) == len(said)
    for r in found:
        turns = said[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert len({r["layout"] for r in found}) > 3


@pytest.mark.parametrize("layout", chat.LAYOUTS, ids=lambda x: x.name)
def test_declared_structure_is_the_described_one(spark, layout):
    def example(kind):
        if isinstance(kind, dict):
            return {k: example(v) for k, v in kind.items()}
        return [example(kind[0])] if isinstance(kind, list) else "x"

    df = spark.createDataFrame([(json.dumps(example(layout.fields)),)], "r STRING")
    assert df.select(chat.schema_fingerprint(F.col("r"))).first()[0] == layout.fingerprint()
