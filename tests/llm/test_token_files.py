import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from passageworks.llm import queries
from passageworks.llm import token_files as tf

SF = "/root/testdata/sf0.001"
FILE = f"{queries.TOKENIZERS}/word_bpe_49k.json"
NASTY = [
    "", None, " ", "\n\n a  b\t", "Don't STOP, we'll go", "é é ́x", "<|endoftext|>x<|startoftext|>", "日本語 テスト", "a b c\x1cd", "x" * 3000, "1234 5.6 ΑΣ Σ", "\x00 ퟿",
    "ﬁ ǅ İ", " leading", "trailing ",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.just(7)), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    payload = tf.pack(ids)
    assert np.array_equal(tf.unpack(payload), ids)
    for block in range(-(-len(ids) // tf.BLOCK)):
        assert np.array_equal(tf.unpack(payload, block), ids[block * tf.BLOCK : (block + 1) * tf.BLOCK])


def test_outliers_do_not_widen_a_block():
    narrow = np.arange(128, dtype=np.uint32) % 16 + 1000
    wide = narrow.copy()
    wide[5] = 2**31
    assert len(tf.pack(wide)) - len(tf.pack(narrow)) == 5


def test_words_give_the_ids_of_whole_texts():
    tokenizer = Tokenizer.from_file(FILE)
    texts = [t or "" for t in NASTY]
    for text, ids in zip(texts, tf.WordEncoder(tokenizer, 2).encode(texts)):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
    assert tf.WordEncoder(tokenizer, 2).encode([]) == []


def test_small_cache_changes_nothing(monkeypatch):
    tokenizer = Tokenizer.from_file(FILE)
    monkeypatch.setattr(tf, "CACHE_WORDS", 3)
    encoder = tf.WordEncoder(tokenizer, 2)
    for text in ["a b c d e", "c d x", "a"]:
        assert encoder.encode([text])[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def plain(rows):
    tokenizer, at = Tokenizer.from_file(FILE), 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        yield doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        at += len(ids)


def test_files_against_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_IDS", 40)
    rows = [(i * 7 - 20, t) for i, t in enumerate(NASTY)]
    docs = spark.createDataFrame(rows[::-1], "doc_id LONG, text STRING").withColumnRenamed("x", "y").repartition(5)
    tf.write_ids(docs, str(tmp_path / "ids"), FILE, 2)
    got = sorted((r["id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in tf.read_ids(spark, str(tmp_path / "ids"), with_ids=True).collect())
    assert got == list(plain(rows))


def test_nulls_repeats_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(3, "b", 1), (None, "z", 2), (3, "a", 3), (3, "a", 4)], "doc_id LONG, text STRING, shard INT")
    tf.write_ids(docs, str(tmp_path / "a"), FILE, 2)
    got = sorted((r["start"], r["id"], r["n_tokens"]) for r in tf.read_ids(spark, str(tmp_path / "a")).collect())
    assert got == [(0, None, 2), (2, 3, 2), (4, 3, 2), (6, 3, 2)]
    tf.write_ids(docs.limit(0), str(tmp_path / "b"), FILE, 2)
    assert tf.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_query_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_files(spark, SF).collect())
    assert got == [x[:4] for x in plain(rows)]
