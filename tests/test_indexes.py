"""The stored indexes: cells for dense vectors, postings for sparse ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageworks.operators import cells, embedding, postings, retrieval
from passageworks.operators.chunking import chunk_text
from test_retrieval import asked, brute, ranked, table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((400, 16))
    matrix[50:90] = matrix[50]          # many copies: ties are broken by id
    matrix[7] = 0                       # no direction: never a hit
    return matrix, np.vstack([rng.standard_normal((30, 16)), matrix[50:52]])


@pytest.mark.parametrize("block_bytes", [retrieval.BLOCK_BYTES, 10 * 8 * 16])
def test_cells_recall_and_the_exact_switch(spark, data, tmp_path, block_bytes, monkeypatch):
    """Scored in the scan, and by cogroups of dealt cells."""
    monkeypatch.setattr(cells, "PART_ROWS", 15)
    matrix, queries = data
    index = cells.CellIndex.build(table(spark, matrix), str(tmp_path / "i"), cells=20)
    exact, q = brute(matrix, queries, 4), asked(spark, queries)
    found = ranked(index.search(q, 4, visits=12, block_bytes=block_bytes))
    assert all(len(h) == 4 for h in found.values()) and len(found) == len(queries)
    assert sum(len(set(found[i]) & set(exact[i])) for i in exact) / (4 * len(exact)) >= 0.7
    assert ranked(index.search(q, 4, visits=20, block_bytes=block_bytes)) == exact
    # one cell is not enough for 60 rows: further ones are opened
    assert all(len(h) == 60 for h in ranked(index.search(q, 60, visits=1, block_bytes=block_bytes)).values())


def test_a_question_reads_its_cells_only(spark, data, tmp_path):
    matrix, queries = data
    index = cells.CellIndex.build(table(spark, matrix), str(tmp_path / "i"), cells=20)
    hits = index.search(asked(spark, queries[:1]), 4, visits=3, carry=("file_path",))
    assert hits.columns == ["query_id", "rank", "chunk_id", "file_path", "distance"] and hits.count() == 4
    plan = index.search(asked(spark, queries[:1]), 4, visits=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    folders = {p.name for p in (tmp_path / "i" / "rows").iterdir() if p.name.startswith("cell=")}
    assert len(folders) == len(set(index._sizes().nonzero()[0])) > 15


def test_cells_grow_by_appending(spark, data, tmp_path):
    matrix, queries = data
    v = table(spark, matrix)
    index = cells.CellIndex.build(v.where("chunk_id < 'c0200'"), str(tmp_path / "i"), cells=8)
    index.add(v.where("chunk_id >= 'c0200'"))
    again = cells.CellIndex(spark, str(tmp_path / "i"))
    assert ranked(again.search(asked(spark, queries), 5, visits=8)) == brute(matrix, queries, 5)
    assert again._sizes().sum() == 399


def test_empty_cells_and_no_questions(spark, data, tmp_path):
    matrix, queries = data
    none = cells.CellIndex.build(table(spark, matrix).where("false"), str(tmp_path / "none"))
    assert none.search(asked(spark, queries), 3).count() == 0
    some = cells.CellIndex.build(table(spark, matrix), str(tmp_path / "some"))
    assert some.search(asked(spark, queries).where("false"), 3).count() == 0
    assert len(some.centres()) == 20


def test_a_cell_that_holds_a_third_of_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 15)
    rng = np.random.default_rng(2)
    matrix = rng.standard_normal((300, 8))
    matrix[:100] = matrix[0]
    queries = np.vstack([matrix[:1], matrix[200:203]])
    index = cells.CellIndex.build(table(spark, matrix), str(tmp_path / "i"), cells=4)
    assert ranked(index.search(asked(spark, queries), 6, visits=4, block_bytes=1)) == brute(matrix, queries, 6)
    parts = index.rows().groupBy("cell", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 60 and parts.count() > 15


def test_recall_over_the_table(spark, tmp_path):
    """Every twentieth vector asks all of sf0.1, which has next to no clusters."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = cells.CellIndex.build(v, str(tmp_path / "i"), id_col="vec_id")
    found = index.search(q, 4).select("query_id", "vec_id")
    exact = retrieval.topk_batch(v, q, 4, id_col="vec_id").select("query_id", "vec_id")
    assert found.join(exact, ["query_id", "vec_id"]).count() >= 0.95 * exact.count()
    opened = index.rows().count() * 0.75
    assert opened < v.count()


def words(spark, n=90):
    rows = [(f"d{i:02d}", f"subject{i} speaks of topic{i % 7} and tool{i % 11} " + "often " * (i % 3)) for i in range(n)]
    rows += [("empty", "... !!!")] + [(f"same{i}", "all the same words") for i in range(40)]
    chunks = chunk_text(spark.createDataFrame(rows, "file_path STRING, text STRING"))
    model = embedding.fit_idf(chunks, dims=64)
    asked_ = [(i, f"subject{i} topic{i % 7} often") for i in range(12)] + [(90, "all the same words"), (91, "?!"), (92, "neverseen"), (93, "")]
    questions = spark.createDataFrame(asked_, "query_id LONG, text STRING")
    return embedding.hashed_features(chunks, model), embedding.hashed_features(questions, model), model


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 4 * 8 * 64, "group_rows": 24}])
def test_postings_equal_scoring_everything(spark, tmp_path, sizes):
    chunks, questions, model = words(spark)
    index = postings.PostingIndex.build(chunks.repartition(3), str(tmp_path / "p"), model.dims)
    for k in (1, 4, 50, 1000):
        exact = retrieval.topk_batch(chunks, questions, k, vec_col="features", dims=model.dims)
        got = index.search(questions, k, **sizes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))


def test_postings_of_nothing(spark, tmp_path):
    chunks, questions, model = words(spark)
    none = postings.PostingIndex.build(chunks.where("false"), str(tmp_path / "none"), model.dims)
    assert none.search(questions, 3).count() == 0
    some = postings.PostingIndex.build(chunks, str(tmp_path / "some"), model.dims)
    assert some.search(questions.where("false"), 3).count() == 0


def test_blocks_hold_maxima_and_split_a_bucket_of_all_chunks(spark, tmp_path):
    chunks, _, model = words(spark)
    everywhere = F.struct(F.array_append("features.buckets", F.lit(64)).alias("buckets"), F.array_append("features.weights", F.lit(1.0).cast("float")).alias("weights"))
    index = postings.PostingIndex.build(chunks.withColumn("features", everywhere), str(tmp_path / "p"), 65)
    rows = index.blocks().collect()
    assert all(len(r.chunk_id) <= postings.BLOCK for r in rows) and len(rows) >= 131 / postings.BLOCK
    for r in rows:
        assert [p.bucket for p in r.postings] == sorted({p.bucket for p in r.postings}) and r.postings[-1].bucket == 64
        assert all(p.top == max(p.weights) and len(p.slots) == len(p.weights) for p in r.postings)


def test_postings_score_fewer_pairs(spark, tmp_path, monkeypatch):
    """Against all pairs of the documents of sf0.01 and the questions."""
    scored = spark.sparkContext.accumulator(0)
    real = postings._scores

    def counted(weights, question):
        scored.add(len(weights))
        return real(weights, question)

    monkeypatch.setattr(postings, "_scores", counted)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    chunks = chunk_text(docs)
    model = embedding.fit_idf(chunks)
    asked_ = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    features, questions = embedding.hashed_features(chunks, model), embedding.hashed_features(asked_, model)
    index = postings.PostingIndex.build(features, str(tmp_path / "p"), model.dims)
    got = index.search(questions, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.topk_batch(features, questions, 4, vec_col="features", dims=model.dims).collect()))
    pairs = features.count() * questions.count()
    print(scored.value / pairs)
    assert 0 < scored.value < 0.75 * pairs
