import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passageworks.operators import embedding, retrieval
from passageworks.operators.chunking import chunk_text
from passageworks.plans import ask

VEC = "chunk_id STRING, file_path STRING, embedding ARRAY<FLOAT>"


def table(spark, matrix, parts=3):
    rows = [(f"c{i:04d}", f"f{i % 5}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, VEC).repartition(parts)


def asked(spark, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "query_id LONG, embedding ARRAY<FLOAT>")


def brute(matrix, queries, k):
    m, q = (np.asarray(x, dtype=np.float32).astype(float) for x in (matrix, queries))
    out = {}
    for i, v in enumerate(q):
        scored = []
        for j, u in enumerate(m):
            size = np.linalg.norm(u) * np.linalg.norm(v)
            if size > 0:
                scored.append((round(1 - float(u @ v) / size, 9), f"c{j:04d}"))
        out[i] = [c for _, c in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((400, 16))
    matrix[50:90] = matrix[50]          # many copies: ties are broken by id
    matrix[7] = 0                       # no direction: never a hit
    return matrix, np.vstack([rng.standard_normal((30, 16)), matrix[50:52]])


def test_exact_topk_broadcast_and_blocks_agree(spark, data):
    matrix, queries = data
    expected = brute(matrix, queries, 5)
    v, q = table(spark, matrix), asked(spark, queries)
    assert ranked(retrieval.topk_batch(v, q, 5)) == expected
    # room for 4 questions only: both sides are dealt into blocks
    blocks = retrieval.topk_batch(v, q, 5, block_bytes=4 * 8 * 16, group_rows=90)
    assert ranked(blocks) == expected


def test_small_blocks_do_not_multiply_the_rows(spark, data, monkeypatch):
    matrix, queries = data
    sides = []

    def spy(left, right, *args, real=retrieval._score_groups):
        sides.append((left, right))
        return real(left, right, *args)

    monkeypatch.setattr(retrieval, "_score_groups", spy)
    # one question and one row a block
    found = ranked(retrieval.topk_batch(table(spark, matrix), asked(spark, queries), 5, block_bytes=8 * 16, group_rows=1))
    assert found == brute(matrix, queries, 5)
    left, right = sides[0]
    assert left.count() <= len(matrix) * retrieval.MOST_BLOCKS
    assert right.count() <= len(queries) * retrieval.MOST_BLOCKS


def test_later_batches_enter_by_their_scores(data):
    matrix, queries = data
    alive = np.flatnonzero((matrix * matrix).sum(axis=1))
    unit, wanted = retrieval._unit(matrix)[0], retrieval._unit(queries)[0]
    best = retrieval._Best(retrieval._Block(pa.array(np.arange(len(queries))), wanted), 5, "chunk_id")
    for lo, hi in ((0, 200), (200, 230), (230, 399)):
        rows = pa.table({"chunk_id": [f"c{i:04d}" for i in alive[lo:hi]]})
        best.add(rows, unit[lo:hi], np.arange(len(queries)))
        # the first rows bound the rest, without waiting for a full store of winners
        assert (best.worst < retrieval.UNKNOWN).all()
    got = pa.Table.from_batches(best.batches())
    steps = np.sort(np.rint((1.0 - wanted @ unit.T) * retrieval.STEPS), axis=1)[:, :5]
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 5), steps / retrieval.STEPS, atol=2e-9)


def test_stored_counts_give_the_model_and_the_features_of_the_texts(spark):
    texts = spark.createDataFrame([(1, "one two, two"), (2, "Two é three"), (3, ""), (4, None)], "id INT, text STRING")
    counted = texts.withColumn("counts", embedding.postings(F.col("text")))
    model = embedding.fit_idf(texts)
    assert embedding.fit_idf(counted.drop("text"), counts="counts") == model
    from_text = embedding.hashed_features(texts, model).select("id", "features").collect()
    assert embedding.hashed_features(counted.drop("text"), model, counts="counts").select("id", "features").collect() == from_text


def test_fewer_rows_than_k_and_no_rows(spark, data):
    matrix, queries = data
    assert ranked(retrieval.topk_batch(table(spark, matrix[:3]), asked(spark, queries[:2]), 10)) == brute(
        matrix[:3], queries[:2], 10
    )
    assert retrieval.topk_batch(table(spark, matrix).filter("false"), asked(spark, queries), 4).count() == 0
    assert retrieval.topk_batch(table(spark, matrix), asked(spark, queries).filter("false"), 4).count() == 0


def test_metadata_filter_and_projection(spark, data):
    matrix, queries = data
    hits = retrieval.topk_batch(
        table(spark, matrix), asked(spark, queries), 4, where=F.col("file_path") == "f2", carry=("file_path",)
    )
    assert {r.file_path for r in hits.collect()} == {"f2"}
    assert hits.columns == ["query_id", "rank", "chunk_id", "file_path", "distance"]


def test_one_vector(spark, data):
    matrix, queries = data
    hits = retrieval.topk_by_vector(table(spark, matrix), list(np.float32(queries[0]).astype(float)), 6)
    assert [r.chunk_id for r in hits.collect()] == brute(matrix, queries[:1], 6)[0]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Sort " not in plan


def test_null_vectors_are_no_hits(spark, data):
    matrix, queries = data
    v = table(spark, matrix[:20]).withColumn("embedding", F.when(F.col("chunk_id") != "c0003", F.col("embedding")))
    hits = ranked(retrieval.topk_batch(v, asked(spark, queries[:1]), 50))[0]
    assert "c0003" not in hits and "c0007" not in hits and len(hits) == 18


def test_unequal_widths_are_refused(spark, data):
    matrix, _ = data
    v = table(spark, matrix[:5]).unionByName(table(spark, np.ones((1, 3))))
    with pytest.raises(ValueError):
        embedding.require_one_dimension(v)
    assert embedding.require_one_dimension(table(spark, matrix[:5])) == 16


def test_exact_plan_has_no_cross_join(spark, data):
    matrix, queries = data
    plan = retrieval.topk_batch(table(spark, matrix), asked(spark, queries), 4)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_one_question_over_many_tasks(spark, data):
    """Winners of 150 tasks, ranked in two levels; texts are joined to the last rows only."""
    matrix, queries = data
    v = table(spark, matrix, 150).withColumn("text", F.concat(F.lit("about "), "chunk_id"))
    hits = retrieval.topk_batch(v, asked(spark, queries[:1]), 5, carry=("text",))
    assert ranked(hits) == brute(matrix, queries[:1], 5)
    assert all(r.text == f"about {r.chunk_id}" for r in hits.collect())
    scored = retrieval.topk_batch(v, asked(spark, queries[:1]), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count("Window [") == 2 and "text#" not in scored.split("MapInArrow")[0]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    # nothing below the scoring reads the text; it enters beside the final join
    scoring = plan[plan.index("MapInArrow"):]
    assert "text" not in scoring[:scoring.index("\n")]


def test_many_batches_keep_the_best(spark, data, monkeypatch):
    """Small Arrow batches: winners are merged and thresholds applied many times."""
    matrix, queries = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        big = np.vstack([matrix] * 30)
        found = ranked(retrieval.topk_batch(table(spark, big, 1), asked(spark, queries[:3]), 50))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(f"c{i:04d}") for i in range(len(big))]
    assert len(set(rows)) == len(big)
    assert found == brute(big, queries[:3], 50)


def texts(spark):
    rows = [(f"d{i}", f"subject{i} speaks of topic{i % 7} and tool{i % 11}") for i in range(60)]
    rows.append(("empty", "... !!!"))
    return spark.createDataFrame(rows, "file_path STRING, text STRING")


def test_hashed_vectors_rank_the_source_first(spark):
    chunks = chunk_text(texts(spark))
    model = embedding.fit_idf(chunks)
    q = spark.createDataFrame([(i, f"subject{i} topic{i % 7}") for i in range(60)], "query_id LONG, text STRING")
    sparse = ask.retrieve(q, embedding.hashed_features(chunks, model), model, 3)
    dense = ask.retrieve(q, embedding.hashed_embedding(chunks, model), model, 3)
    assert sorted(sparse.collect()) == sorted(dense.collect())
    top = {r.query_id: r.file_path for r in sparse.collect() if r.rank == 1}
    assert sum(top[i] == f"d{i}" for i in range(60)) >= 54


def test_dense_vector_properties(spark):
    chunks = chunk_text(texts(spark))
    model = embedding.fit_idf(chunks, dims=50)
    rows = {r.file_path: r.embedding for r in embedding.hashed_embedding(chunks, model).collect()}
    assert {len(v) for v in rows.values()} == {50}
    assert not any(rows["empty"])
    assert np.linalg.norm(rows["d3"]) == pytest.approx(1, abs=1e-6)
    again = embedding.IdfModel.from_df(model.to_df(spark))
    assert again == model


def test_table_maintenance(spark, data):
    matrix, _ = data
    v = table(spark, matrix[:20])
    gone = spark.createDataFrame([("c0001",), ("unknown",)], "chunk_id STRING")
    assert retrieval.delete_chunks_by_id(v, gone).count() == 19
    assert retrieval.delete_chunks_by_file(v, spark.createDataFrame([("f1",)], "file_path STRING")).count() == 16
    assert retrieval.vector_append(v, v).count() == 20
    new = table(spark, matrix[:2]).withColumn("file_path", F.lit("f0")).withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))
    replaced = retrieval.replace_chunks(v, new)
    assert replaced.count() == 18 and replaced.filter("file_path = 'f0'").count() == 2


def test_rag_statuses(spark):
    chunks = chunk_text(texts(spark))
    model = embedding.fit_idf(chunks)
    stored = embedding.hashed_features(chunks, model)
    q = spark.createDataFrame([(1, "subject5 topic5"), (2, "... ?")], "query_id LONG, text STRING")
    rows = {r.query_id: r for r in ask.rag_batch(q, stored, model).collect()}
    assert rows[1].status == "answered" and "d5" in rows[1].sources and "subject5" in rows[1].answer
    assert rows[2].status == "no_context" and rows[2].sources == []
    made = spark.createDataFrame(
        [(1, '{"answer": "martians everywhere", "no_answer": false}', None)],
        "query_id LONG, generated STRING, error STRING",
    )
    assert {r.query_id: r.status for r in ask.rag_batch(q, stored, model, generated=made).collect()} == {
        1: "no_answer", 2: "no_context",
    }


def test_words_are_hashed_once_a_task_and_counted_as_by_the_expressions(spark):
    from pyspark.sql import functions as F

    from passageworks.functions.text import word_bucket, words
    from passageworks.operators import embedding

    texts = ["", " . ", None, "A b_a 1b a\tB", "Größe GRÖẞE İı Σίσυφος ²½ 中文 é x y", "word " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING").coalesce(1)
    made = df.select("id", embedding.postings(F.col("text")).alias("p"))
    assert made.schema["p"].dataType.simpleString() == "struct<buckets:array<int>,counts:array<int>>"
    assert "md5" not in made._jdf.queryExecution().optimizedPlan().toString()
    plain = {r["id"]: r["b"] for r in df.select("id", F.transform(words(F.col("text")), lambda w: word_bucket(w, 384)).alias("b")).collect()}
    for r in made.collect():
        found = plain[r["id"]]
        want = None if found is None else sorted(set(found))
        assert r["p"]["buckets"] == want
        assert r["p"]["counts"] == (None if found is None else [found.count(b) for b in want])
