import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from passageworks.operators import embedding
from passageworks.operators.chunking import chunk_text
from passageworks.operators.hooks import encode_with, generate_with
from passageworks.plans.ingest import incremental_ingest
from passageworks.schemas import CORPUS, Options
from passageworks.sources import files, state
from passageworks.streaming.ingest import streaming_ingest

T1, T2, T3 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))


def corpus(spark, texts, when=T1):
    rows = [(p, "", when, len(t), bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in texts.items()]
    return spark.createDataFrame(rows, CORPUS)


def paths(df):
    return sorted({r.file_path for r in df.select("file_path").collect()})


def test_life_of_a_collection(spark, tmp_path):
    where = str(tmp_path / "c")
    first = {"/a.txt": "alpha", "/b.txt": "beta " * 500, "/c.txt": "gamma", "/x.bin": "skip"}
    report = {r.status: (r.n, r.loaded) for r in incremental_ingest(spark, corpus(spark, first), where, now=T1).collect()}
    assert report == {"new": (4, 3)}
    col = state.Collection(spark, where)
    assert paths(col.manifest()) == ["/a.txt", "/b.txt", "/c.txt"]
    assert [r.load_error for r in col.quarantine().collect()] == ["unsupported"]
    n_b = col.vectors().filter("file_path = '/b.txt'").count()
    assert n_b == 4

    second = {"/a.txt": "alpha two", "/b.txt": "beta " * 500, "/c.txt": b"\xff", "/d.txt": "delta"}
    report = {r.status: (r.n, r.loaded) for r in incremental_ingest(spark, corpus(spark, second, T2), where, now=T2).collect()}
    assert report == {"new": (1, 1), "modified": (2, 1)}
    col = state.Collection(spark, where)
    live = {r.file_path: r.text for r in col.chunks().filter("chunk_no = 0").collect()}
    assert live["/a.txt"] == "alpha two" and "/c.txt" not in live and "/d.txt" in live
    assert col.vectors().filter("file_path = '/b.txt'").count() == n_b
    man = {r.file_path: r for r in col.manifest().collect()}
    # a modified file that fails keeps its entry and is modified again next time
    assert man["/c.txt"].created_at == T1 and man["/a.txt"].created_at == T2

    third = {"/a.txt": "alpha two", "/c.txt": "gamma three"}
    report = {r.status: (r.n, r.loaded) for r in incremental_ingest(spark, corpus(spark, third, T3), where, now=T3).collect()}
    assert report == {"modified": (1, 1), "deleted": (2, 0)}
    col = state.Collection(spark, where)
    assert paths(col.vectors()) == paths(col.manifest()) == ["/a.txt", "/c.txt"]

    # no change: nothing is committed
    last = col.last_run()
    assert incremental_ingest(spark, corpus(spark, third, T3), where).count() == 0
    assert state.Collection(spark, where).last_run() == last == 3


def fitted(spark, texts):
    """Vectors of a table of texts weighed by themselves."""
    docs = spark.createDataFrame([(p, t) for p, t in texts.items()], "file_path STRING, text STRING")
    chunks = chunk_text(docs)
    return {r.chunk_id: r.embedding for r in embedding.hashed_embedding(chunks, embedding.fit_idf(chunks)).collect()}


def held(spark, where):
    return {r.chunk_id: r.embedding for r in state.Collection(spark, where).vectors().collect()}


def test_vectors_are_weighed_by_the_live_collection(spark, tmp_path):
    """Whatever runs, edits and compactions brought it in."""
    where = str(tmp_path / "c")
    first = {"/a.txt": "alpha beta", "/b.txt": "beta gamma " * 200}
    incremental_ingest(spark, corpus(spark, first), where)
    assert held(spark, where) == fitted(spark, first)
    second = {"/a.txt": "alpha delta", "/c.txt": "gamma epsilon", "/d.txt": "zeta"}
    incremental_ingest(spark, corpus(spark, second, T2), where)
    assert held(spark, where) == fitted(spark, second)
    col = state.Collection(spark, where)
    assert col.idf().n_chunks == 3
    kept = col.vectors().filter("file_path = '/d.txt'").collect()
    col.delete_by_file(spark.createDataFrame([("/d.txt",)], "file_path STRING"))
    assert held(spark, where) == fitted(spark, {k: v for k, v in second.items() if k != "/d.txt"})
    col = state.Collection(spark, where)
    col.append(spark.createDataFrame(kept, state.STORED))
    assert held(spark, where) == fitted(spark, second)
    col.compact()
    assert held(spark, where) == fitted(spark, second)


def test_other_widths_are_refused(spark, tmp_path):
    where = str(tmp_path / "c")
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha"}), where, Options(dims=50))
    with pytest.raises(ValueError, match="widths"):
        incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha", "/b.txt": "beta"}, T2), where, Options(dims=60))
    assert paths(state.Collection(spark, where).vectors()) == ["/a.txt"]


def test_compaction_keeps_the_live_rows(spark, tmp_path):
    where = str(tmp_path / "c")
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha", "/b.txt": "beta"}), where)
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha two", "/c.txt": "gamma"}, T2), where)
    before = sorted(state.Collection(spark, where).vectors().collect())
    state.Collection(spark, where).compact()
    col = state.Collection(spark, where)
    assert sorted(col.vectors().collect()) == before and paths(col.manifest()) == ["/a.txt", "/c.txt"]
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha three"}, T3), where)
    assert [r.text for r in state.Collection(spark, where).chunks().collect()] == ["alpha three"]


def test_crashed_run_is_invisible_and_repeated(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "c")
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha"}), where)
    monkeypatch.setattr(state.Collection, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha", "/b.txt": "beta"}), where)
    assert paths(state.Collection(spark, where).vectors()) == ["/a.txt"]
    assert paths(state.Collection(spark, where).manifest()) == ["/a.txt"]
    monkeypatch.undo()
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha", "/b.txt": "beta"}), where)
    col = state.Collection(spark, where)
    assert paths(col.vectors()) == ["/a.txt", "/b.txt"] and col.vectors().count() == 2


@pytest.mark.parametrize("table", ["diff", "counters", "vectors", "log", "quarantine", "commits"])
def test_run_that_dies_after_any_write_leaves_nothing(spark, tmp_path, monkeypatch, table):
    where, kept = str(tmp_path / "c"), {"/a.txt": "alpha", "/x.bin": "skip"}
    if table != "counters":
        incremental_ingest(spark, corpus(spark, kept), where)
    write = state.Collection.write

    def dying(self, name, run, df):
        if name == "commits":
            raise RuntimeError("lost")
        write(self, name, run, df)
        if name == table:
            raise RuntimeError("lost")

    more = {**kept, "/a.txt": "alpha two", "/b.txt": "beta", "/y.bin": "skip"}
    monkeypatch.setattr(state.Collection, "write", dying)
    with pytest.raises(RuntimeError):
        incremental_ingest(spark, corpus(spark, more, T2), where)
    monkeypatch.undo()
    seen = state.Collection(spark, where)
    before = [] if table == "counters" else ["/a.txt"]
    assert paths(seen.manifest()) == paths(seen.vectors()) == before
    if before:
        seen.compact()  # takes the number that the dead run had
        assert paths(state.Collection(spark, where).manifest()) == before
    incremental_ingest(spark, corpus(spark, more, T3), where)
    for _ in range(2):
        col = state.Collection(spark, where)
        assert paths(col.manifest()) == paths(col.vectors()) == ["/a.txt", "/b.txt"]
        assert sorted(r.text for r in col.chunks().collect()) == ["alpha two", "beta"]
        assert paths(col.quarantine()) == ["/x.bin", "/y.bin"]
        col.compact()
    assert incremental_ingest(spark, corpus(spark, more, T3).filter("suffix <> '.bin' AND file_path LIKE '%.txt'"), where).count() == 0


def test_repaired_file_leaves_the_quarantine(spark, tmp_path):
    where = str(tmp_path / "c")
    incremental_ingest(spark, corpus(spark, {"/a.txt": b"\xff", "/b.txt": "beta"}), where)
    assert paths(state.Collection(spark, where).quarantine()) == ["/a.txt"]
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha", "/b.txt": b"\xff"}, T2), where)
    assert paths(state.Collection(spark, where).quarantine()) == ["/b.txt"]


def test_vectors_of_another_width_are_refused(spark, tmp_path):
    where = str(tmp_path / "c")
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha"}), where)
    encoder = lambda chunks: encode_with(chunks, lambda: lambda ts: [[1.0, 2.0] for _ in ts])
    with pytest.raises(ValueError):
        incremental_ingest(spark, corpus(spark, {"/a.txt": "beta"}, T2), where, encoder=encoder)
    assert [r.text for r in state.Collection(spark, where).chunks().collect()] == ["alpha"]


def test_late_and_tied_versions(spark, tmp_path):
    log, where = tmp_path / "log", str(tmp_path / "c")
    schema = "file_path STRING, op STRING, content BINARY, modified_at TIMESTAMP"

    def send(*rows):
        rows = [(p, op, None if t is None else bytearray(t.encode()), w) for p, op, t, w in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(log))
        stream = spark.readStream.schema(schema).parquet(str(log))
        streaming_ingest(spark, stream, where, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.file_path, r.text) for r in state.Collection(spark, where).chunks().collect())

    assert send(("/a.txt", "upsert", "new", T3), ("/b.txt", "upsert", "bee", T2)) == [("/a.txt", "new"), ("/b.txt", "bee")]
    assert send(("/a.txt", "upsert", "old", T1), ("/b.txt", "delete", None, T1)) == [("/a.txt", "new"), ("/b.txt", "bee")]
    assert send(("/b.txt", "delete", None, T3)) == [("/a.txt", "new")]
    state.Collection(spark, where).compact()
    assert send(("/b.txt", "upsert", "late", T2)) == [("/a.txt", "new")]
    twice = [("/c.txt", "upsert", t, T1) for t in ("one", "two", "one")]
    assert send(*twice) == send(*twice[::-1])
    assert not os.path.exists(f"{where}/contents/ingest=1") or not os.listdir(f"{where}/contents/ingest=1")


def test_any_split_of_a_log_gives_the_same_collection(spark, tmp_path):
    """Late versions, equal times and versions that change nothing, in one batch or one by one."""
    schema = "file_path STRING, op STRING, content BINARY, modified_at TIMESTAMP"
    text = lambda t: bytearray(t.encode())
    log = [
        ("/a.txt", "upsert", text("one"), T1), ("/a.txt", "upsert", text("two"), T2), ("/a.txt", "upsert", text("one"), T3),
        ("/b.txt", "upsert", text("x"), T2), ("/b.txt", "upsert", text("y"), T2), ("/b.txt", "delete", None, T2),
        ("/c.txt", "delete", None, T3), ("/c.txt", "upsert", text("gone"), T2),
    ]
    found = set()
    for nth, batches in enumerate(([log], [log[:3][::-1] + log[3:5], log[5:]], [[v] for v in log[::-1]])):
        feed, where = tmp_path / f"log{nth}", str(tmp_path / f"c{nth}")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
            streaming_ingest(spark, spark.readStream.schema(schema).parquet(str(feed)), where, str(tmp_path / f"cp{nth}")).awaitTermination()
        found.add(tuple(sorted((r.file_path, r.text) for r in state.Collection(spark, where).chunks().collect())))
    assert len(found) == 1 and [p for p, _ in next(iter(found))] == ["/a.txt", "/b.txt"]


def test_empty_collection(spark, tmp_path):
    where = str(tmp_path / "none")
    assert state.read_manifest(spark, where).count() == 0
    assert state.ensure_index(spark, where).count() == 0
    assert os.path.isdir(os.path.join(where, "vectors"))
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha"}), where)
    assert state.ensure_index(spark, where).count() == 1


def test_folder_ingest(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("first file")
    (docs / "b.md").write_text("# Second")
    where = str(tmp_path / "c")
    incremental_ingest(spark, files.scan_corpus(spark, str(docs)), where)
    (docs / "a.txt").write_text("first file, changed")
    (docs / "b.md").unlink()
    report = incremental_ingest(spark, files.scan_corpus(spark, str(docs)), where)
    assert {r.status: r.n for r in report.collect()} == {"modified": 1, "deleted": 1}
    assert [r.text for r in state.Collection(spark, where).chunks().collect()] == ["first file, changed"]


def test_own_encoder(spark, tmp_path):
    where = str(tmp_path / "c")
    encoder = lambda chunks: encode_with(chunks, lambda: lambda ts: [[len(t), 1.0] for t in ts])
    incremental_ingest(spark, corpus(spark, {"/a.txt": "alpha"}), where, Options(), encoder=encoder)
    assert state.Collection(spark, where).vectors().first().embedding == [5.0, 1.0]


def test_streaming_ingest_matches_batch_and_skips_repeats(spark, tmp_path):
    log, where = tmp_path / "log", str(tmp_path / "c")
    schema = "file_path STRING, op STRING, content BINARY, modified_at TIMESTAMP"

    def write(rows):
        rows = [(p, op, None if t is None else bytearray(t.encode()), w) for p, op, t, w in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(log))

    def run(checkpoint="cp"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(log))
        streaming_ingest(spark, stream, where, str(tmp_path / checkpoint)).awaitTermination()

    write([("/a.txt", "upsert", "one", T1), ("/a.txt", "upsert", "two", T2), ("/b.txt", "upsert", "bee", T1)])
    run()
    write([("/a.txt", "upsert", "three", T3), ("/b.txt", "delete", None, T3), ("/z.txt", "delete", None, T3)])
    run()
    col = state.Collection(spark, where)
    assert [(r.file_path, r.text) for r in col.chunks().collect()] == [("/a.txt", "three")]
    assert paths(col.manifest()) == ["/a.txt"]
    assert col.last_run() == 2 and col.committed_batch(f"{tmp_path / 'cp'}#0")
    run()
    assert state.Collection(spark, where).last_run() == 2


def test_generator_hook_isolates_failures(spark):
    def load():
        def generate(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("refused")
            return [p.upper() for p in prompts]
        return generate

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt STRING").coalesce(1)
    rows = {r.prompt: (r.generated, r.error) for r in generate_with(df, load).collect()}
    assert rows == {"a": ("A", None), "bad": (None, "refused"), "c": ("C", None)}


def test_contents_stay_where_they_are_for_few_paths_and_unread_for_none(spark):
    from passageworks.plans.ingest import _only

    files = corpus(spark, {f"/{i}.txt": f"text {i}" for i in range(20)})
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = files.mapInArrow(noted, files.schema)
    none = spark.createDataFrame([], "file_path STRING")
    assert _only(watched, none).count() == 0 and read.value == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = _only(files, spark.createDataFrame([("/3.txt",), ("/5.txt",), ("/x.txt",)], "file_path STRING"))
        assert sorted(r.file_path for r in some.collect()) == ["/3.txt", "/5.txt"]
        assert "SortMergeJoin" not in some._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_small_files_are_ingested_by_few_tasks(spark, tmp_path):
    """Tasks, and the files that they write, follow the bytes of a folder and not its number of files."""
    docs, where = tmp_path / "docs", str(tmp_path / "c")
    for i in range(200):
        (docs / f"{i % 5}").mkdir(parents=True, exist_ok=True)
        (docs / f"{i % 5}" / f"{i}.txt").write_text(f"text of file {i}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert state.ensure_index(spark, where).count() == 0
        incremental_ingest(spark, files.Folder(spark, str(docs)), where)
        assert sorted(r.text for r in state.ensure_index(spark, where).collect()) == sorted(f"text of file {i}" for i in range(200))
        incremental_ingest(spark, files.Folder(spark, f"{docs}/[0-2]"), where)
        assert state.ensure_index(spark, where).count() == 120
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for run in (1, 2):
        parts = [p for p in os.listdir(next((tmp_path / "c" / "vectors" / f"ingest={run}").iterdir())) if p.startswith("part-")]
        assert len(parts) <= 4 * spark.sparkContext.defaultParallelism
