import datetime as dt

from pyspark.sql import functions as F

from passageworks.operators import diff

OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def current(spark):
    rows = [("/a/new", "h1", NEW), ("/a/changed", "h2", NEW), ("/a/touched", "h3", NEW)]
    return spark.createDataFrame(rows, "file_path STRING, content_hash STRING, modified_at TIMESTAMP")


def manifest(spark):
    rows = [("/a/changed", "old", OLD, OLD), ("/a/touched", "h3", OLD, OLD), ("/b/gone", "h4", OLD, OLD)]
    return spark.createDataFrame(
        rows, "file_path STRING, content_hash STRING, last_modified TIMESTAMP, created_at TIMESTAMP"
    )


def statuses(df):
    return {r.file_path: r.status for r in df.collect()}


def test_only_the_hash_decides(spark):
    assert statuses(diff.snapshot_diff(current(spark), manifest(spark))) == {
        "/a/new": "new", "/a/changed": "modified", "/a/touched": "unchanged", "/b/gone": "deleted",
    }


def test_root_limits_deletions(spark):
    found = statuses(diff.snapshot_diff(current(spark), manifest(spark), root="/a"))
    assert "/b/gone" not in found


def test_set_operators_agree_with_diff(spark):
    c, m = current(spark), manifest(spark)
    assert [r[0] for r in diff.new_files(c, m).collect()] == ["/a/new"]
    assert [r[0] for r in diff.deleted_files(c, m).collect()] == ["/b/gone"]
    assert [tuple(r) for r in diff.modified_files(c, m).collect()] == [("/a/changed", "h2", "old")]
    report = {r.status: r.n for r in diff.ingest_report(diff.snapshot_diff(c, m)).collect()}
    assert report == {"new": 1, "modified": 1, "deleted": 1, "unchanged": 1}


def test_upsert_takes_last_writer_and_renews_created_at(spark):
    delta = spark.createDataFrame(
        [("/a/changed", "h2", OLD), ("/a/changed", "h9", NEW), ("/a/new", "h1", NEW)],
        "file_path STRING, content_hash STRING, last_modified TIMESTAMP",
    )
    rows = {r.file_path: r for r in diff.manifest_upsert(manifest(spark), delta, NEW).collect()}
    assert rows["/a/changed"].content_hash == "h9" and rows["/a/changed"].created_at == NEW
    assert rows["/a/touched"].created_at == OLD
    assert len(rows) == 4


def test_lookup_gives_null_for_unknown(spark):
    rows = {r[0]: r[1] for r in diff.lookup(manifest(spark), current(spark), ["content_hash"]).collect()}
    assert rows == {"/a/new": None, "/a/changed": "old", "/a/touched": "h3"}


def test_listing_does_not_join_contents(spark):
    corpus = spark.createDataFrame(
        [("/a/x", bytearray(b"abc"), NEW)], "file_path STRING, content BINARY, modified_at TIMESTAMP"
    )
    row = diff.listing(corpus).first()
    assert row.content_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert "content" not in diff.listing(corpus).columns
    assert diff.listing(corpus.withColumn("content", F.lit(None).cast("binary"))).first().content_hash == ""
