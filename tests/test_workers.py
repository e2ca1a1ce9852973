"""Workers must not need the package: jobs started from another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config(
    "spark.ui.enabled", "false").getOrCreate()
from passageworks.operators import adaptive, cells, postings, retrieval
rows = [(i, [float(i), 1.0, float(i % 3)]) for i in range(40)]
v = spark.createDataFrame(rows, "chunk_id LONG, embedding ARRAY<FLOAT>")
q = v.limit(3).withColumnRenamed("chunk_id", "query_id")
assert retrieval.topk_batch(v, q, 2).count() == 6
assert retrieval.topk_batch(v, q, 2, block_bytes=1, group_rows=10).count() == 6
index = cells.CellIndex.build(v, {place!r} + "/cells")
assert index.search(q, 2).count() == 6
assert index.search(q, 2, block_bytes=1).count() == 6
words = spark.sql("SELECT id AS chunk_id, named_struct('buckets', array(1, 2 + int(id % 5)), 'weights', array(float(0.6), float(0.8))) AS features FROM range(30)")
posted = postings.PostingIndex.build(words, {place!r} + "/postings", 10)
some = words.limit(3).withColumnRenamed("chunk_id", "query_id")
assert posted.search(some, 2).count() == 6
assert posted.search(some, 2, block_bytes=1, group_rows=8).count() == 6
e = spark.sql("SELECT id % 4 AS key, timestamp_seconds(id * 999) AS ts, id, 9.0D AS value FROM range(80)")
assert adaptive.budget_controller(e, "key", ["ts", "id"], "value", stretch=5).count() == 4
print("all done")
"""


def test_jobs_run_without_the_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" or ROOT not in v}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, place=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=180,
    )
    assert "all done" in done.stdout, done.stderr[-2000:]
