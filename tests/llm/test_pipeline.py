import numpy as np
from brute import WORD, base_failed, counts, gone_lines, groups

import corpus_pipeline as cp
from passageworks.llm import line_dedup, mixing, pieces, queries
from passageworks.llm.common import store

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    results = []
    for name, stage in cp.STAGES:
        docs = store(stage(spark, docs, SF), "test-pipeline")
        results.append(docs)
    assert all(d.columns == columns for d in results[:4])

    # with so few labels no cutoff can be certified, so only the base rule rejects
    kept = {d: t for d, t in texts.items() if not base_failed(counts(t))}
    assert {r["doc_id"] for r in results[0].collect()} == set(kept)

    gone = gone_lines(list(kept.items()), line_dedup.MIN_WORDS, line_dedup.EDIT_WORDS)
    cleared = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in kept.items()}
    cleared = {d: t for d, t in cleared.items() if d not in gone or WORD.search(t)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in results[1].collect()} == {d: (t, len(t)) for d, t in cleared.items()}

    first = {d for d, least in groups(list(cleared.items())).items() if d == least}
    assert {r["doc_id"] for r in results[2].collect()} == first

    weights = [queries.TARGETS[d] for d in mixing.DOMAINS]
    rated = mixing.rated(results[2], spark.read.parquet(f"{SF}/labels.parquet"), mixing.domain_of(), weights).collect()
    mixed = sorted(r["doc_id"] for r in results[3].collect())
    assert mixed == sorted(r["_mix_id"] for r in rated for _ in range(r["_mix_copies"]))

    back = pieces.decode(results[4], f"{queries.TOKENIZERS}/piece_bpe_32k.model").collect()
    assert sorted(r["doc_id"] for r in back) == mixed
    assert all(r["text"] == cleared[r["doc_id"]] and len(np.frombuffer(r["ids"], "<u2")) == r["n_pieces"] for r in back)


def test_run_has_the_rows_of_its_stages(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "n_pieces", "ids", "samples"]
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][0] == "quality rules"


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = store(stage(spark, docs, SF), "test-pipeline")
    assert docs.count() == 0
