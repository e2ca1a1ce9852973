import re

from brute import base_spans, sha
from pyspark.sql import functions as F

from passageworks.llm import queries, secrets

SF = "/root/testdata/sf0.001"
OWN = "aB3dE5gH7jK9mN1pQ3sT5vW7"  # mixed, 24 characters
SCHEMA = "doc_id LONG, text STRING, source STRING, lang STRING"


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r for r in secrets.find_secrets(df, **more).collect()}


def test_base_kinds(spark):
    texts = [
        None, "", "x", 'password = "abcdefghijkl"', "PassWd: abcdefghijk", "apikey=abcdefghijklm api_key=1 token==x", "AKIA" + "A" * 14, "AKIAKIA" + "B" * 11, "AKIA" + "C" * 13,
        "0123456789abcdef", "0123456789abcde", "é" * 50 + "token: " + "0123456789abcdef" * 3, "secret='a' secret=" + "z" * 5000, "tokentoken=abcdefghijkl",
        "ſecret=abcdefghijklmn toKen=abcdefghijklmn",
    ]
    got = found(spark, [(i, t, "s", None) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"], s["kind"]) for s in got[i]["base"]] == [(a, e, k) for a, _, e, k in base_spans(t)], t


def test_owners_decide_on_tokens(spark):
    rows = [(1, f"x {OWN} y", "a", "en"), (2, "z " + OWN[::-1], "a", "en"), (3, OWN[::-1], "b", "en"), (4, OWN[::-1], "c", "en"), (5, f"token={OWN}", "d", None)]
    got = found(spark, rows)
    assert [s["kind"] for s in got[1]["spans"]] == ["token"] and got[1]["base"] == []
    assert got[1]["spans"][0]["n_owners"] == 2 and got[1]["spans"][0]["live"]
    assert all(got[i]["spans"] == [] for i in (2, 3, 4))
    assert [(s["kind"], s["start"], s["end"]) for s in got[5]["spans"]] == [("assign", 0, 30), ("live", 6, 30)]


def test_owners_and_repositories_decide_on_values(spark):
    """Two owners in one repository each pass; one owner's value in three repositories does not."""
    one, two, many = "04dbebab91ab85687d33eeaaf9ac", "f3ef4d6b2755a36d7d9c25bd72c4", "cb1a9fee807a05366fcb8b6c95c7"
    rows = [(1, f"token={one}", "a", "en"), (2, one, "b", "en"), (3, two, "a", "en"), (4, two, "a", "de"), (5, two, "a", "fr")]
    rows += [(10 + i, many, f"o{i}", "en") for i in range(4)] + [(20, "9807915762804490 " + "a1" * 14, "a", "en")]
    got = found(spark, rows)
    kinds = lambda i: [s["kind"] for s in got[i]["spans"]]
    assert kinds(1) == ["assign", "hex", "live"] and kinds(2) == ["hex", "live"]
    assert all(kinds(i) == ["hex"] for i in (3, 4, 5, 10, 11, 12, 13))
    assert got[3]["spans"][0]["n_owners"] == 1 and got[3]["spans"][0]["n_repos"] == 3
    # digits only, or hardly any different characters, do not look live
    assert kinds(20) == ["hex", "hex"]


def test_shared_base_secret_stays_but_is_no_live_one(spark):
    got = found(spark, [(i, "AKIA" + "Q" * 16, f"owner{i}", "en") for i in range(5)])
    assert all(len(r["base"]) == 1 and not r["spans"][0]["live"] and r["spans"][0]["n_owners"] == 5 for r in got.values())


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "0123456789abcdef", None, None), (None, "0123456789abcdef", None, None), (1, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(1)).withColumn("digest", F.lit("x"))
    assert sorted(len(r["spans"]) for r in secrets.find_secrets(df).collect()) == [0, 1, 1]
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_plain_version(spark):
    """Base spans, added spans and both counts, from plain loops over sf0.01."""
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    base = {r["doc_id"]: base_spans(r["text"]) for r in docs}
    value = lambda text, a, b, kind: re.search("[A-Za-z0-9+/_.=-]+$", text[a:b])[0].lstrip("=") if kind == "assign" else text[a:b]
    owners, repos = {}, {}
    for r in docs:
        for a, _, b, kind in base[r["doc_id"]]:
            v = value(r["text"], a, b, kind)
            owners.setdefault(v, set()).add(r["source"])
            repos.setdefault(v, set()).add((r["source"], r["lang"]))
    few = lambda v: len(owners[v]) <= 2 and len(repos[v]) <= 2
    looks = lambda v: len(v) >= 20 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)  # noqa: E731  all of these are varied
    rows = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, folder).collect()}
    assert len(rows) == len(docs)
    added = 0
    for r in docs:
        got, spans, text = rows[r["doc_id"]], base[r["doc_id"]], r["text"]
        assert (got["n_assign"], got["n_access"], got["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert got["base_sha256"] == sha(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans))
        values = [value(text, a, b, kind) for a, _, b, kind in spans]
        assert (got["n_live"], got["n_shared"]) == (sum(map(few, values)), sum(not few(v) for v in values))
        live = {(b - len(v), 3, b, "live") for (_, _, b, _), v in zip(spans, values) if looks(v) and few(v)}
        added += len(live)
        assert got["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted([*spans, *live]))
    assert added > 10
