"""Secret scan with corpus-wide ownership frequency.

Every whole text is searched for candidates. Those of the three base kinds are kept wherever
they are found. Two more kinds are kept only if the corpus shows that they belong to few
owners and few repositories: ``live``, the value itself of a base candidate that looks like a
credential (long, of letters and digits, not repetitive), and ``token``, a long string of mixed
letters and digits that touches no base candidate. The hash of each value is counted by distinct
repositories and owners, after pairs of hash and repository were made distinct by map-side
aggregation. Values that many owners or repositories share are examples copied from
elsewhere; values of few look like live credentials.

Null and empty texts have no spans; a null owner or repository counts as one of
its own; repeated rows, also of one id, are scanned each, and equal rows count
once; columns other than those named are ignored; no row is dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

# The patterns of the base kinds and the least length of what counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "live", "token")
BASE = KINDS[:3]

#: A ``token``: so many characters, with both cases and digits, and bits per character.
TOKEN_CHARS, TOKEN_BITS = 24, 3.5
#: A value that looks live: so many characters, with letters and digits, and bits per character.
VALUE_CHARS, VALUE_BITS = 20, 3.0
#: A value is owner-specific if at most so many owners have it, in so many repositories.
MAX_OWNERS, MAX_REPOS = 2, 2

SPAN = "STRUCT<start: BIGINT, kind: STRING, end: BIGINT, digest: BINARY>"


def base_matches(text: str) -> list[tuple[str, int, int, int, str]]:
    """``(kind, start, end, start of the value, value)`` of the base kinds, in code points, end exclusive.

    A value reaches to the end of its span.
    """
    found = []
    for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= LEAST["assign"]:
            found.append(("assign", m.start(), m.end(), m.start(2), m[2]))
    if "AKIA" in text:
        for m in re.finditer(ACCESS, text):
            if len(m[0]) >= LEAST["access"]:
                found.append(("access", m.start(), m.end(), m.start(), m[0]))
    # runs are maximal, so asking for the length in the pattern leaves the same ones
    for m in re.finditer(HEX[:-1] + "{%d,}" % LEAST["hex"], text):
        found.append(("hex", m.start(), m.end(), m.start(), m[0]))
    return found


def bits(text: str) -> float:
    """Bits per character, from the characters' frequencies in the text."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def live_values(matches: list[tuple[str, int, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Values of base candidates that look like credentials, each place once."""
    values = {(start, end, value) for _, _, end, start, value in matches if len(value) >= VALUE_CHARS}
    return [("live", a, b, v) for a, b, v in values if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and bits(v) >= VALUE_BITS]


def token_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
    """Long mixed strings that touch no other candidate."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_CHARS, text):
        s = m[0]
        if re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s):
            if bits(s) >= TOKEN_BITS and all(m.end() <= a or b <= m.start() for a, b in taken):
                found.append(("token", m.start(), m.end(), s))
    return found


def spans_of(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, secret)`` of all candidates, by place, then kind."""
    matches = base_matches(text)
    found = [(kind, start, end, value) for kind, start, end, _, value in matches]
    found += live_values(matches) + token_spans(text, [(a, b) for _, a, b, _, _ in matches])
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` spans and all ``spans``.

    A span holds kind, start, end, the digest of its secret, the numbers of
    owners and repositories that have it, and ``live``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("digest", pa.binary())]))
        for batch in batches:
            spans = []
            for text in batch.column("text").to_pylist():
                spans.append([{"start": a, "kind": k, "end": b, "digest": hashlib.sha256(s.encode()).digest()[:16]} for k, a, b, s in spans_of(text or "")])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "owner", "repo")), pa.array(spans, kind)], ["id", "owner", "repo", "found"])

    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), owner.alias("owner"), repo.alias("repo"), F.col(text_col).cast("string").alias("text"))
    scanned = chosen.mapInArrow(scan, f"id BIGINT, owner STRING, repo STRING, found ARRAY<{SPAN}>")
    scanned = store(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")

    candidates = scanned.select("row", "owner", "repo", F.explode("found").alias("span"))
    held = candidates.select(F.col("span.digest").alias("digest"), "owner", "repo").distinct()
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    frequency = by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))

    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("span.kind"))
    judged = (
        candidates.withColumn("digest", F.col("span.digest")).join(frequency, "digest")
        .where(F.col("span.kind").isin(*BASE) | live)
        .select("row", F.struct(F.col("span.start").alias("start"), rank.alias("rank"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"), "digest", "n_owners", "n_repos", live.alias("live")).alias("span"))
    )
    # the spans of one text meet here: as many as that text holds
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint,digest:binary,n_owners:bigint,n_repos:bigint,live:boolean>>"))
    rows = scanned.select("row", "id").join(per_row, "row", "left").select("id", spans.alias("spans"))
    return rows.select("id", F.filter("spans", lambda s: s["kind"].isin(*BASE)).alias("base"), "spans")
