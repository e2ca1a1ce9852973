"""DuckDB statements that state the same results as ``queries`` independently."""

from __future__ import annotations

from ..functions.answers import GUIDE, NOT_ANSWERED, NOTHING_FOUND, FAILED
from ..functions.text import WHITESPACE
from .queries import LATENCY

WS = f"[{WHITESPACE}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> '')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DOCS = "SELECT concat('doc/', doc_id) AS file_path, text FROM documents"
PAGES = "SELECT concat('page/', page_id) AS file_path, html AS text FROM pages"
LABELLED = "SELECT concat('doc/', doc_id) AS file_path, quality, toxic FROM labels"
EARLIER = f"""SELECT d.file_path, CASE WHEN l.quality = 0 THEN d.text || ' (draft)' ELSE d.text END AS text
  FROM ({DOCS}) d JOIN ({LABELLED}) l USING (file_path) UNION ALL {PAGES}"""
SNAPSHOTS = f"""cur AS (SELECT file_path, sha256(text) AS content_hash FROM ({DOCS})),
man AS (SELECT file_path, sha256(text) AS content_hash, '2024-01-01 00:00:00' AS last_modified,
  '2024-01-01 00:00:00' AS created_at FROM ({EARLIER})),
diff AS (SELECT coalesce(c.file_path, m.file_path) AS file_path, c.content_hash, m.content_hash AS last_hash,
  CASE WHEN m.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted'
       WHEN c.content_hash <> m.content_hash THEN 'modified' ELSE 'unchanged' END AS status
  FROM cur c FULL JOIN man m ON c.file_path = m.file_path)"""


def _chunks(source: str, size: int = 1000, overlap: int = 200, name: str = "chunks") -> str:
    step = size - overlap
    return f"""{name} AS (SELECT concat(file_path, '::', no) AS chunk_id, file_path, no::INT AS chunk_no,
  (no * {step})::INT AS start,
  CASE WHEN no * {step} + {size} < n AND NOT regexp_matches(raw, '{WS}$') AND cut > 0
       THEN substr(raw, 1, cut) ELSE raw END AS text
  FROM (SELECT *, length(regexp_extract(raw, '(?s)^(.*) [^ ]*$', 1)) AS cut
    FROM (SELECT file_path, length(text) AS n, no, substr(text, no * {step} + 1, {size}) AS raw
      FROM (SELECT file_path, text, unnest(range(0, CAST(ceil(length(text) / {step}.0) AS BIGINT))) AS no
        FROM ({source}) WHERE text <> ''))))"""


CHUNKS = _chunks(DOCS)
WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
BUCKET = "(('0x' || substr(md5(w), 1, 8))::BIGINT % 384)::INT"


def _features(name: str, table: str, key: str) -> str:
    return f"""{name}_tf AS (SELECT {key}, {BUCKET} AS bucket, count(*) AS tf
  FROM (SELECT {key}, unnest({WORDS}) AS w FROM {table}) GROUP BY 1, 2),
{name}_raw AS (SELECT {key}, bucket, (1 + ln(tf::DOUBLE)) * idf AS raw FROM {name}_tf JOIN idf USING (bucket)),
{name} AS (SELECT {key}, bucket, (raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w
  FROM {name}_raw)"""


IDF = f"""seen AS (SELECT bucket, count(*) AS df FROM (SELECT DISTINCT chunk_id, {BUCKET} AS bucket
  FROM (SELECT chunk_id, unnest({WORDS}) AS w FROM chunks)) GROUP BY 1),
idf AS (SELECT b::INT AS bucket, ln(((SELECT count(*) FROM chunks) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM range(384) r(b) LEFT JOIN seen ON b = bucket)"""
ASKED = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
HITS = f"""{CHUNKS},
{IDF},
{_features('cf', 'chunks', 'chunk_id')},
{ASKED},
{_features('qf', 'asked', 'query_id')},
cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM cf GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qf GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(qf.w * cf.w) AS dot FROM qf JOIN cf USING (bucket) GROUP BY 1, 2),
scored AS (SELECT query_id, chunk_id, round(1 - dot / (qn.norm * cn.norm), 9) + 0.0 AS distance
  FROM dots JOIN qn USING (query_id) JOIN cn USING (chunk_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM scored),
hits AS (SELECT query_id, rank::INT AS rank, chunk_id, file_path, text, round(distance, 6) AS distance
  FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 4)"""
FOUND = f"""{HITS},
found AS (SELECT query_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY rank), 1, 6000) AS context,
  list_sort(list(DISTINCT file_path)) AS sources FROM hits GROUP BY 1)"""


def _sentences(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\\n]+[.!?]*'), lambda s: {_strip('s')}), "
        "lambda s: s <> '')"
    )


def _best(keys: str, question: str, context: str, table: str, name: str = "best") -> str:
    """Per row the first sentence covering most distinct question tokens."""
    return f"""{name}_s AS (SELECT {keys}, {question} AS q, unnest({_sentences(context)}) AS s,
  generate_subscripts({_sentences(context)}, 1) AS pos FROM {table}),
{name} AS (SELECT {keys}, arg_max(s, (score, -pos)) AS sentence, max(score) AS score FROM
  (SELECT *, len(list_filter(list_distinct({_tokens('q')}), lambda t: list_contains({_tokens('s')}, t))) AS score
   FROM {name}_s) GROUP BY ALL)"""


def _grounding(answer: str, context: str) -> str:
    long = f"list_filter({_tokens(answer)}, lambda t: length(t) > 3)"
    return f"""len(list_filter({long}, lambda t: list_contains({_tokens(context)}, t)))::INT AS hits,
  len({long})::INT AS total"""


RATIO = "CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE hits::DOUBLE / total END"
PAIRS = """turned AS (SELECT conv_id, turn, role, text AS question,
  lead(role) OVER w AS next_role, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, question, answer FROM turned WHERE role = 'user' AND next_role = 'assistant')"""
ESC = r"""replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n')"""
GENERATED = f"""made AS (SELECT conv_id, turn, role, text, CASE (conv_id + turn) % 7 WHEN 0 THEN text
  WHEN 1 THEN '{{"answer": "' || {ESC} || '", "no_answer": false}}'
  WHEN 2 THEN 'Here: {{"answer": "' || {ESC} || '", "no_answer": "false"}} done'
  WHEN 3 THEN '{{"answer": "' || {ESC} || '"}}'
  WHEN 4 THEN '[no_answer] ' || text
  WHEN 5 THEN '{{"answer": "' || {ESC} || '", "no_answer": 1.5}} or {{x}}'
  ELSE '{{"answer": "' || {ESC} || '", "no_answer": null}}' END AS generated FROM conversations
 UNION ALL SELECT conv_id, turn + 1000, role, text, CASE WHEN (conv_id + turn) % 7 < 2 THEN '{{"answer": null, "no_answer": 0}}'
  WHEN (conv_id + turn) % 7 < 4 THEN '{{"answer": true, "no_answer": []}}'
  ELSE ' ' || substr(text, 1, 1) END FROM conversations)"""


def _parsed(source: str, keys: str, name: str = "parsed") -> str:
    plain = _strip("generated")
    return f"""{name}_j AS (SELECT *, {plain} AS plain,
  CASE WHEN json_valid(span) AND json_type(span) = 'OBJECT' AND json_exists(span, '$.answer')
    AND json_exists(span, '$.no_answer') THEN span::JSON END AS j
  FROM (SELECT *, regexp_extract(generated, '(?s)\\{{.*\\}}') AS span FROM {source})),
{name} AS (SELECT {keys},
  CASE WHEN j IS NOT NULL THEN {_strip('''CASE json_type(j, '$.answer') WHEN 'NULL' THEN 'None'
      WHEN 'BOOLEAN' THEN CASE WHEN (j->>'$.answer') = 'true' THEN 'True' ELSE 'False' END
      ELSE j->>'$.answer' END''')}
    WHEN length(plain) < 2 OR contains(upper(plain), '[NO_ANSWER]') THEN '' ELSE plain END AS answer,
  CASE WHEN j IS NOT NULL THEN CASE json_type(j, '$.no_answer') WHEN 'NULL' THEN false
      WHEN 'BOOLEAN' THEN (j->>'$.no_answer') = 'true' WHEN 'VARCHAR' THEN (j->>'$.no_answer') <> ''
      WHEN 'ARRAY' THEN json_array_length(j, '$.no_answer') > 0
      WHEN 'OBJECT' THEN len(json_keys(j, '$.no_answer')) > 0
      ELSE (j->>'$.no_answer')::DOUBLE <> 0 END
    ELSE length(plain) < 2 OR contains(upper(plain), '[NO_ANSWER]') END AS no_answer
  FROM {name}_j)"""


STATUS = f"""CASE WHEN n_sources = 0 THEN 'no_context' WHEN error IS NOT NULL THEN 'error'
  WHEN no_answer OR {_strip('answer')} = '' OR {RATIO} < 0.55 THEN 'no_answer' ELSE 'answered' END"""

SPOKEN = """SELECT conv_id, string_agg(text, '' ORDER BY turn) AS context FROM conversations
  WHERE role = 'user' GROUP BY 1"""

CSV_TOKEN = r"""("(?:[^"]|"")*(?:"[^,\n]*|$)|[^",\n][^,\n]*|)(,|\n|$)"""


# a quoted cell: the quoted part with doubled quotes made single, then what follows the closing quote
CSV_QUOTED = (
    "replace(regexp_extract(cell, '(?s)^\"((?:[^\"]|\"\")*)', 1), '\"\"', '\"') "
    "|| regexp_extract(cell, '(?s)^\"(?:[^\"]|\"\")*\"(.*)$', 1)"
)


def _md_blocks() -> str:
    heading = r"(?m)^(#{1,6}[ \t]*[^#\n][^\n]*)$"
    item = r"(?m)^((?:[-*+]|[0-9]+\.)[ \t]+[^\n]*)$"
    mark = "chr(30)"
    alone = f"regexp_replace(regexp_replace(text, '{heading}', {mark} || '\\1' || {mark}, 'g'), '{item}', {mark} || '\\1' || {mark}, 'g')"
    cut = f"regexp_replace({alone}, '\\n[ \\t]*\\n', {mark}, 'g')"
    return (
        f"list_filter(list_transform(string_split({cut}, {mark}), "
        "lambda b: regexp_replace(b, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')), lambda b: b <> '')"
    )


_TAGS = (
    "h[1-6]|p|li|ul|ol|div|title|article|section|nav|header|footer|body|head|html|table|tr|td|th|blockquote|pre|br"
)


def _html_blocks() -> str:
    bare = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for hidden in ("script", "style"):
        bare = f"regexp_replace({bare}, '(?is)<{hidden}\\b.*?</{hidden}\\s*>', '', 'g')"
    marked = f"regexp_replace({bare}, '(?i)<(/?(?:{_TAGS}))\\b[^>]*>', chr(30) || '\\1' || chr(31), 'g')"
    return f"string_split(regexp_replace({marked}, '<[^>]*>', '', 'g'), chr(30))"


_UNESCAPED = "regexp_replace(b, '^[^' || chr(31) || ']*' || chr(31), '')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"

CENTROIDS = """parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label AS query_id, list(x ORDER BY i) AS c FROM
  (SELECT label, i, avg(x) AS x FROM parts GROUP BY 1, 2) GROUP BY 1)"""
EXACT = """1 - list_dot_product(embedding::DOUBLE[], {c}) /
  (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({c}, {c})))"""
DIST = f"round({EXACT}, 9) + 0.0"

_TYPED = """SELECT conv_id, 2 * turn AS turn, ' ' || chr(9) || text || chr(10) || ' ' AS text FROM conversations
 UNION ALL SELECT conv_id, 2 * turn + 1, CASE (conv_id + turn) % 9 WHEN 0 THEN ' Quit ' WHEN 1 THEN 'EXIT'
  ELSE ' ' || chr(9) || ' ' END FROM conversations WHERE (conv_id + turn) % 9 < 4"""

_ALPHA = "0.4::DOUBLE"
_EMA = f"""list_reduce(list_transform(list(value ORDER BY ts, event_id), lambda v: v::DOUBLE),
  lambda a, x: {_ALPHA} * x + (1 - {_ALPHA}) * a)"""
_T = f"{LATENCY.latency_target}::DOUBLE"
_PASSED = f"CASE WHEN a.e IS NULL THEN w.e ELSE {_ALPHA} * w.e + (1 - {_ALPHA}) * coalesce(w.st, a.e) END"
# stretches of 4096 events; the weight of an average 4096 events back is zero in double precision
_HOT = f"""WITH ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
  CASE day(ts) % 4 WHEN 1 THEN {_T} * 1.1::DOUBLE WHEN 3 THEN {_T} * 0.5::DOUBLE ELSE value::DOUBLE END AS x FROM events),
ends AS (SELECT s + 1 AS s, list_reduce(xs, lambda a, x: {_ALPHA} * x + (1 - {_ALPHA}) * a) AS e
  FROM (SELECT i // 4096 AS s, list(x ORDER BY i) AS xs FROM ev GROUP BY 1)),
items AS (SELECT i, {{'e': x, 'st': CASE WHEN i % 4096 = 0 THEN e END, 'b': 0::INT}} AS v FROM ev LEFT JOIN ends ON s = i // 4096),
done AS (SELECT count(*) AS n, list_reduce(list_prepend({{'e': NULL::DOUBLE, 'st': NULL::DOUBLE, 'b': 384::INT}}, list(v ORDER BY i)),
  lambda a, w: {{'e': {_PASSED}, 'st': NULL::DOUBLE, 'b': CASE
    WHEN {_PASSED} > {_T} * 1.1::DOUBLE AND a.b > 64 THEN greatest(64, trunc(a.b * 0.7::DOUBLE)::INT)
    WHEN {_PASSED} < {_T} * 0.5::DOUBLE AND a.b < 512 THEN least(512, trunc(a.b * 1.2::DOUBLE)::INT)
    ELSE a.b END}}) AS r FROM items)
SELECT 'all' AS user, n, round(r.e, 6) AS ema, r.b AS budget FROM done"""
_BUDGET = f"""WITH RECURSIVE ev AS (SELECT user_id, value::DOUBLE AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
st AS (SELECT user_id, 0::BIGINT AS n, NULL::DOUBLE AS ema, 384 AS budget FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL
 SELECT user_id, i, e, CASE
   WHEN e > {_T} * 1.1::DOUBLE AND budget > 64 THEN greatest(64, trunc(budget * 0.7::DOUBLE)::INT)
   WHEN e < {_T} * 0.5::DOUBLE AND budget < 512 THEN least(512, trunc(budget * 1.2::DOUBLE)::INT)
   ELSE budget END
 FROM (SELECT st.user_id, ev.i, budget,
   CASE WHEN ema IS NULL THEN x ELSE {_ALPHA} * x + (1 - {_ALPHA}) * ema END AS e
   FROM st JOIN ev ON st.user_id = ev.user_id AND ev.i = st.n + 1))
SELECT user_id, n, round(ema, 6) AS ema, budget FROM st
QUALIFY n = max(n) OVER (PARTITION BY user_id)"""

_LIVE = _chunks("SELECT file_path || '.txt' AS file_path, text FROM (" + DOCS + ")")
_ESCAPED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _csv_query() -> str:
    # a match that is empty at the very end of the text is not a cell
    token = CSV_TOKEN.replace("'", "''")
    return f"""WITH src AS ({DOCS} UNION ALL {PAGES}),
norm AS (SELECT file_path, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM src),
plain AS (SELECT file_path, regexp_replace(replace(text, ',', ', '), '\\n$', '') AS text
  FROM norm WHERE NOT contains(text, '"')),
toks AS (SELECT file_path, unnest(regexp_extract_all(text, '{token}')) AS tok,
  generate_subscripts(regexp_extract_all(text, '{token}'), 1) AS i
  FROM (SELECT file_path, regexp_replace(text, '\\n$', '') AS text FROM norm
    WHERE contains(text, '"'))),
cells AS (SELECT file_path, i, CASE WHEN tok LIKE '%,' THEN ',' WHEN right(tok, 1) = chr(10) THEN chr(10) ELSE '' END AS sep,
  tok FROM toks),
cut AS (SELECT file_path, i, sep, CASE WHEN sep = '' THEN tok ELSE left(tok, length(tok) - 1) END AS cell FROM cells),
clean AS (SELECT file_path, i, CASE WHEN sep = ',' THEN ', ' ELSE sep END AS sep,
  CASE WHEN cell LIKE '"%' THEN {CSV_QUOTED} ELSE cell END AS cell FROM cut)
SELECT * FROM plain UNION ALL
SELECT file_path, string_agg(cell || sep, '' ORDER BY i) AS text FROM clean GROUP BY 1"""


_MIXED_BAD = f"""SELECT file_path || '.bad.txt' AS file_path, 'bad_utf8' AS load_error FROM ({DOCS})
UNION ALL SELECT file_path || '.html', 'unsupported' FROM ({PAGES})
UNION ALL SELECT file_path || '.pdf', 'corrupt_pdf' FROM ({PAGES})"""

def _approx_query(per_cell: int = 64, most: int = 65_536, rounds: int = 2, share: float = 0.75) -> str:
    """Cells trained as the index trains them: starts and sample by MD5, then moves to the mean direction."""
    dot = "list_dot_product({a}.u, {b}.u)"

    def near(rows: str, centres: str, name: str) -> str:
        return f"""{name} AS (SELECT r.vec_id, r.u, c.cell FROM {rows} r, {centres} c
  QUALIFY row_number() OVER (PARTITION BY r.vec_id ORDER BY {dot.format(a='r', b='c')} DESC, c.cell) = 1)"""

    steps = []
    for i in range(rounds):
        steps.append(near("sample", f"c{i}", f"near{i}"))
        steps.append(f"""mean{i} AS (SELECT cell, list(x ORDER BY i) AS m FROM (SELECT cell, i, avg(u[i]) AS x
  FROM near{i}, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
c{i + 1} AS (SELECT cell, CASE WHEN m IS NULL THEN u ELSE [x / sqrt(list_dot_product(m, m)) FOR x IN m] END AS u FROM c{i} LEFT JOIN mean{i} USING (cell))""")
    last = f"c{rounds}"
    return f"""WITH v AS (SELECT vec_id, embedding, [x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]] AS u FROM embeddings),
n AS (SELECT least(4096, ceil(sqrt(count(*))))::INT AS cells FROM v),
lot AS (SELECT vec_id, u, row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) - 1 AS place FROM v),
sample AS (SELECT vec_id, u FROM lot, n WHERE place < least({most}, {per_cell} * cells)),
c0 AS (SELECT place AS cell, u FROM lot, n WHERE place < cells),
{', '.join(steps)},
{near('v', last, 'placed')},
asked AS (SELECT q.vec_id AS query_id, q.embedding::DOUBLE[] AS c, cell FROM v q, {last} c, n WHERE q.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {dot.format(a='q', b='c')} DESC, cell) <= ceil({share} * any_value(cells) OVER ())),
s AS (SELECT query_id, vec_id, {DIST.format(c='c')} AS distance FROM asked JOIN placed USING (cell) JOIN embeddings USING (vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= 4"""


ORACLE = {
    "content_hash": f"SELECT file_path, sha256(text) AS content_hash FROM ({DOCS})",
    "snapshot_diff": f"WITH {SNAPSHOTS} SELECT * FROM diff",
    "new_files": f"WITH {SNAPSHOTS} SELECT file_path FROM diff WHERE status = 'new'",
    "deleted_files": f"WITH {SNAPSHOTS} SELECT file_path FROM diff WHERE status = 'deleted'",
    "modified_files": f"WITH {SNAPSHOTS} SELECT file_path, content_hash, last_hash FROM diff WHERE status = 'modified'",
    "ingest_report": f"WITH {SNAPSHOTS} SELECT status, count(*) AS n FROM diff GROUP BY 1",
    "manifest_upsert": f"""WITH {SNAPSHOTS} SELECT * FROM man ANTI JOIN cur USING (file_path) UNION ALL
SELECT file_path, content_hash, '2024-02-01 00:00:00', '2024-02-01 00:00:00' FROM cur""",
    "manifest_delete": f"WITH {SNAPSHOTS} SELECT * FROM man SEMI JOIN cur USING (file_path)",
    "manifest_lookup": f"""WITH {SNAPSHOTS} SELECT c.file_path, m.content_hash, m.last_modified
FROM cur c LEFT JOIN man m USING (file_path)""",
    "manifest_source": f"""WITH {SNAPSHOTS} SELECT file_path || '.txt' AS file_path, content_hash,
CASE WHEN status = 'unchanged' THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS last_modified,
CASE WHEN status = 'unchanged' THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS created_at
FROM diff WHERE status <> 'deleted'""",
    "incremental_ingest": f"WITH {_LIVE} SELECT * FROM chunks",
    "streaming_ingest": f"WITH {_LIVE} SELECT * FROM chunks",
    "collection_edits": f"""WITH {_LIVE},
marks AS (SELECT concat('doc/', doc_id, '.txt') AS file_path, quality, toxic FROM labels),
c AS (SELECT chunk_id, file_path, chunk_no = 0 AS opens,
  file_path IN (SELECT file_path FROM marks WHERE toxic = 1) AS toxic,
  file_path IN (SELECT file_path FROM marks WHERE quality = 0) AS poor FROM chunks)
SELECT 1 AS step, chunk_id, file_path FROM c WHERE NOT toxic
UNION ALL SELECT 2, chunk_id, file_path FROM c WHERE NOT toxic AND NOT (poor AND opens)
UNION ALL SELECT 3, chunk_id, file_path FROM c WHERE (NOT toxic AND NOT (poor AND opens)) OR (toxic AND opens)""",
    "ingest_vectors": f"""WITH {_LIVE}, {IDF}, {_features('cf', 'chunks', 'chunk_id')}
SELECT chunk_id, bucket, round(w, 6) AS weight FROM cf""",
    "streaming_vectors": f"""WITH {_LIVE}, {IDF}, {_features('cf', 'chunks', 'chunk_id')}
SELECT chunk_id, bucket, round(w, 6) AS weight FROM cf""",
    "chunk_text": f"WITH {CHUNKS} SELECT * FROM chunks",
    "chunk_keys": f"WITH {_chunks(PAGES, 300, 50)} SELECT chunk_id, file_path, length(text)::INT AS n_chars FROM chunks",
    "delete_chunks_by_file": f"""WITH {CHUNKS} SELECT chunk_id, file_path FROM chunks
WHERE file_path NOT IN (SELECT file_path FROM ({LABELLED}) WHERE toxic = 1)""",
    "delete_chunks_by_id": f"""WITH {CHUNKS} SELECT chunk_id, file_path FROM chunks
WHERE NOT (chunk_no = 0 AND file_path IN (SELECT file_path FROM ({LABELLED})))""",
    "vector_append": f"""WITH {CHUNKS} SELECT chunk_id, file_path,
CASE WHEN file_path IN (SELECT file_path FROM ({LABELLED})) THEN 'stored' ELSE 'added' END AS origin FROM chunks""",
    "replace_chunks": f"""WITH poor AS (SELECT file_path FROM ({LABELLED}) WHERE quality = 0), {CHUNKS},
{_chunks('SELECT * FROM (' + DOCS + ') SEMI JOIN poor USING (file_path)', 400, 40, 'fresh')}
SELECT chunk_id, file_path, start, length(text)::INT AS n_chars FROM chunks ANTI JOIN poor USING (file_path)
UNION ALL SELECT chunk_id, file_path, start, length(text)::INT FROM fresh""",
    "load_csv": _csv_query(),
    "markup_blocks": f"""WITH b AS (SELECT file_path, unnest({_md_blocks()}) AS raw,
  generate_subscripts({_md_blocks()}, 1) - 1 AS no FROM ({DOCS})),
k AS (SELECT *, CASE WHEN regexp_matches(raw, '^#{{1,6}}[ \\t]*[^#\\n][^\\n]*$') THEN 'heading'
  WHEN regexp_matches(raw, '^[-*+][ \\t]+[^\\n]*$') THEN 'bullet'
  WHEN regexp_matches(raw, '^[0-9]+\\.[ \\t]+[^\\n]*$') THEN 'number' ELSE 'paragraph' END AS kind FROM b)
SELECT file_path, no::INT AS block_no, kind,
  CASE WHEN kind = 'heading' THEN length(regexp_extract(raw, '^#{{1,6}}')) ELSE 0 END::INT AS level,
  CASE kind WHEN 'heading' THEN regexp_replace(regexp_replace(raw, '^#{{1,6}}[ \\t]*', ''), '[ \\t]*#*[ \\t]*$', '')
    WHEN 'bullet' THEN regexp_replace(raw, '^[-*+][ \\t]+', '')
    WHEN 'number' THEN regexp_replace(raw, '^[0-9]+\\.[ \\t]+', '') ELSE raw END AS text FROM k""",
    "scan_corpus": """SELECT doc_id, '.txt' AS suffix, octet_length(encode(text || chr(10)))::BIGINT AS length,
  sha256(text || chr(10)) AS content_hash FROM documents""",
    "ensure_index": f"""WITH {_chunks("SELECT doc_id::VARCHAR AS file_path, text || chr(10) AS text FROM documents")},
c AS (SELECT file_path::BIGINT AS doc_id, chunk_no FROM chunks)
SELECT 1 AS step, * FROM c UNION ALL SELECT 2, * FROM c WHERE doc_id % 10 IN (0, 1, 3, 4, 6, 7, 9)""",
    "markdown_html": """SELECT p_partkey, concat('<h1>Part ', p_partkey, '</h1>', chr(10), '<p>The <code>a*', p_size, '*b &lt;i&gt;</code> of <strong>', p_name,
  '</strong> is <em>', p_brand, '</em> <b>here</b>, x_y_z &amp; 3 &lt; 4 *plain*', chr(10), 'next line</p>', chr(10),
  '<ul>', chr(10), '<li>one<ul>', chr(10), '<li>', p_type, '<ol>', chr(10), '<li>deep <em>', p_name, '</em></li>', chr(10), '</ol>', chr(10), '</li>', chr(10),
  '<li>two</li>', chr(10), '</ul>', chr(10), '</li>', chr(10), '<li>three</li>', chr(10), '</ul>', chr(10), '<h2>Kinds</h2>', chr(10),
  '<ol>', chr(10), '<li><a href="http://x/p_', p_partkey, '_q">to</a></li>', chr(10), '<li><img alt="pic" src="i.png" /></li>', chr(10), '</ol>', chr(10),
  '<pre><code># ', p_name, ' *not* &lt;read&gt;', chr(10), '</code></pre>', chr(10), '<div>', chr(10), '*raw* ', p_name, chr(10), '</div>', chr(10),
  '<blockquote>', chr(10), '<p>said ', p_brand, '</p>', chr(10), '</blockquote>', chr(10), '<hr />', chr(10), '<pre><code>kept &lt;as&gt; is', chr(10), '</code></pre>') AS html
FROM part""",
    "html_text": f"""WITH b AS (SELECT concat('page/', page_id) AS file_path, list_filter(list_transform({_html_blocks()},
  lambda b: {{'tag': lower(regexp_extract(b, '^([^' || chr(31) || ']*)' || chr(31), 1)),
    'text': trim(regexp_replace({_UNESCAPED}, '[ \\t\\r\\n]+', ' ', 'g'))}}), lambda b: b.text <> '') AS bs FROM pages),
u AS (SELECT file_path, unnest(bs) AS x, generate_subscripts(bs, 1) - 1 AS no FROM b)
SELECT file_path, no::INT AS block_no, CASE WHEN regexp_matches(x.tag, '^h[1-6]$') THEN 'heading'
  WHEN x.tag = 'li' THEN 'bullet' ELSE 'paragraph' END AS kind,
  CASE WHEN regexp_matches(x.tag, '^h[1-6]$') THEN substr(x.tag, 2, 1)::INT ELSE 0 END AS level, x.text AS text FROM u""",
    "load_documents": f"""SELECT file_path || '.TXT' AS file_path, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text,
  NULL::VARCHAR AS load_error FROM ({DOCS})
UNION ALL SELECT concat('item/', item_id, '.md'), concat('<h1>Item ', item_id, '</h1>', chr(10), '<p>',
  replace({_ESCAPED.format(x=_strip('text'))}, chr(10) || chr(10), '</p>' || chr(10) || '<p>'),
  '</p>', chr(10), '<ul>', chr(10), '<li>from the benchmark</li>', chr(10), '<li>one item</li>', chr(10), '</ul>'), NULL
  FROM benchmark
UNION ALL SELECT concat('part/', p_partkey, '.csv'),
  concat('name, kind, size', chr(10), p_name, ', ', p_type, ', ', p_brand, ', ', p_size), NULL FROM part
UNION ALL SELECT file_path, '', load_error FROM ({_MIXED_BAD})""",
    "quarantine": _MIXED_BAD,
    "embedding_dimension": """SELECT min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim
FROM embeddings""",
    "cosine_distance": f"""WITH {CENTROIDS} SELECT vec_id, label, round({EXACT.format(c='c')}, 6) AS distance
FROM embeddings JOIN cent ON label = query_id""",
    "topk_by_vector": f"""WITH {CENTROIDS}, mean AS (SELECT list(x ORDER BY i) AS c FROM
  (SELECT i, avg(x) AS x FROM parts GROUP BY 1)),
s AS (SELECT vec_id, label, {DIST.format(c='c')} AS distance FROM embeddings, mean)
SELECT vec_id, label, round(distance, 6) AS distance FROM s
QUALIFY row_number() OVER (ORDER BY distance, vec_id) <= 10""",
    "topk_batch": f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS c FROM embeddings),
s AS (SELECT query_id, vec_id, label, {DIST.format(c='c')} AS distance FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, label, round(distance, 6) AS distance FROM r WHERE rank <= 4""",
    "topk_blocks": f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS c FROM embeddings),
s AS (SELECT query_id, vec_id, label, {DIST.format(c='c')} AS distance FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, label, round(distance, 6) AS distance FROM r WHERE rank <= 4""",
    "approx_topk": _approx_query(),
    "metadata_filter_topk": f"""WITH {CENTROIDS},
s AS (SELECT query_id, vec_id, label, {DIST.format(c='c')} AS distance FROM embeddings, cent WHERE label = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, label, round(distance, 6) AS distance FROM r WHERE rank <= 4""",
    "fit_idf": f"""WITH {CHUNKS}, {IDF} SELECT bucket, round(idf, 9) AS idf,
(SELECT count(*) FROM chunks) AS n_chunks FROM idf""",
    "hashed_embedding": f"""WITH {CHUNKS}, {IDF}, {_features('cf', 'chunks', 'chunk_id')}
SELECT chunk_id, bucket, round(w, 6) AS weight FROM cf""",
    "topk_by_text": f"WITH {HITS} SELECT query_id, rank, chunk_id, file_path, distance FROM hits",
    "inverted_topk": f"WITH {HITS} SELECT query_id, rank, chunk_id, file_path, distance FROM hits",
    "context_assembly": f"WITH {FOUND} SELECT query_id, context, len(sources)::INT AS n_sources FROM found",
    "context_cut": f"""WITH {FOUND.replace('rank <= 4)', 'rank <= 8)')} SELECT query_id, length(context)::INT AS n_chars,
sha256(context) AS context_hash, len(sources)::INT AS n_sources FROM found""",
    "distinct_sources": f"""WITH {FOUND} SELECT query_id,
array_to_string(list_transform(sources, lambda s: '• ' || s), chr(10)) AS sources FROM found""",
    "build_prompt": f"""WITH {FOUND} SELECT query_id, concat({_q(GUIDE)}, chr(10), chr(10), 'Passages:', chr(10),
coalesce(context, ''), chr(10), chr(10), 'Question: ', text, chr(10), 'Reply: ') AS prompt
FROM asked LEFT JOIN found USING (query_id)""",
    "rag_batch": f"""WITH {FOUND},
joined AS (SELECT query_id, text AS question, coalesce(context, '') AS context, sources
  FROM asked LEFT JOIN found USING (query_id)),
{_best('query_id', 'question', 'context', 'joined')},
ans AS (SELECT j.*, CASE WHEN coalesce(score, 0) = 0 THEN '' ELSE sentence END AS answer,
  coalesce(score, 0) = 0 AS no_answer, coalesce(len(sources), 0) AS n_sources, NULL AS error
  FROM joined j LEFT JOIN best USING (query_id)),
st AS (SELECT *, {STATUS} AS status FROM (SELECT *, {_grounding('answer', 'context')} FROM ans))
SELECT query_id, status, CASE WHEN status = 'answered' THEN answer ELSE '' END AS answer,
  CASE status WHEN 'answered' THEN answer WHEN 'no_context' THEN {_q(NOTHING_FOUND)} ELSE {_q(NOT_ANSWERED)} END AS reply,
  CASE WHEN status = 'answered' THEN array_to_string(sources, '|') ELSE '' END AS sources FROM st""",
    "extractive_answer": f"""WITH {PAIRS}, {_best('conv_id, turn', 'question', 'answer', 'pairs')}
SELECT p.conv_id, p.turn, CASE WHEN coalesce(score, 0) = 0 THEN '' ELSE sentence END AS answer,
  coalesce(score, 0) = 0 AS no_answer FROM pairs p LEFT JOIN best b ON p.conv_id = b.conv_id AND p.turn = b.turn""",
    "grounding_check": f"""WITH {PAIRS}, g AS (SELECT *, {_grounding('answer', 'question')} FROM pairs)
SELECT conv_id, turn, hits, total, round({RATIO}, 6) AS ratio,
  {_strip('answer')} <> '' AND {RATIO} >= 0.55 AS grounded FROM g""",
    "normalize_tokens": f"""SELECT file_path, len({_tokens('text')})::INT AS n,
array_to_string({_tokens('text')}, ' ') AS tokens FROM ({DOCS})""",
    "parse_generated": f"WITH {GENERATED}, {_parsed('made', 'conv_id, turn')} SELECT * FROM parsed",
    "resolve_answer": f"""WITH {GENERATED}, {_parsed('made', 'conv_id, turn, role')},
j AS (SELECT p.*, coalesce(context, '') AS context, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS n_sources,
  CASE WHEN (conv_id + turn) % 11 = 7 THEN 'timeout' END AS error FROM parsed p LEFT JOIN ({SPOKEN}) s USING (conv_id)),
st AS (SELECT *, {STATUS} AS status FROM (SELECT *, {_grounding('answer', 'context')} FROM j))
SELECT conv_id, turn, status, CASE WHEN status = 'answered' THEN answer ELSE '' END AS answer,
  CASE status WHEN 'answered' THEN answer WHEN 'no_context' THEN {_q(NOTHING_FOUND)} ELSE {_q(NOT_ANSWERED)} END AS reply,
  CASE WHEN status = 'answered' THEN 1 ELSE 0 END AS n_sources FROM st""",
    "fragment_assembly": "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1",
    "resolve_streamed": f"""WITH about AS (SELECT conv_id AS request_id, max((role = 'system')::INT) AS system,
  string_agg(text, '' ORDER BY turn) FILTER (WHERE role <> 'system') AS context,
  coalesce(string_agg(text || ' ', '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS generated
  FROM conversations GROUP BY 1),
src AS (SELECT a.request_id, a.generated, 1 - a.system AS n_sources,
  CASE WHEN a.request_id % 7 = 5 THEN 'broken stream' END AS error, coalesce(c.context, '') AS context FROM about a
  LEFT JOIN about c ON c.request_id = a.request_id + CASE WHEN a.request_id % 3 = 0 THEN 1 ELSE 0 END),
{_parsed('src', 'request_id, generated AS raw, n_sources, error, context')},
st AS (SELECT *, {STATUS} AS status FROM (SELECT *, {_grounding('answer', 'context')} FROM parsed))
SELECT request_id, CASE WHEN status = 'no_context' THEN '' ELSE raw END AS raw,
  CASE status WHEN 'answered' THEN answer WHEN 'no_context' THEN {_q(NOTHING_FOUND)} WHEN 'error' THEN {_q(FAILED)}
    ELSE '' END AS final, status, CASE WHEN status = 'answered' THEN 1 ELSE 0 END AS n_sources FROM st""",
    "question_intake": f"""WITH typed AS (SELECT conv_id, turn, {_strip('text')} AS text FROM ({_TYPED})),
ended AS (SELECT *, max((lower(text) IN ('exit', 'quit'))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS over
  FROM typed)
SELECT conv_id, turn, text FROM ended WHERE over = 0 AND text <> ''""",
    "pair_turns": f"WITH {PAIRS} SELECT * FROM pairs",
    "render_history": f"""WITH {PAIRS} SELECT conv_id, turn, concat('User: ', question, chr(10), 'AI: ', answer, chr(10),
chr(10), repeat('-', 40), chr(10)) AS entry FROM pairs""",
    "history_sink": f"""WITH {PAIRS} SELECT strftime(DATE '2024-01-01' + turn::INT, '%Y-%m-%d') AS day, conv_id, turn,
concat('User: ', question, chr(10), 'AI: ', answer, chr(10), chr(10), repeat('-', 40), chr(10)) AS entry FROM pairs""",
    "ema_latency": f"SELECT user_id, count(*) AS n, round({_EMA}, 6) AS ema FROM events GROUP BY 1",
    "budget_controller": _BUDGET,
    "budget_controller_hot": _HOT,
    "budget_controller_stream": _BUDGET,
    "encode_with": f"""WITH {CHUNKS} SELECT chunk_id, length(text) AS chars,
length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, chr(10), '')) AS breaks
FROM chunks""",
    "generate_with": f"""WITH {PAIRS}, p AS (SELECT conv_id, turn, (conv_id + turn) % 5 = 0 AS fails,
  {len(GUIDE)} + 12 + length(answer) + 12 + length(question) + 8 AS n FROM pairs)
SELECT conv_id, turn, CASE WHEN fails THEN '' ELSE concat(n, ' characters') END AS answer, fails AS no_answer,
  CASE WHEN fails THEN 'no reply' END AS error FROM p""",
    "extract_with": f"""SELECT concat('doc/', doc_id, '.pdf') AS file_path, CASE WHEN doc_id % 10 = 3 THEN '' ELSE text END AS text,
CASE WHEN doc_id % 10 = 3 THEN 'corrupt_pdf' END AS load_error FROM documents""",
}
