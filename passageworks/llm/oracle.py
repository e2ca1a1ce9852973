"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from .chat import END, TURN, _alternatives


def _op1() -> str:
    """Digests of the turns, and the length of the text that the template must give them."""
    said = "</s>[INST] ok [/INST]"
    order = "ORDER BY turn, role, text"
    frame = len(TURN) + 1 + len(END) + 2
    controls = _alternatives()
    return f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
done AS (SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' {order}) AS roles,
  bool_and(role IN ('system', 'user', 'assistant')) AS usual, ((conv_id % 4) + 4) % 4 AS way,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({frame} + length(role) + length(regexp_replace(text, '(\\\\*{controls})', '\\\\\\1', 'g')))::BIGINT AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  CASE WHEN way = 0 AND roles = 'user,assistant' THEN 'prompt' WHEN way = 1 AND roles = 'user,assistant' THEN 'instruction'
    WHEN way < 2 AND roles = 'system,user,assistant' THEN 'instruction_system' WHEN way = 1 AND usual THEN 'shared'
    WHEN way = 2 THEN 'nested' WHEN way = 3 AND usual THEN 'dialog' ELSE 'messages' END AS layout FROM done"""


def _whole(scale: int) -> str:
    """Vectors that take part, in whole numbers."""
    fine = "embedding IS NOT NULL AND len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0"
    return f"SELECT DISTINCT vec_id, label, [floor({scale} * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings WHERE {fine}"


OP11 = f"""WITH v AS (SELECT DISTINCT vec_id, x FROM ({_whole(1024)})),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

OP13 = f"""WITH w AS ({_whole(256)}),
v AS (SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM w WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND (c.vec_id IS DISTINCT FROM a.vec_id)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id NULLS LAST)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

ORACLE = {"op1_chat_format": _op1(), "op11_exact_topk": OP11, "op13_hard_negatives": OP13}
