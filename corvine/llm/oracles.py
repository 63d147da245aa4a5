"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from corvine.llm.mixing import MixPlan
from corvine.llm.url_filters import PATTERNS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op4() -> str:
    def case(verdict: str) -> str:
        return " ".join(f"WHEN regexp_matches(low, {_q(p.regex)}) THEN {_q(p.name)}" for p in PATTERNS if p.verdict == verdict)

    allowed = ", ".join(_q(p.name) for p in PATTERNS if p.verdict == "allow")
    fits = lambda rule: f"(host = {_q(rule.partition('/')[0])} OR ends_with(host, {_q('.' + rule.partition('/')[0])})) AND starts_with(path, {_q('/' + rule.partition('/')[2])})"
    rules = sorted((("net/"), ("example.net/en/"), ("example.com/de/"), ("org/fr/")), key=lambda r: -len(r))
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substring(url, position('://' IN url) + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT *, CASE {' '.join(f"WHEN {fits(r)} THEN {_q(r)}" for r in rules)} END AS rule FROM parts),
named AS (
  SELECT *, CASE WHEN rule IS NULL THEN CASE {case('allow')} {case('block')} END END AS pattern FROM judged)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL OR pattern IS NULL OR pattern IN ({allowed}) THEN 'allow' ELSE 'block' END AS verdict,
       pattern FROM named"""


_OP10 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\[\\*(?:SYS\]|/SYS\]|INST\]|/INST\]|TURN |/TURN\])|<\\*(?:s>|/s>)'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(hex(role)) END AS n,
    row_number() OVER w - 1 AS i, lag(role, 1, '') OVER w AS prev
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
ok AS (
  SELECT *, (prev = '' AND i = 0 AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user') OR (prev = 'user' AND role = 'assistant')
    OR (prev = 'assistant' AND role = 'user') AS fine FROM marked)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, bool_and(fine) AND arg_max(role, i) = 'assistant' AS valid, min(i) FILTER (NOT fine)::BIGINT AS first_bad_turn
FROM ok GROUP BY conv_id"""

_OP5 = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sized AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM ok),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sized a JOIN sized b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id)::BIGINT AS n_links,
  least(e.vec_id, coalesce((SELECT min(r.v) FROM reach r WHERE r.u = e.vec_id), e.vec_id))::BIGINT AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(r.v) FROM reach r WHERE r.u = e.vec_id), e.vec_id)) AS kept
FROM embeddings e"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP2 = rf"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])))) END AS s FROM cut),
classes AS (SELECT s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
places AS (SELECT rep, n, unnest(s) AS g FROM classes),
linked AS (
  SELECT a.rep AS u, b.rep AS v FROM places a JOIN places b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(least(c.rep, m.v), c.rep, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN least m ON m.u = c.rep"""


def mixing_sql(docs: str = "documents", columns: str = "doc_id, lang, source") -> str:
    """The mixing operator without its slices: each leaf's seeded order is summed as a whole."""
    plan = MixPlan()
    names = ["domain", "language", "origin"]

    def choose(col: str, of: dict, other) -> str:
        return f"CASE {' '.join(f'WHEN {col} = {_q(k)} THEN {v}' for k, v in of.items())} ELSE {other} END"

    domain = f"CASE {' '.join(f'WHEN source IN ({', '.join(map(_q, v))}) THEN {_q(k)}' for k, v in plan.domains.items())} ELSE 'other' END"
    sql = f"""
WITH keyed AS (
  SELECT *, {domain} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS tokens FROM {docs}),
leaves AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens, sum(tokens) * {float(plan.max_epochs)}::DOUBLE AS capacity FROM keyed GROUP BY ALL)"""
    for level, child in enumerate(names):
        above = names[:level]
        cols, part = ", ".join([*above, child]), f"PARTITION BY {', '.join(above)}" if above else ""
        budget = f"JOIN fill{level - 1} USING ({', '.join(above)})" if above else f"CROSS JOIN (SELECT sum(capacity) * {plan.share / plan.max_epochs!r}::DOUBLE AS budget FROM leaves)"
        sql += f""",
nodes{level} AS (
  SELECT n.*, budget, {choose(child, plan.weights[level], plan.other[level])}::DOUBLE AS w, capacity / ({choose(child, plan.weights[level], plan.other[level])})::DOUBLE AS ratio
  FROM (SELECT {cols}, sum(capacity)::DOUBLE AS capacity FROM leaves GROUP BY ALL) n {budget}),
level{level} AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER b, 0)) / (sum(w) OVER ({part}) - coalesce(sum(w) OVER b, 0)) AS level
  FROM nodes{level} WINDOW b AS ({part} ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fill{level} AS (
  SELECT {cols}, CASE WHEN ratio <= level THEN capacity ELSE greatest(w * max(level) FILTER (ratio > level) OVER ({part}), 0) END AS budget FROM level{level})"""
    return sql + f""",
taken AS (
  SELECT domain, language, origin, tokens, CASE WHEN tokens > 0 THEN least(floor(floor(budget + 1e-6) / tokens), {plan.max_epochs}) ELSE 0 END::INT AS epochs,
    floor(budget + 1e-6)::BIGINT AS whole FROM leaves JOIN fill2 USING (domain, language, origin)),
placed AS (
  SELECT k.*, t.epochs, t.whole - t.epochs * t.tokens AS rest, md5('{plan.seed}:' || (t.epochs + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM keyed k JOIN taken t USING (domain, language, origin)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY place) AS cum FROM placed)
SELECT {columns}, (epochs + CASE WHEN epochs < {plan.max_epochs} AND cum <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM summed
WHERE epochs + CASE WHEN epochs < {plan.max_epochs} AND cum <= rest THEN 1 ELSE 0 END > 0"""


_OP11 = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (
  SELECT k, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda h, i: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT k FROM named)),
marred AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM named JOIN summed USING (k) WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM marred),
rows_ AS MATERIALIZED (
  SELECT conv_id, pos, turn, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM ordered),
grammar(state, initial, role, next) AS (VALUES (0, 's', '', 1), (0, 'u', 'user:', 2), (1, 'u', 'user:', 2), (2, 'a', 'assistant:', 3), (3, 'u', 'user:', 2)),
states(state) AS (VALUES (0), (1), (2), (3)),
inserts AS (
  SELECT state, '' AS edits, []::VARCHAR[] AS lines, state AS next FROM states
  UNION ALL SELECT state, 'I', [role], next FROM grammar WHERE role <> ''
  UNION ALL SELECT a.state, 'II', [a.role, b.role], b.next FROM grammar a JOIN grammar b ON a.next = b.state WHERE a.role <> '' AND b.role <> ''),
moves AS MATERIALIZED (
  SELECT state, edits || 'D' AS edits, lines, NULL::VARCHAR AS initial, NULL::VARCHAR AS role, next, 3 * length(edits) + 4 AS cost FROM inserts
  UNION ALL SELECT i.state, i.edits || 'K', i.lines, g.initial, NULL, g.next, 3 * length(i.edits) FROM inserts i JOIN grammar g ON g.state = i.next
  UNION ALL SELECT i.state, i.edits || 'R', i.lines, NULL, g.role, g.next, 3 * length(i.edits) + 3 FROM inserts i JOIN grammar g ON g.state = i.next WHERE g.role <> ''),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM rows_
  UNION ALL
  SELECT d.conv_id, d.pos + 1, m.next, min({'cost': d.best.cost + m.cost + CASE WHEN r.fault = 'truncated' AND NOT ends_with(m.edits, 'D') THEN 3 ELSE 0 END, 'audit': d.best.audit || m.edits,
    'lines': d.best.lines || m.lines || CASE WHEN ends_with(m.edits, 'D') THEN [] WHEN m.role IS NULL THEN [r.role || ':' || r.text] ELSE [m.role || r.text] END})
  FROM dp d JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.pos
    JOIN moves m ON m.state = d.state AND (m.initial IS NULL OR m.initial = r.initial) AND (ends_with(m.edits, 'D') OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY d.conv_id, d.pos, m.next),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
ended AS (
  SELECT c.conv_id, min({'cost': d.best.cost + 3 * length(i.edits), 'audit': d.best.audit || i.edits, 'lines': d.best.lines || i.lines}) AS best
  FROM counted c JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.pos = c.n JOIN inserts i ON i.state = d.state WHERE i.next = 3 OR (i.next = 0 AND i.edits = '')
  GROUP BY c.conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES = {"op2_jaccard_join": _OP2, "op4_url_filters": _op4(), "op3_mixing": mixing_sql(), "op5_embedding_dedup": _OP5, "op10_chat_formatting": _OP10, "op11_conversation_repair": _OP11}
