"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from corvine.functions.text import JUDGE_STOPWORDS, QUESTION_STOPWORDS, SEARCH_STOPWORDS
from corvine.operators.answer import ABSTAIN, EMPTY, NO_CITATIONS, NO_EVIDENCE, REFUSAL
from corvine.operators.chunking import VERSION  # noqa: F401
from corvine.plans import checks


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


TERM = "[a-z0-9]+(?:[-_.][a-z0-9]+)*"


def terms(c: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '{TERM}'), lambda x: x NOT IN ({_list(SEARCH_STOPWORDS)}))"


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, source, lang, source || '/' || doc_id AS source_path, lang AS title FROM documents)"
ASKED = "questions AS (SELECT item_id AS query_id, trim(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(13)) AS text FROM benchmark)"
TOK = f"tok AS (SELECT doc_id, {terms('text')} AS terms FROM docs)"
INDEX = "(('0x' || substr(sha1(term), 1, 8))::BIGINT & 2147483647)"
WEIGHTS = f"""
corpus AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE dl END)) AS w FROM tf JOIN df USING (term) CROSS JOIN corpus)"""
SPARSE = f"""
asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({terms('text')}) AS term FROM questions)),
sparse_scores AS (SELECT query_id, doc_id, sum(w ORDER BY {INDEX}) AS score FROM asked JOIN weights USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sparse_scores WHERE score > 0 QUALIFY rank <= 40)"""


def hashed(c: str) -> str:
    digits = " || ".join(f"sha256('\\x00\\x00\\x00\\x0{i}'::BLOB || encode({c}))" for i in range(4))
    return f"list_transform(range(32), lambda i: ('0x' || substr({digits}, (i * 8 + 1)::INT, 8))::BIGINT / 2147483648.0::DOUBLE - 1)"


def vectors(name: str, key: str, source: str) -> str:
    return f"{name} AS (SELECT {key}, list_transform(v, lambda x: x / norm) AS v FROM (SELECT {key}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (SELECT {key}, {hashed('text')} AS v FROM {source})))"


DENSE = f"""
{vectors('dv', 'doc_id', 'docs')}, {vectors('qv', 'query_id', 'questions')},
dense AS (SELECT query_id, doc_id, round(list_dot_product(q.v, d.v), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, doc_id) AS rank FROM qv q CROSS JOIN dv d QUALIFY rank <= 40)"""


def fused(dense: float = 1.0, sparse: float = 1.0) -> str:
    return f"""
fused AS (
  SELECT query_id, doc_id, sum(part ORDER BY branch) AS score, max(rank) FILTER (branch = 'dense') AS dense_rank, max(rank) FILTER (branch = 'sparse') AS sparse_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY sum(part ORDER BY branch) DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, rank, 'dense' AS branch, {dense}::DOUBLE / (60 + rank) AS part FROM dense
        UNION ALL SELECT query_id, doc_id, rank, 'sparse', {sparse}::DOUBLE / (60 + rank) FROM sparse) GROUP BY query_id, doc_id)"""


BOTH = f"WITH {DOCS}, {ASKED}, {TOK}, {WEIGHTS}, {SPARSE}, {DENSE}, "
ONE = f"WITH {DOCS}, {ASKED}, {TOK}, {WEIGHTS}, {SPARSE}, one AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score, rank FROM sparse)"
CASES = """cases AS (
  SELECT query_id AS id, q.text, coalesce(list_sort(list(DISTINCT doc_id) FILTER (doc_id IS NOT NULL)), []) AS expected
  FROM (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark) q LEFT JOIN (SELECT doc_id, coalesce(text, '') AS body FROM documents) d ON q.text <> '' AND contains(body, q.text) GROUP BY ALL),
labelled AS (SELECT *, CASE len(expected) WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'single' ELSE 'multi' END AS category FROM cases)"""


def tier1(hits: str, k: int, by: str = "") -> str:
    """Case rows from a relation of query_id, doc_id, rank (and a column ``by``)."""
    group = f"{by}, " if by else ""
    return f"""
lists AS (SELECT {group}query_id AS id, list(doc_id ORDER BY rank) AS got FROM {hits} WHERE rank <= {k} GROUP BY ALL),
rows_ AS (
  SELECT {group.replace(by, 'g.' + by) if by else ''}c.id, category, expected, len(expected) > 0 AS scored, coalesce(got, []) AS got FROM labelled c {f'CROSS JOIN (SELECT DISTINCT {by} FROM {hits}) g' if by else ''} LEFT JOIN lists l ON c.id = l.id {f'AND l.{by} = g.{by}' if by else ''}),
scores AS (
  SELECT *, list_filter(range(1, len(got) + 1), lambda i: list_contains(expected, got[i])) AS found FROM rows_),
tier1 AS (
  SELECT {group}id, category, scored, scored AND len(found) > 0 AS hit, CASE WHEN scored THEN list_min(found) END AS hit_rank,
    CASE WHEN scored THEN len(found)::DOUBLE / len(expected) ELSE 0 END AS recall, CASE WHEN scored AND len(found) > 0 THEN 1.0::DOUBLE / list_min(found) ELSE 0 END AS reciprocal_rank,
    CASE WHEN scored AND len(found) > 0 THEN list_sum(list_transform(found, lambda i: 1.0::DOUBLE / log2(i + 1))) / list_sum(list_transform(range(1, len(expected) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END AS ndcg FROM scores)"""


# what a sentence is, without lookbehind: a mark behind each end, then a split at it
ENDS = r"regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g')"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def first_sentence(c: str) -> str:
    return f"trim(string_split({ENDS.format(FLAT.format(c))}, chr(1))[1])"


def cite(s: str, marker: str) -> str:
    return rf"CASE WHEN regexp_matches({s}, '[.!?]$') THEN rtrim(regexp_replace({s}, '[.!?]$', '')) || ' [' || {marker} || ']' || right({s}, 1) ELSE {s} || ' [' || {marker} || '].' END"


def asked_words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({_list(QUESTION_STOPWORDS)})))"


def judged_words(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(regexp_replace(lower({c}), '\[\d+\]', ' ', 'g'), '[a-z0-9_]+'), lambda x: x NOT IN ({_list(JUDGE_STOPWORDS)})))"


def share(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}), 0)"


def render(marker: str) -> str:
    return f"'[' || {marker} || '] source=' || source_path || ' | title=' || title || chr(10) || text"


def blocks(hits: str, most: int, budget: int) -> str:
    """Greedy selection with skips, as a recursion over ranks."""
    return f"""
hits AS (SELECT h.query_id, h.rank, h.score, d.* FROM {hits} h JOIN docs d USING (doc_id) WHERE h.rank <= 12),
fold(query_id, rank, taken, used, took) AS (
  SELECT query_id, 0, 0, 0, false FROM (SELECT DISTINCT query_id FROM hits)
  UNION ALL
  SELECT f.query_id, f.rank + 1, f.taken + fits::INT, f.used + CASE WHEN fits THEN cost ELSE 0 END, fits
  FROM (SELECT f.*, length({render('f.taken + 1')}) // 4 + 1 AS cost, f.taken < {most} AND (f.taken = 0 OR f.used + length({render('f.taken + 1')}) // 4 + 1 <= {budget}) AS fits
        FROM fold f JOIN hits h ON h.query_id = f.query_id AND h.rank = f.rank + 1) f),
picked AS (SELECT f.query_id, f.taken AS marker, h.* EXCLUDE (query_id) FROM fold f JOIN hits h ON h.query_id = f.query_id AND h.rank = f.rank WHERE took),
sums AS (SELECT query_id, max(used) AS tokens, max(rank) - max(taken) AS dropped FROM fold GROUP BY query_id)"""


def answers(hits: str, most: int = 8) -> str:
    return f"""{blocks(hits, most, 6000)},
said AS (
  SELECT query_id, count(*) FILTER (trim(text, chr(32)||chr(9)||chr(10)||chr(13)) <> '') AS n, {asked_words("string_agg(text, ' ' ORDER BY marker)")} AS known,
    list({cite('s', 'marker')} ORDER BY marker) FILTER (s <> '' AND i <= 2) AS parts, list(marker ORDER BY marker) FILTER (s <> '' AND i <= 2) AS cited, count(*) AS n_blocks
  FROM (SELECT *, {first_sentence('text')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY (trim(text, chr(32)||chr(9)||chr(10)||chr(13)) = ''), marker) AS i FROM picked) GROUP BY query_id),
raw AS (
  SELECT q.query_id, q.text AS question, s.*  EXCLUDE (query_id), s.query_id IS NOT NULL AS has,
    s.query_id IS NULL OR n = 0 OR (len({asked_words('q.text')}) > 0 AND NOT list_has_any({asked_words('q.text')}, known)) OR coalesce(len(parts), 0) = 0 AS abstains
  FROM questions q LEFT JOIN said s ON q.query_id = s.query_id),
answered AS (
  SELECT *, CASE WHEN NOT has THEN '{NO_EVIDENCE}' WHEN abstains THEN '{ABSTAIN_REASON}' END AS reason,
    CASE WHEN has AND NOT abstains THEN regexp_replace(regexp_replace(array_to_string(parts, ' '), '\\s+([.,;:!?])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g') END AS answer FROM raw)"""


ABSTAIN_REASON = "model_abstained"

BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)"
FINAL = f"CASE WHEN reason IS NULL THEN answer ELSE '{REFUSAL}' END"
SAID = "said_ AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
# the split that keeps a trailing marker with its sentence: a mark behind each end that no "[digit" follows
CLAIMS = r"list_filter(list_transform(string_split(regexp_replace(trim(text, BLANKS), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, BLANKS)), lambda s: length(s) >= 24 AND NOT regexp_matches(s, '\[\d+\]'))".replace("BLANKS", BLANKS)
VERSIONS = "old AS (SELECT doc_id AS point_id, source, sha256(coalesce(text, '')) AS content FROM documents), new AS (SELECT 2 * point_id AS point_id, source, content || '-new' AS content FROM old)"
PAIRS = "pairs AS (SELECT doc_id, lang, quality = 1 AS a, toxic = 0 AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
GOLDEN = f"""golden AS (
  SELECT 'q' || (item_id - CASE WHEN item_id % 9 = 8 THEN 1 ELSE 0 END) AS id, CASE WHEN item_id % 10 = 9 THEN 'same question' ELSE text END AS question,
    CASE WHEN item_id % 6 = 5 THEN [] ELSE ['src' || (item_id % 25) || '/' || item_id] END AS paths, [{_list(checks.SLICES)}][item_id % 4 + 1] AS category,
    CASE WHEN item_id % 4 = 1 THEN false WHEN item_id % 8 = 0 THEN true END AS answerable, item_id % 8 = 2 AS filtered,
    CASE WHEN item_id % 8 = 3 THEN substr(text, 1, 3) ELSE '' END AS token FROM benchmark)"""
KNN = "knn AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS query_label, e.label, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM knn)"
CONFIGS = f"""{fused()},
hyb AS (SELECT * FROM fused WHERE rank <= 40),
covered AS (SELECT h.query_id, doc_id, h.rank AS before, len(list_intersect(list_distinct({terms('q.text')}), {terms('d.text')}))::DOUBLE / nullif(len(list_distinct({terms('q.text')})), 0) AS cover FROM hyb h JOIN questions q USING (query_id) JOIN docs d USING (doc_id)),
rer AS (SELECT query_id, doc_id, before, coalesce(cover, 0) AS cover, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(cover, 0) DESC, before) AS rank FROM covered),
every AS (SELECT 'sparse' AS config, query_id, doc_id, rank FROM sparse UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense
          UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused WHERE rank <= 60 UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, rank FROM rer)"""
USD = "round(({e} * 0.02 + {i} * 0.15 + {o} * 0.60) / 1000000, {d})"


def _uuid5(name: str) -> str:
    h = f"sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode({name}))"
    variant = f"lower(to_hex((('0x' || substr({h}, 17, 2))::INT & 63) | 128))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"

TIER2 = ONE.replace("WITH ", "WITH RECURSIVE ", 1) + "," + answers("one") + f""", {CASES},
cit AS (
  SELECT a.query_id, count(*) AS n, count(*) FILTER (list_contains(l.expected, p.doc_id)) AS good, list_distinct(flatten(list({judged_words('p.text')}))) AS seen
  FROM answered a JOIN picked p ON p.query_id = a.query_id AND list_contains(a.cited, p.marker) JOIN labelled l ON l.id = a.query_id WHERE a.reason IS NULL GROUP BY a.query_id),
tier2 AS (
  SELECT l.id, CASE WHEN len(expected) > 0 THEN round(good::DOUBLE / cit.n, 4) END AS citation_precision, coalesce(cit.n, 0) AS citations, reason IS NOT NULL AS refused, len(expected) = 0 AS unanswerable,
    CASE WHEN reason IS NULL THEN round({share(judged_words('a.answer'), 'seen')}, 4) END AS faithfulness, CASE WHEN reason IS NULL THEN round({share(judged_words('l.text'), judged_words('a.answer'))}, 4) END AS relevance
  FROM labelled l JOIN answered a ON a.query_id = l.id LEFT JOIN cit ON cit.query_id = l.id)"""


ORACLES: dict[str, str] = {
    "tier2_per_case": TIER2 + " SELECT id, citation_precision, citations::INT AS citations, refused, refused = unanswerable AS refusal_correct, faithfulness, relevance FROM tier2",
    "tier2_aggregates": TIER2 + """ SELECT count(*)::BIGINT AS cases, count(*) FILTER (unanswerable)::BIGINT AS unanswerable_cases, count(*) FILTER (refused)::BIGINT AS refusals, round(coalesce(avg(citation_precision), 0), 4) AS citation_precision,
  0.0::DOUBLE AS invalid_marker_rate, round(avg((refused = unanswerable)::INT), 4) AS refusal_accuracy, round(avg(faithfulness), 4) AS faithfulness, round(avg(relevance), 4) AS relevance FROM tier2""",
    "tokenize_terms": f"WITH {DOCS}, {TOK} SELECT doc_id, len(terms)::INT AS n_terms, len(list_distinct(terms))::INT AS n_distinct, sha256(array_to_string(terms, ' ')) AS terms_sha256 FROM tok",
    "term_hash": f"WITH {ASKED} SELECT DISTINCT term, {INDEX}::INT AS term_idx FROM (SELECT unnest({terms('text')}) AS term FROM questions)",
    "posting_search_topk": f"WITH {DOCS}, {ASKED}, {TOK}, {WEIGHTS}, {SPARSE} SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 10",
    "posting_statistics": f"WITH {DOCS}, {TOK} SELECT term, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM tok) GROUP BY term UNION ALL SELECT NULL, count(*)::BIGINT FROM tok",
    "bm25_corpus_stats": f"WITH {DOCS}, {TOK} SELECT count(*)::BIGINT AS document_count, round(sum(len(terms)) / count(*), 6) AS average_length, (SELECT count(DISTINCT term) FROM (SELECT unnest(terms) AS term FROM tok))::BIGINT AS vocabulary_size FROM tok",
    "bm25_document_weights": f"WITH {DOCS}, {TOK}, {WEIGHTS} SELECT doc_id, term, round(w, 6) AS weight FROM weights",
    "sparse_vectors": f"WITH docs AS (SELECT item_id AS doc_id, text FROM benchmark), {TOK}, {WEIGHTS} SELECT doc_id AS item_id, list({INDEX}::INT ORDER BY {INDEX}) AS indices, list(round(w, 6) ORDER BY {INDEX}) AS weights FROM weights GROUP BY doc_id",
    "sparse_search_topk": f"WITH {DOCS}, {ASKED}, {TOK}, {WEIGHTS}, {SPARSE} SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 10",
    "fake_embedding_vectors": f"WITH {DOCS}, {vectors('dv', 'doc_id', 'docs')} SELECT doc_id, dim::INT AS dim, round(v[dim + 1], 6) AS x FROM (SELECT doc_id, v, unnest(range(32)) AS dim FROM dv)",
    "dense_knn_cosine": f"WITH {KNN} SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "dense_knn_label_recall": f"WITH {KNN} SELECT query_label, count(*)::BIGINT AS neighbours, round(avg((label = query_label)::INT), 6) AS label_share FROM ranked WHERE rank <= 11 AND query_id <> vec_id GROUP BY query_label",
    "hybrid_rrf_fusion": f"{BOTH}{fused()} SELECT query_id, doc_id, rank::INT AS rank, round(score, 9) AS score, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank FROM fused WHERE rank <= 12",
    "hybrid_zero_weight_branch": f"{BOTH}{fused(dense=0.0)} SELECT query_id, doc_id, rank::INT AS rank, round(score, 9) AS score, dense_rank::INT AS dense_rank FROM fused WHERE rank <= 12",
    "hybrid_filtered": (BOTH + fused() + " SELECT query_id, doc_id, rank::INT AS rank, round(score, 9) AS score FROM fused WHERE rank <= 12")
        .replace("JOIN weights USING (term) GROUP BY", "JOIN weights USING (term) WHERE doc_id IN (SELECT doc_id FROM docs WHERE source IN ('src1', 'src2') AND (lang IN ('en', 'fr') OR source IN ('en', 'fr'))) GROUP BY")
        .replace("FROM qv q CROSS JOIN dv d QUALIFY", "FROM qv q CROSS JOIN dv d WHERE doc_id IN (SELECT doc_id FROM docs WHERE source IN ('src1', 'src2') AND (lang IN ('en', 'fr') OR source IN ('en', 'fr'))) QUALIFY"),
    "score_threshold_dropped": f"{BOTH}{fused()} SELECT query_id, CASE WHEN count(*) FILTER (score >= 0.0125) > 60 THEN 0 ELSE count(*) FILTER (score < 0.0125) END::INT AS dropped, least(count(*) FILTER (score >= 0.0125), 60)::BIGINT AS kept FROM fused GROUP BY query_id",
    "branch_contribution": f"{BOTH}{fused()} SELECT CASE WHEN dense_rank IS NULL THEN 'sparse_only' WHEN sparse_rank IS NULL THEN 'dense_only' ELSE 'both' END AS branch, count(*)::BIGINT AS hits, round(avg(rank), 6) AS mean_rank FROM fused WHERE rank <= 12 GROUP BY 1",
    "rerank_term_coverage": f"{BOTH}{CONFIGS} SELECT query_id, doc_id, rank::INT AS rank, before::INT AS pre_rerank_rank, round(cover, 6) AS rerank_score FROM rer WHERE rank <= 6",
    "context_budget_blocks": ONE.replace("WITH ", "WITH RECURSIVE ", 1) + "," + blocks("one", 8, 1500) + " SELECT query_id, dropped::INT AS dropped, tokens::INT AS tokens, marker::INT AS marker, doc_id, p.rank::INT AS rank FROM picked p JOIN sums USING (query_id)",
    "prompt_render": ONE.replace("WITH ", "WITH RECURSIVE ", 1) + "," + blocks("one", 8, 6000) + f""",
prompts AS (SELECT q.query_id, 'Context blocks:' || chr(10) || chr(10) || coalesce(string_agg({render('marker')}, chr(10) || chr(10) ORDER BY marker), '(no context blocks were retrieved)') || chr(10) || chr(10) || 'Question: ' || q.text AS p
  FROM questions q LEFT JOIN (SELECT * RENAME (text AS body) FROM picked) p ON p.query_id = q.query_id GROUP BY q.query_id, q.text)
SELECT query_id, length(p)::INT AS prompt_chars, sha256(p) AS prompt_sha256 FROM prompts""".replace("|| chr(10) || text,", "|| chr(10) || body,"),
    "extractive_answer": ONE.replace("WITH ", "WITH RECURSIVE ", 1) + "," + answers("one") + f" SELECT query_id, {FINAL} AS answer, reason IS NOT NULL AS refused, CASE WHEN reason IS NULL THEN n_blocks ELSE 0 END::INT AS hits_used FROM answered",
    "refusal_reasons": f"WITH RECURSIVE {DOCS}, {ASKED}, {DENSE}, near AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dense JOIN docs USING (doc_id) WHERE source IN ('src0', 'src1') AND rank <= 12)," + answers("near", 2) + " SELECT coalesce(reason, 'answered') AS reason, count(*)::BIGINT AS questions FROM answered GROUP BY 1",
    "citation_markers": r"""
WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS text, (turn % 5)::INT AS m FROM conversations WHERE role = 'assistant'),
found AS (SELECT *, list_filter([m, 2, 9, 1], lambda x: x BETWEEN 1 AND 3) AS good, list_filter([m, 2, 9, 1], lambda x: x NOT BETWEEN 1 AND 3) AS bad FROM said),
once AS (SELECT *, CASE WHEN m IN (1, 2) THEN list_filter([m, 3 - m], lambda x: x BETWEEN 1 AND 3) WHEN m = 3 THEN [3, 2, 1] ELSE [2, 1] END AS c, CASE WHEN m BETWEEN 1 AND 3 THEN [9] ELSE [m, 9] END AS i FROM found)
SELECT conv_id, turn, array_to_string(c, ',') AS cited, array_to_string(i, ',') AS invalid,
  sha256(trim(regexp_replace(regexp_replace(text || ' ' || CASE WHEN m BETWEEN 1 AND 3 THEN '[' || m || ']' ELSE '' END || '[2] and [1] .', '\s+([.,;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), chr(32)||chr(9)||chr(10)||chr(13))) AS answer_sha256 FROM once""",
    "uncited_sentences": f"WITH {SAID} SELECT conv_id, turn, len({CLAIMS})::INT AS n, sha256(array_to_string({CLAIMS}, '|')) AS claims_sha256 FROM said_",
    "judge_overlap": f"WITH {SAID}, both_ AS (SELECT a.conv_id, a.turn, {judged_words('a.text')} AS said, {judged_words('q.text')} AS asked FROM said_ a JOIN said_ q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant') SELECT conv_id, turn, round({share('said', 'asked')}, 4) AS faithfulness, round({share('asked', 'said')}, 4) AS relevance FROM both_",
    "judge_reply_scores": "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN round(least(1, greatest(0, round(value, 3))), 4) END AS faithfulness, CASE WHEN event_id % 11 <> 0 AND event_id % 3 <> 0 THEN round(least(1, greatest(0, event_id % 7 / 4.0::DOUBLE - 0.5)), 4) END AS relevance FROM events",
    "golden_labels": f"WITH {CASES} SELECT id, category, len(expected)::INT AS n_expected, array_to_string(expected, ',') AS expected FROM labelled",
    "case_predicates": f"WITH {CASES} SELECT id, len(expected) > 0 AS scorable, CASE WHEN id % 3 = 0 THEN id % 2 <> 0 ELSE len(expected) = 0 END AS unanswerable FROM labelled",
    "tier1_per_case": f"{ONE}, {CASES}, {tier1('one', 5)} SELECT id, scored, hit, hit_rank::INT AS hit_rank, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM tier1",
    "tier1_by_category": f"{ONE}, {CASES}, {tier1('one', 5)} SELECT grouping(category)::INT AS overall, coalesce(category, 'all') AS category, count(*)::BIGINT AS cases, round(avg(hit::INT), 4) AS hit_at_k, round(avg(recall), 4) AS recall_at_k FROM tier1 WHERE scored GROUP BY GROUPING SETS ((), (category))",
    "hit_at_several_k": f"{ONE}, {CASES}, {tier1('one', 10)} SELECT " + ", ".join(f"round(avg((coalesce(hit_rank, 99) <= {k})::INT), 6) AS hit_at_{k}" for k in (1, 3, 5, 10)) + " FROM tier1 WHERE scored",
    "ablation_modes": f"{BOTH}{CONFIGS}, {CASES}, {tier1('every', 5, 'config')} SELECT config, count(*)::BIGINT AS cases, count(*) FILTER (scored)::BIGINT AS scored_cases, " + ", ".join(f"round(coalesce(avg({c}) FILTER (scored), 0), 4) AS {n}" for c, n in (("hit::INT", "hit_at_k"), ("recall", "recall_at_k"), ("reciprocal_rank", "mrr"), ("ndcg", "ndcg_at_k"))) + " FROM tier1 GROUP BY config",
    "paired_delta_mcnemar": f"""
WITH RECURSIVE {PAIRS}, p AS (SELECT lang, count(*) AS n, avg(a::INT - b::INT) AS delta, count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM pairs GROUP BY lang),
terms_(lang, i, term, total) AS (SELECT lang, 0, pow(0.5::DOUBLE, x + y), pow(0.5::DOUBLE, x + y) FROM p UNION ALL SELECT t.lang, i + 1, term * (x + y - i) / (i + 1), total + term * (x + y - i) / (i + 1) FROM terms_ t JOIN p ON t.lang = p.lang WHERE i < least(x, y))
SELECT p.lang, n::BIGINT AS n, round(delta, 6) AS delta, x::INT AS a_only, y::INT AS b_only, round(CASE WHEN x + y = 0 THEN 1 ELSE least(1, 2 * (SELECT max(total) FROM terms_ t WHERE t.lang = p.lang)) END, 9) AS p_exact FROM p""",
    "reportability": "WITH e AS (SELECT user_id, count(*) AS n, min(value) - user_id % 3 * 10 AS low, max(value) AS high FROM events GROUP BY user_id), r AS (SELECT *, CASE WHEN n < 30 THEN 'n < 30' WHEN low <= 0 AND high >= 0 THEN 'ci95 includes zero' ELSE '' END AS reason FROM e) SELECT user_id, n::BIGINT AS n, reason = '' AS reportable, reason FROM r",
    "doc_chunk_point_ids": f"WITH {DOCS}, c AS (SELECT source_path, substr(sha256(source_path), 1, 16) AS doc_id, sha256(text) AS content_sha256 FROM docs) SELECT source_path, doc_id, doc_id || ':0000' AS chunk_id, content_sha256, {_uuid5(chr(115) + 'ource_path' + ' || ' + chr(39) + '::0::' + chr(39) + ' || content_sha256')} AS point_id FROM c",
    "embed_text": f"WITH {DOCS} SELECT doc_id, sha256(title || ' > ' || source || chr(10) || chr(10) || text) AS embed_sha256 FROM docs",
    "token_estimates": f"WITH {DOCS} SELECT doc_id, ((length(text) + 3) // 4)::INT AS chunk_tokens, (length(text) // 4 + 1)::INT AS prompt_tokens FROM docs",
    "path_functions": f"WITH {DOCS} SELECT doc_id, source_path AS path, source FROM docs",
    "headings_and_tags": r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<h1[^>]*>', chr(10) || '# ', 'g'), '</h1>', ' #' || chr(10), 'g') AS md, regexp_replace(coalesce(url, ''), '[/.?=&#:-]', ', ', 'g') AS t FROM pages),
h AS (SELECT page_id, list_filter(list_transform(list_filter(string_split_regex(md, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: starts_with(x, '# ')), lambda x: trim(regexp_replace(trim(substr(x, 3), chr(32)||chr(9)), '#+$', ''), chr(32)||chr(9))), lambda x: x <> '') AS heads,
  list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM p)
SELECT page_id, heads[1] AS h1, array_to_string(tags, '|') AS tags FROM h""",
    "comments_stripped": "WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS x FROM pages) SELECT page_id, length(x)::INT AS n_chars, sha256(x) AS sha256 FROM p",
    "stream_pieces": f"WITH {SAID} SELECT conv_id, turn, (len(string_split(text, ' ')) - CASE WHEN text = '' OR ends_with(text, ' ') THEN 1 ELSE 0 END)::INT AS pieces, sha256(text) AS text_sha256 FROM said_",
    "first_cited_sentences": f"WITH {DOCS}, f AS (SELECT doc_id, {first_sentence('text')} AS s FROM docs) SELECT doc_id, CASE WHEN s <> '' THEN {cite('s', '3')} END AS cited FROM f",
    "filter_predicates": "SELECT doc_id, source, lang FROM documents WHERE source IN ('src3', 'src4') AND (lang = 'de' OR source = 'de')",
    "incremental_anti_join": f"WITH {VERSIONS} SELECT * FROM new WHERE point_id NOT IN (SELECT point_id FROM old)",
    "upsert_merge": f"WITH {VERSIONS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE point_id NOT IN (SELECT point_id FROM new)",
    "existing_point_ids": f"WITH {VERSIONS} SELECT point_id FROM new WHERE point_id IN (SELECT point_id FROM old)",
    "point_count": "SELECT count(*)::BIGINT AS points FROM documents",
    "embedder_models": "SELECT DISTINCT 'model-' || lang AS embedded_model FROM documents WHERE doc_id % 5 BETWEEN 1 AND 3",
    "corpus_identity_hash": f"WITH {DOCS} SELECT sha256(string_agg(source_path || chr(0) || sha256(text) || chr(0), '' ORDER BY source_path, sha256(text))) AS corpus_hash, count(*)::BIGINT AS doc_count FROM docs",
    "identities_compatible": "WITH a AS (SELECT source, count(*) AS doc_count, min(lang) AS embedder_id FROM documents GROUP BY source) SELECT a.source, b.source AS other, a.doc_count = b.doc_count AS compatible FROM a JOIN a b ON a.embedder_id IS NOT DISTINCT FROM b.embedder_id AND a.source < b.source",
    "cache_key_digest": """SELECT item_id AS query_id, sha256('points' || chr(10) || text || chr(10) || '{"source":"src1","tags":["en","fr"]}' || chr(10) || 'fake-deterministic-v1' || chr(10) || 'fake' || chr(10)
  || '{"dense_top_k":40,"mode":"hybrid","rerank":"","rrf_k":60,"sparse_top_k":40,"top_k":12}' || chr(10)) AS digest FROM benchmark""",
    "golden_integrity": f"""
WITH {DOCS}, {GOLDEN}, wanted AS (SELECT id, unnest(paths) AS path FROM golden)
SELECT CASE WHEN path NOT IN (SELECT source_path FROM docs) THEN 'missing' ELSE 'no_chunks' END AS code, id AS subject, path AS detail FROM wanted WHERE path NOT IN (SELECT source_path FROM docs WHERE length(text) >= 120)
UNION ALL SELECT 'duplicate_id', id, count(*)::VARCHAR FROM golden GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_question', question, count(*)::VARCHAR FROM golden GROUP BY question HAVING count(*) > 1
UNION ALL SELECT 'unanswerable_with_sources', id, '' FROM golden WHERE answerable = false AND len(paths) > 0
UNION ALL SELECT 'slice_size', category, count(*)::VARCHAR FROM golden GROUP BY category HAVING count(*) <> 10""",
    "difficulty_rank1": f"""
WITH {GOLDEN}, ranks AS (SELECT id, max(CASE WHEN id LIKE '%5' THEN NULL ELSE length(question) % 3 END) AS r FROM golden WHERE id NOT LIKE '%7' GROUP BY id),
g AS (SELECT golden.*, ranks.id IS NOT NULL AS listed, r FROM golden LEFT JOIN ranks USING (id)),
s AS (SELECT category, count(*) FILTER (r <= 1) AS items, avg((r <= 1)::INT) AS share FROM g WHERE r IS NOT NULL AND category <> 'unanswerable' GROUP BY category)
SELECT category AS slice, 'missing_rank' AS code, count(*)::BIGINT AS items FROM g WHERE NOT listed GROUP BY category UNION ALL SELECT category, 'bad_rank', count(*) FROM g WHERE listed AND r IS NULL GROUP BY category
UNION ALL SELECT category, 'all_trivial_rank1', items FROM s WHERE share >= 0.5 UNION ALL SELECT category, 'slice_all_rank1', items FROM s WHERE share = 1""",
    "difficulty_structure": f"""
WITH {GOLDEN}, f AS (
  SELECT category AS slice, 'answerable_flag' AS code FROM golden WHERE category = 'answerable' AND answerable = false UNION ALL SELECT category, 'answerable_paths' FROM golden WHERE category = 'answerable' AND len(paths) = 0
  UNION ALL SELECT category, 'unanswerable_flag' FROM golden WHERE category = 'unanswerable' AND answerable IS DISTINCT FROM false UNION ALL SELECT category, 'unanswerable_paths' FROM golden WHERE category = 'unanswerable' AND len(paths) > 0
  UNION ALL SELECT category, 'filter_required' FROM golden WHERE category = 'filter' AND NOT filtered UNION ALL SELECT category, 'rare_token' FROM golden WHERE category = 'hybrid-vs-dense' AND (token = '' OR NOT contains(question, token)))
SELECT slice, code, count(*)::BIGINT AS items FROM f GROUP BY ALL UNION ALL SELECT s, 'missing_slice', 0 FROM (SELECT unnest([{_list(checks.SLICES)}]) AS s) WHERE s NOT IN (SELECT category FROM golden)
UNION ALL SELECT 'overall', 'n_below_minimum', count(*) FROM golden HAVING count(*) < 50""",
    "question_target_overlap": f"WITH {DOCS}, {CASES}, w AS (SELECT id, text, unnest(expected) AS doc_id FROM labelled) SELECT id, doc_id, len(list_intersect(list_distinct({terms('w.text')}), {terms('d.text')}))::INT AS shared FROM w JOIN docs d USING (doc_id)",
    "usage_ledger": "WITH u AS (SELECT event_type, event_id % 100 AS p, CASE WHEN event_id % 2 = 0 THEN user_id % 50 ELSE 0 END AS c FROM events) SELECT event_type, count(*)::BIGINT AS calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, " + USD.format(e="0", i="sum(p)::DOUBLE", o="sum(c)::DOUBLE", d=6) + " AS cost_usd FROM u GROUP BY event_type",
    "cost_preflight": f"""
WITH {DOCS}, t AS (SELECT lang, sum((length(text) + 3) // 4)::DOUBLE AS e FROM docs GROUP BY lang)
SELECT lang, e::BIGINT AS embedding_tokens, 4320 AS query_tokens, 240 AS generations,
  CASE WHEN lang = 'es' THEN 0 ELSE {USD.format(e='(e + 4320)', i='720000::DOUBLE', o='84120::DOUBLE', d=4)} END AS expected_usd, CASE WHEN lang = 'es' THEN 0 ELSE {USD.format(e='(e + 4320)', i='1440000::DOUBLE', o='168240::DOUBLE', d=4)} END AS upper_bound_usd FROM t""",
    "load_percentiles": """
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*)::BIGINT AS n, round(max(value) FILTER (i = round_even((n - 1) * 0.5::DOUBLE, 0)), 6) AS p50, round(max(value) FILTER (i = round_even((n - 1) * 0.95::DOUBLE, 0)), 6) AS p95,
  round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.975), 6) AS type7_975 FROM e GROUP BY event_type""",
    "payload_projection": ONE + """ SELECT query_id, rank::INT AS rank, '{"doc_id":' || doc_id || ',"source_path":"' || source_path || '","score":"' || round(score, 6)::DECIMAL(20, 6) || '","rank":' || rank || '}' AS payload FROM one JOIN docs USING (doc_id) WHERE rank <= 12""",
}

ORACLES["cached_answers"] = ORACLES["extractive_answer"]
