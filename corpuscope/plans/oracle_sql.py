"""DuckDB SQL that recomputes each registered query from the raw tables.

Shared CTEs mirror the corpus bindings of ``corpuscope.sources.tables``.
"""

from __future__ import annotations

from corpuscope.functions.text import PY_WHITESPACE, KW_CLASS_ASCII, KW_CLASS_MULTI, STOP_WORDS, STOP_WORDS_EN, WORD_TOKEN, sql_list
from corpuscope.plans import params as P

WS_SQL = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def is_phrase(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '' AND lower({x}) <> 'nan')"


# embedded corpus: embeddings ⋈ documents, label as intent
EMB_CORPUS = f"""
emb_base AS (
  SELECT e.vec_id AS phrase_id, 'label_' || CAST(e.label AS VARCHAR) AS intent, e.vec_id AS row_pos,
         {strip('d.text')} AS phrase, CAST(e.embedding AS DOUBLE[]) AS v
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
),
emb AS (
  SELECT phrase_id, intent, min(row_pos) OVER (PARTITION BY intent) AS intent_pos, row_pos, phrase, v,
         sqrt(list_dot_product(v, v)) AS nv
  FROM emb_base WHERE {is_phrase('phrase')}
)"""

DOC_CORPUS = f"""
doc_base AS (
  SELECT doc_id AS phrase_id, source AS intent, doc_id AS row_pos, {strip('text')} AS phrase
  FROM documents
),
doc AS (
  SELECT phrase_id, intent, min(row_pos) OVER (PARTITION BY intent) AS intent_pos, row_pos, phrase
  FROM doc_base WHERE {is_phrase('phrase')} AND intent IS NOT NULL
)"""

CONV_CORPUS = f"""
conv_base AS (
  SELECT conv_id * 2147483648 + turn AS phrase_id, role AS intent, conv_id * 2147483648 + turn AS row_pos,
         {strip('text')} AS phrase
  FROM conversations
),
conv AS (
  SELECT phrase_id, intent, min(row_pos) OVER (PARTITION BY intent) AS intent_pos, row_pos, phrase
  FROM conv_base WHERE {is_phrase('phrase')} AND intent IS NOT NULL
)"""


def cos(a: str, b: str) -> str:
    return (f"(CASE WHEN {a}.nv = 0 OR {b}.nv = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}.v, {b}.v) / ({a}.nv * {b}.nv) END)")


def keywords_sql(x: str, variant: str = "multi") -> str:
    cls, stops = (KW_CLASS_MULTI, STOP_WORDS) if variant == "multi" else (KW_CLASS_ASCII, STOP_WORDS_EN)
    return (f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{WORD_TOKEN}'), "
            f"lambda t: regexp_full_match(t, '{cls[1:-1]}') AND length(t) > 2 "
            f"AND NOT list_contains({sql_list(stops)}, t))")


CONFLICT_PAIRS = f"""
conf_all AS (
  SELECT a.phrase_id, a.intent, a.phrase, b.phrase_id AS other_id, b.intent AS other_intent,
         b.phrase AS similar_to, round({cos('a', 'b')}, 6) AS sim, a.phrase = b.phrase AS is_exact,
         a.intent_pos, a.row_pos, b.intent_pos AS other_pos, b.row_pos AS other_row
  FROM emb a JOIN emb b ON a.intent_pos < b.intent_pos
  WHERE {cos('a', 'b')} >= {P.CONFLICT_T}
),
conf_pairs AS (
  SELECT * FROM conf_all
)"""

CONFLICT_SELECT = "phrase_id, intent, phrase, other_id, other_intent, similar_to, sim, is_exact"

CENTROIDS = """
cent_dims AS (
  SELECT intent, min(intent_pos) AS intent_pos, i AS dim, avg(x) AS val
  FROM (SELECT intent, intent_pos, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM emb)
  GROUP BY intent, i
),
cent AS (
  SELECT intent, min(intent_pos) AS intent_pos, list(val ORDER BY dim) AS v
  FROM cent_dims GROUP BY intent
),
centn AS (SELECT *, sqrt(list_dot_product(v, v)) AS nv FROM cent),
matrix AS (
  SELECT a.intent AS intent_a, b.intent AS intent_b, a.intent_pos AS a_pos, b.intent_pos AS b_pos,
         """ + cos("a", "b") + """ AS sim
  FROM centn a CROSS JOIN centn b
)"""


def hash_vectors(name: str, src: str, id_col: str, text_col: str, dim: int = P.ENCODE_DIM) -> str:
    """CTEs ``{name}_w (id, b, w)`` and ``{name}_n (id, nv)`` of the hashing encoder."""
    return f"""
{name}_t AS (
  SELECT {id_col} AS id, md5(unnest(regexp_extract_all(lower(coalesce({text_col}, '')), '{WORD_TOKEN}'))) AS h
  FROM {src}
),
{name}_w AS (
  SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % {dim} AS INTEGER) AS b,
         CAST(sum(CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER < 8 THEN 1 ELSE -1 END) AS DOUBLE) AS w
  FROM {name}_t GROUP BY ALL
),
{name}_n AS (SELECT id, sqrt(sum(w * w)) AS nv FROM {name}_w GROUP BY id)"""


QRY = f"""
qry AS (SELECT item_id AS query_id, {strip('text')} AS query FROM benchmark)"""


def search_hits_sql(threshold: float, top_k: int) -> str:
    """CTE ``hits`` (query_id, query, rank, phrase_id, intent, phrase, sim, intent_pos, row_pos)."""
    return f"""{DOC_CORPUS}, {QRY},
{hash_vectors('dv', 'doc', 'phrase_id', 'phrase')},
{hash_vectors('qv', 'qry', 'query_id', 'query')},
dots AS (
  SELECT q.id AS query_id, d.id AS phrase_id, sum(q.w * d.w) AS dp
  FROM qv_w q JOIN dv_w d ON q.b = d.b GROUP BY ALL
),
sims AS (
  SELECT t.query_id, t.phrase_id,
         CASE WHEN qn.nv = 0 OR dn.nv = 0 THEN 0.0 ELSE t.dp / (qn.nv * dn.nv) END AS raw
  FROM dots t JOIN qv_n qn ON qn.id = t.query_id JOIN dv_n dn ON dn.id = t.phrase_id
),
hits_all AS (
  SELECT s.query_id, q.query, s.phrase_id, d.intent, d.phrase, round(s.raw, 6) AS sim, d.intent_pos, d.row_pos
  FROM sims s JOIN doc d ON d.phrase_id = s.phrase_id JOIN qry q ON q.query_id = s.query_id
  WHERE s.raw >= {threshold}
),
hits AS (
  SELECT query_id, query,
         row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, intent_pos, row_pos) AS rank,
         phrase_id, intent, phrase, sim, intent_pos, row_pos
  FROM hits_all QUALIFY rank <= {top_k}
)"""


# band CASE expressions (mirror corpuscope.functions.bands)
def batch_action_sql(s: str, b) -> str:
    return (f"(CASE WHEN {s} > {b.duplicate} THEN 'DUPLICATE' WHEN {s} > {b.add} THEN 'ADD' "
            f"WHEN {s} > {b.review} THEN 'REVIEW' ELSE 'NEW_INTENT' END)")


def single_action_sql(s: str, c: str, b) -> str:
    return (f"(CASE WHEN {s} > {b.duplicate} THEN 'DUPLICATE' WHEN {s} > {b.add} AND {c} > {b.confidence} THEN 'ADD' "
            f"WHEN {s} > {b.review} THEN 'REVIEW' ELSE 'NEW_INTENT' END)")


def action_sentence_sql(a: str, i: str) -> str:
    return (f"(CASE {a} WHEN 'DUPLICATE' THEN 'DUPLICATE -- Do not add' "
            f"WHEN 'ADD' THEN 'ADD to ' || coalesce({i}, 'N/A') "
            f"WHEN 'REVIEW' THEN 'REVIEW -- possibly ' || coalesce({i}, 'N/A') "
            f"WHEN 'NEW_INTENT' THEN 'NEW INTENT suggested' ELSE {a} END)")


def match_type_sql(s: str, phrase: str, query: str, b) -> str:
    return (f"(CASE WHEN lower({strip(phrase)}) = lower({strip(query)}) THEN 'Exact' "
            f"WHEN {s} > {b.mt_very_high} THEN 'Very High' WHEN {s} > {b.mt_high} THEN 'High' "
            f"WHEN {s} > {b.mt_moderate} THEN 'Moderate' WHEN {s} > {b.mt_low} THEN 'Low' ELSE 'Very Low' END)")


def sim_caption_sql(s: str, b) -> str:
    return (f"(CASE WHEN {s} > {b.cap_very_high} THEN 'Very High -- Likely duplicate' "
            f"WHEN {s} > {b.add} THEN 'High -- Good fit' WHEN {s} > {b.review} THEN 'Moderate -- Acceptable fit' "
            f"ELSE 'Low -- Consider new intent' END)")


def phrase_action_sql(s: str, b) -> str:
    return (f"(CASE WHEN {s} > {b.move} THEN 'MOVE or DELETE' WHEN {s} > {b.rephrase} THEN 'REPHRASE' "
            f"ELSE 'REVIEW' END)")


def phrase_reason_sql(s: str, b) -> str:
    return (f"(CASE WHEN {s} > {b.move} THEN 'Almost identical to other intent' "
            f"WHEN {s} > {b.rephrase} THEN 'Very similar - needs differentiation' "
            f"ELSE 'Moderately similar - consider rewording' END)")


def grade_sql(s: str, b) -> str:
    return (f"(CASE WHEN {s} >= {b.grade_good} THEN 'Good' WHEN {s} >= {b.grade_fair} THEN 'Fair' "
            f"ELSE 'Needs Work' END)")


def avg6(x: str) -> str:
    """Mean of 6-decimal values rounded half-up to 6 decimals, exactly (see functions.stats.avg6)."""
    return (f"(floor((2 * sum(CAST(round({x} * 1000000) AS BIGINT)) + count({x})) / (2 * count({x}))) / 1000000.0)")


PAGES_CORPUS = f"""
pg AS (
  SELECT * FROM (
    SELECT (CAST(0 AS BIGINT) << 40) + page_id AS phrase_id, 'url' AS intent, CAST(0 AS BIGINT) AS intent_pos,
           page_id AS row_pos, {strip('url')} AS phrase FROM pages
    UNION ALL
    SELECT (CAST(1 AS BIGINT) << 40) + page_id, 'html', CAST(1 AS BIGINT), page_id, {strip('html')} FROM pages
  ) WHERE {is_phrase('phrase')}
)"""


def truncate_sql(x: str, n: int = 80) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def validate_sql(src: str) -> str:
    return f"""
sizes AS (
  SELECT intent, min(intent_pos) AS intent_pos, count(*) AS n,
         count(*) FILTER (WHERE length(phrase) > 500) AS n_long,
         count(*) FILTER (WHERE regexp_matches(phrase, '^https?://'))
           + count(*) FILTER (WHERE regexp_matches(phrase, '<[^>]+>'))
           + count(*) FILTER (WHERE regexp_full_match(regexp_replace(phrase, '[.,]', '', 'g'), '\\p{{Nd}}+')) AS n_nontext
  FROM {src} GROUP BY intent
),
names AS (
  SELECT lower({strip('intent')}) AS key, count(*) AS k, min(intent_pos) AS pos,
         string_agg(intent, ', ' ORDER BY intent_pos) AS names
  FROM sizes GROUP BY 1
),
report AS (
  SELECT 1 AS check_no, intent_pos AS pos, 'warning' AS level,
         printf('Intent ''%s'' has only %d phrase(s) -- too few for meaningful analysis.', intent, n) AS message
  FROM sizes WHERE n < 3
  UNION ALL
  SELECT 2, intent_pos, 'warning',
         printf('Intent ''%s'' has %d phrase(s) longer than 500 characters -- possible data error.', intent, n_long)
  FROM sizes WHERE n_long > 0
  UNION ALL
  SELECT 3, intent_pos, 'warning', printf('Intent ''%s'' has %d non-text phrase(s) (URLs/HTML/numbers).', intent, n_nontext)
  FROM sizes WHERE n_nontext > 0
  UNION ALL
  SELECT 4, pos, 'error', 'Duplicate intent names (case-insensitive): ' || names FROM names WHERE k > 1
  UNION ALL
  SELECT 5, 0, 'warning',
         printf('Found %d duplicate phrase(s) across intents. This may inflate similarity scores.', d)
  FROM (SELECT count(*) - count(DISTINCT phrase) AS d FROM {src}) WHERE d > 0
)"""


def terms_sql(src: str, name: str = "terms") -> str:
    return f"""
{name}_kw AS (SELECT intent, intent_pos, unnest({keywords_sql('phrase')}) AS term FROM {src}),
{name} AS (SELECT intent, term, min(intent_pos) AS intent_pos FROM {name}_kw GROUP BY ALL)"""


def overlap_sql(pairs: str, terms: str = "terms", show: int = 10) -> str:
    """CTE ``overlap`` (intent_a, intent_b, n_common, overlap_score, common, a_unique, b_unique)."""
    def firstn(src, name):
        return f"""{name} AS (
  SELECT intent_a, intent_b, string_agg(term, ', ' ORDER BY term) AS {name}
  FROM (SELECT *, row_number() OVER (PARTITION BY intent_a, intent_b ORDER BY term) AS r FROM {src})
  WHERE r <= {show} GROUP BY ALL)"""
    return f"""
ov_sizes AS (SELECT intent, count(*) AS n FROM {terms} GROUP BY intent),
ov_p AS (SELECT DISTINCT intent_a, intent_b FROM {pairs}),
ov_a AS (SELECT p.intent_a, p.intent_b, t.term FROM ov_p p JOIN {terms} t ON t.intent = p.intent_a),
ov_b AS (SELECT p.intent_a, p.intent_b, t.term FROM ov_p p JOIN {terms} t ON t.intent = p.intent_b),
ov_c AS (SELECT a.* FROM ov_a a JOIN ov_b b ON a.intent_a = b.intent_a AND a.intent_b = b.intent_b AND a.term = b.term),
ov_ao AS (SELECT * FROM ov_a EXCEPT SELECT * FROM ov_c),
ov_bo AS (SELECT * FROM ov_b EXCEPT SELECT * FROM ov_c),
{firstn('ov_c', 'common')},
{firstn('ov_ao', 'a_unique')},
{firstn('ov_bo', 'b_unique')},
ov_n AS (SELECT intent_a, intent_b, count(*) AS n_common FROM ov_c GROUP BY ALL),
overlap AS (
  SELECT p.intent_a, p.intent_b, coalesce(n.n_common, 0) AS n_common,
         round(coalesce(n.n_common, 0) / greatest(coalesce(sa.n, 0), coalesce(sb.n, 0), 1), 6) AS overlap_score,
         coalesce(c.common, '') AS common, coalesce(ua.a_unique, '') AS a_unique, coalesce(ub.b_unique, '') AS b_unique
  FROM ov_p p
  LEFT JOIN ov_n n ON n.intent_a = p.intent_a AND n.intent_b = p.intent_b
  LEFT JOIN ov_sizes sa ON sa.intent = p.intent_a
  LEFT JOIN ov_sizes sb ON sb.intent = p.intent_b
  LEFT JOIN common c ON c.intent_a = p.intent_a AND c.intent_b = p.intent_b
  LEFT JOIN a_unique ua ON ua.intent_a = p.intent_a AND ua.intent_b = p.intent_b
  LEFT JOIN b_unique ub ON ub.intent_a = p.intent_a AND ub.intent_b = p.intent_b
)"""


def tfidf_sql(src: str, max_features: int = 50, top: int = 50) -> str:
    """CTE ``tfidf`` (intent, term, score, rank)."""
    stops = sql_list(STOP_WORDS)
    return f"""
tf_ph AS (
  SELECT intent, intent_pos, row_pos,
         list_filter(regexp_extract_all(lower(coalesce(phrase, '')), '{WORD_TOKEN}'),
                     lambda t: length(t) >= 2 AND NOT list_contains({stops}, t)) AS k
  FROM {src}
),
tf_uni AS (SELECT intent, unnest(k) AS term FROM tf_ph),
tf_inb AS (SELECT intent, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS term
           FROM tf_ph WHERE len(k) > 1),
tf_ends AS (SELECT intent, row_pos, k[1] AS head, k[len(k)] AS tail FROM tf_ph WHERE len(k) > 0),
tf_cross AS (SELECT intent, tail || ' ' || lead(head) OVER (PARTITION BY intent ORDER BY row_pos) AS term FROM tf_ends),
tf_grams AS (SELECT * FROM tf_uni UNION ALL SELECT * FROM tf_inb UNION ALL SELECT * FROM tf_cross WHERE term IS NOT NULL),
tf_tf AS (SELECT intent, term, count(*) AS tf FROM tf_grams GROUP BY ALL),
tf_vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf_tf GROUP BY term
             ORDER BY total DESC, term LIMIT {max_features}),
tf_n AS (SELECT count(DISTINCT intent) AS N FROM {src}),
tf_scored AS (
  SELECT t.intent, t.term, (1 + ln(t.tf)) * (ln((1 + n.N) / (1 + v.df)) + 1) AS raw
  FROM tf_tf t JOIN tf_vocab v ON v.term = t.term CROSS JOIN tf_n n
),
tf_norm AS (SELECT intent, sqrt(sum(raw * raw)) AS nrm FROM tf_scored GROUP BY intent),
tf_final AS (SELECT s.intent, s.term, round(s.raw / n.nrm, 6) AS score FROM tf_scored s JOIN tf_norm n ON n.intent = s.intent),
tfidf AS (
  SELECT intent, term, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY intent ORDER BY score DESC, term) AS rank FROM tf_final WHERE score > 0)
  WHERE rank <= {top}
)"""


PAIRS = f"""
pairs AS (SELECT intent_a, intent_b, a_pos, b_pos, sim FROM matrix WHERE a_pos < b_pos AND sim >= {P.PAIR_T})"""
