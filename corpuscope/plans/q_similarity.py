"""Registered similarity queries (SIM-1 … SIM-9, PF-2, PF-3, PF-10, LIM-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import similarity as S
from corpuscope.plans import params as P
from corpuscope.plans.catalog import register
from corpuscope.plans.oracle_sql import CENTROIDS, CONFLICT_PAIRS, CONFLICT_SELECT, DOC_CORPUS, EMB_CORPUS
from corpuscope.plans.prepared import prepared, prepared_value
from corpuscope.sources.tables import documents_corpus, embedded_corpus

_PUBLIC = S.CONFLICT_COLS


def prepared_corpus(spark, sf):
    """The embedded corpus, computed once and stored (read by every view)."""
    return prepared(spark, "embedded_corpus", sf, ["embeddings", "documents"], lambda: embedded_corpus(spark, sf))


def prepared_documents(spark, sf):
    return prepared(spark, "documents_corpus", sf, ["documents"], lambda: documents_corpus(spark, sf))


def prepared_cells(spark, sf):
    """The embedded corpus cut into cells, once per input."""
    return prepared_value(spark, "conflict_cells", sf, ["embeddings", "documents"],
                          lambda: S.conflict_cells(prepared_corpus(spark, sf)))


def prepared_phrases(spark, sf):
    """The places and distinct texts of the embedded corpus, once per input."""
    return prepared_value(spark, "conflict_phrases", sf, ["embeddings", "documents"],
                          lambda: S.phrase_index(prepared_corpus(spark, sf)))


def _conflicts(spark, sf, cap=None):
    return S.phrase_conflicts(prepared_corpus(spark, sf), P.CONFLICT_T, max_conflicts=cap, cells=prepared_cells(spark, sf),
                              phrases=prepared_phrases(spark, sf))


def _placed(spark, sf):
    """The conflicts without their texts, for queries that keep some of them."""
    pairs = S.conflict_pairs(prepared_corpus(spark, sf), P.CONFLICT_T, cells=prepared_cells(spark, sf))
    return S.place_pairs(pairs, prepared_phrases(spark, sf))


@register("phrase_conflicts", f"WITH {EMB_CORPUS}, {CONFLICT_PAIRS} SELECT {CONFLICT_SELECT} FROM conf_pairs")
def q_phrase_conflicts(spark, sf):
    return _conflicts(spark, sf).select(*_PUBLIC)


@register("conflicts_blocked", f"WITH {EMB_CORPUS}, {CONFLICT_PAIRS} SELECT {CONFLICT_SELECT} FROM conf_pairs")
def q_conflicts_blocked(spark, sf):
    # small blocks, so that test scale spans many block pairs
    return S.phrase_conflicts(prepared_corpus(spark, sf), P.CONFLICT_T, method="blocked", block_rows=P.BLOCK_ROWS,
                              phrases=prepared_phrases(spark, sf)).select(*_PUBLIC)


@register("conflicts_capped", f"""WITH {EMB_CORPUS}, {CONFLICT_PAIRS},
tot AS (SELECT count(*) AS n FROM conf_all)
SELECT {CONFLICT_SELECT}, (SELECT n FROM tot) >= {P.CAP_N} AS limit_reached
FROM conf_all ORDER BY intent_pos, row_pos, other_pos, other_row LIMIT {P.CAP_N}""")
def q_conflicts_capped(spark, sf):
    return S.cap_conflicts(_conflicts(spark, sf, cap=P.CAP_N), P.CAP_N).select(*_PUBLIC, "limit_reached")


@register("conflicts_filtered", f"""WITH {EMB_CORPUS}, {CONFLICT_PAIRS}
SELECT {CONFLICT_SELECT} FROM conf_pairs
WHERE sim >= {P.CONFLICT_FILTER_T} AND (intent = '{P.FILTER_INTENT}' OR other_intent = '{P.FILTER_INTENT}')""")
def q_conflicts_filtered(spark, sf):
    kept = S.filter_conflicts(_placed(spark, sf), P.CONFLICT_FILTER_T, P.FILTER_INTENT)
    return S.with_texts(kept, prepared_phrases(spark, sf)).select(*_PUBLIC)


@register("conflicts_shown", f"""WITH {EMB_CORPUS}, {CONFLICT_PAIRS},
sim_only AS (SELECT * FROM conf_pairs WHERE NOT is_exact),
tot AS (SELECT count(*) AS n FROM sim_only)
SELECT {CONFLICT_SELECT}, greatest((SELECT n FROM tot) - {P.SHOW_N}, 0) AS hidden
FROM sim_only ORDER BY sim DESC, intent_pos, row_pos, other_pos, other_row LIMIT {P.SHOW_N}""")
def q_conflicts_shown(spark, sf):
    _, similar = S.split_exact(_placed(spark, sf))
    return S.with_texts(S.top_conflicts(similar, P.SHOW_N), prepared_phrases(spark, sf), few=True).select(*_PUBLIC, "hidden")


_TOPK_SQL = f"""WITH {EMB_CORPUS},
allp AS (
  SELECT a.phrase_id, a.intent_pos AS ip, a.row_pos AS ir, b.phrase_id AS other_id,
         b.intent_pos AS jp, b.row_pos AS jr,
         round(CASE WHEN a.nv = 0 OR b.nv = 0 THEN 0.0 ELSE list_dot_product(a.v, b.v) / (a.nv * b.nv) END, 6) AS sim
  FROM emb a CROSS JOIN emb b
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY sim DESC, jp, jr) AS rk FROM allp
)
SELECT r.phrase_id, a.intent, a.phrase, r.other_id, b.intent AS other_intent, b.phrase AS similar_to,
       r.sim, a.phrase = b.phrase AS is_exact
FROM ranked r JOIN emb a ON a.phrase_id = r.phrase_id JOIN emb b ON b.phrase_id = r.other_id
WHERE r.rk <= {P.TOPK_K} AND (r.ip < r.jp OR (r.ip = r.jp AND r.ir < r.jr)) AND r.ip <> r.jp
  AND r.sim >= {P.CONFLICT_T}"""


@register("conflicts_topk", _TOPK_SQL)
def q_conflicts_topk(spark, sf):
    return S.conflicts_topk(prepared_corpus(spark, sf), P.CONFLICT_T, P.TOPK_K, cells=prepared_cells(spark, sf),
                            phrases=prepared_phrases(spark, sf)).select(*_PUBLIC)


@register("conflicts_lsh", f"""WITH {EMB_CORPUS}, {CONFLICT_PAIRS},
size AS (SELECT greatest(8, ceil(log2(greatest(2, count(*)))))::BIGINT AS bits FROM emb),
signs AS (SELECT t, b, i, CASE WHEN substr(md5(t || ':' || b || ':' || i || ':42'), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s
          FROM range({P.LSH_TABLES}) x(t), range((SELECT bits FROM size)) y(b), range(64) z(i)),
planes AS (SELECT t, b, list(s ORDER BY i) AS p FROM signs GROUP BY t, b),
proj AS (SELECT phrase_id, t, b, list_dot_product(v, p) AS z FROM emb CROSS JOIN planes),
buckets AS (SELECT phrase_id, t, sum(CASE WHEN z >= 0 THEN 1 << b ELSE 0 END) AS bucket FROM proj GROUP BY phrase_id, t),
weak AS (SELECT *, row_number() OVER (PARTITION BY phrase_id, t ORDER BY z * z, b) - 1 AS w FROM proj
         QUALIFY w < {S.WEAK_BITS}),
flips AS (SELECT phrase_id, t, m, sum(z * z) FILTER ((m >> w) & 1 = 1) AS cost, coalesce(sum(1 << b) FILTER ((m >> w) & 1 = 1), 0) AS mask
          FROM weak, range(1 << least({S.WEAK_BITS}, (SELECT bits FROM size))) ms(m) GROUP BY phrase_id, t, m),
looks AS (SELECT phrase_id, t, mask FROM flips QUALIFY row_number() OVER (PARTITION BY phrase_id, t ORDER BY coalesce(cost, 0))
          <= least({P.LSH_PROBES}, ceil({P.LSH_SHARE} * (1 << least({S.WEAK_BITS}, (SELECT bits FROM size)))))),
near AS (SELECT DISTINCT c.phrase_id, c.other_id FROM conf_pairs c JOIN buckets a ON a.phrase_id = c.phrase_id
         JOIN buckets o ON o.phrase_id = c.other_id AND o.t = a.t
         JOIN looks l ON l.phrase_id = a.phrase_id AND l.t = a.t AND l.mask = xor(a.bucket::BIGINT, o.bucket::BIGINT))
SELECT {CONFLICT_SELECT} FROM conf_pairs JOIN near USING (phrase_id, other_id)""")
def q_conflicts_lsh(spark, sf):
    return S.conflicts_lsh(prepared_corpus(spark, sf), P.CONFLICT_T, num_tables=P.LSH_TABLES, probe_share=P.LSH_SHARE,
                           most_probes=P.LSH_PROBES, phrases=prepared_phrases(spark, sf)).select(*_PUBLIC)


@register("exact_duplicates", f"""WITH {DOC_CORPUS}
SELECT a.phrase_id, a.intent, a.phrase, b.phrase_id AS other_id, b.intent AS other_intent,
       b.phrase AS similar_to, CAST(1.0 AS DOUBLE) AS sim, true AS is_exact
FROM doc a JOIN doc b ON a.phrase = b.phrase AND a.intent_pos < b.intent_pos""")
def q_exact_duplicates(spark, sf):
    return S.exact_duplicates(prepared_documents(spark, sf)).select(*_PUBLIC)


@register("duplicate_groups", f"""WITH {DOC_CORPUS},
firsts AS (SELECT * FROM doc QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY intent_pos, row_pos) = 1)
SELECT a.phrase_id, a.intent, a.phrase, b.phrase_id AS other_id, b.intent AS other_intent,
       b.phrase AS similar_to, CAST(1.0 AS DOUBLE) AS sim, true AS is_exact
FROM firsts a JOIN doc b ON a.phrase = b.phrase AND a.intent_pos < b.intent_pos""")
def q_duplicate_groups(spark, sf):
    return S.duplicate_groups(prepared_documents(spark, sf)).select(*_PUBLIC)


@register("intent_centroids", f"""WITH {EMB_CORPUS}, {CENTROIDS}
SELECT intent, dim, round(val, 6) AS value FROM cent_dims""")
def q_intent_centroids(spark, sf):
    c = S.intent_centroids(prepared_corpus(spark, sf))
    return c.select("intent", F.posexplode("centroid").alias("dim", "value")).select(
        "intent", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@register("intent_matrix", f"""WITH {EMB_CORPUS}, {CENTROIDS}
SELECT intent_a, intent_b, round(sim, 6) AS sim FROM matrix""")
def q_intent_matrix(spark, sf):
    m = S.intent_matrix(S.intent_centroids(prepared_corpus(spark, sf)))
    return m.select("intent_a", "intent_b", F.round("sim", 6).alias("sim"))


@register("confusing_pairs", f"""WITH {EMB_CORPUS}, {CENTROIDS}
SELECT intent_a, intent_b, round(sim, 6) AS sim, round(sim, 3) AS sim3,
       CASE WHEN sim > {P.TABLE_BANDS.risk_high} THEN 'High' ELSE 'Medium' END AS risk
FROM matrix WHERE a_pos < b_pos AND sim >= {P.PAIR_T}""")
def q_confusing_pairs(spark, sf):
    m = S.intent_matrix(S.intent_centroids(prepared_corpus(spark, sf)))
    p = S.confusing_pairs(m, P.PAIR_T, P.TABLE_BANDS)
    return p.select("intent_a", "intent_b", F.round("sim", 6).alias("sim"), "sim3", "risk")
