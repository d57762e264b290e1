"""Registered search queries: every ``benchmark`` text against the whole
``documents`` corpus, both hashed by the same encoder (EMB-1, SIM-10 … 13,
AGG-14 … 21, PF-5, PF-6, PF-13 … 17, PF-20, LIM-1, LIM-9, LIM-11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope.functions.text import py_strip
from corpuscope.operators import search as S
from corpuscope.operators.encode import HashingEncoder, encode
from corpuscope.plans import params as P
from corpuscope.plans.catalog import register
from corpuscope.plans.oracle_sql import (action_sentence_sql, avg6, batch_action_sql, keywords_sql, match_type_sql,
                                         search_hits_sql, sim_caption_sql, single_action_sql, strip)
from corpuscope.plans.prepared import prepared, prepared_value
from corpuscope.plans.q_similarity import prepared_documents
from corpuscope.session import checkpoint_dir
from corpuscope.sources.tables import benchmark_queries

BANDS = P.TABLE_BANDS


def encoded(spark, sf):
    """Hashing-encoded documents and queries, each computed once and stored."""
    enc = HashingEncoder(P.ENCODE_DIM)
    corpus = prepared(spark, f"encoded_documents_{P.ENCODE_DIM}", sf, ["documents"],
                      lambda: encode(prepared_documents(spark, sf), "phrase", "phrase_id", enc))
    q = prepared(spark, f"encoded_queries_{P.ENCODE_DIM}", sf, ["benchmark"],
                 lambda: encode(benchmark_queries(spark, sf).withColumn("query", py_strip("query")),
                                "query", "query_id", enc))
    return corpus, q


def batch_hits(spark, sf):
    corpus, q = encoded(spark, sf)
    return S.search_hits(corpus, q, P.SEARCH_T, P.SEARCH_TOPK), q


def single_hits(spark, sf, include_exact=False):
    corpus, q = encoded(spark, sf)
    hits = S.search_hits(corpus, q, P.SEARCH_T, P.SINGLE_TOPK)
    return hits if include_exact else S.drop_exact(hits)


BATCH_SQL = f"""WITH {search_hits_sql(P.SEARCH_T, P.SEARCH_TOPK)},
top10 AS (SELECT query_id, intent, count(*) AS cnt, min(rank) AS fr FROM hits WHERE rank <= 10 GROUP BY ALL),
mode AS (SELECT query_id, intent AS recommended_intent FROM top10
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cnt DESC, fr) = 1),
st AS (SELECT query_id, count(*) AS matches_found, max(sim) AS top_sim FROM hits GROUP BY ALL),
audit AS (
  SELECT q.query_id, substr(q.query, 1, 80) AS query, m.recommended_intent,
         coalesce(st.top_sim, 0.0) AS top_similarity, coalesce(st.matches_found, 0) AS matches_found
  FROM qry q LEFT JOIN st ON st.query_id = q.query_id LEFT JOIN mode m ON m.query_id = q.query_id
),
audit2 AS (SELECT *, {batch_action_sql('top_similarity', BANDS)} AS action FROM audit)"""


@register("batch_search", BATCH_SQL + f"""
SELECT query_id, query, recommended_intent, top_similarity, matches_found, action,
       {action_sentence_sql('action', 'recommended_intent')} AS action_text FROM audit2""")
def q_batch_search(spark, sf):
    hits, q = batch_hits(spark, sf)
    a = S.batch_audit(hits, q, BANDS)
    return a.select("query_id", F.substring("query", 1, 80).alias("query"), "recommended_intent",
                    "top_similarity", "matches_found", "action", "action_text")


@register("batch_matches", f"""WITH {search_hits_sql(P.SEARCH_T, P.SEARCH_TOPK)}
SELECT query_id, rank, phrase_id, intent, sim FROM hits""")
def q_batch_matches(spark, sf):
    hits, _ = batch_hits(spark, sf)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "phrase_id", "intent", "sim")


def search_index(spark, sf):
    """The encoded documents as an inverted file, stored once per input."""
    def build():
        path = f"{checkpoint_dir(spark).rstrip('/')}/tables/search-index-{uuid.uuid4().hex[:12]}"
        S.write_index(encoded(spark, sf)[0], path)
        return path

    return S.open_index(spark, prepared_value(spark, "search_index", sf, ["documents"], build))


@register("batch_matches_indexed", f"""WITH {search_hits_sql(P.SEARCH_T, P.SEARCH_TOPK)}
SELECT query_id, rank, phrase_id, intent, sim FROM hits""")
def q_batch_matches_indexed(spark, sf):
    corpus, q = encoded(spark, sf)
    hits = S.search_hits(corpus, q, P.SEARCH_T, P.SEARCH_TOPK, index=search_index(spark, sf))
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "phrase_id", "intent", "sim")


@register("batch_totals", BATCH_SQL + """,
names AS (SELECT * FROM (VALUES (0, 'DUPLICATE'), (1, 'ADD'), (2, 'REVIEW'), (3, 'NEW_INTENT')) t(action_pos, action))
SELECT n.action, coalesce(c.cnt, 0) AS count FROM names n
LEFT JOIN (SELECT action, count(*) AS cnt FROM audit2 GROUP BY action) c ON c.action = n.action""")
def q_batch_totals(spark, sf):
    hits, q = batch_hits(spark, sf)
    return S.action_totals(S.batch_audit(hits, q, BANDS)).select("action", "count")


SINGLE_SQL = f"""WITH {search_hits_sql(P.SEARCH_T, P.SINGLE_TOPK)},
shown AS (
  SELECT query_id, query, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank,
         phrase_id, intent, phrase, sim
  FROM hits WHERE lower({strip('phrase')}) <> lower({strip('query')})
)"""


@register("search_one", SINGLE_SQL + f"""
SELECT query_id, rank, phrase_id, intent, sim, {match_type_sql('sim', 'phrase', 'query', BANDS)} AS match_type,
       array_to_string(list_slice({keywords_sql('phrase')}, 1, 5), ', ') AS keywords
FROM shown""")
def q_search_one(spark, sf):
    r = S.result_table(single_hits(spark, sf), BANDS)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "phrase_id", "intent", "sim",
                    "match_type", "keywords")


@register("search_match_types", SINGLE_SQL + f""",
typed AS (SELECT *, {match_type_sql('sim', 'phrase', 'query', BANDS)} AS match_type FROM shown)
SELECT query_id, rank, phrase_id, intent, sim, match_type FROM typed
WHERE match_type IN ('Exact', 'Very High', 'High', 'Moderate', 'Low')""")
def q_search_match_types(spark, sf):
    r = S.result_table(single_hits(spark, sf), BANDS)
    r = S.filter_results(r, None, ["Exact", "Very High", "High", "Moderate", "Low"])
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "phrase_id", "intent", "sim",
                    "match_type")


DECISION_SQL = SINGLE_SQL + f""",
top10 AS (SELECT query_id, intent, count(*) AS cnt, min(rank) AS fr FROM shown WHERE rank <= 10 GROUP BY ALL),
mode AS (SELECT query_id, intent AS dominant_intent, cnt AS dominant_count FROM top10
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cnt DESC, fr) = 1),
firsts AS (SELECT query_id, sim AS top_similarity, intent AS top_intent FROM shown WHERE rank = 1),
n AS (SELECT query_id, count(*) AS n_results FROM shown GROUP BY ALL),
dec AS (
  SELECT f.query_id, f.top_similarity, f.top_intent, m.dominant_intent, m.dominant_count, n.n_results,
         m.dominant_count / least(10, n.n_results) AS conf
  FROM firsts f JOIN mode m ON m.query_id = f.query_id JOIN n ON n.query_id = f.query_id
)"""


@register("search_dominant", DECISION_SQL + f"""
SELECT query_id, top_similarity, top_intent, dominant_intent, dominant_count, n_results, round(conf, 6) AS confidence,
       {single_action_sql('top_similarity', 'conf', BANDS)} AS action,
       {sim_caption_sql('top_similarity', BANDS)} AS sim_caption,
       CASE WHEN conf > {BANDS.confidence} THEN 'High confidence' ELSE 'Mixed results' END AS confidence_caption
FROM dec""")
def q_search_dominant(spark, sf):
    return S.single_decision(single_hits(spark, sf), BANDS)


@register("search_frequency", SINGLE_SQL + """,
top10 AS (SELECT query_id, intent, count(*) AS cnt, min(rank) AS fr FROM shown WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, intent, cnt, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cnt DESC, fr) AS pos FROM top10) WHERE pos <= 3""")
def q_search_frequency(spark, sf):
    f = S.intent_frequency(single_hits(spark, sf))
    return f.select("query_id", "intent", "cnt", F.col("pos").cast("bigint").alias("pos"))


@register("search_stats", SINGLE_SQL + f"""
SELECT query_id, count(DISTINCT intent) AS unique_intents,
       count(*) FILTER (WHERE sim > {BANDS.stat_very}) AS very_similar,
       count(*) FILTER (WHERE sim > {BANDS.stat_high} AND sim <= {BANDS.stat_very}) AS high_similar,
       {avg6('sim')} AS avg_similarity
FROM shown GROUP BY query_id""")
def q_search_stats(spark, sf):
    return S.search_stats(single_hits(spark, sf), BANDS)


@register("search_distribution", SINGLE_SQL + f""",
per AS (SELECT query_id, intent, count(*) AS count, {avg6('sim')} AS avg_sim, max(sim) AS max_sim,
               min(sim) AS min_sim
        FROM shown GROUP BY ALL),
tot AS (SELECT query_id, count(*) AS tot FROM shown GROUP BY ALL)
SELECT p.query_id, p.intent, p.count, p.avg_sim, p.max_sim, p.min_sim,
       round(p.count * 100.0 / t.tot, 6) AS pct_results
FROM per p JOIN tot t ON t.query_id = p.query_id""")
def q_search_distribution(spark, sf):
    return S.intent_distribution(single_hits(spark, sf))


@register("search_histogram", SINGLE_SQL + """,
rng AS (SELECT query_id, min(sim) AS lo, max(sim) AS hi FROM shown GROUP BY ALL),
binned AS (
  SELECT s.query_id, CAST(CASE WHEN r.hi = r.lo THEN 1
                               ELSE least(floor((s.sim - r.lo) / (r.hi - r.lo) * 20) + 1, 20) END AS BIGINT) AS bin
  FROM shown s JOIN rng r ON r.query_id = s.query_id
)
SELECT query_id, bin, count(*) AS count FROM binned GROUP BY ALL""")
def q_search_histogram(spark, sf):
    return S.sim_histogram(single_hits(spark, sf))


@register("search_pie", SINGLE_SQL + """,
per AS (SELECT query_id, intent, count(*) AS count FROM shown GROUP BY ALL),
multi AS (SELECT query_id FROM per GROUP BY query_id HAVING count(*) > 1)
SELECT p.query_id, p.intent, p.count FROM per p JOIN multi m ON m.query_id = p.query_id""")
def q_search_pie(spark, sf):
    return S.intent_pie(single_hits(spark, sf))


@register("search_examples", DECISION_SQL + f"""
SELECT query_id, rank, phrase_id, sim, 'near_duplicate' AS kind FROM shown
WHERE rank <= 3 AND sim > {BANDS.cap_very_high}
UNION ALL
SELECT s.query_id, s.rank, s.phrase_id, s.sim, 'dominant_example' AS kind
FROM shown s JOIN dec d ON d.query_id = s.query_id
WHERE s.rank <= 5 AND s.intent = d.dominant_intent""")
def q_search_examples(spark, sf):
    hits = single_hits(spark, sf)
    ex = S.near_duplicate_examples(hits, S.single_decision(hits, BANDS), BANDS)
    return ex.select("query_id", F.col("rank").cast("bigint").alias("rank"), "phrase_id", "sim", "kind")
