"""Registered keyword queries (KW-1 … KW-7, SET-2 … SET-4, SIM-14, SIM-15, LIM-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import keywords as K
from corpuscope.operators import similarity as S
from corpuscope.operators.textstore import keywords_once, shared_store
from corpuscope.plans import params as P
from corpuscope.plans.catalog import register
from corpuscope.plans.oracle_sql import (CENTROIDS, CONV_CORPUS, DOC_CORPUS, EMB_CORPUS, PAIRS, keywords_sql,
                                         overlap_sql, terms_sql, tfidf_sql)
from corpuscope.plans.prepared import prepared
from corpuscope.plans.q_similarity import prepared_corpus, prepared_documents
from corpuscope.sources.tables import conversations_corpus


def confusing(spark, sf, corpus=None):
    """Confusing label pairs of the embedded corpus, stored once (labels² rows at most)."""
    corpus = corpus if corpus is not None else prepared_corpus(spark, sf)
    return prepared(spark, f"confusing_pairs_{P.PAIR_T}", sf, ["embeddings", "documents"],
                    lambda: S.confusing_pairs(S.intent_matrix(S.intent_centroids(corpus)), P.PAIR_T, P.TABLE_BANDS))


@register("keywords", f"""WITH {DOC_CORPUS}
SELECT phrase_id, array_to_string({keywords_sql('phrase')}, ' ') AS keywords,
       CAST(len({keywords_sql('phrase')}) AS BIGINT) AS n_keywords FROM doc""")
def q_keywords(spark, sf):
    k = K.phrase_keywords(prepared_documents(spark, sf))
    return k.select("phrase_id", F.array_join("keywords", " ").alias("keywords"),
                    F.size("keywords").cast("bigint").alias("n_keywords"))


@register("keywords_stored", f"""WITH {DOC_CORPUS}
SELECT phrase_id, array_to_string({keywords_sql('phrase')}, ' ') AS keywords, 0::BIGINT AS computed_again FROM doc""")
def q_keywords_stored(spark, sf):
    """KW-7: keywords from the store, after an earlier run over the same corpus; the second run computes none."""
    corpus, store, again = prepared_documents(spark, sf), shared_store(spark, "keywords-multi", "array<string>"), {}
    keywords_once(corpus, store)
    k = keywords_once(corpus, store, stats=again)
    return k.select("phrase_id", F.array_join("keywords", " ").alias("keywords"),
                    F.lit(again["computed"]).cast("long").alias("computed_again"))


@register("keywords_ascii", f"""WITH {DOC_CORPUS}
SELECT phrase_id, array_to_string({keywords_sql('phrase', 'ascii')}, ' ') AS keywords,
       CAST(len({keywords_sql('phrase', 'ascii')}) AS BIGINT) AS n_keywords FROM doc""")
def q_keywords_ascii(spark, sf):
    k = K.phrase_keywords(prepared_documents(spark, sf), "ascii")
    return k.select("phrase_id", F.array_join("keywords", " ").alias("keywords"),
                    F.size("keywords").cast("bigint").alias("n_keywords"))


@register("keyword_overlap", f"""WITH {EMB_CORPUS}, {CENTROIDS}, {PAIRS}, {terms_sql('emb')}, {overlap_sql('pairs')}
SELECT * FROM overlap""")
def q_keyword_overlap(spark, sf):
    corpus = prepared_corpus(spark, sf)
    terms = prepared(spark, "intent_terms", sf, ["embeddings", "documents"], lambda: K.intent_terms(corpus))
    return K.keyword_overlap(terms, confusing(spark, sf, corpus))


@register("tfidf_terms", f"""WITH {CONV_CORPUS}, {tfidf_sql('conv')} SELECT * FROM tfidf""")
def q_tfidf_terms(spark, sf):
    t = K.tfidf_terms(prepared(spark, 'conversations_corpus', sf, ['conversations'], lambda: conversations_corpus(spark, sf)))
    return t.select("intent", "term", "score", F.col("rank").cast("bigint").alias("rank"))


@register("keyword_counts", f"""WITH {CONV_CORPUS},
ex AS (SELECT c.intent, c.row_pos, t.term, t.pos
       FROM conv c, (SELECT unnest(k) AS term, unnest(range(1, len(k) + 1)) AS pos
                     FROM (SELECT {keywords_sql('c.phrase')} AS k)) t),
g AS (SELECT intent, term, count(*) AS count, min((row_pos, pos)) AS first FROM ex GROUP BY ALL)
SELECT intent, term, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY intent ORDER BY count DESC, first) AS rank FROM g) WHERE rank <= 50""")
def q_keyword_counts(spark, sf):
    c = K.keyword_counts(prepared(spark, 'conversations_corpus', sf, ['conversations'], lambda: conversations_corpus(spark, sf)))
    return c.select("intent", "term", "count", F.col("rank").cast("bigint").alias("rank"))


@register("pair_keywords", f"""WITH {EMB_CORPUS}, {CENTROIDS}, {PAIRS}, {terms_sql('emb')},
first5 AS (SELECT * FROM pairs ORDER BY a_pos, b_pos LIMIT 5),
{overlap_sql('first5')}, {tfidf_sql('emb', 50, 10)},
tops AS (SELECT intent, string_agg(term, ', ' ORDER BY rank) AS terms FROM tfidf GROUP BY intent)
SELECT f.intent_a, f.intent_b, round(f.sim, 6) AS sim, o.n_common, o.common,
       coalesce(ta.terms, '') AS a_terms, coalesce(tb.terms, '') AS b_terms
FROM first5 f JOIN overlap o ON o.intent_a = f.intent_a AND o.intent_b = f.intent_b
LEFT JOIN tops ta ON ta.intent = f.intent_a LEFT JOIN tops tb ON tb.intent = f.intent_b""")
def q_pair_keywords(spark, sf):
    corpus = prepared_corpus(spark, sf)
    first5 = confusing(spark, sf, corpus).orderBy("a_pos", "b_pos").limit(5)
    ov = K.keyword_overlap(prepared(spark, "intent_terms", sf, ["embeddings", "documents"], lambda: K.intent_terms(corpus)), first5)
    tf = K.tfidf_terms(corpus, 50, 10)
    tops = tf.groupBy("intent").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias("terms"))
    out = first5.join(ov, ["intent_a", "intent_b"]) \
        .join(tops.select(F.col("intent").alias("intent_a"), F.col("terms").alias("a_terms")), "intent_a", "left") \
        .join(tops.select(F.col("intent").alias("intent_b"), F.col("terms").alias("b_terms")), "intent_b", "left")
    return out.select("intent_a", "intent_b", F.round("sim", 6).alias("sim"), "n_common", "common",
                      F.coalesce("a_terms", F.lit("")).alias("a_terms"), F.coalesce("b_terms", F.lit("")).alias("b_terms"))


@register("target_keywords", f"""WITH {EMB_CORPUS}, {CENTROIDS}, {PAIRS}, {terms_sql('emb')},
both_ AS (SELECT intent_a AS intent, intent_b AS other FROM pairs UNION ALL SELECT intent_b, intent_a FROM pairs),
uniq AS (SELECT b.intent, b.other, t.term FROM both_ b JOIN terms t ON t.intent = b.intent
         WHERE NOT EXISTS (SELECT 1 FROM terms o WHERE o.intent = b.other AND o.term = t.term)),
firsts AS (SELECT DISTINCT intent, term FROM (
  SELECT *, row_number() OVER (PARTITION BY intent, other ORDER BY term) AS r FROM uniq) WHERE r <= 5),
shown AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY term) AS r FROM firsts)
SELECT intent, string_agg(term, ', ' ORDER BY term) AS hints, count(*) AS n_hints FROM shown WHERE r <= 10 GROUP BY intent""")
def q_target_keywords(spark, sf):
    corpus = prepared_corpus(spark, sf)
    return K.target_hints(prepared(spark, "intent_terms", sf, ["embeddings", "documents"], lambda: K.intent_terms(corpus)), confusing(spark, sf, corpus))


@register("confused_with", f"""WITH {EMB_CORPUS}, {CENTROIDS}, {PAIRS},
both_ AS (SELECT intent_a AS intent, intent_b AS other_intent, round(sim, 6) AS sim FROM pairs
          UNION ALL SELECT intent_b, intent_a, round(sim, 6) FROM pairs)
SELECT intent, other_intent, sim FROM both_""")
def q_confused_with(spark, sf):
    pairs = confusing(spark, sf)
    names = pairs.select(F.col("intent_a").alias("intent")).union(pairs.select("intent_b")).distinct()
    a = pairs.join(names.withColumnRenamed("intent", "intent_a"), "intent_a").select(
        F.col("intent_a").alias("intent"), F.col("intent_b").alias("other_intent"), "sim")
    b = pairs.select(F.col("intent_b").alias("intent"), F.col("intent_a").alias("other_intent"), "sim")
    return a.unionByName(b).select("intent", "other_intent", F.round("sim", 6).alias("sim"))
