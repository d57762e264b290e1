"""Registered queries on labels derived from the tables, where the checks find something, and single
operators that other queries only reach through their callers (DQ-1, DQ-4, DIM-2, SIM-13, SIM-15, LIM-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import project2d as D
from corpuscope.operators import quality as Q
from corpuscope.operators import search as S
from corpuscope.operators import similarity as SIM
from corpuscope.plans import params as P
from corpuscope.plans.catalog import register
from corpuscope.plans.oracle_sql import CENTROIDS, CONFLICT_PAIRS, EMB_CORPUS, PAIRS, is_phrase, search_hits_sql, strip, validate_sql
from corpuscope.plans.q_keywords import confusing
from corpuscope.plans.q_recommend import analysis
from corpuscope.plans.q_search import batch_hits
from corpuscope.plans.q_similarity import prepared_corpus
from corpuscope.sources.corpus import long_to_corpus

LANDMARKS = 100
PAGE = 25

# every document; its label is the source, in capitals for French texts, and with a mark for very long ones
DERIVED = f"""
der_base AS (
  SELECT doc_id AS phrase_id, (CASE WHEN lang = 'fr' THEN upper(source) ELSE source END)
         || (CASE WHEN length(text) > 8000 THEN '-' || lang || '-long' ELSE '' END) AS intent,
         doc_id AS row_pos, {strip('text')} AS phrase FROM documents
),
der AS (SELECT phrase_id, intent, min(row_pos) OVER (PARTITION BY intent) AS intent_pos, row_pos, phrase
        FROM der_base WHERE {is_phrase('phrase')} AND intent IS NOT NULL)"""


@register("quality_report_derived", f"""WITH {DERIVED}, {validate_sql('der')}
SELECT check_no, pos, level, message FROM report""")
def q_quality_report_derived(spark, sf):
    """DQ-1 and DQ-4 with rows: small labels, and labels that differ in case alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = F.concat(F.when(F.col("lang") == "fr", F.upper("source")).otherwise(F.col("source")),
                     F.when(F.length("text") > 8000, F.concat(F.lit("-"), "lang", F.lit("-long"))).otherwise(""))
    return Q.validate(long_to_corpus(docs.select("doc_id", "text", label.alias("label")), "label", "text", "doc_id"))


@register("landmark_sample_100", f"""WITH {EMB_CORPUS}
SELECT phrase_id, intent FROM emb ORDER BY md5(CAST(phrase_id AS VARCHAR) || ':42'), phrase_id LIMIT {LANDMARKS}""")
def q_landmark_sample_100(spark, sf):
    """DIM-2 with a sample smaller than the table: the sample size is the feature."""
    return D.landmark_sample(prepared_corpus(spark, sf), LANDMARKS).select("phrase_id", "intent")


@register("confused_with_one", f"""WITH {EMB_CORPUS}, {CENTROIDS}, {PAIRS}
SELECT '{P.FILTER_INTENT}' AS intent, CASE WHEN intent_a = '{P.FILTER_INTENT}' THEN intent_b ELSE intent_a END AS other_intent,
       round(sim, 6) AS sim FROM pairs WHERE intent_a = '{P.FILTER_INTENT}' OR intent_b = '{P.FILTER_INTENT}'""")
def q_confused_with_one(spark, sf):
    """SIM-15 by its operator."""
    return SIM.confused_with(confusing(spark, sf), P.FILTER_INTENT).select("intent", "other_intent", F.round("sim", 6).alias("sim"))


@register("nested_matches", f"""WITH {search_hits_sql(P.SEARCH_T, P.SEARCH_TOPK)}
SELECT query_id, count(*) AS n, string_agg(CAST(phrase_id AS VARCHAR), ',' ORDER BY rank) AS ids,
       string_agg(intent, ',' ORDER BY rank) AS intents FROM hits GROUP BY query_id""")
def q_nested_matches(spark, sf):
    """SIM-13: the nested lists, shown as joined strings."""
    hits, _ = batch_hits(spark, sf)
    joined = lambda name: F.array_join(F.transform("matches", lambda m: m[name].cast("string")), ",")
    return S.nest_matches(hits).select("query_id", F.size("matches").cast("long").alias("n"), joined("idx").alias("ids"),
                                       joined("intent").alias("intents"))


@register("conflicts_page", f"""WITH {EMB_CORPUS}, {CONFLICT_PAIRS}, t AS (SELECT count(*) AS total FROM conf_pairs)
SELECT phrase_id, other_id, sim, total,
       CASE WHEN total > {PAGE} THEN printf('Showing %d of %d', {PAGE}, total) END AS caption
FROM conf_pairs CROSS JOIN t ORDER BY sim DESC, intent_pos, row_pos, other_pos, other_row LIMIT {PAGE}""")
def q_conflicts_page(spark, sf):
    """LIM-12: the page size is the feature."""
    _, _, conflicts = analysis(spark, sf)
    order = [F.desc("sim"), "intent_pos", "row_pos", "other_pos", "other_row"]
    return S.display_page(conflicts, order, PAGE).select("phrase_id", "other_id", "sim", "total", "caption")
