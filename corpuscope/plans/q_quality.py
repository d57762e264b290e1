"""Registered ingest and data-quality queries (SRC-3, SRC-4, PF-1, PF-8, PF-9, PF-18,
PF-19, DQ-1 … DQ-10, WIDE-1, LIM-3, AGG-24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import quality as Q
from corpuscope.plans import params as P
from corpuscope.plans.catalog import register
from corpuscope.plans.oracle_sql import DOC_CORPUS, PAGES_CORPUS, truncate_sql, validate_sql
from corpuscope.plans.q_similarity import prepared_documents
from corpuscope.sources.tables import documents_with_raw, pages_corpus


@register("corpus_long", f"""WITH {PAGES_CORPUS}
SELECT phrase_id, intent, intent_pos, row_pos, phrase FROM pg""")
def q_corpus_long(spark, sf):
    return pages_corpus(spark, sf)


@register("corpus_preview", f"""WITH {DOC_CORPUS},
sizes AS (SELECT intent, min(intent_pos) AS ip, count(*) AS total FROM doc GROUP BY intent),
firsts AS (SELECT * FROM sizes ORDER BY ip LIMIT 5),
sel AS (SELECT d.*, f.total, row_number() OVER (PARTITION BY d.intent ORDER BY d.row_pos) AS idx
        FROM doc d JOIN firsts f ON f.intent = d.intent)
SELECT intent, intent_pos, total, idx, phrase_id, {truncate_sql('phrase', 100)} AS display FROM sel WHERE idx <= 3""")
def q_corpus_preview(spark, sf):
    p = Q.preview(prepared_documents(spark, sf))
    return p.select("intent", "intent_pos", "total", F.col("idx").cast("bigint").alias("idx"), "phrase_id", "display")


@register("quality_report", f"""WITH {DOC_CORPUS}, {validate_sql('doc')}
SELECT check_no, pos, level, message FROM report""")
def q_quality_report(spark, sf):
    return Q.validate(prepared_documents(spark, sf))


@register("quality_report_pages", f"""WITH {PAGES_CORPUS}, {validate_sql('pg')}
SELECT check_no, pos, level, message FROM report""")
def q_quality_report_pages(spark, sf):
    return Q.validate(pages_corpus(spark, sf))


_DUPS = f"""WITH {DOC_CORPUS},
per AS (SELECT phrase, intent, count(*) AS cnt, min(intent_pos) AS ip, min(row_pos) AS rp FROM doc GROUP BY ALL),
g AS (
  SELECT phrase, CAST(sum(cnt) AS BIGINT) AS count, min(ip) AS first_pos, arg_min(rp, ip) AS first_row,
         string_agg(array_to_string(list_resize([intent], CAST(cnt AS INTEGER), intent), ', '), ', ' ORDER BY ip)
           AS appears_in,
         string_agg(intent, ', ' ORDER BY ip) AS appears_in_distinct
  FROM per GROUP BY phrase
)"""


@register("duplicate_phrases", _DUPS + f"""
SELECT {truncate_sql('phrase')} AS phrase, count, appears_in, first_pos, first_row FROM g WHERE count > 1""")
def q_duplicate_phrases(spark, sf):
    return Q.repeated_phrases(prepared_documents(spark, sf))


@register("duplicate_phrases_distinct", _DUPS + f"""
SELECT {truncate_sql('phrase')} AS phrase, count, appears_in_distinct AS appears_in, first_pos, first_row
FROM g WHERE count > 1 ORDER BY count DESC, first_pos, first_row LIMIT 50""")
def q_duplicate_phrases_distinct(spark, sf):
    return Q.repeated_phrases(prepared_documents(spark, sf), distinct_intents=True, top=50)


@register("dedupe_corpus", f"""WITH {DOC_CORPUS}
SELECT phrase_id, intent, phrase FROM doc
QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY intent_pos, row_pos) = 1""")
def q_dedupe_corpus(spark, sf):
    return Q.remove_repeats(prepared_documents(spark, sf)).select("phrase_id", "intent", "phrase")


@register("dedupe_within", """SELECT doc_id AS phrase_id, source AS intent, text AS raw FROM documents
WHERE source IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1""")
def q_dedupe_within(spark, sf):
    return Q.remove_repeats_within(documents_with_raw(spark, sf), "raw").select("phrase_id", "intent", "raw")


@register("wide_compact", f"""WITH {DOC_CORPUS},
kept AS (SELECT * FROM doc QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY intent_pos, row_pos) = 1),
ranked AS (SELECT intent, phrase, row_number() OVER (PARTITION BY intent ORDER BY row_pos) AS rn FROM kept)
SELECT rn, {", ".join(f"max(CASE WHEN intent = '{n}' THEN phrase END) AS {n}" for n in P.DOC_LABELS)}
FROM ranked GROUP BY rn""")
def q_wide_compact(spark, sf):
    return Q.compact_wide(Q.remove_repeats(prepared_documents(spark, sf)), P.DOC_LABELS)


@register("load_counts", f"""WITH {DOC_CORPUS}
SELECT count(*) AS total_phrases, count(DISTINCT intent) AS total_intents, count(*) > 1000 AS is_large FROM doc""")
def q_load_counts(spark, sf):
    return Q.load_counts(prepared_documents(spark, sf))
