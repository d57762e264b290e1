"""Queries of the deduplication operators."""

from __future__ import annotations

from corpuscope.llm.exact_dedup import exact_groups
from corpuscope.llm.near_dedup import near_groups
from corpuscope.llm.queries import register

OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d"""


@register("op1_exact_dedup", OP1_SQL)
def op1_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@register("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    """No SQL: tests hold it against all pairs by brute force."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
