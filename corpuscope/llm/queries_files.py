"""Queries of the operators that write files, mix and pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.llm.common import materialize
from corpuscope.llm.packing import pack_documents
from corpuscope.llm.queries import register
from corpuscope.llm.source_mix import fit, mix, mix_sql
from corpuscope.llm.token_files import read_token_files, write_token_files
from corpuscope.llm.warc import read_records, resolve_revisits, write_archives

#: Vocabulary file of the queries and the ids that end a document.
TOKENIZER = "word_bpe_49k.json"
FILE_END_ID, PACK_END_ID = 2, 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@register("op5_source_mix", mix_sql())
def op5_source_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, fit(docs))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, url,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to
FROM h"""


@register("op6_warc", OP6_SQL)
def op6_warc(spark, sf_dir):
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = materialize(read_records(index), "warc-records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@register("op8_token_files")
def op8_token_files(spark, sf_dir):
    """No SQL: tests hold it against whole texts encoded by the tokenizer itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, tokenizer_path(), FILE_END_ID))


@register("op10_packing")
def op10_packing(spark, sf_dir):
    """No SQL: tests hold the pieces against the tokenizer and the plan against its lower bound."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_path(), PACK_END_ID).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
