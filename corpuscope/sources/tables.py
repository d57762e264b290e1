"""Bindings of the driver's parquet tables to the audit data model.

* ``documents``  → text corpus: label = ``source``, phrase = ``text``, order = ``doc_id``.
* ``embeddings ⋈ documents`` (``vec_id = doc_id``) → embedded corpus:
  label = ``'label_' || label``, phrase = ``text``, vector = ``embedding``.
* ``benchmark``  → batch query texts.
* ``conversations`` → corpus with ``role`` as label (TF-IDF).
* ``pages``      → URL / HTML phrases for the data-quality checks.
* ``events``     → append-only search history.

Every reader prunes to the columns it needs, so the parquet scan reads only
those (``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import spread
from corpuscope.sources.corpus import long_to_corpus, wide_to_corpus


BROADCAST_IDS = 1_000_000    # ids of embedded documents that are broadcast to the documents
BROADCAST_VECTORS = 64 << 20 # bytes of vectors that are broadcast to the documents, whose texts are then not shuffled


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return long_to_corpus(docs, intent="source", phrase="text", order="doc_id")


def embedded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with ``embedding array<float>`` (already unit-normalised upstream)."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, values = emb.agg(F.count(F.lit(1)), F.sum(F.size("embedding"))).first()
    if rows <= BROADCAST_IDS:  # texts of documents without a vector are not shuffled
        docs = docs.join(F.broadcast(emb.select(F.col("vec_id").alias("doc_id"))), "doc_id", "left_semi")
    docs = spread(docs)
    emb = F.broadcast(emb) if 64 * rows + 4 * (values or 0) <= BROADCAST_VECTORS else spread(emb)
    joined = docs.join(emb, emb.vec_id == docs.doc_id).select(
        "vec_id", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("intent"),
        "text", "embedding")
    return long_to_corpus(joined, intent="intent", phrase="text", order="vec_id", extra=["embedding"])


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select(
        (F.shiftleft(F.col("conv_id").cast("long"), 31) + F.col("turn")).alias("ord"), "role", "text")
    return long_to_corpus(conv, intent="role", phrase="text", order="ord")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` read as a wide table: two labels, ``url`` and ``html``, one row per page."""
    pages = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return wide_to_corpus(pages.withColumnRenamed("page_id", "row_pos"), ["url", "html"])


def documents_with_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents corpus that also keeps the unstripped cell as ``raw`` (DQ-10)."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).withColumn("raw", F.col("text"))
    return long_to_corpus(docs, intent="source", phrase="text", order="doc_id", extra=["raw"])
