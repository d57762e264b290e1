"""Exact deduplication with a heavy-hitter split (native).

1. Every text is normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space)
   and digested with SHA-256.  The slim (id, digest) table is stored once.
2. A Misra-Gries pass (``DataFrameStatFunctions.freqItems``) names at most
   ``1 / support`` digests; it finds every digest with more than ``support`` of
   the rows.  One aggregate verifies them: their true counts and winners.
3. The verified winners (at most ``1 / support`` rows) are broadcast, so copies
   of a heavy text are settled map-side and never meet in one task.
4. The other digests, each below ``support`` of the rows, go through an
   ordinary shuffle on the digest.

Defined results: null text counts as empty; all empty texts are equal.  A null
id sorts after every other id.  Of rows that tie on the smallest id, one stays.
An empty table gives an empty result.  Other columns are never read by
``exact_groups`` and pass through ``drop_exact_duplicates`` unchanged, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import fresh, materialize, row_key, whole_text

#: Share of the rows from which a digest is settled by broadcast.
SUPPORT = 1 / 1024


def normalised(text: str | Column = "text") -> Column:
    """The text with each white-space run as one space (single spaces are left as they are)."""
    return F.regexp_replace(whole_text(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def text_digest(text: str | Column = "text") -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def heavy_winners(slim: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests with at least ``support`` of the rows of ``slim(doc_id, text_sha256, rid)``.

    Returns ``text_sha256, h_size, h_first`` with ``h_first = (id is null, id,
    rid)`` of the row that stays; at most ``1 / support`` rows.
    """
    candidates = (slim.stat.freqItems(["text_sha256"], support)
                  .select(F.explode("text_sha256_freqItems").alias("text_sha256")))
    total = slim.agg(F.count(F.lit(1)).alias("n_rows"))
    counted = (slim.join(F.broadcast(candidates), "text_sha256", "left_semi")
               .groupBy("text_sha256")
               .agg(F.count(F.lit(1)).alias("h_size"), F.min(_order()).alias("h_first")))
    return (counted.join(F.broadcast(total), F.col("h_size") >= F.greatest(F.lit(2.0), support * F.col("n_rows")))
            .select("text_sha256", "h_size", "h_first"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 support: float = SUPPORT) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256"),
                                   F.monotonically_increasing_id().alias("rid")), "exact-digests")
    heavy = materialize(heavy_winners(slim, support), "exact-heavy")
    settled = slim.join(F.broadcast(heavy), "text_sha256").select(
        "doc_id", F.col("h_first.id").alias("keep_id"), F.col("h_size").alias("group_size"),
        (F.col("rid") == F.col("h_first.rid")).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = (slim.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
            .withColumn("first", F.min(_order()).over(group))
            .withColumn("group_size", F.count(F.lit(1)).over(group))
            .select("doc_id", F.col("first.id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256"))
    return settled.unionByName(rest)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each set of equal texts, that with the smallest id.

    Copies of heavy texts are dropped map-side.  The others keep the first row
    per digest: Spark limits each group before the shuffle (partial group
    limit), so a task sends at most one row per text.
    """
    digest, heavy_id, heavy_none, rank, tie = fresh(docs, "text_sha256", "heavy_id", "heavy_none", "rank", "tie")
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256"),
                                   F.lit(0).cast("long").alias("rid")), "exact-digests")
    heavy = materialize(heavy_winners(slim, support).select(
        F.col("text_sha256").alias(digest), F.col("h_first.id").alias(heavy_id),
        F.lit(True).alias(heavy_none)), "exact-heavy")
    rows = docs.withColumn(tie, row_key(docs)).withColumn(digest, text_digest(text_col))
    left = (rows.join(F.broadcast(heavy), digest, "left")
            .filter(F.col(heavy_none).isNull() | F.col(id_col).eqNullSafe(F.col(heavy_id))))
    first = Window.partitionBy(digest).orderBy(F.col(id_col).asc_nulls_last(), tie)
    return (left.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
