"""The corpus: one row per phrase with a stable order (SRC-3, SRC-4, PF-1, SRC-5).

Schema (``CORPUS_COLS``)::

    phrase_id  bigint   identity of the phrase
    intent     string   label
    intent_pos bigint   order of the label (column index, or first row id)
    row_pos    bigint   order of the phrase inside its label
    phrase     string   stripped text

The total order of the reference's flat phrase list is ``(intent_pos,
row_pos)``.  Pairs across two labels are therefore ordered by ``intent_pos``
alone, which the similarity joins use directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import is_phrase, py_strip
from corpuscope.session import materialize

CORPUS_COLS = ["phrase_id", "intent", "intent_pos", "row_pos", "phrase"]

# labels that are broadcast to their rows: a name and a number each
BROADCAST_LABELS = 100_000

# phrase ids of wide input: column index in the high bits, row index in the low
# 40 bits, so id order equals column-major order without any global sort.
ROW_BITS = 40


def wide_to_corpus(wide: DataFrame, intent_cols: list[str] | None = None,
                   row_col: str = "row_pos") -> DataFrame:
    """SRC-3 + SRC-4 + PF-1: wide table (one column per label) to the long corpus.

    ``wide`` carries a dense ``row_col``; every other column is a label.  Empty
    labels simply produce no rows.
    """
    cols = intent_cols or [c for c in wide.columns if c != row_col]
    if not cols:
        return wide.sparkSession.createDataFrame([], "phrase_id bigint, intent string, intent_pos bigint, "
                                                     "row_pos bigint, phrase string")
    stacked = wide.select(
        F.col(row_col).cast("long").alias("row_pos"),
        F.explode(F.array(*[
            F.struct(F.lit(i).cast("long").alias("intent_pos"), F.lit(c).alias("intent"),
                     F.col(f"`{c}`").cast("string").alias("raw"))
            for i, c in enumerate(cols)
        ])).alias("cell"),
    ).select("row_pos", "cell.*")
    cleaned = stacked.withColumn("phrase", py_strip("raw")).where(is_phrase(F.col("phrase")))
    return cleaned.select(
        (F.shiftleft(F.col("intent_pos"), ROW_BITS) + F.col("row_pos")).alias("phrase_id"),
        "intent", "intent_pos", "row_pos", "phrase")


def long_to_corpus(df: DataFrame, intent: str, phrase: str, order: str,
                   phrase_id: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """A long (label, text, order) table as a corpus.

    Labels are ordered by their first row (``min(order)``), the analogue of
    column order for long input.  The label map (a map-side combined ``groupBy``) is
    worked out and stored at once; when its counted rows are few it is broadcast, and no
    row is shuffled by label.
    """
    base = df.select(
        F.col(phrase_id or order).cast("long").alias("phrase_id"),
        F.col(intent).cast("string").alias("intent"),
        F.col(order).cast("long").alias("row_pos"),
        py_strip(F.col(phrase).cast("string")).alias("phrase"),
        *(extra or []),
    ).where(is_phrase(F.col("phrase")) & F.col("intent").isNotNull())
    first = materialize(base.groupBy("intent").agg(F.min("row_pos").alias("intent_pos")), "labels")
    return base.join(F.broadcast(first) if first.count() <= BROADCAST_LABELS else first, "intent").select(*CORPUS_COLS, *(extra or []))


def queries_from_text(spark, text: str) -> DataFrame:
    """SRC-5: pasted text → one query per non-blank line, trimmed, in order."""
    lines = text.strip().split("\n") if text else []
    rows = [(i, ln) for i, ln in enumerate(lines)]
    df = spark.createDataFrame(rows, "query_id bigint, query string")
    return df.withColumn("query", py_strip("query")).where(F.col("query") != "")


def queries_from_files(spark, path: str) -> DataFrame:
    """SRC-5 for files: every non-blank line of the text files under ``path``."""
    df = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("query_id"), py_strip("value").alias("query"))
    return df.where(F.col("query") != "")
