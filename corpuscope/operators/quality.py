"""Data-quality checks, repeats and de-duplication (DQ-1 … DQ-10, WIDE-1,
PF-18, PF-19, AGG-24).

All checks are aggregations with map-side combine.  Where a result lists
labels per repeated text, the text is first reduced to one row per
(text, label); only DQ-7, whose result names a label once per occurrence, repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import py_strip, truncate
from corpuscope.operators.ordering import first_per_key, rank_within

URL_RE = "^https?://"
HTML_RE = "<[^>]+>"
DIGITS_RE = r"^\p{Nd}+$"

REPORT_COLS = ["check_no", "pos", "level", "message"]


def validate(corpus: DataFrame, min_phrases: int = 3, long_chars: int = 500) -> DataFrame:
    """DQ-1 … DQ-6: one report, checks in fixed order, labels in label order."""
    sizes = corpus.groupBy("intent").agg(
        F.min("intent_pos").alias("intent_pos"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.length("phrase") > long_chars).alias("n_long"),
        (F.count_if(F.col("phrase").rlike(URL_RE)) + F.count_if(F.col("phrase").rlike(HTML_RE))
         + F.count_if(F.regexp_replace("phrase", "[.,]", "").rlike(DIGITS_RE))).alias("n_nontext"))
    few = sizes.where(F.col("n") < min_phrases).select(
        F.lit(1).alias("check_no"), F.col("intent_pos").alias("pos"), F.lit("warning").alias("level"),
        F.format_string("Intent '%s' has only %d phrase(s) -- too few for meaningful analysis.",
                        "intent", "n").alias("message"))
    long_ = sizes.where(F.col("n_long") > 0).select(
        F.lit(2).alias("check_no"), F.col("intent_pos").alias("pos"), F.lit("warning").alias("level"),
        F.format_string("Intent '%s' has %d phrase(s) longer than %d characters -- possible data error.",
                        "intent", "n_long", F.lit(long_chars)).alias("message"))
    nontext = sizes.where(F.col("n_nontext") > 0).select(
        F.lit(3).alias("check_no"), F.col("intent_pos").alias("pos"), F.lit("warning").alias("level"),
        F.format_string("Intent '%s' has %d non-text phrase(s) (URLs/HTML/numbers).",
                        "intent", "n_nontext").alias("message"))
    keyed = sizes.select("intent", "intent_pos", F.lower(py_strip("intent")).alias("key"))
    names = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.min("intent_pos").alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("intent_pos", "intent"))),
                                 lambda s: s["intent"]), ", ").alias("names"))
    dup_names = names.where(F.col("k") > 1).select(
        F.lit(4).alias("check_no"), "pos", F.lit("error").alias("level"),
        F.concat(F.lit("Duplicate intent names (case-insensitive): "), F.col("names")).alias("message"))
    tot = corpus.agg((F.count(F.lit(1)) - F.count_distinct("phrase")).alias("d"))
    repeats = tot.where(F.col("d") > 0).select(
        F.lit(5).alias("check_no"), F.lit(0).cast("long").alias("pos"), F.lit("warning").alias("level"),
        F.format_string("Found %d duplicate phrase(s) across intents. This may inflate similarity scores.",
                        "d").alias("message"))
    return few.unionByName(long_).unionByName(nontext).unionByName(dup_names).unionByName(repeats)


def _per_text_intent(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("phrase", "intent").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("intent_pos").alias("intent_pos"),
        F.min(F.struct("intent_pos", "row_pos")).alias("first"))


def repeated_phrases(corpus: DataFrame, distinct_intents: bool = False, top: int | None = None) -> DataFrame:
    """DQ-7 (``distinct_intents=False``): texts seen more than once, count desc,
    ties by first occurrence; ``appears_in`` names a label once per occurrence.
    DQ-8 (``distinct_intents=True``, usually ``top=50``): each label once.
    """
    per = _per_text_intent(corpus)
    names = (F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("intent_pos", "intent", "cnt"))),
                                   lambda s: F.array_repeat(s["intent"], s["cnt"].cast("int"))))
             if not distinct_intents else
             F.transform(F.array_sort(F.collect_list(F.struct("intent_pos", "intent"))), lambda s: s["intent"]))
    g = per.groupBy("phrase").agg(F.sum("cnt").alias("count"), F.min("first").alias("first"),
                                  F.array_join(names, ", ").alias("appears_in"))
    out = g.where(F.col("count") > 1).select(
        truncate("phrase", 80).alias("phrase"), "count", "appears_in",
        F.col("first.intent_pos").alias("first_pos"), F.col("first.row_pos").alias("first_row"))
    if top is not None:
        out = out.orderBy(F.desc("count"), "first_pos", "first_row").limit(top)
    return out


def remove_repeats(corpus: DataFrame) -> DataFrame:
    """DQ-9: keep each text once over the whole corpus, first in label order.

    Repeats inside one label are removed too (trap T-11)."""
    return first_per_key(corpus, ["phrase"], ["intent_pos", "row_pos"], "phrase_id")


def remove_repeats_within(corpus: DataFrame, raw_col: str = "raw") -> DataFrame:
    """DQ-10: keep each *raw* value once inside its own label."""
    return first_per_key(corpus, ["intent", raw_col], ["row_pos"], "phrase_id")


def compact_wide(corpus: DataFrame, names: list[str] | None = None) -> DataFrame:
    """WIDE-1: long → wide with every column shifted up; all-null rows cannot occur."""
    ranked = rank_within(corpus.select("intent", "intent_pos", "row_pos", "phrase"), "intent",
                         ["row_pos"], "rn")
    g = ranked.groupBy("rn")
    p = g.pivot("intent", names) if names is not None else g.pivot("intent")
    return p.agg(F.first("phrase"))


def preview(corpus: DataFrame, n_intents: int = 5, n_phrases: int = 3, width: int = 100) -> DataFrame:
    """PF-18: first ``n_phrases`` (cut at ``width``) and the total, for the first ``n_intents`` labels."""
    sizes = corpus.groupBy("intent").agg(F.min("intent_pos").alias("intent_pos"),
                                         F.count(F.lit(1)).alias("total"))
    first_intents = sizes.orderBy("intent_pos").limit(n_intents)
    sel = corpus.join(first_intents.select("intent", "total"), "intent")
    w = Window.partitionBy("intent").orderBy("row_pos")
    top = sel.withColumn("idx", F.row_number().over(w)).where(F.col("idx") <= n_phrases)
    return top.select("intent", "intent_pos", "total", "idx", "phrase_id", truncate("phrase", width).alias("display"))


def load_counts(corpus: DataFrame, large: int = 1000) -> DataFrame:
    """AGG-24 + PF-19: phrase total, label total, large-corpus flag."""
    return corpus.agg(F.count(F.lit(1)).alias("total_phrases"),
                      F.count_distinct("intent").alias("total_intents")).withColumn(
        "is_large", F.col("total_phrases") > large)
