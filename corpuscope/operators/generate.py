"""Paraphrase generation jobs and appending phrases (GEN-1 … GEN-3, SET-1).

The generator is pluggable: a function from the prompt ``Column`` to a
``Column`` (runs as SQL), or a factory returning ``f(list[str]) -> list[str]``
that runs in an iterator pandas UDF, built once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions.text import py_strip
from corpuscope.operators.ordering import rank_within


def echo_generator(prompt: Column, variation: Column) -> Column:
    """Deterministic stand-in for a paraphrase model: echoes the phrase with
    the variation number, in the model output format ('paraphrased: …')."""
    body = F.regexp_replace(F.regexp_replace(prompt, "^paraphrase: ", ""), " </s>$", "")
    return F.concat(F.lit("paraphrased: "), body, F.lit(" (variation "), variation.cast("string"), F.lit(")"))


def prompt_for(phrase: Column, model_name: str) -> Column:
    """GEN-2: the prompt format depends on the model family."""
    if "chatgpt_paraphraser" in model_name:
        return F.concat(F.lit("paraphrase: "), phrase)
    return F.concat(F.lit("paraphrase: "), phrase, F.lit(" </s>"))


def _pandas_generator(factory: Callable[[], Callable]):
    @F.pandas_udf(T.StringType())
    def gen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()))
    return gen


def paraphrase_jobs(corpus: DataFrame, model_name: str, num_variations: int = 2, max_phrases: int | None = None,
                    generator=echo_generator, strategy: str = "Diverse Variations",
                    generated_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """GEN-1 + GEN-3 for every label: its phrases × ``num_variations`` prompts →
    generator → 'paraphrased: ' removed, stripped.

    With ``max_phrases`` only the first so many phrases of each label take part:
    ``row_number <= max_phrases`` plans as a ``WindowGroupLimit`` (bounded per
    label before the shuffle), and ``was_limited`` flags labels that had more.
    """
    sizes = corpus.groupBy("intent").agg(F.count(F.lit(1)).alias("_n"))
    first = corpus
    if max_phrases is not None:
        w = Window.partitionBy("intent").orderBy("row_pos")
        first = corpus.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_phrases)
    jobs = first.select("intent", "intent_pos", "row_pos", "phrase_id", "phrase",
                        F.explode(F.sequence(F.lit(1), F.lit(num_variations))).alias("variation"))
    jobs = jobs.withColumn("prompt", prompt_for(F.col("phrase"), model_name))
    if getattr(getattr(generator, "__code__", None), "co_argcount", 0) == 2:
        raw = generator(F.col("prompt"), F.col("variation"))
    else:
        raw = _pandas_generator(generator)(F.col("prompt"))
    out = jobs.withColumn("generated", py_strip(F.replace(raw, F.lit("paraphrased: "), F.lit(""))))
    return out.join(sizes, "intent").select(
        "intent", "intent_pos", "row_pos", "phrase_id", F.col("variation").cast("long").alias("variation"),
        "prompt", "generated", (F.lit(False) if max_phrases is None else F.col("_n") > max_phrases).alias("was_limited"),
        F.lit(strategy).alias("strategy"), F.lit(int(num_variations)).cast("long").alias("num_variations"),
        F.lit(generated_at).alias("generated_at"), F.lit(model_name).alias("model_used"))


def clear_generated(generated: DataFrame) -> DataFrame:
    """GEN-3: the record of generated phrases, cleared: no rows, the same columns."""
    return generated.where(F.lit(False))


def append_generated(corpus: DataFrame, generated: DataFrame) -> DataFrame:
    """SET-1: add generated phrases to their label after its current last row.

    New rows get ``row_pos`` = label max + their rank by (source row, variation),
    counted in ranges of the source row, so a hot label is not sorted in one task.
    """
    last = corpus.groupBy("intent").agg(F.max("row_pos").alias("_last"), F.min("intent_pos").alias("_ip"))
    g = rank_within(generated, "intent", ["row_pos", "variation"], "_k").join(last, "intent")
    new = g.select(F.lit(None).cast("long").alias("phrase_id"), "intent", F.col("_ip").alias("intent_pos"),
                   (F.col("_last") + F.col("_k")).alias("row_pos"), F.col("generated").alias("phrase"),
                   F.lit(True).alias("is_generated"))
    old = corpus.select("phrase_id", "intent", "intent_pos", "row_pos", "phrase", F.lit(False).alias("is_generated"))
    return old.unionByName(new)
