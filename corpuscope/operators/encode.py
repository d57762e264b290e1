"""Embedding operators (EMB-1 … EMB-6).

* ``encode``: text → ``embedding array<double>`` with a pluggable encoder.
  - ``HashingEncoder`` is a deterministic stand-in that runs entirely as Spark
    SQL (tokens → md5 bucket and sign → two aggregations), so it needs no
    Python on executors and can be recomputed by any SQL engine.
  - Any other encoder is a factory returning ``f(list[str]) -> 2-D array``;
    it runs in an iterator pandas UDF, built once per Python worker and fed
    Arrow batches (EMB-1).
* ``mean_pool`` / ``cls_pool``: pooling over a token table (EMB-2, EMB-3).
* ``normalise``: L2 normalisation (EMB-4); unknown pooling names raise
  (EMB-5); empty input gives an empty frame with the schema (EMB-6).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions.text import WORD_TOKEN
from corpuscope.functions.vectors import l2_normalise, norm


def _densify_udf(dim: int, normalize: bool = True):
    """Signed bucket codes (b ≥ 0 for +1, -(b+1) for -1) → dense vectors, L2-normalised or as counted.

    Vectorised over the whole Arrow batch: one ``np.add.at`` scatter, no
    per-row Python loop.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def densify(codes: pd.Series) -> pd.Series:
        n = len(codes)
        mat = np.zeros((n, dim), dtype=np.float64)
        lens = codes.map(lambda a: 0 if a is None else len(a)).to_numpy()
        if lens.sum() > 0:
            flat = np.concatenate([np.asarray(a, dtype=np.int64) for a in codes.values if a is not None and len(a)])
            rows = np.repeat(np.arange(n), lens)
            pos = flat >= 0
            np.add.at(mat, (rows, np.where(pos, flat, -flat - 1)), np.where(pos, 1.0, -1.0))
        if normalize:
            nrm = np.sqrt((mat * mat).sum(axis=1))
            nrm[nrm == 0] = 1.0
            mat /= nrm[:, None]
        return pd.Series(list(mat))
    return densify


class HashingEncoder:
    """Signed feature hashing of lower-cased word tokens into ``dim`` buckets.

    bucket = first 8 hex digits of md5(token) mod dim; sign = + when the 9th
    hex digit is below 8.  Vectors are L2-normalised (zero stays zero).

    Tokenising and hashing are JVM expressions on each row; only the final
    scatter into a dense vector runs in an Arrow-batched pandas UDF.  The
    whole encoder is map-only: no shuffle, linear in the text size, and a
    long text is processed whole inside its own row.
    """

    def __init__(self, dim: int = 256):
        self.dim = int(dim)

    def codes(self, text) -> Column:
        toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_TOKEN), 0)

        def code(t):
            h = F.md5(t)
            b = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % self.dim
            return F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, b).otherwise(-b - 1)
        return F.transform(toks, code)

    def column(self, text, normalize: bool = True) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return _densify_udf(self.dim, normalize)(self.codes(text))

    def encode(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return df.select(id_col, self.column(text_col).alias("embedding"))


def _pandas_encoder(factory: Callable[[], Callable], batch_size: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()           # built once per Python worker
        for texts in batches:
            if len(texts) == 0:
                yield pd.Series([], dtype=object)
                continue
            held = texts.fillna("").tolist()
            parts = [np.asarray(model(held[i:i + batch_size]), dtype=np.float64) for i in range(0, len(held), batch_size)]
            yield pd.Series([row for part in parts for row in part])
    return enc


def encode(df: DataFrame, text_col: str = "phrase", id_col: str = "phrase_id", encoder=None,
           normalize: bool = True, batch_size: int = 32) -> DataFrame:
    """EMB-1: ``df`` + ``embedding``.  ``encoder`` is a ``HashingEncoder`` or a
    zero-argument factory returning ``f(list[str]) -> array (n, d)``, which is given
    ``batch_size`` texts at a time."""
    encoder = encoder or HashingEncoder()
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if isinstance(encoder, HashingEncoder):
        return df.withColumn("embedding", encoder.column(text_col, normalize))
    out = df.withColumn("embedding", _pandas_encoder(encoder, batch_size)(F.col(text_col)))
    if normalize:
        out = out.withColumn("_n", norm("embedding")).withColumn(
            "embedding", l2_normalise("embedding", "_n")).drop("_n")
    return out


def normalise(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """EMB-4 as a frame operator."""
    return df.withColumn("_n", norm(vec)).withColumn(vec, l2_normalise(vec, "_n")).drop("_n")


POOLING = ("mean", "cls")
SUM_DIMS = 64     # numbers of a vector up to which each is summed by an aggregate of its own


def pool(tokens: DataFrame, strategy: str = "mean", normalize: bool = True, first_pos: int | None = None,
         dim: int | None = None) -> DataFrame:
    """EMB-2 / EMB-3 over ``(phrase_id, token_pos, mask, vec array<double>)``.

    Mean pooling is one weighted vector aggregate (``Summarizer``, mask as weight) that is
    combined in every task, so a very long text is summed in pieces.  Where all vectors are known to
    have ``dim`` numbers, ``SUM_DIMS`` at most, plain sums take its place: one pass, and no object per phrase.
    A phrase whose masks are all 0 has the zero vector.  CLS pooling takes each phrase's first token; where every
    phrase's positions are known to begin at ``first_pos``, other tokens are not sorted and aggregated.
    """
    if strategy not in POOLING:
        raise ValueError(f"Unsupported pooling strategy: {strategy}")   # EMB-5
    if strategy == "cls":
        tokens = tokens if first_pos is None else tokens.where(F.col("token_pos") == first_pos)
        out = tokens.groupBy("phrase_id").agg(F.min_by("vec", "token_pos").alias("embedding"))
    elif dim is not None and dim <= SUM_DIMS:
        weight = F.col("mask").cast("double")
        sums = tokens.groupBy("phrase_id").agg(F.sum(F.when(weight > 0, weight)).alias("w"), *[
            F.sum(F.when(weight > 0, F.col("vec")[i] * weight)).alias(f"s{i}") for i in range(dim)])
        out = sums.select("phrase_id", F.array(*[
            F.when(F.col("w").isNull(), F.lit(0.0)).otherwise(F.col(f"s{i}") / F.col("w")) for i in range(dim)]).alias("embedding"))
    else:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        weight = F.col("mask").cast("double")
        means = tokens.where(weight > 0).groupBy("phrase_id").agg(
            Summarizer.mean(array_to_vector("vec"), weight).alias("m"))
        every = tokens.groupBy("phrase_id").agg(F.max(F.size("vec")).alias("d"))
        zero = F.transform(F.sequence(F.lit(1), F.col("d")), lambda _: F.lit(0.0))
        out = every.join(means, "phrase_id", "left").select(
            "phrase_id", F.when(F.col("m").isNull(), zero).otherwise(vector_to_array("m")).alias("embedding"))
    return normalise(out) if normalize else out
