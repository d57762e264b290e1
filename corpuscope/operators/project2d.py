"""2-D projection data for the scatter view (DIM-1 … DIM-4).

PCA (distributed Gramian) and landmarks: a seeded, partition-independent sample
whose coordinates are given, with every other point placed from its 5 nearest
landmarks (inverse-distance weights).  ``operators.layout2d`` computes landmark
coordinates that keep neighbourhoods.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import prefix
from corpuscope.operators.cells import TOP_SCHEMA, TopRows, resident_join
from corpuscope.operators.similarity import unit_vectors


def pca_2d(corpus: DataFrame, vec: str = "embedding", pre_dims: int = 50) -> DataFrame:
    """DIM-1 + DIM-4: PCA to ``pre_dims`` when n and d exceed it, then PCA to 2."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = corpus.select("phrase_id", "intent", "phrase", array_to_vector(vec).alias("v"))
    d = len(corpus.select(vec).first()[0]) if corpus.limit(1).count() else 0
    n = corpus.count()
    col = "v"
    if d > pre_dims and n > pre_dims:
        v = PCA(k=pre_dims, inputCol="v", outputCol="v50").fit(v).transform(v)
        col = "v50"
    pts = PCA(k=2, inputCol=col, outputCol="xy").fit(v).transform(v)
    xy = vector_to_array("xy")
    return pts.select("phrase_id", xy[0].alias("x"), xy[1].alias("y"), "intent",
                      prefix("phrase", 80).alias("phrase"))


def landmark_sample(corpus: DataFrame, cap: int = 5000, seed: int = 42) -> DataFrame:
    """DIM-2: ``cap`` rows without replacement, chosen by a seeded hash of the id
    (the same rows whatever the partitioning); all rows when n <= cap."""
    key = F.md5(F.concat(F.col("phrase_id").cast("string"), F.lit(f":{seed}")))
    return corpus.withColumn("_h", key).orderBy("_h", "phrase_id").limit(cap).drop("_h")


def landmark_place(corpus: DataFrame, landmarks: DataFrame, k: int = 5, vec: str = "embedding",
                   broadcast_bytes: int = 64 << 20) -> DataFrame:
    """DIM-3: coordinates of non-landmark points as the inverse-distance weighted
    mean of their ``k`` nearest landmarks by cosine distance (ties: smaller id).

    Points are scored against the landmark matrix by matrix products inside
    ``mapInPandas``; nothing is shuffled and no pair leaves a task.  The matrix is
    shipped to the tasks when its bytes fit ``broadcast_bytes``; a larger set streams
    past tiles of points (``cells.resident_join``).
    """
    lm = unit_vectors(landmarks.select(F.col("phrase_id").alias("lm_id"), F.col(vec).alias("lv"), "x", "y"), "lv") \
        .select("lm_id", F.col("u").alias("lu"), "x", "y")
    pts = unit_vectors(corpus.select("phrase_id", vec), vec).select("phrase_id", "u") \
        .join(lm.select(F.col("lm_id").alias("phrase_id")), "phrase_id", "left_anti")
    n, dim = lm.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("lu")), F.lit(1))).first()
    if n * 8 * (dim + 3) <= broadcast_bytes:
        own = lm.orderBy("lm_id").toPandas()
        near = pts.mapInPandas(_nearest(own, k), "phrase_id long, lm_id long, x double, y double, dist double")
    else:
        near = _nearest_streamed(pts, lm, k, dim, broadcast_bytes)
    w = 1.0 / (F.col("dist") + 1e-8)
    return near.groupBy("phrase_id").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"),
                                         (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))


def _nearest_streamed(pts: DataFrame, lm: DataFrame, k: int, dim: int, tile_bytes: int) -> DataFrame:
    """The ``k`` nearest landmarks where these are too many to ship: tasks keep a tile of points and
    stream their share of the landmarks past it."""
    spark = pts.sparkSession
    tiles = max(1, -(-pts.count() * (8 * dim + 32 + 40 * k) // tile_bytes))
    shares = max(1, -(-4 * spark.sparkContext.defaultParallelism // tiles))
    zero = [F.lit(0).alias("cell"), F.lit(0).alias("tile"), F.lit(-2.0).alias("floor")]
    residents = pts.select(F.pmod(F.xxhash64("phrase_id"), F.lit(tiles)).cast("int").alias("q"),
                           F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("h"), F.col("phrase_id").alias("id"),
                           F.lit(0).cast("long").alias("ipos"), F.lit(0).cast("long").alias("rpos"), *zero, F.col("u").alias("v"))
    streamed = lm.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("q"),
                         F.pmod(F.xxhash64("lm_id"), F.lit(shares)).cast("int").alias("h"), F.col("lm_id").alias("id"),
                         F.col("lm_id").alias("ipos"), F.lit(0).cast("long").alias("rpos"), *zero, F.col("lu").alias("v"))
    found = resident_join(residents, streamed, dim, lambda kept: TopRows(kept, k, np.ones((len(kept), 1), bool), places=12),
                          TOP_SCHEMA, min(4096, 2 * tiles * shares))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "jp")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return best.select(F.col("id").alias("phrase_id"), F.col("other_id").alias("lm_id"), F.round(1 - F.col("sim"), 12).alias("dist")) \
        .join(lm.select("lm_id", "x", "y"), "lm_id")


def _nearest(landmarks: pd.DataFrame, k: int):
    """The ``k`` nearest of ``landmarks`` (sorted by id) for every point of a batch, in tiles."""
    def score(batches):
        ids, xy = landmarks["lm_id"].to_numpy(np.int64), landmarks[["x", "y"]].to_numpy(np.float64)
        mat = np.stack(landmarks["lu"].values) if len(landmarks) else np.zeros((0, 1))
        for pdf in batches:
            for at in range(0, len(pdf) if len(ids) else 0, 1024):
                part = pdf.iloc[at:at + 1024]
                dist = np.round(1 - np.stack(part["u"].values) @ mat.T, 12)
                best = np.argsort(dist, axis=1, kind="stable")[:, :k]      # stable: ties stay in id order
                rows = np.repeat(np.arange(len(part)), best.shape[1])
                cols = best.ravel()
                yield pd.DataFrame({"phrase_id": part["phrase_id"].to_numpy(np.int64)[rows], "lm_id": ids[cols],
                                    "x": xy[cols, 0], "y": xy[cols, 1], "dist": dist[rows, cols]})
    return score
