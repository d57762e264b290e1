"""2-D layout that keeps neighbourhoods (DIM-4 with DIM-2 and DIM-3).

At most ``cap`` landmarks (a seeded sample, ``project2d.landmark_sample``) are laid
out by the gradient of t-SNE on their graph of nearest neighbours; every other
phrase is placed from its nearest landmarks.  The graph is the exact join of
``similarity._nearest``.  A round is one map job over the stored graph: the tasks
get the coordinates (2 x ``cap`` numbers), each row's task works out the pull of its
neighbours and the push of all landmarks, and at most ``cap`` sums come back.
Nothing is shuffled in a round, and a lost executor costs a part of one.

``neighbour_layout`` runs its jobs at once.  Results are the same whatever the
partitioning: sums are taken per row, in the order of the neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators import similarity as S
from corpuscope.operators.cells import PRODUCT_ROWS, TILE_BYTES
from corpuscope.operators.project2d import landmark_place, landmark_sample, pca_2d
from corpuscope.session import materialize, spread

CAP = 5000                # fixed value: landmarks that are laid out
NEIGHBOURS = 15
ROUNDS, EARLY, EXAGGERATION = 40, 12, 4.0


def neighbour_graph(points: DataFrame, vec: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """(i, others array<int>, p array<double>, nearest array<int>): rows of ``points`` numbered in the order of their id,
    their neighbours in either direction with the symmetric weights of t-SNE, and the ``k`` nearest alone.

    The weight of a neighbour falls with its squared distance, on the scale of the row's farthest one.
    """
    numbers = points.select("phrase_id").withColumn("i", F.row_number().over(Window.orderBy("phrase_id")) - 1)  # at most cap rows
    numbers = materialize(numbers, "layout-numbers")
    w = Window.partitionBy("phrase_id").orderBy(F.desc("sim"), "jp", "jr")
    near = S._nearest(S.conflict_cells(points, vec), k + 1, TILE_BYTES).where("phrase_id <> other_id")
    near = near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    per = Window.partitionBy("phrase_id")
    d2 = F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))
    near = near.select("phrase_id", "other_id", "rk", d2.alias("d2"), F.min(d2).over(per).alias("lo"), F.max(d2).over(per).alias("hi"))
    pull = F.exp(-2 * (F.col("d2") - F.col("lo")) / F.greatest("hi", F.lit(1e-12)))
    near = near.withColumn("pull", pull).withColumn("share", F.col("pull") / F.sum("pull").over(per))
    ids = numbers.withColumnRenamed("i", "j").withColumnRenamed("phrase_id", "other_id")
    edges = materialize(near.join(numbers, "phrase_id").join(ids, "other_id").select("i", "j", "rk", "share"), "layout-edges")
    both = edges.select("i", "j", "share").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "share"))
    n = F.lit(float(max(1, numbers.count())))
    sums = both.groupBy("i", "j").agg((F.sum("share") / (2 * n)).alias("p"))
    lists = sums.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("e"))
    own = edges.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "j"))), lambda s: s["j"]).alias("nearest"))
    graph = numbers.join(lists, "i", "left").join(own, "i", "left")
    none = F.array().cast("array<int>")
    return materialize(spread(graph.select(
        "phrase_id", "i", F.coalesce(F.transform("e", lambda s: s["j"]), none).alias("others"),
        F.coalesce(F.transform("e", lambda s: s["p"]), F.array().cast("array<double>")).alias("p"),
        F.coalesce("nearest", none).alias("nearest"))), "layout-graph")


def _forces(y: np.ndarray):
    """Per row: the pull of its neighbours, the push of all landmarks, and its part of the normaliser."""
    def run(batches):
        for batch in batches:
            i = batch.column("i").to_numpy()
            lists, weights = batch.column("others"), batch.column("p")
            size = np.diff(lists.offsets.to_numpy())
            rows, cols, p = np.repeat(np.arange(len(i)), size), lists.flatten().to_numpy(), weights.flatten().to_numpy()
            gap = y[i[rows]] - y[cols]
            pull = p / (1 + (gap * gap).sum(axis=1))
            out = np.zeros((len(i), 5))
            for c in (0, 1):
                out[:, c] = np.bincount(rows, weights=pull * gap[:, c], minlength=len(i))
            for s in range(0, len(i), PRODUCT_ROWS):
                part = slice(s, s + PRODUCT_ROWS)
                away = y[i[part], None, :] - y[None, :, :]
                q = 1 / (1 + (away * away).sum(axis=2))
                out[part, 4] = q.sum(axis=1) - 1  # a row is not pushed by itself
                out[part, 2:4] = ((q * q)[:, :, None] * away).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(i), *[pa.array(out[:, c]) for c in range(5)]],
                                             names=["i", "ax", "ay", "rx", "ry", "q"])
    return run


def neighbour_layout(points: DataFrame, vec: str = "embedding", k: int = NEIGHBOURS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((phrase_id, x, y) of ``points``, at most some thousand rows, centred; their neighbour graph)."""
    graph = neighbour_graph(points, vec, k)
    start = graph.select("phrase_id", "i").join(pca_2d(points, vec).select("phrase_id", "x", "y"), "phrase_id").toPandas() \
        if graph.count() > 2 else graph.select("phrase_id", "i", F.col("i").cast("double").alias("x"), F.lit(0.0).alias("y")).toPandas()
    start = start.sort_values("i")
    y = start[["x", "y"]].to_numpy(np.float64)
    n = len(y)
    if n > 2:
        y = (y - y.mean(axis=0)) / max(y[:, 0].std(), 1e-12) * 0.1
        speed, gain = np.zeros_like(y), np.ones_like(y)
        rate = max(n / EXAGGERATION / 4, 50.0)
        for r in range(rounds):
            sums = graph.select("i", "others", "p").mapInArrow(_forces(y), "i int, ax double, ay double, rx double, ry double, q double")
            got = sums.toArrow().sort_by("i")
            pull = np.column_stack([got["ax"].to_numpy(), got["ay"].to_numpy()])
            push = np.column_stack([got["rx"].to_numpy(), got["ry"].to_numpy()])
            slope = 4 * ((EXAGGERATION if r < EARLY else 1.0) * pull - push / max(got["q"].to_numpy().sum(), 1e-12))
            gain = np.where(slope * speed > 0, np.maximum(gain * 0.8, 0.01), gain + 0.2)
            speed = (0.5 if r < EARLY else 0.8) * speed - rate * gain * slope
            y = y + speed
        y = y - y.mean(axis=0)
    placed = points.sparkSession.createDataFrame(
        [(int(p), float(a), float(b)) for p, (a, b) in zip(start["phrase_id"], y)], "phrase_id long, x double, y double")
    return materialize(placed, "layout"), graph


def neighbours_kept(graph: DataFrame, xy: DataFrame, k: int = 10) -> float:
    """Share of each row's ``k`` nearest neighbours that are among its ``k`` nearest in the plane."""
    at = graph.select("phrase_id", "i").join(xy, "phrase_id").toPandas().sort_values("i")  # landmarks: at most cap
    y = at[["x", "y"]].to_numpy(np.float64)

    def run(batches):
        for batch in batches:
            i, hits = batch.column("i").to_numpy(), []
            for row, own in zip(i, batch.column("nearest").to_pylist()):
                d = ((y - y[row]) ** 2).sum(axis=1)
                d[row] = np.inf
                hits.append(len(set(own[:k]) & set(np.argsort(d, kind="stable")[:k].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hits, np.int64))], names=["hits"])

    total, n = graph.select("i", "nearest").mapInArrow(run, "hits long").agg(F.sum("hits"), F.count(F.lit(1))).first()
    return (total or 0) / max(1, n * k)


def layout_2d(corpus: DataFrame, vec: str = "embedding", cap: int = CAP, rounds: int = ROUNDS) -> DataFrame:
    """DIM-4: (phrase_id, x, y, intent, phrase prefix) of every phrase: landmarks laid out, the others placed."""
    from corpuscope.functions.text import prefix

    landmarks = materialize(landmark_sample(corpus, cap).select("phrase_id", "intent", "intent_pos", "row_pos", "phrase", vec), "landmarks")
    xy, _ = neighbour_layout(landmarks, vec, rounds=rounds)
    placed = landmark_place(corpus, landmarks.select("phrase_id", vec).join(xy, "phrase_id"), vec=vec)
    return xy.unionByName(placed.select("phrase_id", "x", "y")).join(
        corpus.select("phrase_id", "intent", prefix("phrase", 80).alias("phrase")), "phrase_id")
