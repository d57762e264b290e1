"""Semantic search: single and batch (SIM-10 … SIM-13, PF-5, PF-6, PF-13 … PF-16,
PF-20, AGG-14 … AGG-21, LIM-1, LIM-9, LIM-11).

``search_hits`` scores every (query, phrase) pair and keeps each query's
top-k at or above the threshold, ordered by similarity then phrase order
(the reference's stable sort).  Plans:

``broadcast``  the query matrix (its bytes checked against ``broadcast_bytes``)
               is shipped to every task once; each corpus partition is scored
               in tiles by matrix products in ``mapInPandas`` and keeps a
               running top-k, so the final per-query top-k (a
               ``WindowGroupLimit``) sees ≤ k × partitions rows per query.
               The corpus is scanned once and never shuffled.
``blocked``    for query sets too large to broadcast: a task keeps a block of
               queries, sized by bytes, and streams its share of the corpus
               past it (``cells.resident_join``).
index          with a stored inverted file (``write_index``, ``open_index``) only
               the cells whose angular bound reaches a query's k-th hit are
               read, by partition pruning; the hits are the same.

Similarity is the cosine: both sides are normalised, zero vectors stay zero.
Texts are joined after the ranking, for at most k rows per query.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import bands as B
from corpuscope.functions.stats import avg6
from corpuscope.functions.text import keywords, py_strip
from corpuscope.operators.cells import (MAX_PIVOTS, TILE_BYTES, TOP_SCHEMA, Block, Cells, TopRows, build_cells, matrix,
                                        resident_join, unit_rows)
from corpuscope.session import materialize

HIT_SCHEMA = "query_id long, phrase_id long, intent_pos long, row_pos long, sim double"
TILE = 1024                 # queries per matrix product
SCAN_ROWS = 1024            # phrases per matrix product
BROADCAST_BYTES = 64 << 20  # largest query matrix that is broadcast
BROADCAST_HITS = 1_000_000  # hits that are broadcast to the texts of the corpus


def _unit(values) -> np.ndarray:
    """Rows as unit vectors (float64); a zero vector stays zero."""
    if len(values) == 0:
        return np.zeros((0, 1))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class _TopK:
    """Running best k hits per query, by (similarity rounded to 6 places desc, phrase order)."""

    def __init__(self, qids: np.ndarray, qmat: np.ndarray, threshold: float, k: int):
        self.qids, self.qmat, self.threshold, self.k = qids, qmat, float(threshold), k
        self.parts, self.size = [], 0

    def add(self, pids, ipos, rpos, cmat) -> None:
        for q0 in range(0, len(self.qids) if len(pids) else 0, TILE):
            sims = self.qmat[q0:q0 + TILE] @ cmat.T
            qi, pi = np.nonzero(sims >= self.threshold)
            self.parts.append((qi + q0, pids[pi], ipos[pi], rpos[pi], np.round(sims[qi, pi], 6)))
            self.size += len(qi)
            if self.size > 200_000 + 2 * self.k * len(self.qids):
                self._cut()

    def _cut(self) -> None:
        q, p, ip, rp, s = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((rp, ip, -s, q))
        q, p, ip, rp, s = (c[order] for c in (q, p, ip, rp, s))
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.parts, self.size = [(q[keep], p[keep], ip[keep], rp[keep], s[keep])], int(keep.sum())

    def frame(self) -> pd.DataFrame:
        if not self.parts:
            self.parts = [tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0),)]
        self._cut()
        q, p, ip, rp, s = self.parts[0]
        return pd.DataFrame({"query_id": self.qids[q.astype(int)], "phrase_id": p, "intent_pos": ip, "row_pos": rp, "sim": s})


def _hits_broadcast(corpus: DataFrame, queries: DataFrame, threshold: float, k: int) -> DataFrame:
    spark = corpus.sparkSession
    qpdf = queries.select("query_id", "embedding").toPandas()   # its bytes were checked by the caller
    bq = spark.sparkContext.broadcast((qpdf["query_id"].to_numpy(dtype=np.int64), _unit(qpdf["embedding"].values)))

    def score(batches):
        top = _TopK(*bq.value, threshold, k)
        for batch in batches:
            for s in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(s, SCAN_ROWS)
                top.add(*(part.column(c).to_numpy() for c in ("phrase_id", "intent_pos", "row_pos")),
                        unit_rows(matrix(part.column("embedding"), bq.value[1].shape[1])))
        yield pa.RecordBatch.from_pandas(top.frame(), preserve_index=False)

    vectors = F.col("embedding").cast("array<double>").alias("embedding")
    return corpus.select("phrase_id", "intent_pos", "row_pos", vectors).mapInArrow(score, HIT_SCHEMA)


# ---------------------------------------------------------------------------
# plans that keep a block of queries and stream the corpus
# ---------------------------------------------------------------------------

def _query_rows(queries: DataFrame, blocks: int, threshold: float) -> DataFrame:
    return queries.select(F.col("query_id").alias("id"), F.lit(0).cast("long").alias("ipos"), F.lit(0).cast("long").alias("rpos"),
                          F.lit(0).alias("cell"), F.lit(0).alias("tile"), F.lit(float(threshold)).alias("floor"),
                          F.col("embedding").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q"))


def _query_plan(queries: DataFrame, dim: int, nq: int, k: int, tile_bytes: int) -> tuple[int, int]:
    """(query blocks by bytes, tasks that share the corpus for one block: a number of cores, not of rows)."""
    per_task = max(1, tile_bytes // (8 * dim + 32 + 40 * k))
    blocks = max(1, math.ceil(nq / per_task))
    return blocks, max(1, math.ceil(4 * queries.sparkSession.sparkContext.defaultParallelism / blocks))


def _share(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("h")


def _as_hits(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("query_id"), F.col("other_id").alias("phrase_id"), F.col("jp").alias("intent_pos"),
                        F.col("jr").alias("row_pos"), "sim")


def _hits_blocked(corpus: DataFrame, queries: DataFrame, threshold: float, k: int,
                  nq: int, dim: int, tile_bytes: int) -> DataFrame:
    """Every query block against the whole corpus: a phrase is copied once per query block, a query
    once per share of the corpus, and the number of shares follows the cores."""
    blocks, shares = _query_plan(queries, dim, nq, k, tile_bytes)
    residents = _query_rows(queries, blocks, threshold).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    streamed = corpus.select(F.col("phrase_id").alias("id"), F.col("intent_pos").alias("ipos"), F.col("row_pos").alias("rpos"),
                             F.lit(0).alias("cell"), F.lit(0).alias("tile"), F.lit(0.0).alias("floor"), F.col("embedding").alias("v"),
                             F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"),
                             F.pmod(F.xxhash64("phrase_id"), F.lit(shares)).cast("int").alias("h"))

    def kernel(kept: Block) -> TopRows:
        return TopRows(kept, k, np.ones((len(kept), 1), bool), threshold)

    return _as_hits(resident_join(residents, streamed, dim, kernel, TOP_SCHEMA, min(4096, 2 * blocks * shares)))


# ---------------------------------------------------------------------------
# a stored inverted file
# ---------------------------------------------------------------------------

def write_index(corpus: DataFrame, path: str, max_pivots: int = MAX_PIVOTS) -> None:
    """Store ``corpus`` (phrase_id, intent_pos, row_pos, embedding) as an inverted file: one Parquet
    partition per cell, and the catalog of the cells (centre, ranges of angles, rows).  A cell of any
    size is written by many tasks.  Overwrites what is at ``path``."""
    cells = build_cells(corpus.select("phrase_id", "intent_pos", "row_pos", "embedding"),
                        ["phrase_id", "intent_pos", "row_pos"], "embedding", max_pivots, "index-cells")
    cells.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path.rstrip('/')}/rows")
    centres = np.vstack([cells.pivots, np.zeros((1, cells.dim))])
    catalog = [(c, centres[c].tolist(), int(cells.count[c]), float(cells.lo[c]), float(cells.hi[c]),
                cells.guide_lo[c].tolist(), cells.guide_hi[c].tolist(), cells.value_bytes) for c in range(len(centres))]
    corpus.sparkSession.createDataFrame(catalog, "cell int, centre array<double>, n long, lo double, hi double, "
                                        "guide_lo array<double>, guide_hi array<double>, value_bytes int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/catalog")


def open_index(spark, path: str) -> Cells:
    """The inverted file at ``path``; its catalog (at most ``MAX_PIVOTS`` + 1 rows) is read at once."""
    c = spark.read.parquet(f"{path.rstrip('/')}/catalog").orderBy("cell").toPandas()
    schema = "phrase_id long, intent_pos long, row_pos long, v array<%s>, cell int" % ("float" if c["value_bytes"][0] == 4 else "double")
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/rows")
    stack = lambda name: np.stack([np.asarray(x, float) for x in c[name]])
    centres = stack("centre")
    return Cells(rows, centres[:-1], c["n"].to_numpy(), c["lo"].to_numpy(), c["hi"].to_numpy(), stack("guide_lo"),
                 stack("guide_hi"), centres.shape[1], int(c["value_bytes"][0]))


def _cells_to_visit(queries: DataFrame, index: Cells, probes: int, first: bool) -> DataFrame:
    """(q, cell): cells the queries of a block visit.  First those ``probes`` cells of each query whose
    bound is highest; later the other cells whose bound reaches the query's floor."""
    light = replace(index, rows=None)

    def run(batches):
        for batch in batches:
            visit = _visits(light, matrix(batch.column("v"), light.dim), batch.column("floor").to_numpy(), probes, first)
            rows, cells = np.nonzero(visit)
            pairs = np.unique(np.column_stack([batch.column("q").to_numpy()[rows], cells]).astype(np.int32), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["q", "cell"])

    return queries.select("q", "floor", "v").mapInArrow(run, "q int, cell int").distinct()


def _visits(index: Cells, v: np.ndarray, floor: np.ndarray, probes: int, first: bool) -> np.ndarray:
    upper = index.upper_for(unit_rows(v))
    near = np.zeros(upper.shape, bool)
    best = np.argsort(-upper, axis=1, kind="stable")[:, :probes]
    np.put_along_axis(near, best, True, axis=1)
    return (upper >= floor[:, None] - 1e-6) & (near if first else ~near)


def index_hits(index: Cells, queries: DataFrame, threshold: float, k: int, probes: int = 8,
               tile_bytes: int = TILE_BYTES) -> tuple[DataFrame, dict]:
    """Each query's best ``k`` rows of the index at or above ``threshold``, exactly, and what was read.

    Cells are visited in the order of their bound: first every query's ``probes`` most promising
    ones, whose k-th hit is a floor, then the cells whose bound reaches the floor.  Only the
    partitions of visited cells are read (partition pruning by ``cell``).  Runs two jobs at once
    and stores the first hits.  The second result has the cells of the index, those read, and the
    share of its rows that they hold.
    """
    spark = queries.sparkSession
    nq = queries.count()
    blocks, shares = _query_plan(queries, index.dim, nq, k, tile_bytes)
    asked = _query_rows(queries, blocks, threshold)
    light, read = replace(index, rows=None), set()

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        needs = materialize(_cells_to_visit(asked, index, probes, first), "index-visits")
        names = [r["cell"] for r in needs.select("cell").distinct().collect()]  # at most one per cell of the catalog
        read.update(names)
        residents = asked.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        rows = index.rows.where(F.col("cell").isin(names)).join(needs, "cell").select(
            F.col("phrase_id").alias("id"), F.col("intent_pos").alias("ipos"), F.col("row_pos").alias("rpos"), "cell",
            F.lit(0).alias("tile"), F.lit(0.0).alias("floor"), "v", "q")

        def kernel(kept: Block) -> TopRows:
            return TopRows(kept, k, _visits(light, kept.v, kept.floor, probes, first), threshold)

        return resident_join(residents, rows.withColumn("h", _share(shares)), index.dim, kernel, TOP_SCHEMA,
                             min(4096, 2 * blocks * shares))

    near = materialize(visit(asked, True), "index-hits")
    w = Window.partitionBy("id").orderBy(F.desc("sim"))
    kth = near.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("id", F.col("sim").alias("kth"))
    raised = asked.join(kth, "id", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor"))).drop("kth")
    found = near.unionByName(visit(raised, False))
    live = int((index.count > 0).sum())
    report = {"cells": live, "cells_read": len(read),
              "rows_read": float(index.count[sorted(read)].sum()) / max(1, int(index.count.sum()))}
    return _as_hits(found), report


def search_hits(corpus: DataFrame, queries: DataFrame, threshold: float = 0.7, top_k: int = 100,
                method: str = "auto", broadcast_bytes: int = BROADCAST_BYTES, tile_bytes: int = TILE_BYTES,
                index: Cells | None = None) -> DataFrame:
    """SIM-10 / SIM-11 + LIM-1: each query's top-k phrases with ``sim >= threshold``.

    With ``index`` (see ``open_index``) only the cells that can hold a hit are read.

    ``corpus``: phrase_id, intent, intent_pos, row_pos, phrase, embedding.
    ``queries``: query_id, query, embedding.
    Output: query_id, query, rank, phrase_id, intent, phrase, sim, intent_pos, row_pos.
    """
    if method not in ("auto", "broadcast", "blocked"):
        raise ValueError(f"unknown method {method!r}")
    nq = queries.count() if method == "broadcast" or index is not None else None
    if nq is None:
        nq, dim = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
        if method == "auto":
            method = "broadcast" if nq * (8 * dim + 8) <= broadcast_bytes else "blocked"
    if index is not None:
        raw, _ = index_hits(index, queries, threshold, top_k, tile_bytes=tile_bytes)
    elif method == "broadcast":
        raw = _hits_broadcast(corpus, queries, threshold, top_k)
    else:
        raw = _hits_blocked(corpus, queries, threshold, top_k, nq, dim, tile_bytes)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "intent_pos", "row_pos")
    ranked = raw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    meta = corpus.select("phrase_id", "intent", "phrase")
    if nq * top_k <= BROADCAST_HITS:   # the corpus stays where it is
        ranked = F.broadcast(ranked)
    return ranked.join(meta, "phrase_id").join(queries.select("query_id", "query"), "query_id").select(
        "query_id", "query", "rank", "phrase_id", "intent", "phrase", "sim", "intent_pos", "row_pos")


# ---------------------------------------------------------------------------
# batch audit (SIM-12, SIM-13, AGG-17, AGG-18, PF-13, PF-17)
# ---------------------------------------------------------------------------

def _per_query(hits: DataFrame, n: int = 10) -> DataFrame:
    """One pass over the hits: per (query, label) counts, then per query (a
    window over at most top_k rows): total, best similarity, first label and
    the label most frequent among the first n (ties: seen first)."""
    per = hits.groupBy("query_id", "intent").agg(
        F.count(F.lit(1)).alias("n"), F.max("sim").alias("max_sim"), F.min("rank").alias("first_rank"),
        F.count_if(F.col("rank") <= n).alias("cnt"))
    q = Window.partitionBy("query_id")
    m = Window.partitionBy("query_id").orderBy(F.desc("cnt"), "first_rank")
    per = per.select(
        "*", F.sum("n").over(q).alias("n_results"), F.max("max_sim").over(q).alias("top_similarity"),
        F.first(F.when(F.col("first_rank") == 1, F.col("intent")), ignorenulls=True).over(
            q.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top_intent"),
        F.row_number().over(m).alias("_m"))
    return per.where(F.col("_m") == 1).select(
        "query_id", "n_results", "top_similarity", "top_intent",
        F.col("intent").alias("mode_intent"), F.col("cnt").alias("mode_count"))


def batch_audit(hits: DataFrame, queries: DataFrame, bands: B.Bands = B.DEFAULT) -> DataFrame:
    """One row per query, matches or not (left join, SIM-12)."""
    pq = _per_query(hits)
    out = (queries.select("query_id", "query").join(pq, "query_id", "left")
           .select("query_id", "query", F.col("mode_intent").alias("recommended_intent"),
                   F.coalesce("top_similarity", F.lit(0.0)).alias("top_similarity"),
                   F.coalesce("n_results", F.lit(0)).cast("long").alias("matches_found")))
    act = B.batch_action("top_similarity", bands)
    return out.withColumn("action", act).withColumn("action_text", B.action_sentence("action", "recommended_intent"))


def nest_matches(hits: DataFrame) -> DataFrame:
    """SIM-13: matches as an ordered nested list per query."""
    return hits.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "sim", "phrase", "intent", "phrase_id"))),
        lambda s: F.struct(s["sim"].alias("similarity"), s["phrase"].alias("phrase"),
                           s["intent"].alias("intent"), s["phrase_id"].alias("idx"))).alias("matches"))


ACTIONS = ["DUPLICATE", "ADD", "REVIEW", "NEW_INTENT"]


def action_totals(audit: DataFrame) -> DataFrame:
    """AGG-18: count per action; the four actions always appear."""
    spark = audit.sparkSession
    names = spark.createDataFrame([(i, a) for i, a in enumerate(ACTIONS)], "action_pos int, action string")
    counts = audit.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "action", "left").select(
        "action", F.coalesce("n", F.lit(0)).cast("long").alias("count"), "action_pos")


# ---------------------------------------------------------------------------
# single search, run for every query of a frame (PF-6, PF-14 … PF-16, AGG-14 … 21)
# ---------------------------------------------------------------------------

def drop_exact(hits: DataFrame) -> DataFrame:
    """PF-6: remove hits equal to the query after lower+strip, *after* top-k (T-18);
    ranks are renumbered so later "first n" steps see the shown list."""
    kept = hits.where(F.lower(py_strip("phrase")) != F.lower(py_strip("query")))
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w))


def single_decision(hits: DataFrame, bands: B.Bands = B.DEFAULT) -> DataFrame:
    """AGG-16 + PF-14 + PF-15: dominant label of the first 10, confidence, action."""
    pq = _per_query(hits).withColumn(
        "confidence", F.col("mode_count") / F.least(F.lit(10), F.col("n_results")))
    return pq.select("query_id", "top_similarity", "top_intent", F.col("mode_intent").alias("dominant_intent"),
                     F.col("mode_count").cast("long").alias("dominant_count"), "n_results",
                     F.round("confidence", 6).alias("confidence"),
                     B.single_action("top_similarity", "confidence", bands).alias("action"),
                     B.similarity_caption("top_similarity", bands).alias("sim_caption"),
                     B.confidence_caption("confidence", bands).alias("confidence_caption"))


def intent_frequency(hits: DataFrame, n: int = 10, show: int = 3) -> DataFrame:
    """AGG-19: label counts among the first n hits, first ``show`` labels."""
    top = hits.where(F.col("rank") <= n).groupBy("query_id", "intent").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("rank").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cnt"), "first_rank")
    return top.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= show)


def result_table(hits: DataFrame, bands: B.Bands = B.DEFAULT) -> DataFrame:
    """PF-16 + PF-20: match type and first five keywords per hit."""
    return hits.select("query_id", "rank", "phrase_id", "intent", "phrase", "sim",
                       B.match_type("sim", "phrase", "query", bands).alias("match_type"),
                       F.array_join(F.slice(keywords("phrase"), 1, 5), ", ").alias("keywords"))


def filter_results(results: DataFrame, intent: str | None = None, match_types: list[str] | None = None) -> DataFrame:
    """PF-5: optional label filter and match-type set (empty set = no filter)."""
    out = results
    if intent is not None and intent != "All":
        out = out.where(F.col("intent") == intent)
    if match_types:
        out = out.where(F.col("match_type").isin(match_types))
    return out


def search_stats(hits: DataFrame, bands: B.Bands = B.DEFAULT) -> DataFrame:
    """AGG-14 per query."""
    s = F.col("sim")
    return hits.groupBy("query_id").agg(
        F.count_distinct("intent").alias("unique_intents"),
        F.count_if(s > bands.stat_very).alias("very_similar"),
        F.count_if((s > bands.stat_high) & (s <= bands.stat_very)).alias("high_similar"),
        avg6(s).alias("avg_similarity"))


def intent_distribution(hits: DataFrame) -> DataFrame:
    """AGG-15: per query and label: count, avg/max/min sim and share of results."""
    per = hits.groupBy("query_id", "intent").agg(
        F.count(F.lit(1)).alias("count"), avg6("sim").alias("avg_sim"),
        F.max("sim").alias("max_sim"), F.min("sim").alias("min_sim"))
    tot = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_tot"))
    return per.join(tot, "query_id").select(
        "query_id", "intent", "count", "avg_sim", "max_sim", "min_sim",
        F.round(F.col("count") * 100.0 / F.col("_tot"), 6).alias("pct_results"))


def sim_histogram(hits: DataFrame, bins: int = 20) -> DataFrame:
    """AGG-20: equal-width bins between each query's min and max similarity."""
    rng = hits.groupBy("query_id").agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"))
    j = hits.join(rng, "query_id")
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("sim") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    return j.groupBy("query_id", b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def intent_pie(hits: DataFrame) -> DataFrame:
    """AGG-21: count per label, only for queries whose hits span more than one label."""
    per = hits.groupBy("query_id", "intent").agg(F.count(F.lit(1)).alias("count"))
    multi = per.groupBy("query_id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > 1)
    return per.join(multi.select("query_id"), "query_id")


def near_duplicate_examples(hits: DataFrame, decision: DataFrame, bands: B.Bands = B.DEFAULT) -> DataFrame:
    """LIM-11: hits above the very-high band among the first 3, and hits of the
    dominant label among the first 5."""
    dup = hits.where((F.col("rank") <= 3) & (F.col("sim") > bands.cap_very_high)).select(
        "query_id", "rank", "phrase_id", "sim", F.lit("near_duplicate").alias("kind"))
    dom = hits.join(decision.select("query_id", "dominant_intent"), "query_id").where(
        (F.col("rank") <= 5) & (F.col("intent") == F.col("dominant_intent"))).select(
        "query_id", "rank", "phrase_id", "sim", F.lit("dominant_example").alias("kind"))
    return dup.unionByName(dom)


def first_matches(hits: DataFrame, n: int = 5) -> DataFrame:
    """LIM-9: each query's first ``n`` matches (``n=10`` is the Top-10 sheet)."""
    return hits.where(F.col("rank") <= n)


def display_page(df: DataFrame, order: list, n: int) -> DataFrame:
    """LIM-12: the first ``n`` rows in ``order`` with the total and a
    "Showing n of total" caption (``orderBy().limit()`` keeps n per task)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    head = df.orderBy(*order).limit(n)
    return head.crossJoin(total).withColumn(
        "caption", F.when(F.col("total") > n, F.format_string("Showing %d of %d", F.lit(n), F.col("total"))))


def display_results(results: DataFrame) -> DataFrame:
    """PF-7: the columns shown for search results, similarity as a 4-place display string."""
    return results.select(F.format_string("%.4f", F.col("sim")).alias("similarity_score"), "match_type",
                          "intent", "phrase", "keywords")
