"""Similarity operators: centroids, label matrix, confusing pairs, phrase conflicts.

IDs: SIM-1 … SIM-9, SIM-15, PF-2, PF-3, PF-10, LIM-4, LIM-10.

Phrase conflicts (SIM-5) are an all-pairs theta self-join.  Three physical
plans give the same rows:

``cells``    (default) rows are cut into cells around pivots (``operators.cells``);
             cells whose angular bound excludes the threshold never meet.  A task
             keeps one tile of rows, sized by bytes, and streams past it only the
             rows of cells that may hold a partner; products run in single
             precision and pairs near or above the threshold are computed again
             in double.  A row is copied once per tile it must meet.

``plain``    one Spark join ``a.intent_pos < b.intent_pos`` with a JVM dot
             product; the planner makes it a broadcast nested-loop join when
             one side is small.
``blocked``  rows are hashed into B blocks of ``block_rows``; each row is
             replicated to the B block pairs it takes part in and every pair
             of blocks is scored with one matrix product (``cogroup`` +
             ``applyInPandas``).  Memory per task is two blocks whatever the
             label sizes are (a label with a third of all rows is spread over
             all blocks); work is the unavoidable n²/2 dot products.

For corpora where n² is out of reach, ``conflicts_lsh`` (SIM-7) is the
approximate plan: SimHash buckets with multi-probe look-ups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import bands as B
from corpuscope.functions.vectors import cosine, dot, l2_normalise, norm
from corpuscope.operators.cells import (ANGLE_MARGIN, OUT_ROWS, PRODUCT_COLS, PRODUCT_ROWS, TILE_BYTES, TOP_SCHEMA, Block,
                                        Cells, Meetings, Tiles, TopRows, build_cells, join_report, matrix, own_tile_floors, partners,
                                        plan_tiles, resident_join, single_margin, tiles_of_ranges, unit_rows, with_tile)
from corpuscope.operators.bothsides import join_both_sides
from corpuscope.operators.textstore import text_digest
from corpuscope.session import materialize

PHRASE_SIMILARITY_MIN = 0.70     # fixed value: default base threshold
CHUNK_ROWS = 1024                # rows per matrix product inside a block pair
SALTS = 8                        # tasks a hot text is dealt to in the join of equal texts

CONFLICT_COLS = ["phrase_id", "intent", "phrase", "other_id", "other_intent", "similar_to",
                 "sim", "is_exact"]
_ORDER_COLS = ["intent_pos", "row_pos", "other_pos", "other_row"]
# a conflict without its texts, which ``text_id`` and ``other_text`` number; ``place`` and ``other_place`` number the rows
NUMBER_COLS = ["text_id", "other_text", "place", "other_place"]
PLACED_COLS = ["phrase_id", "intent", "other_id", "other_intent", "sim", "is_exact", *_ORDER_COLS, *NUMBER_COLS]
BROADCAST_PHRASES = 1_000_000    # places of phrases that are broadcast to the pairs: four numbers and a label each
SAMPLE_PHRASES = 4096            # phrases whose conflicts show how similarities are spread
RANGE_BINS = 1 << 16             # steps of a similarity at which ranges may be cut
DEAL_ROWS = 8192                 # rows of a dealt block (``method="blocked"``)


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------

def unit_vectors(corpus: DataFrame, vec: str = "embedding") -> DataFrame:
    """Adds ``u array<double>``: the L2-normalised vector (zero stays zero)."""
    return (corpus.withColumn("_n", norm(vec))
            .withColumn("u", l2_normalise(vec, "_n")).drop("_n"))


def _round6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# SIM-1 … SIM-4, SIM-15
# ---------------------------------------------------------------------------

def intent_centroids(corpus: DataFrame, vec: str = "embedding") -> DataFrame:
    """SIM-1: element-wise mean vector per label (not re-normalised).

    ``Summarizer.mean`` is a partial (map-side) aggregate, so a huge label is
    reduced in every task before the shuffle.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    agg = corpus.groupBy("intent").agg(
        F.min("intent_pos").alias("intent_pos"),
        F.count(F.lit(1)).alias("n_phrases"),
        Summarizer.mean(array_to_vector(F.col(vec))).alias("_mean"))
    return agg.select("intent", "intent_pos", "n_phrases",
                      vector_to_array("_mean", "float64").alias("centroid"))


def intent_matrix(centroids: DataFrame) -> DataFrame:
    """SIM-2: label × label cosine matrix, diagonal included (long form).

    The centroid table has one row per label; ``crossJoin`` plans as a
    broadcast nested-loop join when the planner's size estimate allows it.
    """
    c = centroids.select("intent", "intent_pos", "centroid", norm("centroid").alias("nrm"))
    a, b = c.alias("a"), c.alias("b")
    return a.crossJoin(b).select(
        F.col("a.intent").alias("intent_a"), F.col("b.intent").alias("intent_b"),
        F.col("a.intent_pos").alias("a_pos"), F.col("b.intent_pos").alias("b_pos"),
        cosine("a.centroid", "b.centroid", "a.nrm", "b.nrm").alias("sim"))


def intent_matrix_wide(matrix: DataFrame, names: list[str] | None = None) -> DataFrame:
    """SIM-3: matrix pivoted, one column per label.

    Passing ``names`` avoids the extra job that discovers pivot values.
    """
    g = matrix.groupBy("intent_a", "a_pos")
    p = g.pivot("intent_b", names) if names is not None else g.pivot("intent_b")
    return p.agg(F.first("sim")).withColumnRenamed("intent_a", "intent")


def confusing_pairs(matrix: DataFrame, threshold: float = 0.85, bands: B.Bands = B.DEFAULT) -> DataFrame:
    """SIM-4 + PF-10: label pairs a before b with ``sim >= threshold``."""
    return matrix.where((F.col("a_pos") < F.col("b_pos")) & (F.col("sim") >= threshold)).select(
        "intent_a", "intent_b", "a_pos", "b_pos", "sim",
        B.sim3("sim").alias("sim3"), B.risk("sim", bands).alias("risk"))


def confused_with(pairs: DataFrame, intent: str) -> DataFrame:
    """SIM-15: labels confused with ``intent`` from either side of a pair."""
    return pairs.where((F.col("intent_a") == intent) | (F.col("intent_b") == intent)).select(
        F.lit(intent).alias("intent"),
        F.when(F.col("intent_a") == intent, F.col("intent_b")).otherwise(F.col("intent_a")).alias("other_intent"),
        F.when(F.col("intent_a") == intent, F.col("b_pos")).otherwise(F.col("a_pos")).alias("other_pos"),
        "sim")


# ---------------------------------------------------------------------------
# SIM-5: phrase conflicts
# ---------------------------------------------------------------------------

def _ids(corpus: DataFrame, vec: str) -> DataFrame:
    return unit_vectors(corpus.select("phrase_id", "intent", "intent_pos", "row_pos", vec), vec).drop(vec)


@dataclass
class Phrases:
    """What conflict rows say of a phrase: ``rows`` (phrase_id, intent, intent_pos, row_pos, text_id, place), one per
    row of the corpus, stored, and ``texts`` (text_id, phrase), one per distinct text, stored when first asked for."""

    rows: DataFrame
    digests: DataFrame # _h, text_id and the rows of each distinct text
    corpus: DataFrame
    few: bool          # rows that may be broadcast

    @cached_property
    def texts(self) -> DataFrame:
        """Only texts that repeat are shuffled, while the digests can be broadcast; runs its job at once."""
        digests = F.broadcast(self.digests) if self.few else self.digests
        met = self.corpus.select("phrase", text_digest("phrase").alias("_h")).join(digests, "_h")
        once = met.where("_n = 1").select("text_id", "phrase")
        more = met.where("_n > 1").groupBy("text_id").agg(F.any_value("phrase").alias("phrase"))
        return materialize(once.unionByName(more), "conflict-texts")


def phrase_index(corpus: DataFrame) -> Phrases:
    """The phrases of ``corpus`` and their distinct texts, numbered; runs its jobs at once, but that of the texts."""
    keyed = corpus.select("phrase_id", "intent", "intent_pos", "row_pos", text_digest("phrase").alias("_h"))
    digests = materialize(keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
                          .withColumn("text_id", F.monotonically_increasing_id()), "conflict-digests")
    rows = materialize(keyed.join(digests.select("_h", "text_id"), "_h").drop("_h")
                       .withColumn("place", F.monotonically_increasing_id()), "conflict-phrases")
    return Phrases(rows, digests, corpus, rows.count() <= BROADCAST_PHRASES)


def place_pairs(pairs: DataFrame, phrases: Phrases) -> DataFrame:
    """(phrase_id, other_id, sim) → conflict rows without their texts (``PLACED_COLS``).  Up to ``BROADCAST_PHRASES``
    phrases are broadcast, so the pairs are not shuffled; beyond, pairs without texts are."""
    rows = F.broadcast(phrases.rows) if phrases.few else phrases.rows
    out = pairs.select("phrase_id", "other_id", "sim").join(rows, "phrase_id").join(
        rows.toDF("other_id", "other_intent", "other_pos", "other_row", "other_text", "other_place"), "other_id")
    return out.withColumn("is_exact", F.col("text_id") == F.col("other_text")).select(*PLACED_COLS)


def _in_millionths(placed: DataFrame) -> DataFrame:
    """The similarity, which has six places (``packed_pairs``), as an int."""
    return placed.withColumn("sim", F.rint(F.col("sim") * 1e6).cast("int"))


def _looked_up(dealt: DataFrame, phrases: Phrases) -> DataFrame:
    """Rows of (place, other_place, sim in millionths) with what the broadcast phrases say of both places."""
    out = dealt.join(F.broadcast(phrases.rows), "place").join(F.broadcast(
        phrases.rows.toDF("other_id", "other_intent", "other_pos", "other_row", "other_text", "other_place")), "other_place")
    return out.withColumn("is_exact", F.col("text_id") == F.col("other_text")).withColumn("sim", F.col("sim") / F.lit(1e6))


def similarity_bounds(corpus: DataFrame, threshold: float, vec: str = "embedding") -> list[float]:
    """Rising similarities that cut the conflicts at ``threshold`` into ranges of about as many rows: quantiles of the
    conflicts among ``SAMPLE_PHRASES`` phrases, whose vectors are collected; none if these have no conflict.  They only say
    where a row is sorted, and no row depends on them.  Runs its job at once."""
    some = (corpus.orderBy(F.xxhash64("phrase_id"), "phrase_id").limit(SAMPLE_PHRASES)
            .select("intent_pos", F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL").toArrow())
    if not some.num_rows:
        return []
    ipos, unit, found = some["intent_pos"].to_numpy(), unit_rows(matrix(some["v"], len(some["v"][0]))), []
    for s in range(0, len(unit), PRODUCT_ROWS):
        sims = unit[s:s + PRODUCT_ROWS] @ unit.T
        found.append(sims[(sims >= threshold) & (ipos[s:s + PRODUCT_ROWS, None] < ipos)])
    sims = np.sort(np.concatenate(found))
    ranges = max(2, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted(set(sims[len(sims) * np.arange(1, ranges) // ranges].tolist())) if len(sims) else []


def dealt_down(df: DataFrame, column: str, bounds: list[float], unit: float = 1.0) -> DataFrame:
    """Rows dealt to ranges of falling ``column``, a similarity in ``unit`` parts, that ``bounds`` cut; not sorted within
    them.  Unlike ``repartitionByRange`` this does not work all rows out beforehand, for a sample."""
    edges = F.array(*[F.lit(math.floor(b * RANGE_BINS)).cast("long") for b in bounds])
    bins = df.sparkSession.range(-RANGE_BINS - 1, RANGE_BINS + 2).select(
        F.col("id").alias("_bin"), F.size(F.filter(edges, lambda e: e > F.col("id"))).alias("_range"))
    placed = df.withColumn("_bin", F.floor(F.col(column) * F.lit(RANGE_BINS / unit))).join(F.broadcast(bins), "_bin")
    return placed.repartitionById(len(bounds) + 1, F.col("_range")).select(*df.columns)


def dealt_by_similarity(placed: DataFrame, phrases: Phrases, bounds: list[float] | None = None) -> DataFrame:
    """``place_pairs`` rows dealt to ranges of falling similarity, not sorted within them; with ``bounds``
    (``similarity_bounds``) the pairs are found once.  While the phrases can be broadcast, only the two places and the
    similarity of a conflict are dealt, and the rest is looked up again."""
    deal = (lambda df, unit: dealt_down(df, "sim", bounds, unit)) if bounds else (lambda df, _: df.repartitionByRange(F.desc("sim")))
    if not phrases.few:
        return deal(placed, 1.0)
    return _looked_up(deal(_in_millionths(placed).select("place", "other_place", "sim"), 1e6), phrases).select(*PLACED_COLS)


def with_texts(placed: DataFrame, phrases: Phrases, few: bool = False) -> DataFrame:
    """``PLACED_COLS`` rows with both texts: ``CONFLICT_COLS`` and the order columns (and any column added).

    Texts are met by ``join_both_sides``, as rows that carry them are many times the corpus; while the phrases can
    be broadcast, only the two places and the similarity of a conflict are dealt, and the rest is looked up again.
    ``few`` is for rows that are a bounded number, which are broadcast to the texts."""
    more = [c for c in placed.columns if c not in PLACED_COLS]
    if few:
        own = F.broadcast(placed).join(phrases.texts, "text_id")
        out = F.broadcast(own).join(phrases.texts.toDF("other_text", "similar_to"), "other_text")
    else:
        dealt = _in_millionths(placed) if phrases.few else placed
        carry = ["place", "other_place", "sim", *more] if phrases.few else None
        out = join_both_sides(dealt, ("text_id", "other_text"), phrases.texts, "text_id", {"phrase": ("phrase", "similar_to")},
                              F.octet_length("phrase"), carry=carry)
        if phrases.few:
            out = _looked_up(out, phrases)
    return out.select(*CONFLICT_COLS, *_ORDER_COLS, *more)


def _attach_text(pairs: DataFrame, corpus: DataFrame, phrases: Phrases | None = None) -> DataFrame:
    """(i, j, sim) → full conflict rows."""
    phrases = phrases or phrase_index(corpus)
    return with_texts(place_pairs(pairs, phrases), phrases)


def _conflicts_plain(corpus: DataFrame, threshold: float, vec: str) -> DataFrame:
    u = _ids(corpus, vec)
    a, b = u.alias("a"), u.alias("b")
    j = a.join(b, F.col("a.intent_pos") < F.col("b.intent_pos"))
    s = j.select(F.col("a.phrase_id").alias("phrase_id"), F.col("b.phrase_id").alias("other_id"),
                 dot("a.u", "b.u").alias("sim"))
    return s.where(F.col("sim") >= threshold)


def _block_count(n: int, block_rows: int, parallelism: int = 1) -> int:
    """Blocks of at most ``block_rows`` rows, and enough of them that the
    B(B+1)/2 block pairs give every core at least two tasks."""
    b = max(1, int(math.ceil(n / float(max(block_rows, 1)))))
    while b * (b + 1) // 2 < 2 * parallelism and b < n:
        b += 1
    return b


def _with_block(u: DataFrame, nblocks: int) -> DataFrame:
    return u.withColumn("blk", F.pmod(F.xxhash64("phrase_id"), F.lit(nblocks)).cast("int"))


def _block_pairs(u: DataFrame, nblocks: int):
    """Left copies go to (blk, hi) for hi >= blk; right copies to (lo, blk) for lo <= blk."""
    ub = _with_block(u, nblocks)
    cols = [c for c in ub.columns if c != "blk"]
    # fresh aliases give each side its own attribute ids (a self-cogroup needs that)
    left = ub.select(*[F.col(c).alias(c) for c in cols], F.col("blk").alias("lo"),
                     F.explode(F.sequence(F.col("blk"), F.lit(nblocks - 1))).alias("hi"))
    right = ub.select(*[F.col(c).alias(c) for c in cols],
                      F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("lo"), F.col("blk").alias("hi"))
    return left, right


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.values])


def _unit_stack(rows: pd.DataFrame) -> np.ndarray:
    """The vectors ``v`` of norm ``_n`` as unit vectors (``l2_normalise``); zero stays zero."""
    v, n = _stack(rows["v"]), rows["_n"].to_numpy()[:, None]
    return np.divide(v, n, out=np.zeros_like(v), where=n != 0)


def _pair_kernel(threshold: float, cap: int | None, chunk: int = CHUNK_ROWS):
    """Score one (left block, right block) group: oriented cross-label pairs with
    ``sim >= threshold``, in chunks of ``chunk`` left rows; with ``cap``
    only the first ``cap`` pairs in (i, j) order leave the group."""
    t = float(threshold)

    def score(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"phrase_id": pd.Series([], dtype="int64"),
                              "other_id": pd.Series([], dtype="int64"),
                              "sim": pd.Series([], dtype="float64")})
        if len(lp) == 0 or len(rp) == 0:
            return empty
        same = int(lp["lo"].iloc[0]) == int(lp["hi"].iloc[0])
        b = _unit_stack(rp)
        pb_all, rb = rp["intent_pos"].to_numpy(), rp["row_pos"].to_numpy()
        idb_all = rp["phrase_id"].to_numpy()
        a_all, pa_all = _unit_stack(lp), lp["intent_pos"].to_numpy()
        ra_all, ida_all = lp["row_pos"].to_numpy(), lp["phrase_id"].to_numpy()
        parts, keys = [], []
        for c0 in range(0, len(lp), chunk):          # bounded memory: chunk × block
            sims = a_all[c0:c0 + chunk] @ b.T
            pa = pa_all[c0:c0 + chunk][:, None]
            pb = pb_all[None, :]
            keep = ((pa < pb) if same else (pa != pb)) & (sims >= t)
            ii, jj = np.nonzero(keep)
            if len(ii) == 0:
                continue
            ra = ra_all[c0:c0 + chunk]
            first_left = pa[ii, 0] < pb[0, jj]
            ip = np.where(first_left, pa[ii, 0], pb[0, jj])
            ir = np.where(first_left, ra[ii], rb[jj])
            jp = np.where(first_left, pb[0, jj], pa[ii, 0])
            jr = np.where(first_left, rb[jj], ra[ii])
            ida, idb = ida_all[c0:c0 + chunk][ii], idb_all[jj]
            part = pd.DataFrame({"phrase_id": np.where(first_left, ida, idb),
                                 "other_id": np.where(first_left, idb, ida), "sim": sims[ii, jj]})
            key = np.stack([ip, ir, jp, jr], axis=1)
            if cap is not None and len(part) > cap:
                sel = np.lexsort((jr, jp, ir, ip))[:cap]
                part, key = part.iloc[sel], key[sel]
            parts.append(part)
            keys.append(key)
        if not parts:
            return empty
        out = pd.concat(parts, ignore_index=True)
        if cap is not None and len(out) > cap:
            k = np.concatenate(keys)
            out = out.iloc[np.lexsort((k[:, 3], k[:, 2], k[:, 1], k[:, 0]))[:cap]]
        return out

    return score


def _conflicts_blocked(corpus: DataFrame, threshold: float, vec: str, block_rows: int,
                       n: int | None = None, max_pairs: int | None = None) -> DataFrame:
    """Blocked SIM-5: ``block_rows`` rows at a time against a dealt block.  Blocks are dealt in
    sizes of ``DEAL_ROWS`` at least, as a row is copied once per dealt block.  With ``max_pairs``
    each block pair emits only its first ``max_pairs`` pairs in (i, j) order: the global first N is
    always among them, and a group of identical vectors cannot flood the output."""
    # vectors are dealt in their own precision, half of that of unit vectors
    u = corpus.select("phrase_id", "intent_pos", "row_pos", F.col(vec).alias("v"), norm(vec).alias("_n"))
    n = corpus.count() if n is None else n
    nb = _block_count(n, max(block_rows, DEAL_ROWS), corpus.sparkSession.sparkContext.defaultParallelism)
    left, right = _block_pairs(u, nb)
    score = _pair_kernel(threshold, None if max_pairs is None else int(max_pairs), max(1, min(CHUNK_ROWS, block_rows)))
    return (left.groupBy("lo", "hi").cogroup(right.groupBy("lo", "hi"))
            .applyInPandas(score, "phrase_id long, other_id long, sim double"))


class _PairKernel:
    """Conflicts of the resident rows with streamed rows: cross-label pairs at or above the
    threshold, each once.  With ``cap`` only the first so many in (i, j) order leave the task."""

    def __init__(self, kept: Block, threshold: float, keep: np.ndarray, cap: int | None):
        self.a, self.t, self.cap = kept, float(threshold), cap
        self.floor = self.t - single_margin(kept.v.shape[1])
        self.meet = Meetings(keep[kept.cell])
        self.found, self.size = [], 0

    def add(self, b: Block):
        a = self.a
        for rows, run in self.meet.runs(b.cell):
            for s in range(0, len(rows), PRODUCT_ROWS):
                ra = rows[s:s + PRODUCT_ROWS]
                for c in range(0, len(run), PRODUCT_COLS):
                    rb = run[c:c + PRODUCT_COLS]
                    # few products are near the threshold: labels are compared for these alone
                    near = np.flatnonzero(a.single[ra] @ b.single[rb].T >= self.floor)
                    for o in range(0, len(near), OUT_ROWS):
                        ii, jj = np.divmod(near[o:o + OUT_ROWS], len(rb))
                        i, j = ra[ii], rb[jj]
                        pi, pj = a.ipos[i], b.ipos[j]
                        met = np.where(self.once(i, b, j), pi < pj, pi != pj)
                        yield from self._pairs(i[met], b, j[met])

    def once(self, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
        """Where both orders of a pair come by: within a tile; there only the one in corpus order counts."""
        return self.a.tile[i] == b.tile[j]

    def _pairs(self, i: np.ndarray, b: Block, j: np.ndarray):
        a = self.a
        sim = a.exact(i, b, j)
        hit = sim >= self.t
        i, j, sim = i[hit], j[hit], sim[hit]
        if not len(i):
            return
        first = a.ipos[i] < b.ipos[j]
        pick = lambda x, y: (np.where(first, x, y), np.where(first, y, x))
        (p, o), (ip, jp), (ir, jr) = pick(a.id[i], b.id[j]), pick(a.ipos[i], b.ipos[j]), pick(a.rpos[i], b.rpos[j])
        if self.cap is None:
            yield _pair_batch(p, o, sim)
            return
        self.found.append((ip, ir, jp, jr, p, o, sim))
        self.size += len(p)
        if self.size > self.cap + OUT_ROWS:
            self._cut()

    def _cut(self):
        columns = [np.concatenate(c) for c in zip(*self.found)]
        keep = np.lexsort(columns[3::-1])[:self.cap]
        self.found, self.size = [tuple(c[keep] for c in columns)], len(keep)

    def finish(self):
        if self.found:
            self._cut()
            yield _pair_batch(*self.found[0][4:])


def round6(x: np.ndarray) -> np.ndarray:
    """Doubles to six places, as SQL's ``round`` has it: the shortest decimal of a number, halves away from zero."""
    y = np.abs(x) * 1e6
    whole = np.floor(y + 0.5)
    # a product may miss the decimal by an ulp, which counts beside a half only
    for k in np.flatnonzero((np.abs(y - np.floor(y) - 0.5) < 1e-6) & (y < 2 ** 40)):
        whole[k] = int((Decimal(repr(float(abs(x[k])))) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    return np.where(y < 2 ** 40, np.copysign(whole / 1e6, x) + 0.0, x)   # zero has no sign


def _pair_batch(p, o, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p), pa.array(o), pa.array(round6(sim))], names=["phrase_id", "other_id", "sim"])


PAIR_SCHEMA = "phrase_id long, other_id long, sim double"


def conflict_cells(corpus: DataFrame, vec: str = "embedding") -> Cells:
    """The corpus cut into cells; ``phrase_conflicts`` and ``conflicts_topk`` take it to share it."""
    return build_cells(corpus.select("phrase_id", "intent_pos", "row_pos", vec), ["phrase_id", "intent_pos", "row_pos"], vec,
                       name="conflict-cells")


def _tile_rows(cells: Cells, tiles: Tiles) -> DataFrame:
    return with_tile(cells, tiles, "phrase_id").select(
        F.col("phrase_id").alias("id"), F.col("intent_pos").alias("ipos"), F.col("row_pos").alias("rpos"),
        "cell", "tile", F.lit(0.0).alias("floor"), "v")


def _shares(tiles: Tiles):
    return F.explode(F.sequence(F.lit(0), F.lit(tiles.shares - 1))).alias("h")


def _share_of(column: str, tiles: Tiles):
    return F.pmod(F.xxhash64(column), F.lit(tiles.shares)).cast("int").alias("h")


def conflict_plan(cells: Cells, threshold: float) -> dict:
    """Cell and row pairs the bounds skip, tiles and copies per row of ``phrase_conflicts`` on ``cells``."""
    tiles = plan_tiles(cells, cells.rows.sparkSession.sparkContext.defaultParallelism)
    return join_report(cells, tiles, cells.upper >= threshold - ANGLE_MARGIN)


def _conflicts_cells(cells: Cells, threshold: float, max_pairs: int | None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    spark = cells.rows.sparkSession
    keep = cells.upper >= threshold - ANGLE_MARGIN
    tiles = plan_tiles(cells, spark.sparkContext.defaultParallelism, tile_bytes=tile_bytes)
    rows = _tile_rows(cells, tiles)
    residents = rows.select(F.col("tile").alias("q"), _shares(tiles), *rows.columns)
    # the pair of tiles is met in the earlier one
    streamed = (rows.join(F.broadcast(partners(cells, tiles, keep)), "cell").select(tiles_of_ranges(), _share_of("id", tiles), *rows.columns)
                .where("q <= tile"))
    return resident_join(residents, streamed, cells.dim, lambda kept: _PairKernel(kept, threshold, keep, max_pairs),
                         PAIR_SCHEMA, min(4096, 2 * tiles.total * tiles.shares))


def conflict_pairs(corpus: DataFrame, threshold: float = PHRASE_SIMILARITY_MIN, vec: str = "embedding",
                   method: str = "cells", block_rows: int = 8192, max_conflicts: int | None = None, cells: Cells | None = None,
                   tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The pairs of ``phrase_conflicts`` alone: (phrase_id, other_id, sim); of a capped list all that may be kept."""
    if method == "cells":   # rounded in the task
        return _conflicts_cells(cells or conflict_cells(corpus, vec), threshold,
                                None if max_conflicts is None else int(max_conflicts), tile_bytes)
    if method == "plain":
        pairs = _conflicts_plain(corpus, threshold, vec)
    elif method == "blocked":
        pairs = _conflicts_blocked(corpus, threshold, vec, block_rows, None, max_conflicts)
    else:
        raise ValueError(f"unknown method {method!r}")
    return pairs.select("phrase_id", "other_id", _round6(F.col("sim")).alias("sim"))


def packed_pairs(pairs: DataFrame) -> DataFrame:
    """``conflict_pairs`` for storing: the similarity, which has six places, as an int."""
    return pairs.select("phrase_id", "other_id", F.rint(F.col("sim") * 1e6).cast("int").alias("millionths"))


def unpacked_pairs(packed: DataFrame) -> DataFrame:
    """The pairs of ``packed_pairs``; a division by 10**6 gives the very double that rounding gave."""
    return packed.select("phrase_id", "other_id", (F.col("millionths") / F.lit(1e6)).alias("sim"))


def phrase_conflicts(corpus: DataFrame, threshold: float = PHRASE_SIMILARITY_MIN, vec: str = "embedding",
                     method: str = "cells", block_rows: int = 8192,
                     max_conflicts: int | None = None, cells: Cells | None = None,
                     tile_bytes: int = TILE_BYTES, phrases: Phrases | None = None) -> DataFrame:
    """SIM-5 + SIM-8 + SIM-9: all cross-label pairs i before j with ``sim >= threshold``.

    Output: ``CONFLICT_COLS`` plus the order columns used by caps and sorts.
    One kernel (``cells``) serves every size, so a pair on the threshold is
    judged alike at every size; ``blocked`` compares all blocks and ``plain`` is the
    JVM form, both for comparison.  ``cells`` and ``phrases`` may be given to share the cut
    (see ``conflict_cells``) and the texts (``phrase_index``); else they are made at once.
    Callers that filter or count take ``conflict_pairs`` and ``place_pairs``, and the texts of
    what is left by ``with_texts``.
    ``max_conflicts`` keeps only the first so many in (i, j) order, for callers
    that want the cap; it is applied inside every task and once more
    globally (``TakeOrderedAndProject``).
    """
    pairs = conflict_pairs(corpus, threshold, vec, method, block_rows, max_conflicts, cells, tile_bytes)
    phrases = phrases or phrase_index(corpus)
    placed = place_pairs(pairs, phrases)
    if max_conflicts is None:
        return with_texts(placed, phrases)
    head = placed.orderBy(*_ORDER_COLS).limit(int(max_conflicts))
    return with_texts(head, phrases, few=True).orderBy(*_ORDER_COLS)


def _topk_blocked(u: DataFrame, k: int, n: int, block_rows: int) -> DataFrame:
    """Candidates for each row's k nearest: every block pair keeps, per row and
    direction, the entries at or above its k-th largest (ties kept), so the
    exact global top-k is always among them."""
    nb = _block_count(n, block_rows, u.sparkSession.sparkContext.defaultParallelism)
    left, right = _block_pairs(u.select("phrase_id", "intent_pos", "row_pos", "u"), nb)

    def pick(src_ids, dst, sims):
        if sims.shape[1] > k:
            thr = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
            keep = sims >= thr[:, None]
        else:
            keep = np.ones_like(sims, dtype=bool)
        ii, jj = np.nonzero(keep)
        return pd.DataFrame({"phrase_id": src_ids[ii], "other_id": dst["phrase_id"].to_numpy()[jj],
                             "jp": dst["intent_pos"].to_numpy()[jj], "jr": dst["row_pos"].to_numpy()[jj],
                             "sim": sims[ii, jj]})

    def score(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        cols = {"phrase_id": "int64", "other_id": "int64", "jp": "int64", "jr": "int64", "sim": "float64"}
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in cols.items()})
        a, b = _stack(lp["u"]), _stack(rp["u"])
        ids_l, ids_r = lp["phrase_id"].to_numpy(), rp["phrase_id"].to_numpy()
        out = []
        for c0 in range(0, len(lp), CHUNK_ROWS):          # left rows against the right block
            sims = np.round(a[c0:c0 + CHUNK_ROWS] @ b.T, 6)
            out.append(pick(ids_l[c0:c0 + CHUNK_ROWS], rp, sims))
        if int(lp["lo"].iloc[0]) != int(lp["hi"].iloc[0]):
            for c0 in range(0, len(rp), CHUNK_ROWS):      # and right rows against the left block
                sims = np.round(b[c0:c0 + CHUNK_ROWS] @ a.T, 6)
                out.append(pick(ids_r[c0:c0 + CHUNK_ROWS], lp, sims))
        return pd.concat(out, ignore_index=True)

    return (left.groupBy("lo", "hi").cogroup(right.groupBy("lo", "hi"))
            .applyInPandas(score, "phrase_id long, other_id long, jp long, jr long, sim double"))


def _nearest(cells: Cells, k: int, tile_bytes: int) -> DataFrame:
    """Each row's k nearest rows (itself included): (phrase_id, other_id, jp, jr, sim).

    A first pass takes every row's k-th similarity within its own tile; a cell whose bound lies
    below it for all rows of the tile is not sent there, and is skipped for a single row likewise.
    A task merges all cells of its share before anything is shuffled: at most k rows per row and task.
    """
    spark = cells.rows.sparkSession
    tiles = plan_tiles(cells, spark.sparkContext.defaultParallelism, extra_bytes=40 * k, tile_bytes=tile_bytes)
    rows = materialize(own_tile_floors(cells, _tile_rows(cells, tiles), k), "nearest-floors")
    needs = rows.where("needs is not null").select(F.col("tile").alias("q"), F.explode("needs").alias("cell"))
    plain = rows.drop("needs")
    streamed = plain.join(needs, "cell").select("q", _share_of("id", tiles), *plain.columns)
    residents = plain.select(F.col("tile").alias("q"), _shares(tiles), *plain.columns)
    light = replace(cells, rows=None)

    def kernel(kept: Block) -> TopRows:
        return TopRows(kept, k, light.upper_for(unit_rows(kept.v)) >= kept.floor[:, None])

    found = resident_join(residents, streamed, cells.dim, kernel, TOP_SCHEMA, min(4096, 2 * tiles.total * tiles.shares))
    return found.withColumnRenamed("id", "phrase_id")


def conflicts_topk(corpus: DataFrame, threshold: float = PHRASE_SIMILARITY_MIN, k: int = 100,
                   vec: str = "embedding", block_rows: int = 8192, method: str = "cells",
                   max_conflicts: int | None = None, cells: Cells | None = None, tile_bytes: int = TILE_BYTES,
                   phrases: Phrases | None = None) -> DataFrame:
    """SIM-6: keep j only if it is among i's k nearest over all phrases.

    Neighbours include i itself and its own label (trap T-15); ties go to the
    earlier phrase.  Ranking happens before the ``j after i``, threshold and
    label filters.  Candidates come from ``_nearest`` (or from all block pairs,
    ``method="blocked"``); ``row_number <= k`` then plans as a
    ``WindowGroupLimit`` that keeps at most k rows per i in every task before
    the shuffle.
    """
    if method == "cells":
        cand = _nearest(cells or conflict_cells(corpus, vec), k, tile_bytes)
    elif method == "blocked":
        cand = _topk_blocked(_ids(corpus, vec), k, corpus.count(), block_rows)
    else:
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy("phrase_id").orderBy(F.desc("sim"), "jp", "jr")
    top = cand.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    me = corpus.select("phrase_id", F.col("intent_pos").alias("ip"), F.col("row_pos").alias("ir"))
    kept = top.join(me, "phrase_id").where(
        (F.struct("ip", "ir") < F.struct("jp", "jr")) & (F.col("ip") != F.col("jp")) & (F.col("sim") >= threshold))
    out = _attach_text(kept.select("phrase_id", "other_id", "sim"), corpus, phrases)
    if max_conflicts is not None:   # SIM-9 for this path: (i, sim desc) order
        out = out.orderBy("intent_pos", "row_pos", F.desc("sim"), "other_pos", "other_row").limit(int(max_conflicts))
    return out


def hash_planes(num_tables: int, num_bits: int, dims: int, seed: int = 42) -> np.ndarray:
    """Normals of ±1 (tables · bits × dims), each sign from the md5 of "table:bit:dim:seed", so that
    any engine can compute the same buckets."""
    import hashlib

    sign = lambda t, b, i: 1.0 if hashlib.md5(f"{t}:{b}:{i}:{seed}".encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[sign(t, b, i) for i in range(dims)] for t in range(num_tables) for b in range(num_bits)])


WEAK_BITS = 11            # bits a probe may flip: the weakest ones of a vector


def lsh_bits(n: int) -> int:
    """Bits per table: one bucket per row on average, 8 at least."""
    return max(8, math.ceil(math.log2(max(2, n))))


def probe_count(bits: int, share: float, most: int) -> int:
    """Buckets a vector looks into per table: a share of the buckets, ``most`` at most."""
    return max(1, min(most, math.ceil(share * (1 << min(bits, WEAK_BITS)))))


def _codes(unit: np.ndarray, planes: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each vector in one table, and the ``probes`` buckets nearest to it: those that
    differ in the bits with the least sum of squared projections (multi-probe)."""
    z = unit @ planes.T
    code = (z >= 0).astype(np.int64) @ (1 << np.arange(len(planes), dtype=np.int64))
    weak = min(len(planes), WEAK_BITS)
    bits = np.argsort(z * z, axis=1, kind="stable")[:, :weak]
    flips = (np.arange(1 << weak)[:, None] >> np.arange(weak)) & 1                       # subsets of the weak bits
    near = np.zeros((len(unit), probes), np.int64)
    for s in range(0, len(unit), PRODUCT_ROWS):
        part = slice(s, s + PRODUCT_ROWS)
        cost = np.take_along_axis(z[part] ** 2, bits[part], axis=1) @ flips.T
        best = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes < cost.shape[1] else np.argsort(cost, axis=1)
        masks = (flips[best] * (1 << bits[part])[:, None, :]).sum(axis=2)
        near[part] = code[part, None] ^ masks
    return code, near


class _ProbeKernel:
    """Stored rows of some buckets against streamed rows that look into them; the earlier row of a
    pair is the one that looks."""

    def __init__(self, kept: Block, planes: np.ndarray, bits: int, probes: int, threshold: float):
        self.a, self.t, self.probes = kept, float(threshold), probes
        self.planes = planes[kept.tile[0] * bits:(kept.tile[0] + 1) * bits]
        code, _ = _codes(unit_rows(kept.v), self.planes, 1)
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]

    def add(self, b: Block):
        _, near = _codes(unit_rows(b.v), self.planes, self.probes)
        lo, hi = np.searchsorted(self.code, near, "left"), np.searchsorted(self.code, near, "right")
        size = (hi - lo).sum(axis=1)
        at = 0
        while at < len(b):          # some streamed rows at a time, so that the pairs stay bounded
            end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), OUT_ROWS, "right")) + at)
            yield from self._some(b, np.arange(at, min(end, len(b))), lo, hi)
            at = end

    def _some(self, b: Block, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        a, n = self.a, (hi - lo)[rows]
        start = np.repeat(lo[rows].ravel(), n.ravel())
        step = np.arange(len(start)) - np.repeat(np.cumsum(n.ravel()) - n.ravel(), n.ravel())
        i, j = self.order[start + step], np.repeat(rows, n.sum(axis=1))
        earlier = b.ipos[j] < a.ipos[i]
        i, j = i[earlier], j[earlier]
        for s in range(0, len(i), OUT_ROWS):
            sim = b.exact(j[s:s + OUT_ROWS], a, i[s:s + OUT_ROWS])
            hit = sim >= self.t
            if hit.any():
                yield _pair_batch(b.id[j[s:s + OUT_ROWS]][hit], a.id[i[s:s + OUT_ROWS]][hit], sim[hit])

    def finish(self):
        return ()


def lsh_pairs(corpus: DataFrame, threshold: float, vec: str, num_tables: int, probe_share: float, most_probes: int,
              seed: int, tile_bytes: int) -> DataFrame:
    """Pairs that meet in a bucket, once per table they meet in: (phrase_id, other_id, sim >= threshold)."""
    spark = corpus.sparkSession
    n, dim = corpus.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec)), F.lit(1))).first()
    bits = lsh_bits(n)
    probes = probe_count(bits, probe_share, most_probes)
    planes = hash_planes(num_tables, bits, dim, seed)
    # buckets are stored in 2^high groups of about one tile each
    rows_per_tile = max(1, tile_bytes // (8 * dim + 32))
    high = max(0, math.ceil(math.log2(max(1, n / rows_per_tile))))
    shift = max(0, bits - high)
    kind = corpus.schema[vec].dataType.elementType.simpleString()
    held = corpus.select(F.col("phrase_id").alias("id"), F.col("intent_pos").alias("ipos"), F.col("row_pos").alias("rpos"),
                         F.col(vec).cast(f"array<{kind if kind == 'float' else 'double'}>").alias("v"))

    def place(batches):
        for batch in batches:
            unit = unit_rows(matrix(batch.column("v"), dim))
            for t in range(num_tables):
                code, near = _codes(unit, planes[t * bits:(t + 1) * bits], probes)
                looks = [np.unique(r).astype(np.int32) for r in near >> shift]
                yield (batch.append_column("tile", pa.array(np.full(len(unit), t, np.int32)))
                       .append_column("own", pa.array((code >> shift).astype(np.int32)))
                       .append_column("looks", pa.array(looks, pa.list_(pa.int32()))))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    placed = held.mapInArrow(place, fields + ", tile int, own int, looks array<int>")
    # a group that equal vectors make large is dealt to several tasks
    groups = placed.groupBy("tile", "own").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_tile)).cast("int").alias("deal"))
    key = (F.col("tile") * F.lit(1 << (bits - shift)) + F.col("own")).cast("int").alias("q")
    columns = ["id", "ipos", "rpos", F.lit(0).alias("cell"), "tile", F.lit(0.0).alias("floor"), "v"]
    stored = placed.join(groups, ["tile", "own"]).select(key, F.pmod(F.xxhash64("id"), F.col("deal")).cast("int").alias("h"), *columns)
    looking = (placed.drop("own").withColumn("own", F.explode("looks")).join(groups, ["tile", "own"])
               .select(key, F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("h"), *columns))
    parts = min(4096, 2 * num_tables * (1 << (bits - shift)))
    return resident_join(stored, looking, dim, lambda kept: _ProbeKernel(kept, planes, bits, probes, threshold), PAIR_SCHEMA, parts)


def conflicts_lsh(corpus: DataFrame, threshold: float = PHRASE_SIMILARITY_MIN, vec: str = "embedding",
                  num_tables: int = 8, probe_share: float = 0.075, most_probes: int = 256, seed: int = 42,
                  max_conflicts: int | None = None, tile_bytes: int = TILE_BYTES, phrases: Phrases | None = None) -> DataFrame:
    """SIM-7: approximate conflicts with multi-probe random-hyperplane LSH (SimHash).

    Every phrase is stored in one bucket per table, with bits grown from the corpus size
    (``lsh_bits``).  It looks into the ``probe_share`` of the buckets (at most ``most_probes``)
    that differ from its own in its weakest bits; the earlier phrase of a pair looks, and pairs
    that meet are scored exactly, so the rows are a subset of SIM-5.  Buckets are stored in groups
    of a tile's size: a phrase is sent once per table and group it looks into, which at up to a
    tile of rows is once per table.  A group that equal vectors make large is dealt to several
    tasks.  Pairs found in several tables are kept once.
    """
    pairs = lsh_pairs(corpus, threshold, vec, num_tables, probe_share, most_probes, seed, tile_bytes)
    pairs = pairs.groupBy("phrase_id", "other_id").agg(F.max("sim").alias("sim"))
    out = _attach_text(pairs, corpus, phrases)
    return out.orderBy(*_ORDER_COLS).limit(int(max_conflicts)) if max_conflicts is not None else out


# ---------------------------------------------------------------------------
# SIM-8 standalone, SIM-9, PF-2, PF-3, LIM-4
# ---------------------------------------------------------------------------

def exact_duplicates(corpus: DataFrame) -> DataFrame:
    """SIM-8 standalone: every pair of equal texts in different labels, i before j.

    The result itself has one row per pair.  The join is an equi-join on a digest
    of the text, salted: the later occurrence is dealt to ``SALTS`` buckets and
    the earlier one copied to each, so a hot text is split over that many tasks
    before adaptive execution splits further.  ``duplicate_groups`` is the linear
    form.
    """
    c = corpus.select("phrase_id", "intent", "intent_pos", "row_pos", "phrase").withColumn("_h", F.xxhash64("phrase"))
    repeated = c.groupBy("_h").agg(F.min("intent_pos").alias("_lo"), F.max("intent_pos").alias("_hi")).where("_lo < _hi")
    c = c.join(repeated.select("_h"), "_h", "left_semi")
    a = c.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("a")
    b = c.withColumn("_s", F.pmod(F.xxhash64("phrase_id"), F.lit(SALTS)).cast("int")).alias("b")
    j = a.join(b, (F.col("a._h") == F.col("b._h")) & (F.col("a._s") == F.col("b._s"))
               & (F.col("a.phrase") == F.col("b.phrase")) & (F.col("a.intent_pos") < F.col("b.intent_pos")))
    return _duplicate_rows(j)


def duplicate_groups(corpus: DataFrame) -> DataFrame:
    """Linear form of ``exact_duplicates``: every repeat of a text in a later label, paired with the
    text's first occurrence (a partial ``min`` aggregate, then a join that adaptive execution splits)."""
    from corpuscope.operators.ordering import first_per_key

    c = corpus.select("phrase_id", "intent", "intent_pos", "row_pos", "phrase")
    first = first_per_key(c, ["phrase"], ["intent_pos", "row_pos"], "phrase_id").alias("a")
    return _duplicate_rows(first.join(c.alias("b"), (F.col("a.phrase") == F.col("b.phrase"))
                                      & (F.col("a.intent_pos") < F.col("b.intent_pos"))))


def _duplicate_rows(j: DataFrame) -> DataFrame:
    return j.select(F.col("a.phrase_id").alias("phrase_id"), F.col("a.intent").alias("intent"),
                    F.col("a.phrase").alias("phrase"), F.col("b.phrase_id").alias("other_id"),
                    F.col("b.intent").alias("other_intent"), F.col("b.phrase").alias("similar_to"),
                    F.lit(1.0).alias("sim"), F.lit(True).alias("is_exact"),
                    F.col("a.intent_pos").alias("intent_pos"), F.col("a.row_pos").alias("row_pos"),
                    F.col("b.intent_pos").alias("other_pos"), F.col("b.row_pos").alias("other_row"))


def cap_conflicts(conflicts: DataFrame, max_conflicts: int | None = None,
                  order: str = "pair") -> DataFrame:
    """SIM-9: first N conflicts in (i, j) order (``order='pair'``) or (i, sim desc)
    (``order='topk'``), with ``limit_reached = total >= N`` (T-13).

    ``orderBy().limit(N)`` plans as ``TakeOrderedAndProject``: each task keeps
    its N best, so memory is bounded by N, not by the conflict count.
    """
    if max_conflicts is None:
        return conflicts.withColumn("limit_reached", F.lit(False))
    keys = (["intent_pos", "row_pos", "other_pos", "other_row"] if order == "pair"
            else ["intent_pos", "row_pos", F.desc("sim"), "other_pos", "other_row"])
    head = conflicts.orderBy(*keys).limit(int(max_conflicts))
    # "reached" when the kept list is full — the same as total >= N, read off N rows
    got = head.agg(F.count(F.lit(1)).alias("_got"))
    return head.crossJoin(got).withColumn("limit_reached", F.col("_got") >= int(max_conflicts)).drop("_got")


def filter_conflicts(conflicts: DataFrame, min_similarity: float, intent: str | None = None) -> DataFrame:
    """PF-2: ``sim >= t`` and, optionally, the label on either side."""
    out = conflicts.where(F.col("sim") >= min_similarity)
    if intent is not None and intent != "All Intents":
        out = out.where((F.col("intent") == intent) | (F.col("other_intent") == intent))
    return out


def split_exact(conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PF-3: (exact duplicates, merely similar)."""
    return conflicts.where(F.col("is_exact")), conflicts.where(~F.col("is_exact"))


def top_conflicts(conflicts: DataFrame, n: int) -> DataFrame:
    """LIM-4: first ``n`` by sim desc (ties by pair order) plus the hidden count."""
    total = conflicts.agg(F.count(F.lit(1)).alias("_total"))
    head = conflicts.orderBy(F.desc("sim"), *_ORDER_COLS).limit(n)
    return head.crossJoin(total).withColumn("hidden", F.greatest(F.col("_total") - n, F.lit(0))).drop("_total")
