"""Vector tables cut into cells, and joins that skip cells by angular bounds.

``build_cells`` picks at most ``MAX_PIVOTS`` pivots from a sample, spread out by
farthest-first choice, and gives every row the cell of its nearest pivot.  Per cell
it keeps the row count, the range of angles to the own pivot and to ``GUIDES``
guide pivots: a catalog whose size depends on the pivots only.  For a row x of
cell c and a row y of cell d the triangle inequality of angles gives

    angle(x, y) >= angle(p_c, p_d) - r_c - r_d,   >= lo_c - angle(p_c, p_d) - r_d, ...
    angle(x, y) >= lo_c(g) - hi_d(g)              for each guide g,

so ``Cells.upper[c, d]``, the cosine of the largest bound, is the best similarity
the two cells can hold.  Zero vectors have a cell of their own with similarity 0.

``resident_join`` is the physical plan shared by conflicts, nearest neighbours
and search: rows are dealt by (tile, share) with a secondary sort; a task keeps the
rows of one tile (at most ``TILE_BYTES``) and streams the other side past them in
Arrow batches.  Products are taken in single precision with a margin, and only
pairs that may count are computed again in double precision.

``build_cells`` runs its jobs at once (sample, cells, catalog) and stores the rows
with their cells below the shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import materialize

MAX_PIVOTS = 1024         # cells of a table; the catalog grows with it, not with the rows
PIVOT_FACTOR = 4          # pivots per square root of the rows, up to MAX_PIVOTS
SPREAD = 4                # sampled rows per pivot, from which the pivots are chosen
GUIDES = 32               # pivots whose angle ranges are kept for every cell
TILE_BYTES = 32 << 20     # vectors a task keeps
STREAM_TILES = 32         # tiles that stream past one tile in one task
ANGLE_MARGIN = 1e-6
PRODUCT_ROWS = 1024       # rows of a tile per matrix product
PRODUCT_COLS = 4096
OUT_ROWS = 1 << 18
EXACT_BYTES = 256 << 10   # vectors of one side that are multiplied in double precision at once: they stay in a core's cache


@dataclass
class Cells:
    """Rows with their cell, and the catalog of the cells (the last one holds the zero vectors)."""

    rows: DataFrame            # ids..., v array<float|double>, cell int
    pivots: np.ndarray         # unit vectors, one per cell but the last
    count: np.ndarray          # rows per cell
    lo: np.ndarray             # least and largest angle to the own pivot
    hi: np.ndarray
    guide_lo: np.ndarray       # cells x guides
    guide_hi: np.ndarray
    dim: int
    value_bytes: int

    @property
    def upper(self) -> np.ndarray:
        """Largest cosine two rows of cells (c, d) can have; -2 where a cell is empty."""
        if getattr(self, "_upper", None) is None:
            n = len(self.pivots)
            between = np.arccos(np.clip(self.pivots @ self.pivots.T, -1, 1))
            lo, hi = self.lo[:n], self.hi[:n]
            bound = between - hi[:, None] - hi[None, :]
            bound = np.maximum(bound, lo[:, None] - between - hi[None, :])
            bound = np.maximum(bound, lo[None, :] - between - hi[:, None])
            for g in range(self.guide_lo.shape[1]):
                a, b = self.guide_lo[:n, g], self.guide_hi[:n, g]
                bound = np.maximum(bound, np.maximum(a[:, None] - b[None, :], a[None, :] - b[:, None]))
            out = np.zeros((n + 1, n + 1))
            out[:n, :n] = np.cos(np.clip(bound - ANGLE_MARGIN, 0, np.pi))
            out[self.count == 0, :] = -2
            out[:, self.count == 0] = -2
            self._upper = out
        return self._upper

    def upper_for(self, unit: np.ndarray) -> np.ndarray:
        """Largest cosine of each row of ``unit`` (unit or zero vectors) with any row of each cell."""
        n = len(self.pivots)
        out = np.zeros((len(unit), n + 1))
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))
        bound = np.maximum(angle - self.hi[None, :n], self.lo[None, :n] - angle)
        for g in range(self.guide_lo.shape[1]):
            a = angle[:, g:g + 1]
            bound = np.maximum(bound, np.maximum(self.guide_lo[None, :n, g] - a, a - self.guide_hi[None, :n, g]))
        out[:, :n] = np.cos(np.clip(bound - ANGLE_MARGIN, 0, np.pi))
        out[~unit.any(axis=1), :] = 0.0
        out[:, self.count == 0] = -2
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of vectors of ``dim`` numbers as a matrix, in its own precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; zero stays zero."""
    v = v.astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def spread_out(unit: np.ndarray, wanted: int) -> np.ndarray:
    """``wanted`` rows, each the one farthest from those before it (no two alike)."""
    if not len(unit):
        return unit
    chosen, best = [0], unit @ unit[0]
    while len(chosen) < wanted:
        i = int(best.argmin())
        if best[i] > 1 - 1e-9:
            break
        chosen.append(i)
        best = np.maximum(best, unit @ unit[i])
    return unit[chosen]


def build_cells(df: DataFrame, ids: list[str], vec: str, max_pivots: int = MAX_PIVOTS, name: str = "cells") -> Cells:
    """Cells of the rows of ``df``: columns ``ids`` (the first one names the row) and the vector ``vec``."""
    n, dim = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec)), F.lit(1))).first()
    kind = df.schema[vec].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    wanted = max(1, min(max_pivots, PIVOT_FACTOR * math.isqrt(n)))
    sample = (df.select(ids[0], vec).orderBy(F.xxhash64(ids[0]), ids[0]).limit(SPREAD * wanted)
              .select(F.col(vec).cast("array<double>").alias("v")).toArrow())
    unit = unit_rows(matrix(sample["v"], dim)) if sample.num_rows else np.zeros((0, dim))
    pivots = spread_out(unit[unit.any(axis=1)], wanted)
    if not len(pivots):
        pivots = np.eye(1, dim)
    zero, guides = len(pivots), min(GUIDES, len(pivots))

    def assign(batches):
        for batch in batches:
            u = unit_rows(matrix(batch.column("v"), dim))
            cell = (u @ pivots.T).argmax(axis=1).astype(np.int32)
            cell[~u.any(axis=1)] = zero
            yield batch.append_column("cell", pa.array(cell))

    held = df.select(*ids, F.col(vec).cast(f"array<{kind}>").alias("v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", cell int"
    rows = materialize(held.mapInArrow(assign, schema), name)

    def ranges(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            u = unit_rows(matrix(batch.column("v"), dim))
            order = np.argsort(cell, kind="stable")
            cell, u = cell[order], u[order]
            at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, int)
            if not len(at):
                continue
            size, names = np.diff(np.append(at, len(cell))), cell[at]
            own = np.arccos(np.clip(np.einsum("ij,ij->i", u, np.vstack([pivots, np.zeros(dim)])[cell]), -1, 1))
            to_guide = np.arccos(np.clip(u @ pivots[:guides].T, -1, 1))
            angles = np.column_stack([own, to_guide])
            low, high = np.minimum.reduceat(angles, at), np.maximum.reduceat(angles, at)
            width = angles.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(names, width)), pa.array(np.tile(np.arange(-1, width - 1, dtype=np.int32), len(names))),
                pa.array(low.ravel()), pa.array(high.ravel()), pa.array(np.repeat(size, width).astype(np.int64))],
                names=["cell", "guide", "lo", "hi", "n"])

    stats = (rows.select("cell", "v").mapInArrow(ranges, "cell int, guide int, lo double, hi double, n long")
             .groupBy("cell", "guide").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toArrow())
    cell, guide = stats["cell"].to_numpy(), stats["guide"].to_numpy()
    lo, hi = np.full((zero + 1, guides + 1), np.pi), np.zeros((zero + 1, guides + 1))
    lo[cell, guide + 1], hi[cell, guide + 1] = stats["lo"].to_numpy(), stats["hi"].to_numpy()
    count = np.zeros(zero + 1, np.int64)
    count[cell] = stats["n"].to_numpy()
    return Cells(rows, pivots, count, lo[:, 0], hi[:, 0], lo[:, 1:], hi[:, 1:], dim, 4 if kind == "float" else 8)


# ---------------------------------------------------------------------------
# tiles: what a task keeps
# ---------------------------------------------------------------------------

@dataclass
class Tiles:
    """Each cell's tiles: ``first`` and ``parts`` (a large cell is dealt to several tiles, small ones share one)."""

    first: np.ndarray
    parts: np.ndarray
    total: int
    rows: int          # rows a tile is planned for
    shares: int        # tasks that share the rows streaming past one tile


def plan_tiles(cells: Cells, parallelism: int, extra_bytes: int = 0, tile_bytes: int = TILE_BYTES) -> Tiles:
    n = int(cells.count.sum())
    rows = max(1, tile_bytes // (cells.dim * cells.value_bytes + 32 + extra_bytes))
    rows = max(1, min(rows, math.ceil(n / max(1, math.isqrt(2 * parallelism)))))
    first, parts = np.zeros(len(cells.count), np.int64), np.ones(len(cells.count), np.int64)
    tile, free = 0, rows
    for c in range(len(cells.count)):  # cells in pivot order
        size = int(cells.count[c])
        if size > free:
            if free < rows:
                tile, free = tile + 1, rows
            parts[c] = max(1, math.ceil(size / rows))
        first[c] = tile
        if parts[c] > 1:
            tile, free = tile + int(parts[c]), rows
        else:
            free -= size
    total = tile + (1 if free < rows or tile == 0 else 0)
    shares = max(math.ceil(n / (STREAM_TILES * rows)), math.ceil(2 * parallelism / max(1, total)), 1)
    return Tiles(first, parts, max(1, total), rows, min(shares, max(1, n)))


def with_tile(cells: Cells, tiles: Tiles, key: str) -> DataFrame:
    """``cells.rows`` with the tile of each row (by a hash of ``key`` within a large cell)."""
    spark = cells.rows.sparkSession
    table = spark.createDataFrame([(int(c), int(f), int(p)) for c, (f, p) in enumerate(zip(tiles.first, tiles.parts))],
                                  "cell int, first int, parts int")
    return (cells.rows.join(F.broadcast(table), "cell")
            .withColumn("tile", (F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))).cast("int"))
            .drop("first", "parts"))


def partners(cells: Cells, tiles: Tiles, keep: np.ndarray) -> DataFrame:
    """(cell, ranges): tiles that hold a cell which must meet ``cell``; at most one range per cell."""
    rows = []
    for d in range(len(keep)):
        merged: list[list[int]] = []
        for lo, hi in sorted({(int(tiles.first[c]), int(tiles.first[c] + tiles.parts[c] - 1)) for c in np.flatnonzero(keep[:, d])}):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        if merged:
            rows.append((d, [tuple(r) for r in merged]))
    return cells.rows.sparkSession.createDataFrame(rows, "cell int, ranges array<struct<lo: int, hi: int>>")


def tiles_of_ranges():
    return F.explode(F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"])))).alias("q")


def join_report(cells: Cells, tiles: Tiles, keep: np.ndarray) -> dict:
    """What the bounds save: cell pairs and row pairs that meet, and copies per row."""
    live = cells.count > 0
    pairs = int(live.sum()) ** 2
    weight = cells.count[:, None].astype(float) * cells.count[None, :]
    met = [np.zeros(tiles.total, bool) for _ in range(len(keep))]
    for d in range(len(keep)):
        for c in np.flatnonzero(keep[:, d]):
            met[d][tiles.first[c]:tiles.first[c] + tiles.parts[c]] = True
    n = max(1, int(cells.count.sum()))
    copies = sum(int(cells.count[d]) * int(met[d].sum()) for d in range(len(keep))) / n
    return {"rows": n, "cells": int(live.sum()), "tiles": tiles.total, "cell_pairs": pairs,
            "cell_pairs_skipped": 1 - float(keep[np.ix_(live, live)].sum()) / max(1, pairs),
            "row_pairs_skipped": 1 - float(weight[keep].sum()) / max(1.0, float(weight.sum())),
            "copies_per_row": copies / 2 + tiles.shares}


# ---------------------------------------------------------------------------
# the streaming join
# ---------------------------------------------------------------------------

class Block:
    """Rows as arrays: id, place in the corpus (label, row), cell, tile, floor, vectors."""

    COLUMNS = ("id", "ipos", "rpos", "cell", "tile", "floor")

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        table = pa.Table.from_batches(batches)
        for c in self.COLUMNS:
            setattr(self, c, table[c].to_numpy())
        self.v = matrix(table["v"], dim)
        self.unit = unit_rows(self.v)
        self.single = self.unit.astype(np.float32)

    def __len__(self):
        return len(self.id)

    def exact(self, i: np.ndarray, other: Block, j: np.ndarray) -> np.ndarray:
        """Cosines of the rows i with the rows j of ``other``, in double precision."""
        out = np.zeros(len(i))
        step = max(1, EXACT_BYTES // (8 * max(1, self.v.shape[1])))
        for s in range(0, len(i), step):
            np.einsum("ij,ij->i", self.unit[i[s:s + step]], other.unit[j[s:s + step]], out=out[s:s + step])
        return out


class Meetings:
    """Which residents (rows of ``may``) meet which streamed cells (columns)."""

    def __init__(self, may: np.ndarray):
        self.may, self.all, self.any = may, may.all(axis=0), may.any(axis=0)

    def runs(self, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(resident rows, streamed rows) that meet: one run of the cells that meet every resident, else one per cell."""
        every = np.flatnonzero(self.all[cell])
        if len(every):
            yield np.arange(len(self.may)), every
        some = np.flatnonzero(self.any[cell] & ~self.all[cell])
        some = some[np.argsort(cell[some], kind="stable")]
        for run in np.split(some, np.flatnonzero(np.diff(cell[some])) + 1) if len(some) else ():
            yield np.flatnonzero(self.may[:, cell[run[0]]]), run


def single_margin(dim: int) -> float:
    """How far a product in single precision can be from the true one."""
    return 1e-6 + 2 * dim * 6e-8


def resident_join(residents: DataFrame, streamed: DataFrame, dim: int, kernel: Callable, schema: str, parts: int) -> DataFrame:
    """Deal both sides by (q, h); per key ``kernel(Block)`` gets the residents, then ``add(Block)`` each
    streamed batch, then ``finish()``; add and finish yield record batches.

    Both frames: q int, h int, id long, ipos long, rpos long, cell int, tile int, floor double, v.
    """
    order = ["q", "h", "side", "id", "ipos", "rpos", "cell", "tile", "floor", "v"]
    both = residents.withColumn("side", F.lit(0)).select(*order).unionByName(streamed.withColumn("side", F.lit(1)).select(*order))
    dealt = both.repartition(parts, "q", "h").sortWithinPartitions("q", "h", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, work = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy() for c in ("q", "h", "side")]
            cut = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, batch.num_rows)):
                now, side = (int(marks[0][a]), int(marks[1][a])), int(marks[2][a])
                part = batch.slice(a, b - a)
                if now != key:
                    if work is not None:
                        yield from work.finish()
                    key, kept, work = now, [], None
                if side == 0:
                    kept.append(part)
                    continue
                if not kept and work is None:
                    continue  # nothing to meet here
                if work is None:
                    work, kept = kernel(Block(kept, dim)), []
                yield from work.add(Block([part], dim))
        if work is not None:
            yield from work.finish()

    return dealt.mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# nearest rows
# ---------------------------------------------------------------------------

TOP_SCHEMA = "id long, other_id long, jp long, jr long, sim double"


class TopRows:
    """Running best ``k`` streamed rows of each resident row, by similarity rounded to ``places``, then
    corpus order.  A row's ``floor`` rises with its k-th hit; only rows of cells that can reach it count.

    ``may(block)`` gives the cells each resident may still meet (rows x cells, boolean); ``threshold``
    holds for the similarity before rounding.
    """

    def __init__(self, kept: Block, k: int, may: np.ndarray, threshold: float | None = None, places: int = 6):
        self.a, self.k, self.meet, self.threshold, self.places = kept, k, Meetings(may), threshold, places
        self.floor = kept.floor.copy()
        self.margin = single_margin(kept.v.shape[1]) + 1e-6
        self.parts, self.size = [], 0

    def add(self, b: Block):
        for rows, run in self.meet.runs(b.cell):
            for s in range(0, len(rows), PRODUCT_ROWS):
                ra = rows[s:s + PRODUCT_ROWS]
                for c in range(0, len(run), PRODUCT_COLS):
                    rb = run[c:c + PRODUCT_COLS]
                    ii, jj = np.nonzero(self.a.single[ra] @ b.single[rb].T >= (self.floor[ra] - self.margin)[:, None])
                    if len(ii):
                        self._take(ra[ii], b, rb[jj])
        return ()

    def _take(self, i, b: Block, j) -> None:
        sim = self.a.exact(i, b, j)
        if self.threshold is not None:
            hit = sim >= self.threshold
            i, j, sim = i[hit], j[hit], sim[hit]
        self.parts.append((i, b.id[j], b.ipos[j], b.rpos[j], np.round(sim, self.places)))
        self.size += len(i)
        if self.size > OUT_ROWS + 2 * self.k * len(self.a):
            self._cut()

    def _cut(self) -> None:
        i, o, jp, jr, sim = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((jr, jp, -sim, i))
        i, o, jp, jr, sim = (c[order] for c in (i, o, jp, jr, sim))
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        full = rank == self.k - 1
        self.floor[i[full]] = np.maximum(self.floor[i[full]], sim[full])
        keep = rank < self.k
        self.parts, self.size = [(i[keep], o[keep], jp[keep], jr[keep], sim[keep])], int(keep.sum())

    def finish(self):
        if self.parts:
            self._cut()
            i, o, jp, jr, sim = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.a.id[i]), pa.array(o), pa.array(jp), pa.array(jr), pa.array(sim)],
                                             names=["id", "other_id", "jp", "jr", "sim"])


def own_tile_floors(cells: Cells, rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``floor``, the k-th best similarity within the row's own tile (nothing can be a k-th
    hit below it), and on one row per tile ``needs``: the cells some row of the tile must meet."""
    light = replace(cells, rows=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        block, needs = Block(held, light.dim), np.zeros(len(light.count), bool)
        floor = np.full(len(block), -2.0)
        for s in range(0, len(block), PRODUCT_ROWS):
            part = slice(s, s + PRODUCT_ROWS)
            if len(block) >= k:
                sims = block.single[part] @ block.single.T
                floor[part] = np.partition(sims, len(block) - k, axis=1)[:, len(block) - k] - single_margin(light.dim) - 1e-6
            needs |= (light.upper_for(unit_rows(block.v[part])) >= floor[part][:, None]).any(axis=0)
        at = 0
        for batch in held:
            n = batch.num_rows
            named = [np.flatnonzero(needs).astype(np.int32) if at == 0 and r == 0 else None for r in range(n)]
            table = batch.set_column(batch.schema.get_field_index("floor"), "floor", pa.array(floor[at:at + n]))
            yield table.append_column("needs", pa.array(named, pa.list_(pa.int32())))
            at += n

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("tile").applyInArrow(run, fields + ", needs array<int>")
