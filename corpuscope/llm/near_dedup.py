"""Near-duplicate components by HyperMinHash sketches.

1. Every whole text becomes its set of 5-word shingles and a HyperMinHash
   sketch (``hyperminhash``).  Documents with equal sets form one class, so
   exact copies meet once; only classes take part in what follows.
2. Banding: neighbouring registers are joined to 128 coarse ones (the minimum of
   both buckets), and each run of four is a bucket key.  At similarity 0.75, 32
   bands miss a pair with probability (1 - 0.75**4)**32 = 5e-6.
3. First pass, linear in the rows: each class is paired with the smallest class
   of each of its buckets; the share of agreeing registers gates the pairs and
   the best one per class by the collision-corrected estimate is confirmed on the full shingle sets.  This joins
   groups of copies without ever listing their pairs.
4. Second pass, linear too: in every bucket that still holds more than one
   component, classes of different components are compared by sketch, large
   buckets in block pairs, a pair only in the first bucket it shares; each class proposes its ``TRIES`` best partners
   of other components, which are confirmed on the full sets.
5. Third pass, for what is still apart: all pairs of different components in a
   bucket whose registers may reach the threshold (4.5 deviations of slack) are
   confirmed on the full sets.
6. Components of the confirmed links (``components``), on class level.

Defined results: null text counts as empty; a text without words has no
shingles, is linked with nothing and is its own component; a null id never
becomes a component id unless every id of the component is null.  Repeated rows
are equal sets and share a component.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm import hyperminhash as hmh
from corpuscope.llm.common import fresh, lookup, materialize, whole_text
from corpuscope.llm.components import connected_components
from corpuscope.llm.shingles import WORDS, shingle_sets

#: Coarse registers in a band, and bands.
ROWS = 4
BANDS = hmh.BUCKETS // (2 * ROWS)
THRESHOLD = 0.75
#: Classes of a bucket compared in one block.
BLOCK = 1024
#: Partners that a class proposes in the second pass.
TRIES = 3
#: Bytes of text whose shingle sets a task holds at once.
SKETCH_BYTES = 2 << 20


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """``doc_id, text_md5, n_shingles, set_digest, regs`` of every document."""
    body = whole_text(text_col).cast("binary")
    src = docs.select(F.col(id_col).alias("doc_id"), F.md5(body).alias("text_md5"), body.alias("body"))
    schema = src.drop("body").schema.add("n_shingles", "long").add("set_digest", "binary").add("regs", "binary")

    def run(batches):
        for batch in chain.from_iterable(map(_pieces, batches)):
            sets = list(shingle_sets(batch.column("body").to_pylist(), k))
            regs = hmh.sketch(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_md5"),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "text_md5", "n_shingles", "set_digest", "regs"])

    return src.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``SKETCH_BYTES`` of text: all sets of a run are held at once."""
    sizes = pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SKETCH_BYTES)) + 1
    for start, end in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
        if end > start:
            yield batch.slice(start, end - start)


def classes_of(sketched: DataFrame) -> DataFrame:
    """One row per distinct non-empty shingle set, numbered by ``cid``."""
    return (sketched.filter("n_shingles > 0").groupBy("set_digest")
            .agg(F.min("doc_id").alias("first_id"), F.min("text_md5").alias("text_md5"),
                 F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
            .withColumn("cid", F.monotonically_increasing_id()))


def bucket_members(classes: DataFrame) -> DataFrame:
    """``cid, band, key, size, hub`` of classes in buckets of two or more; ``hub`` is the bucket's smallest class."""
    width = 4 * ROWS  # bytes of the fine registers of a band
    at = lambda j: f"substring(regs, band * {width} + {2 * j + 1}, 2)"
    coarse = [F.expr(f"if({at(2 * j)} != X'FFFF', {at(2 * j)}, concat(X'01', {at(2 * j + 1)}))") for j in range(ROWS)]
    rows = (classes.select("cid", "regs", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
            .filter(F.expr(f"substring(regs, band * {width} + 1, {width}) != X'{'FF' * width}'"))
            .select("cid", "band", F.xxhash64("band", *coarse).alias("key")))
    buckets = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("hub"))
               .filter("size > 1"))
    return rows.join(buckets, "key")


def _registers(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, hmh.BUCKETS)


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``pairs(a, b)`` whose sketches allow the threshold, with ``estimate``."""
    side = classes.select("cid", "n", "regs")
    rows = (pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
            .filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
            .select("a", "b", "n_a", "n_b", "regs_a", "regs_b"))

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            same, used = hmh.agreement(_registers(batch.column("regs_a")), _registers(batch.column("regs_b")))
            est = hmh.corrected(same, used, n_a, n_b)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], ["a", "b", "estimate"])
            yield out.filter(pa.array(hmh.may_reach(same, used, n_a, n_b, threshold)))

    return rows.mapInArrow(run, "a long, b long, estimate double")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, threshold: float,
              k: int = WORDS) -> DataFrame:
    """The ``pairs(a, b)`` of classes linked on their full shingle sets.

    ``pairs`` is a stored table.  Only the texts of classes that occur in it
    are fetched, one per class; they are found by content digest.
    """
    needed = materialize(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
                         .distinct().join(classes.select("cid", "text_md5"), "cid"), "near-needed")
    body = whole_text(text_col).cast("binary")
    texts = materialize(
        lookup(docs.select(F.md5(body).alias("text_md5"), body.alias("body")), needed, ["text_md5"], "inner")
        .groupBy("cid").agg(F.first("body").alias("body")), "near-texts")
    rows = (pairs.select("a", "b").join(texts.toDF("b", "body_b"), "b").join(texts.toDF("a", "body_a"), "a")
            .select("a", "b", "body_a", "body_b"))

    def run(batches):
        part = round(100 * threshold)
        held, held_set = None, None  # rows come grouped by a: its set is made once
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            body_a = batch.column("body_a")
            ok = []
            for i, other in enumerate(shingle_sets(batch.column("body_b").to_pylist(), k)):
                if a[i] != held:
                    held, (held_set,) = a[i], shingle_sets([body_a[i].as_py()], k)
                both = len(np.intersect1d(held_set, other, assume_unique=True))
                ok.append(100 * both >= part * (len(held_set) + len(other) - both))
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            yield out.filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def undecided(members: DataFrame, classes: DataFrame, components: DataFrame, threshold: float,
              tries: int | None = None) -> DataFrame:
    """``a, b, estimate`` of classes of different components that share a bucket and may reach the threshold.

    With ``tries`` only the best partners of each class in each bucket (``a`` is
    the class that proposes); else all such pairs, ``a < b``.  Buckets within one
    component are dropped first.  A bucket of more than ``BLOCK`` classes is cut
    into blocks by a hash of the class, and each pair of blocks is compared on its
    own, so no task holds more than two blocks.
    """
    comp = F.coalesce("component", "cid")
    placed = members.join(components.withColumnRenamed("node", "cid"), "cid", "left").select("key", "band", "size", "cid", comp.alias("comp"))
    placed = materialize(placed, "near-placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    rows = (placed.join(mixed, "key").withColumn("blocks", blocks).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "band", "cid", "comp")
            .join(classes.select("cid", "n", "regs"), "cid"))
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = rows.select("key", "lo", "hi", "own", "band", "cid", "comp", "n", "regs").mapInArrow(
        lambda batches: _cross_pairs(batches, threshold, tries), "a long, b long, estimate double")
    return found


def _cross_pairs(batches, threshold: float, tries: int | None):
    """Compare the rows of each (key, lo, hi) group; groups are contiguous and may span batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        heads = _heads(table)
        if len(heads) > 1:  # the last group may go on in the next batch
            yield from _within(table.slice(0, heads[-1]), heads, threshold, tries)
        held = table.slice(heads[-1]) if len(heads) else None
    if held is not None and held.num_rows:
        yield from _within(held, _heads(held), threshold, tries)


def _heads(table: pa.Table) -> np.ndarray:
    cols = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _within(table: pa.Table, heads: np.ndarray, threshold: float, tries: int | None):
    n = table.num_rows
    ends = np.append(heads[heads < n][1:], n)
    own, lo, hi, cid, comp, size, band = (table.column(c).to_numpy() for c in ("own", "lo", "hi", "cid", "comp", "n", "band"))
    regs = _registers(table.column("regs"))
    sketches_ = regs, _coarse(regs), band
    held, count = [], 0
    for start, end in zip(heads[heads < n], ends):
        rows = np.arange(start, end)
        if lo[start] == hi[start]:
            left, right, offset = rows, rows, True
        else:
            left, right, offset = rows[own[rows] == lo[start]], rows[own[rows] == hi[start]], False
        step = max(1, 200_000 // max(1, len(right)))
        for i in range(0, len(left), step):
            x, y = np.repeat(left[i:i + step], len(right)), np.tile(right, len(left[i:i + step]))
            ok = comp[x] != comp[y]
            if offset:
                ok &= x < y
            ok &= np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
            held.append((x[ok], y[ok]))
            count += int(ok.sum())
            if count >= 100_000:
                yield from _gated(held, sketches_, size, cid, threshold, tries)
                held, count = [], 0
    yield from _gated(held, sketches_, size, cid, threshold, tries)


def _coarse(regs: np.ndarray) -> np.ndarray:
    """Minima of neighbouring buckets: the lower bucket's register where it has one, else the upper's, marked."""
    low, high = regs[:, 0::2].astype(np.uint32), regs[:, 1::2].astype(np.uint32)
    return np.where(low != hmh.EMPTY, low, high | np.uint32(1 << 16))


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which the coarse registers of each pair agree (empty bands agree on nothing)."""
    same = (a == b).reshape(len(a), BANDS, ROWS).all(axis=2)
    return (same & (a != (hmh.EMPTY | 1 << 16)).reshape(len(a), BANDS, ROWS).any(axis=2)).argmax(axis=1)


def _gated(held, sketches_, size, cid, threshold: float, tries: int | None):
    if not held:
        return
    regs, coarse, band = sketches_
    x, y = (np.concatenate(side) for side in zip(*held))
    kept = []
    for i in range(0, len(x), 50_000):
        p, q = x[i:i + 50_000], y[i:i + 50_000]
        here = _first_shared(coarse[p], coarse[q]) == band[p]
        p, q = p[here], q[here]
        n_p, n_q = size[p].astype(float), size[q].astype(float)
        same, used = hmh.agreement(regs[p], regs[q])
        ok = hmh.may_reach(same, used, n_p, n_q, threshold)
        kept.append((p[ok], q[ok], hmh.corrected(same[ok], used[ok], n_p[ok], n_q[ok])))
    x, y, est = (np.concatenate(side) for side in zip(*kept)) if kept else (x, y, np.empty(0))
    if tries is None:
        a, b = np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])
    else:  # rows stand for a class in one bucket: rank the partners of each row
        x, y, est = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((est, est))
        order = np.lexsort((cid[y], -est, x))
        x, y, est = x[order], y[order], est[order]
        new = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, int)
        rank = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
        a, b, est = cid[x][rank < tries], cid[y][rank < tries], est[rank < tries]
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(est, pa.float64())],
                                     ["a", "b", "estimate"])


def class_links(classes: DataFrame, docs: DataFrame, text_col: str, threshold: float, k: int = WORDS) -> DataFrame:
    """Confirmed links ``a, b`` between classes; they connect every component."""
    members = materialize(bucket_members(classes), "near-members")
    stars = materialize(estimated(members.filter("cid != hub").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
                                  .distinct(), classes, threshold), "near-stars")
    best = materialize(stars.groupBy("b").agg(F.min(F.struct((-F.col("estimate")).alias("e"), F.col("a").alias("a"))).alias("m"))
                       .select(F.col("m.a").alias("a"), "b"), "near-best")
    first = materialize(confirmed(best, classes, docs, text_col, threshold, k), "near-first")
    proposed = undecided(members, classes, connected_components(first), threshold, TRIES)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("estimate"), "b"))
    second = materialize(proposed.withColumn("rank", rank).filter(F.col("rank") <= TRIES)
                         .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                         .join(best, ["a", "b"], "left_anti"), "near-proposed")
    links = materialize(first.unionByName(confirmed(second, classes, docs, text_col, threshold, k)), "near-second")
    third = materialize(undecided(members, classes, connected_components(links), threshold).select("a", "b")
                        .join(best.unionByName(second), ["a", "b"], "left_anti"), "near-rest")
    return links.unionByName(confirmed(third, classes, docs, text_col, threshold, k))


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, k: int) -> DataFrame:
    """``doc_id, text_md5, n_shingles, component_id, comp`` (``comp`` null: linked with nothing)."""
    sketched = materialize(sketches(docs, id_col, text_col, k), "near-sketches")
    classes = materialize(classes_of(sketched), "near-classes")
    links = materialize(class_links(classes, docs, text_col, threshold, k), "near-links")
    comp = materialize(connected_components(links), "near-components")
    placed = (classes.select("cid", "set_digest", "first_id")
              .join(comp.withColumnRenamed("node", "cid"), "cid", "left")
              .withColumn("comp", F.coalesce("component", "cid")))
    least = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "comp").select("set_digest", "component_id", "comp")
    rows = sketched.select("doc_id", "text_md5", "n_shingles", "set_digest")
    linked = rows.filter("n_shingles > 0").join(named, "set_digest").drop("set_digest")
    alone = (rows.filter("n_shingles = 0").drop("set_digest")
             .withColumn("component_id", F.col("doc_id")).withColumn("comp", F.lit(None).cast("long")))
    return linked.unionByName(alone)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                k: int = WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    return _grouped(docs, id_col, text_col, threshold, k).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                         k: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id.

    Of different texts with that id the one with the smallest digest stays; rows
    that repeat its id and text are the same document and stay (exact
    deduplication removes them).  Texts without words all stay.
    """
    (key,) = fresh(docs, "drop_key")
    rows = materialize(_grouped(docs, id_col, text_col, threshold, k), "near-groups").filter("comp IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_md5").alias("md5"))
    firsts = rows.groupBy("comp").agg(F.min(order).alias("first"))
    losers = materialize(
        rows.join(firsts, "comp")
        .filter(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_md5") == F.col("first.md5"))))
        .select(F.struct("doc_id", "text_md5").alias(key)).distinct(), "near-losers")
    gone = F.broadcast(losers) if losers.count() <= 200_000 else losers
    body = whole_text(text_col).cast("binary")
    same = F.struct(F.col(id_col).alias("doc_id"), F.md5(body).alias("text_md5")).eqNullSafe(F.col(key))
    return docs.join(gone, same, "left_anti")
