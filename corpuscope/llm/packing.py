"""Best-fit packing of token pieces into fixed-length sequences by exact complements.

1. Every document is encoded once; documents longer than the capacity are cut
   into full pieces and a last, shorter one.
2. Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
   driver.  ``plan`` works on these counts: for each length, from the longest,
   it looks up one, two or three available lengths that fill the gap exactly;
   where there are none the longest piece that fits goes in first (best fit).  A
   pattern is consumed as often as its lengths last, so the size of the plan
   depends on the capacity, not on the data.
3. Every piece gets its rank among the pieces of its length, in salted chunks, so
   that no length meets in one task, and a broadcast join with the plan turns
   (length, rank) into a sequence and an offset.

Defined results: null text counts as empty and has the end id alone.  A null id
is kept.  Repeated rows are packed one by one.  An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from corpuscope.llm.common import fresh, materialize, whole_text
from corpuscope.llm.token_ids import encoder

CAPACITY = 4096
#: Chunks that the pieces of one length are dealt to for ranking.
CHUNKS = 256


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and its ``ids`` on request."""
    src = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("body"))
    schema = (StructType([src.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long")
              .add("ids_crc32", "long"))
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches):
        words = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, packed in enumerate(words.encode(batch.column("body").to_pylist())):
                all_ids = np.concatenate((np.frombuffer(packed, words.dtype).astype("<u4"), end))
                for k, at in enumerate(range(0, len(all_ids), capacity)):
                    part = all_ids[at:at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return src.mapInArrow(run, schema)


def _exact(gap: int, count: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to ``gap``, the largest first."""
    if count[gap]:
        return (gap,)
    have = np.flatnonzero(count[1:gap]) + 1
    pair = _pair(gap, have, count)
    if pair:
        return pair
    # bit x of both masks: x is available, gap - x is available
    here, across = (int.from_bytes(np.packbits(side > 0, bitorder="little").tobytes(), "little")
                    for side in (count[:gap + 1], count[gap::-1]))
    for a in have[::-1].tolist():
        if 3 * a < gap:
            break
        if here & (across >> a):  # two available lengths add up to gap - a
            count[a] -= 1
            left = have[(have <= a) & (count[have] > 0)]
            pair = _pair(gap - a, left, count)
            count[a] += 1
            if pair:
                return (a, *pair)
    return None


def _pair(total: int, have: np.ndarray, count: np.ndarray) -> tuple[int, int] | None:
    large = have[(2 * have >= total) & (have < total)]
    large = large[count[total - large] > (2 * large == total)]  # two of one length must be there twice
    return (int(large[-1]), int(total - large[-1])) if len(large) else None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(sequences, [(length, copies), ...])``: how many sequences hold these pieces, in order.

    A sequence starts with the longest length left.  While no combination fills
    its gap exactly, it takes the longest piece that fits (best fit); the pattern
    is then used for as many sequences as its lengths last.  Every pattern uses
    up a length, so there are at most as many patterns as lengths.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    for length in range(capacity, 0, -1):
        while count[length]:
            need, gap = Counter([length]), capacity - length
            count[length] -= 1
            while gap:
                found = _exact(gap, count)
                if found is None:
                    fits = np.flatnonzero(count[1:gap + 1])
                    if not len(fits):
                        break
                    longest = int(fits[-1]) + 1
                    # as many of them as leave a gap no shorter than the piece itself
                    found = (longest,) * max(1, min(gap // longest - 3, int(count[longest])))
                for x in found:
                    need[x] += 1
                    count[x] -= 1
                    gap -= x
            for x, k in need.items():
                count[x] += k
            n = min(int(count[x]) // k for x, k in need.items())
            for x, k in need.items():
                count[x] -= n * k
            groups.append((n, sorted(need.items(), reverse=True)))
    return groups


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, lo, hi, first_sequence, copies, offset``: ranks ``lo`` to ``hi`` of a length and where they go."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for n, held in groups:
        offset = 0
        for length, copies in held:
            rows.append((length, used[length], used[length] + n * copies, first, copies, offset))
            used[length] += n * copies
            offset += length * copies
        first += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` up to ``capacity``) with ``sequence_id`` and ``offset`` (long), which replace columns of
    those names; other columns pass whatever their names."""
    spark = pieces.sparkSession
    rid, chunk, own, rank = fresh(pieces, "rid", "chunk", "own", "rank")
    slot = dict(zip(("length", "lo", "hi", "first", "copies", "base"),
                    fresh(pieces, "slot_length", "slot_lo", "slot_hi", "slot_first", "slot_copies", "slot_base")))
    stored = materialize(pieces.withColumn(rid, F.monotonically_increasing_id()), "pieces")
    salted = stored.withColumn(chunk, F.pmod(F.xxhash64(rid), F.lit(CHUNKS)).cast("int"))
    counts = materialize(salted.groupBy("length", chunk).agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.createDataFrame(slots(plan(histogram, capacity)), ", ".join(f"{name} long" for name in slot.values()))
    before = Window.partitionBy("length").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    (start,) = fresh(pieces, "chunk_start")
    starts = counts.select("length", chunk, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    ranked = (salted.withColumn(own, F.row_number().over(Window.partitionBy("length", chunk).orderBy(rid)) - 1)
              .join(starts, ["length", chunk]).withColumn(rank, F.col(start) + F.col(own)))
    at = F.col(rank) - F.col(slot["lo"])
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return (ranked.join(F.broadcast(table), (F.col("length") == F.col(slot["length"])) & (F.col(rank) >= F.col(slot["lo"]))
                        & (F.col(rank) < F.col(slot["hi"])))
            .select(*kept, (F.col(slot["first"]) + F.expr(f"(`{rank}` - `{slot['lo']}`) DIV `{slot['copies']}`")).alias("sequence_id"),
                    (F.col(slot["base"]) + at % F.col(slot["copies"]) * F.col("length")).alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and the place in it."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), capacity)
