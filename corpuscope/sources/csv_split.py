"""CSV records out of files that are split, line breaks inside quoted cells included (SRC-1).

Spark's text reader cuts the files into splits and lines.  Whether a line begins a
record depends on the quotes before it, so every split is read twice:

1. each split reports, for both cases (it begins between records, it begins inside
   a quoted cell), how it ends and how many records begin in it; running through the
   splits of a file in order settles the case and the record numbers of each;
2. each split joins its lines to records.  A record that goes on in the next split
   leaves as a piece, and only pieces are put together by a shuffle.

Memory is a batch of lines and one record.  Rows are numbered by file (in path order),
then by place in the file.  A quote opens a cell only at its beginning and is doubled
inside; blank lines are no records.  Lines end in LF or CR LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.session import materialize

OUT, IN = 0, 1            # between cells or in a plain one; inside a quoted cell
BROADCAST_SPLITS = 200_000
LINES_AT_ONCE = 64        # lines of a batch that are Python objects at once
RECORD_CHARS = 1 << 20    # characters of the records that leave together

STATES = "file string, block long, out_end int, out_starts long, in_end int, in_starts long, head string"


def end_state(line: str, state: int) -> int:
    """State after a line that begins in ``state``."""
    if '"' not in line:
        return state
    at, n = 0, len(line)
    while True:
        if state == IN or line.startswith('"', at):
            at += state == OUT
            while True:
                at = line.find('"', at)
                if at < 0:
                    return IN
                if line.startswith('"', at + 1):
                    at += 2
                    continue
                break
            state = OUT
        at = line.find(",", at)
        if at < 0 or at + 1 > n:
            return OUT
        at += 1


def lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """(file, block, id, line binary): lines in their order within a split; ``encoding`` is a Java name."""
    reader = spark.read.option("lineSep", "\n")
    if encoding.startswith("UTF-16"):
        reader = reader.option("encoding", encoding)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"))


def _splits_of(batches: Iterator[pa.RecordBatch], codec: str):
    """(file, block, extra columns of its first line, text lines) pieces of a stream of lines, in order."""
    key, carry = None, b""
    names = None
    for batch in batches:
        names = names or [n for n in batch.schema.names if n not in ("file", "block", "id", "line")]
        rows = (row for s in range(0, batch.num_rows, LINES_AT_ONCE)
                for row in zip(*(batch.column(n).slice(s, LINES_AT_ONCE).to_pylist() for n in ("file", "block", "line", *names))))
        for file, block, raw, *more in rows:
            if key != (file, block):
                key, carry = (file, block), b""
                first = block == 0
            else:
                first = False
            raw = carry + raw
            if codec.startswith("utf-16") and len(raw) % 2:
                carry = raw + "\n".encode(codec)   # half a character that looks like a line break
                continue
            carry = b""
            text = raw.decode(codec)
            if first:
                text = text.removeprefix("﻿")
            yield file, block, more, text[:-1] if text.endswith("\r") else text, text


def _states(codec: str):
    def run(batches):
        key, rows, head = None, [], None

        def row():
            return (*key, state[0], starts[0], state[1], starts[1], head)

        for file, block, _, bare, text in _splits_of(batches, codec):
            if key != (file, block):
                if key is not None:
                    rows.append(row())
                key, state, starts = (file, block), [OUT, IN], [0, 0]
                head, open_head = None, [] if block == 0 else None
            if open_head is not None and (bare or open_head):
                open_head.append(text)
            for case in (0, 1):
                starts[case] += state[case] == OUT and bare != ""
                state[case] = end_state(bare, state[case])
            if open_head and state[0] == OUT:
                head, open_head = "\n".join(open_head).removesuffix("\r"), None
        if key is not None:
            rows.append(row())
        if rows:
            names = [part.split()[0] for part in STATES.split(",")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(
                [("file", pa.string()), ("block", pa.int64()), ("out_end", pa.int32()), ("out_starts", pa.int64()),
                 ("in_end", pa.int32()), ("in_starts", pa.int64()), ("head", pa.string())]))
    return run


def split_states(spark: SparkSession, paths: list[str], encoding: str, codec: str) -> DataFrame:
    """One row per split: its end state and record starts in either case, and the first record of the file."""
    read = lines(spark, paths, encoding).mapInArrow(_states(codec), STATES)
    return materialize(read, "csv-splits")


def _placed(states: DataFrame) -> DataFrame:
    """(file, block, state, base): how each split begins, and records of its file that begin before it."""
    def step(done, s):
        last = F.element_at(done, -1)
        outside = last["state"] == OUT
        end = F.when(outside, last["out_end"]).otherwise(last["in_end"])
        base = last["base"] + F.when(outside, last["out_starts"]).otherwise(last["in_starts"])
        return F.concat(done, F.array(F.struct(s["block"].alias("block"), end.alias("state"), base.alias("base"),
                                               *[s[c].alias(c) for c in ("out_end", "out_starts", "in_end", "in_starts")])))
    per_file = states.groupBy("file").agg(F.array_sort(F.collect_list(
        F.struct("block", "out_end", "out_starts", "in_end", "in_starts"))).alias("s"))
    kind = "array<struct<block: bigint, state: int, base: bigint, out_end: int, out_starts: bigint, in_end: int, in_starts: bigint>>"
    before = F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.lit(OUT).alias("state"), F.lit(0).cast("long").alias("base"),
                              F.lit(OUT).alias("out_end"), F.lit(0).cast("long").alias("out_starts"), F.lit(OUT).alias("in_end"),
                              F.lit(0).cast("long").alias("in_starts"))).cast(kind)
    run = F.aggregate("s", before, lambda d, s: step(d, s).cast(kind))
    return per_file.select("file", F.explode(F.slice(run, 2, F.size("s"))).alias("p")).select(
        "file", "p.block", "p.state", "p.base", F.when(F.col("p.state") == OUT, F.col("p.out_starts")).otherwise(F.col("p.in_starts")).alias("starts"))


def _records(codec: str):
    def run(batches):
        key, out, size = None, [], 0
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("record", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])

        def close(whole):
            if held:
                out.append({"file": key[0], "block": key[1], "record": number, "text": "\n".join(held), "whole": whole})
                held.clear()

        for file, block, more, bare, text in _splits_of(batches, codec):
            if key != (file, block):
                if key is not None:
                    close(state == OUT and started)
                key, held = (file, block), []
                state, base = more
                number, started = base - 1, False        # what comes first may belong to the record before
            if state == OUT:
                if bare == "":
                    continue
                number, started = number + 1, True
            held.append(text)
            size += len(text)
            state = end_state(bare, state)
            if state == OUT:
                close(started)
                if len(out) >= 4096 or size >= RECORD_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if key is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def read_records(spark: SparkSession, paths: list[str], encoding: str, codec: str, states: DataFrame | None = None) -> DataFrame:
    """(row_pos, record): the records of ``paths`` but the first of each file, numbered densely."""
    states = split_states(spark, paths, encoding, codec) if states is None else states
    placed = materialize(_placed(states), "csv-places")
    per_file = placed.groupBy("file").agg(F.sum("starts").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    offsets = per_file.select("file", F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(before), F.lit(0)).alias("offset"))
    held, begins = lines(spark, paths, encoding), placed.select("file", "block", "state", "base")
    if placed.count() <= BROADCAST_SPLITS:
        held = held.join(F.broadcast(begins), ["file", "block"])                    # lines stay in their order
    else:
        held = held.join(begins, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "id")
    found = held.select("file", "block", "id", "line", "state", "base").mapInArrow(
        _records(codec), "file string, block long, record long, text string, whole boolean")
    stored = materialize(found, "csv-records")
    pieces = stored.where("not whole").groupBy("file", "record").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"))
    every = stored.where("whole").select("file", "record", "text").unionByName(pieces).where("record > 0")
    return every.join(F.broadcast(offsets) if offsets.count() <= BROADCAST_SPLITS else offsets, "file").select(
        (F.col("offset") + F.col("record") - 1).alias("row_pos"), F.regexp_replace("text", "\r\\z", "").alias("record"))
