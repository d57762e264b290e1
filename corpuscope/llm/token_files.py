"""Token ids of a corpus in files of patched frame-of-reference blocks (``pfor``).

Documents are dealt to files by ranges of their id, sorted, encoded and written
by the tasks; a manifest lists the files with their numbers of ids, whose running
sum places every file in the whole sequence.  Reading goes file by file through
the document and block indexes.

Defined results: null text counts as empty and has the end id alone; null ids
come first; rows with one id are ordered by their text's hash.  Repeated rows are
written one by one, and dealt to different files where there are many of them.
An empty table writes no file.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, shared_folder, whole_text
from corpuscope.llm.files import open_store, written
from corpuscope.llm.pfor import TokenFile, write_file
from corpuscope.llm.token_ids import encoder


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                      folder: str | None = None) -> DataFrame:
    """Write all documents in ascending id order; the manifest ``part, path, n_ids, first_id`` (stored)."""
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("body"))
    src = src.withColumn("tie", F.xxhash64("body")).withColumn("rid", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "tie", "rid"]
    rows = src.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "body")

    def run(batches):
        from pyspark import TaskContext

        words, end, part = encoder(tokenizer), np.array([end_id], "<u4"), TaskContext.get().partitionId()

        def documents(first):
            for batch in chain([first], batches):
                for name, packed in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("body").to_pylist())):
                    yield name, np.concatenate((np.frombuffer(packed, words.dtype).astype("<u4"), end))

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part-{part:06d}.pfor"
        with written(folder, name) as out:
            n = write_file(out, documents(first))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]),
                                          pa.array([n], pa.int64())], ["part", "path", "n_ids"])

    files = materialize(rows.mapInArrow(run, "part long, path string, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-index")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, and its ``ids`` on request."""
    spark: SparkSession = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist()):
                store, at = open_store(path)
                with store.open_input_file(at) as stream:
                    held = []
                    for name, start, ids in TokenFile(stream).documents():
                        held.append((name, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                                     *([ids.astype(np.int64)] if with_ids else [])))
                        if len(held) >= 4096:
                            yield _batch(held, with_ids)
                            held = []
                    if held:
                        yield _batch(held, with_ids)

    files = manifest.count()
    dealt = manifest.select("path", "first_id").repartition(max(1, min(files, 4 * spark.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = [pa.array(x, pa.int64()) for x in list(zip(*rows))[:4]]
    if with_ids:
        cols.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
