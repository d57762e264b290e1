"""Search history as a log with one partition per micro-batch (SNK-17, SNK-18,
LIM-8) and a Structured Streaming batch audit that writes to it.

History rows: batch, seq, timestamp, query, threshold, results,
top_similarity, recommended_intent.  ``(batch, seq)`` orders the log (a
micro-batch id and an increasing id inside it); "newest first" is that pair
descending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import materialize

HISTORY_SCHEMA = ("batch long, seq long, timestamp string, query string, threshold double, results long, "
                  "top_similarity double, recommended_intent string")
SHOWN = ["timestamp", "query", "threshold", "results", "top_similarity", "recommended_intent"]


def append_history(records: DataFrame, path: str) -> None:
    """SNK-17: append records (already shaped as ``HISTORY_SCHEMA``) to the partitions of their batches."""
    records.write.mode("append").partitionBy("batch").parquet(path)


def append_batch(records: DataFrame, path: str, batch_id: int) -> None:
    """SNK-17 for a stream: write the partition of a micro-batch, in place of what is there.

    The log has one partition per batch and only that one is written (dynamic partition
    overwrite), so a replay puts a whole batch where half of one may have been left, and the
    rest of the log is neither read nor touched.
    """
    (records.withColumn("batch", F.lit(int(batch_id)).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def _batches(spark: SparkSession, path: str) -> list[int] | None:
    """Batch ids of the log from its folders, newest first; None where there is no log."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted((int(n.split("=", 1)[1]) for n in names if n.startswith("batch=")), reverse=True)


def read_history(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """The log, or the partitions of ``batches`` alone; a missing or cleared log is empty."""
    there = _batches(spark, path)
    if not there:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(path)
    return rows if batches is None else rows.where(F.col("batch").isin(batches))


def newest(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """LIM-8 on a stored log: the newest ``n`` records, reading whole batches from the newest on until they suffice."""
    there, take = _batches(spark, path) or [], 1
    while take < len(there) and read_history(spark, path, there[:take]).limit(n).count() < n:
        take *= 2
    return recent(read_history(spark, path, there[:take]), n)


def clear_history(spark: SparkSession, path: str) -> None:
    """SNK-18: an empty log."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(where, True)
    fs.mkdirs(where)


def recent(history: DataFrame, n: int = 20, order: list[str] | None = None) -> DataFrame:
    """LIM-8: newest first, first ``n`` rows (a top-n, planned as TakeOrderedAndProject)."""
    keys = order or ["batch", "seq"]
    return history.orderBy(*[F.desc(k) for k in keys]).limit(n)


def history_records(audit: DataFrame, threshold: float, timestamp: str, batch: int = 0) -> DataFrame:
    """Batch-audit rows (``search.batch_audit``) → history records."""
    return audit.select(
        F.lit(int(batch)).cast("long").alias("batch"), F.col("query_id").cast("long").alias("seq"),
        F.lit(timestamp).alias("timestamp"),
        "query", F.lit(float(threshold)).alias("threshold"), F.col("matches_found").cast("long").alias("results"),
        F.col("top_similarity"), F.coalesce("recommended_intent", F.lit("N/A")).alias("recommended_intent"))


def audit_stream(spark: SparkSession, query_dir: str, corpus: DataFrame, history_path: str,
                 checkpoint: str, threshold: float = 0.7, top_k: int = 20, encoder=None,
                 available_now: bool = False):
    """Structured Streaming: every new text file of queries under ``query_dir``
    (one query per line) is audited against ``corpus`` (with ``embedding``)
    and appended to the history.  ``checkpoint`` must be a shared folder;
    a replayed micro-batch replaces its own partition of the log."""
    from corpuscope.functions.text import py_strip
    from corpuscope.operators.encode import HashingEncoder, encode
    from corpuscope.operators.search import batch_audit, search_hits

    enc = encoder or HashingEncoder()
    lines = spark.readStream.format("text").load(query_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        # stored once: the plans below must agree on the ids
        q = materialize(batch.select(F.monotonically_increasing_id().alias("query_id"), py_strip("value").alias("query"))
                        .where(F.col("query") != ""), "audit-queries")
        qv = encode(q, "query", "query_id", enc)
        audit = batch_audit(search_hits(corpus, qv, threshold, top_k), q)
        ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        recs = history_records(audit, threshold, "", batch_id).withColumn("timestamp", ts)
        append_batch(recs, history_path, batch_id)

    w = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
