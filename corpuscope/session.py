"""Spark session defaults for label-corpus audits.

Everything here is ordinary Spark configuration.  Library functions never
depend on these settings for correctness; they only make local runs behave
like a cluster (AQE, skew-join splitting, Arrow batches).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # cp1252 CSV input (trap T-1) needs the legacy Java charset list.
    "spark.sql.legacy.javaCharsets": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "corpuscope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, laptops) gets a
    scratch folder of its own; on a cluster the setting must be present.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="corpuscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the checkpoint folder.

    A written table survives executor loss (unlike a cached or locally
    checkpointed one) and is read back with column pruning and pushdown.
    Every call writes a fresh folder, so concurrent readers of an older
    result are never disturbed.
    """
    import uuid

    spark = df.sparkSession
    root = checkpoint_dir(spark)
    path = os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` only when its scan has fewer partitions than cores.

    Large inputs arrive in thousands of file splits and are left alone (no
    shuffle); a small single-row-group file is spread so that per-row heavy
    work (tokenising, hashing, vector products) uses every core.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
