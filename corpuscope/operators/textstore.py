"""Results per distinct text, kept from run to run (KW-7, EMB-1).

A ``TextStore`` is a folder of Parquet batches keyed by the SHA-256 of the text.
``compute_once`` looks the distinct texts of a table up, works out those that are
not there (an anti-join on the digest), adds them as a batch of their own and joins
all values back.  Every distinct text is worked out once, however often it repeats
and however many runs ask for it.

A batch counts once its ``_SUCCESS`` marker is there, so a run that stops half way
leaves nothing behind that a later run would read; two runs at once may both work a
text out, and either value is taken.  ``name`` must change with whatever changes the
values (encoder, size, language).  Null texts have the value of the empty text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import keywords
from corpuscope.session import checkpoint_dir, spread


@dataclass(frozen=True)
class TextStore:
    """Values of one kind: ``value_type`` (a Spark SQL type) per text, below ``root``/``name``."""

    root: str
    name: str
    value_type: str

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    def _batches(self, spark: SparkSession) -> list[str]:
        """Complete batches; a path per earlier run that found new texts."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS"))
        return sorted(s.getPath().getParent().toString() for s in done or [])

    def read(self, spark: SparkSession) -> DataFrame:
        """(digest, value), one row per text."""
        schema = f"digest binary, value {self.value_type}"
        paths = self._batches(spark)
        if not paths:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(*paths)
        return rows if len(paths) == 1 else rows.dropDuplicates(["digest"])

    def add(self, rows: DataFrame) -> int:
        """Store (digest, value) rows as a batch, and say how many there were."""
        path = f"{self.path}/batch={uuid.uuid4().hex}"
        rows.select("digest", "value").write.parquet(path)
        return rows.sparkSession.read.parquet(path).count()


def shared_store(spark: SparkSession, name: str, value_type: str) -> TextStore:
    """A store below the shared checkpoint folder."""
    return TextStore(f"{checkpoint_dir(spark).rstrip('/')}/texts", name, value_type)


def text_digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def compute_once(df: DataFrame, store: TextStore, text: str, out: str, compute: Callable[[DataFrame], DataFrame],
                 stats: dict | None = None) -> DataFrame:
    """``df`` with the column ``out``: the stored value of ``text``.

    ``compute`` gets (digest, text) rows of the unseen texts and returns (digest, value).
    It runs at once, over these rows alone; with ``stats`` their number is put under
    ``computed``.
    """
    spark = df.sparkSession
    key = "_digest"
    while key.lower() in {c.lower() for c in df.columns}:
        key = "_" + key
    keyed = df.withColumn(key, text_digest(text))
    texts = keyed.groupBy(F.col(key).alias("digest")).agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    unseen = texts.join(store.read(spark).select("digest"), "digest", "left_anti")
    computed = store.add(compute(spread(unseen))) if unseen.limit(1).count() else 0
    if stats is not None:
        stats["computed"] = computed
    values = store.read(spark).select(F.col("digest").alias(key), F.col("value").alias(out))
    return keyed.join(values, key, "left").drop(key)


def keywords_once(df: DataFrame, store: TextStore, text: str = "phrase", variant: str = "multi", stats: dict | None = None) -> DataFrame:
    """KW-1 / KW-2 + KW-7: ``df`` + ``keywords``, worked out once per distinct text."""
    return compute_once(df, store, text, "keywords",
                        lambda t: t.select("digest", keywords("text", variant).alias("value")), stats)


def encode_once(df: DataFrame, store: TextStore, encoder=None, text: str = "phrase", normalize: bool = True,
                batch_size: int = 32, stats: dict | None = None) -> DataFrame:
    """EMB-1 + KW-7: ``df`` + ``embedding``, each distinct text encoded once."""
    from corpuscope.operators.encode import encode

    return compute_once(df, store, text, "embedding",
                        lambda t: encode(t, "text", "digest", encoder, normalize, batch_size)
                        .select("digest", F.col("embedding").alias("value")), stats)
