"""Order helpers that stay balanced when one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: str, order: list[str], out: str = "rn", width: int = 4096) -> DataFrame:
    """Dense 1-based position of each row inside ``group`` by ``order``.

    ``order[0]`` must be numeric (a row position).  A window partitioned by
    the group would sort a hot group in one task; instead rows are cut into
    fixed ranges of ``order[0]`` (``width`` wide, independent of the data
    layout, so every evaluation agrees):

    * local rank: ``row_number`` over (group, range) — at most ``width``
      distinct positions per window;
    * offset: rows of the group in earlier ranges — one count per
      (group, range), then a running sum over that small table.
    """
    rng = F.floor(F.col(order[0]) / F.lit(width)).cast("long")
    d = df.withColumn("_rng", rng)
    w_local = Window.partitionBy(group, "_rng").orderBy(*order)
    local = d.withColumn("_lr", F.row_number().over(w_local))
    seg = d.groupBy(group, "_rng").agg(F.count(F.lit(1)).alias("_n"))
    w_cum = Window.partitionBy(group).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offs = seg.select(group, "_rng", F.coalesce(F.sum("_n").over(w_cum), F.lit(0)).alias("_off"))
    return local.join(offs, [group, "_rng"]).select(*df.columns, (F.col("_off") + F.col("_lr")).cast("long").alias(out))


def first_per_key(df: DataFrame, key: list[str], order: list[str], id_col: str) -> DataFrame:
    """Rows that come first for their ``key`` by ``order`` ("keep first").

    ``min(struct(order…, id))`` per key is a partial aggregate (a hot key is
    reduced in every task before the shuffle); the winners are joined back on
    their unique id.
    """
    best = df.groupBy(*key).agg(F.min(F.struct(*[F.col(c) for c in order], F.col(id_col))).alias("_b"))
    winners = best.select(F.col(f"_b.{id_col}").alias(id_col))
    return df.join(winners, id_col, "left_semi")
