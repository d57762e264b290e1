"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.session import checkpoint_dir, materialize

__all__ = ["ASCII_SPACE", "fresh", "lookup", "materialize", "row_key", "shared_folder", "whole_text"]

#: White space of every contract: space and the control characters tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` does not use (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(col: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(df: DataFrame) -> Column:
    """Hash of every column of a row: a stable order among rows that tie on the id."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Join a large table with a written lookup table.

    ``small`` must be a stored table (counting it is cheap).  It is broadcast
    when its counted rows stay within ``broadcast_rows``; beyond that the join
    shuffles both sides, where adaptive execution splits skewed partitions.
    """
    if small.count() <= broadcast_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def shared_folder(spark, name: str) -> str:
    """A new folder (not yet made) below the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
