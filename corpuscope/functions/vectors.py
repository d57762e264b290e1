"""Column expressions on ``array<float|double>`` vectors.

All of these are JVM-side higher-order functions: no Python runs per row.
Accumulation is in double even when the input is float (trap T-16).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sq_norm(a) -> Column:
    a = _col(a)
    return F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; a zero vector on either side gives 0.0 (B16)."""
    na = norm(a) if norm_a is None else _col(norm_a)
    nb = norm(b) if norm_b is None else _col(norm_b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def l2_normalise(a, norm_col=None) -> Column:
    """EMB-4: x / ||x||; the zero vector stays zero.

    Pass ``norm_col`` (a column computed in an earlier projection) to keep
    the norm from being re-evaluated inside the lambda.
    """
    a = _col(a)
    n = norm(a) if norm_col is None else _col(norm_col)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double") * 0.0)) \
        .otherwise(F.transform(a, lambda x: x.cast("double") / n))


def to_double(a) -> Column:
    return F.transform(_col(a), lambda x: x.cast("double"))
