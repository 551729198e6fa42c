"""Vector maths on ARRAY<DOUBLE> columns with higher-order functions.

Sums are left folds from 0.0 in index order, the same order NumPy uses in the
block scorer, so a distance computed here and there is bit-identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vector length mismatch"))
    )


def plus(a, b, wa: float | Column = 1.0, wb: float | Column = 1.0) -> Column:
    """``wa * a + wb * b`` element-wise; fails on a length mismatch."""
    a, b = _col(a), _col(b)
    wa = wa if isinstance(wa, Column) else F.lit(float(wa))
    wb = wb if isinstance(wb, Column) else F.lit(float(wb))
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x * wa + y * wb))


def minus(a, b) -> Column:
    return plus(a, b, 1.0, -1.0)


def scaled(a, w: float | Column) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.transform(_col(a), lambda x: x * w)


def sqdist(a, b) -> Column:
    """Squared Euclidean distance, summed left to right from 0.0."""
    a, b = _col(a), _col(b)
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return _same_length(a, b, F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v))


def norm2(a) -> Column:
    """Squared norm (distance to the origin)."""
    return F.aggregate(F.transform(_col(a), lambda x: (x - F.lit(0.0)) * (x - F.lit(0.0))),
                       F.lit(0.0), lambda acc, v: acc + v)


def clip(a, radius: float | Column) -> Column:
    """Project onto the ball of ``radius``: unchanged when the norm is <= radius."""
    a = _col(a)
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    n = F.sqrt(norm2(a))
    return F.when(n <= r, a).otherwise(F.transform(a, lambda x: x * (r / n)))


def safe_div(a, b) -> Column:
    """``a / b``, or 0 when ``b`` is 0 (never raises under ANSI mode)."""
    a, b = _col(a), _col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def log2(x) -> Column:
    return F.log2(_col(x))
