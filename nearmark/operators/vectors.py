"""Operators over tables of vectors (V1-V5, A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.functions.hashing import gaussian, uniform
from nearmark.functions.vectors import clip


SUMS = 32


def vector_sum(df: DataFrame, key: str | list[str], vec: str, out: str | None = None) -> DataFrame:
    """A10: element-wise sum of ``vec`` per ``key`` (a column or several).

    Plain sums, ``SUMS`` dimensions to a row, with a partial (map-side) step: a
    key with very many rows is pre-summed in every task before the shuffle, and
    no row with a vector is sorted. Vectors of one key must have one length; a
    null vector or component is an error.
    """
    out = out or vec
    keys = [key] if isinstance(key, str) else key
    v = F.col(vec)
    n = F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), F.raise_error(F.lit("null vector or component")).cast("int")).otherwise(F.size(v))
    rows = df.select(*keys, F.col(vec).alias("_v"), n.alias("_n"), F.explode(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / F.lit(SUMS)).cast("int") - 1))).alias("_c"))
    sums = [F.sum(F.get("_v", F.col("_c") * SUMS + k)) for k in range(SUMS)]
    s = rows.groupBy(*keys, "_c").agg(F.array(*sums).alias("_s"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    s = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_s"))).alias("_s"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    whole = F.slice(F.flatten(F.col("_s._s")), F.lit(1), F.col("_hi"))
    one = F.col("_lo") == F.col("_hi")
    return s.select(*keys, F.when(one, whole).otherwise(F.raise_error(F.lit("vector length mismatch"))).alias(out))


def clip_vectors(df: DataFrame, vec: str, radius: float) -> DataFrame:
    """V3 over a table."""
    return df.withColumn(vec, clip(vec, radius))


def dropout(vec, ratio: float, *key) -> F.Column:
    """V4: zero component k when its keyed uniform is < ratio; no rescaling."""
    if ratio <= 0:
        return vec if not isinstance(vec, str) else F.col(vec)
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(v, lambda x, k: F.when(uniform(*key, k) < F.lit(float(ratio)), F.lit(0.0)).otherwise(x))


def dropout_vectors(df: DataFrame, id_col: str, vec: str, ratio: float, seed: int) -> DataFrame:
    return df.withColumn(vec, dropout(vec, ratio, seed, F.col(id_col)))


def init_positions(ids: DataFrame, id_col: str, n_dim: int, seed: int, side: str,
                   sigma: float = 0.1, out: str = "p") -> DataFrame:
    """V5: N(0, sigma^2) vectors, one per id, each component keyed by (seed, side, id, k).

    Independent of partitioning; the AdaGrad accumulator starts at 0.
    """
    vec = F.transform(F.sequence(F.lit(0), F.lit(n_dim - 1)),
                      lambda k: gaussian(seed, side, F.col(id_col), k, sigma=sigma))
    return ids.select(id_col).distinct().select(id_col, vec.alias(out), F.lit(0.0).alias("sg"))
