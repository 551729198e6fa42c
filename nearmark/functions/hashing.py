"""Deterministic randomness from hashes of (seed, ids...).

Every random draw in the library is a pure function of its key, so results do
not depend on partitioning, task retries or executor loss. The uniform is the
first 52 bits of an md5 digest, which DuckDB can reproduce for oracle checks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS, _RANGE = 13, float(1 << 52)  # hex digits of the digest: every double step in [0, 1) of 2**-52


def hash_key(*parts) -> Column:
    """``'p1|p2|...'`` from columns or literals (ints print as decimals)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    cols = [c.cast("string") for c in cols]
    return F.concat_ws("|", *cols)


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) keyed by ``parts``."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, _DIGITS), 16, 10).cast("double") / F.lit(_RANGE)


def gaussian(*parts, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """Normal draw by Box-Muller from two keyed uniforms (first uses 1 - U, in (0, 1])."""
    u1 = F.lit(1.0) - uniform(*parts, "a")
    u2 = uniform(*parts, "b")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return z * F.lit(float(sigma)) + F.lit(float(mu))
