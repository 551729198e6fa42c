"""Column-expression helpers (JVM side, whole-stage codegen friendly)."""

from nearmark.functions.vectors import (  # noqa: F401
    clip,
    log2,
    minus,
    norm2,
    plus,
    safe_div,
    scaled,
    sqdist,
)
from nearmark.functions.hashing import hash_key, uniform, gaussian  # noqa: F401
