"""Repeatable pseudo-random draws.

A seeded random generator gives a different stream under a different
partitioning. Every draw here is instead a hash of the row key and a seed:
``h(key, seed) = first 60 bits of md5("key:seed")`` as a non-negative bigint.
The same rule is written in the DuckDB oracle, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_60 = 1152921504606846976.0


def _as_str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def hash60(*parts, seed) -> Column:
    """Non-negative 60-bit hash of ``parts`` joined with ':' and the seed."""
    cols = [_as_str(p) for p in parts] + [F.lit(str(seed))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts, seed) -> Column:
    """Uniform draw in [0, 1)."""
    return hash60(*parts, seed=seed) / F.lit(TWO_POW_60)


def shuffle_key(*parts, seed) -> Column:
    """Sort key for a random order: the full md5 hex string."""
    cols = [_as_str(p) for p in parts] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *cols))
