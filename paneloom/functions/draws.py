"""Counter-based pseudo-random draws from md5.

A draw depends only on its key, so it is the same in every engine, on every
partitioning and after a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIGNS_PER_DIGEST = 32


def digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def bits32(hex_digest: Column, start: int = 1) -> Column:
    """Eight hex digits as a non-negative long."""
    return F.conv(F.substring(hex_digest, start, 8), 16, 10).cast("long")


def below(n: Column, *parts) -> Column:
    """An integer in [0, n)."""
    return bits32(digest(*parts)) % n

