"""Portable pseudo-random draws.

Every draw is a pure function of text, so a re-run task, another partitioning
or another SQL engine sees the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296.0  # 2**32


def hash32(*parts: Column | str | int) -> Column:
    """Integer in [0, 2**32) from the parts joined with ':'.

    A plain value is taken as text; pass columns as ``Column``.
    """
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *columns))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Number in [0, 1) from the parts."""
    return hash32(*parts) / F.lit(HASH_RANGE)
