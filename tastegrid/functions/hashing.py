"""Deterministic pseudo-random numbers from md5, the same in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_key(*parts) -> Column:
    """Sortable random key of the parts (columns by name, everything else as a literal)."""
    cols = [F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def md5_int(*parts) -> Column:
    """Uniform integer in [0, 2^32) from the first eight hex digits."""
    return F.conv(F.substring(md5_key(*parts), 1, 8), 16, 10).cast("bigint")


def md5_unit(*parts) -> Column:
    """Uniform double in (0, 1)."""
    return (md5_int(*parts).cast("double") + 0.5) / F.lit(4294967296.0)
