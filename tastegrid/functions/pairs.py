"""Statistics of member pairs that share a key (item pairs of a user, user pairs of an item, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tastegrid.functions.partners import members, partners

# Limits that callers still name. Profiles and members of any length are taken alike by functions/partners.py, which has its own.
HOT_PROFILE, HOT_WORK = 2_000, 10_000_000
_TASK_ROWS, _KEYS_PER_GROUP, _KEYS_PER_STEP, _BLOCK_MEMBERS, _PROFILE_PART = 2_000_000, 64, 8, 1_000, 200


def pair_stats(
    df: DataFrame,
    key: str,
    member: str,
    value: str | None = None,
    stats: Sequence[str] = ("n",),
    hot_profile: int = HOT_PROFILE,
    sides: DataFrame | None = None,
    hot_work: int = HOT_WORK,
) -> DataFrame:
    """``(i, j, <stats>)`` for members i != j sharing a key, in both directions; ``(key, member)`` must be unique. Columns of
    ``sides(m, ...)``, one row per member, follow as ``*_i`` and ``*_j``.

    A task makes all pairs of a block of members while it reads the member table: a pair is whole when it leaves, and pairs are never
    shuffled. ``hot_profile`` and ``hot_work`` have no effect: no key or member needs another way.
    """
    value_col = F.col(value).cast("double") if value else F.lit(1.0)
    base = df.select(F.col(key).alias("k"), F.col(member).alias("id"), value_col.alias("v"))
    about = [] if sides is None else [c for c in sides.columns if c != "m"]
    table, n_keys = members(base, None if sides is None else sides.withColumnRenamed("m", "id"))
    return partners(table, table, n_keys, list(stats), own=True, about=about)
