"""Cleaning, id mapping and alignment of interaction tables ``(user, item, rating, ts)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.ranking import dense_index
from tastegrid.session import discard, materialise


def drop_incomplete_and_dup(inter: DataFrame, first_by: Sequence[str]) -> DataFrame:
    """Drop rows without user, item or ts, and keep the first row (by ``first_by``) of equal (user, item, ts)."""
    keys = ["user", "item", "ts"]
    rest = [c for c in inter.columns if c not in keys and c not in first_by]
    first = F.min(F.struct(*first_by, *rest)).alias("_f")
    return inter.na.drop(subset=keys).groupBy(*keys).agg(first).select(*keys, *[f"_f.{c}" for c in [*first_by, *rest]])


def binarize(inter: DataFrame, force: bool = False) -> DataFrame:
    """Rating 1.0 for every row, if asked for or if no row has a rating."""
    if force:
        return inter.withColumn("rating", F.lit(1.0))
    rated = inter.agg(F.count("rating").alias("n")).scalar()
    return inter.withColumn("rating", F.when(rated == 0, F.lit(1.0)).otherwise(F.col("rating")))


def last_rating_wins(inter: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per (user, item): the last one in ``order``."""
    last = F.max(F.struct(*order, "rating", *[c for c in ("ts",) if c not in order])).alias("_l")
    return inter.groupBy("user", "item").agg(last).select("user", "item", "_l.rating", "_l.ts")


def id_map(inter: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """(raw id, dense id from 0) in the order of the raw ids."""
    return dense_index(inter.select(column).distinct(), [column], out)


def reindex(inter: DataFrame) -> DataFrame:
    """Users and items replaced by dense ids."""
    users, items = id_map(inter, "user", "user_idx"), id_map(inter, "item", "item_idx")
    rest = [c for c in inter.columns if c not in ("user", "item")]
    return inter.join(users, "user").join(items, "item").select("user_idx", "item_idx", *rest)


def dataset_stats(inter: DataFrame) -> DataFrame:
    """One row: users, items, rows, sparsity and mean actions per user and per item."""
    n = inter.agg(
        F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"), F.count(F.lit(1)).alias("rows")
    )
    u, i, t = F.col("users"), F.col("items"), F.col("rows")
    return n.select(
        "users", "items", "rows", (1 - t / (u * i)).alias("sparsity"), (t / u).alias("per_user"), (t / i).alias("per_item")
    )


def drop_cold_users(part: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of a validation or test part whose user has training rows."""
    return part.join(train.select("user").distinct(), "user", "left_semi")


def aligned_ids(inter: DataFrame, sides: Sequence[DataFrame]) -> dict[str, DataFrame]:
    """``{"user": ids, "item": ids}`` of ``inter`` that every side table knows.

    A side table has a ``user`` column, an ``item`` column, or both. The id sets shrink round by round
    until their sizes stay the same; each round's sets are written out, so the plan does not grow.
    """
    keep = {c: materialise(inter.select(c).distinct(), f"align-{c}") for c in ("user", "item")}
    sizes = {c: keep[c].count() for c in keep}
    while True:
        before = dict(keep)
        for side in sides:
            here = [c for c in ("user", "item") if c in side.columns]
            known = _keep_ids(side, keep)
            for c in here:
                keep[c] = keep[c].join(known.select(c).distinct(), c, "left_semi")
        keep = {c: materialise(keep[c], f"align-{c}") for c in keep}
        for old in before.values():
            discard(old)
        now = {c: keep[c].count() for c in keep}
        if now == sizes:
            return keep
        sizes = now


def _keep_ids(df: DataFrame, keep: dict[str, DataFrame]) -> DataFrame:
    for c in keep:
        if c in df.columns:
            df = df.join(keep[c], c, "left_semi")
    return df


def align_side_info(inter: DataFrame, sides: Sequence[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Interactions and side rows of the users and items that every side table knows."""
    keep = aligned_ids(inter, sides)
    return _keep_ids(inter, keep), [_keep_ids(s, keep) for s in sides]


def align_with_train(train: DataFrame, others: Sequence[DataFrame], sides: Sequence[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """As :func:`align_side_info` with the ids of the training part alone; ``others`` are then cut to them."""
    keep = aligned_ids(train, sides)
    return _keep_ids(train, keep), [_keep_ids(o, keep) for o in others]


def reindex_features(meta: DataFrame, ids: DataFrame) -> DataFrame:
    """Metadata keyed by dense id: unmapped rows dropped, dense id first, sorted by it."""
    rest = [c for c in meta.columns if c != "item"]
    return meta.join(ids, "item").select("idx", *rest).orderBy("idx")


def feature_item_diff(features: DataFrame, inter: DataFrame) -> DataFrame:
    """Items that have features but no interaction."""
    return features.select("item").distinct().join(inter.select("item").distinct(), "item", "left_anti")


def compose_item_text() -> Column:
    """Title, brand, the categories and description in one line; a missing text counts as one blank."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(" "))

    cats = F.coalesce(F.aggregate("categories", F.lit(""), lambda s, c: F.concat(s, c, F.lit(" "))), F.lit(""))
    return F.translate(F.concat(text("title"), F.lit(" "), text("brand"), F.lit(" "), cats, text("description")), "\n", " ")


def count_null_combinations(meta: DataFrame) -> DataFrame:
    """One row: how many items lack title, description, both, also brand, also categories."""
    t, d, b, c = (F.col(x).isNull() for x in ("title", "description", "brand", "categories"))
    return meta.agg(
        F.count_if(t).alias("no_title"),
        F.count_if(d).alias("no_description"),
        F.count_if(d & t).alias("no_both"),
        F.count_if(d & t & b).alias("no_three"),
        F.count_if(d & t & b & c).alias("no_four"),
    )


def merge_splits(*parts: DataFrame) -> DataFrame:
    """The split parts as one table again."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
