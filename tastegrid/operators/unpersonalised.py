"""Item popularity, short head and long tail, and the recommenders that use nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastegrid.functions.ranking import HOT_ROWS, dense_index, first_free_places, running_total, top_k
from tastegrid.operators.sampling import draw_unseen
from tastegrid.session import materialise


def item_popularity(train: DataFrame) -> DataFrame:
    """(item, pop): distinct users per item."""
    return train.groupBy("item").agg(F.countDistinct("user").alias("pop"))


def short_head(train: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Items from the most popular down until they cover ``ratio`` of the rows; the crossing one is in."""
    covered = running_total(item_popularity(train), [F.desc("pop"), F.asc("item")], "pop", "cum")
    rows = train.agg(F.count(F.lit(1))).scalar()
    return covered.filter(F.col("cum_before") < F.lit(ratio) * rows).select("item", "pop")


def long_tail(train: DataFrame, ratio: float = 0.8) -> DataFrame:
    return item_popularity(train).join(short_head(train, ratio), "item", "left_anti")


def most_popular(train: DataFrame, k: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each user's ``k`` most popular unseen items; a user whose profile leaves fewer than k + 1 gets none."""
    seen = materialise(train.select("user", "item").distinct(), "seen")
    ranked = dense_index(seen.groupBy("item").agg(F.count(F.lit(1)).alias("pop")), [F.desc("pop"), F.asc("item")], "place")
    n_items = ranked.count()
    users = seen.groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + k < n_items).select("user")
    taken = seen.join(users, "user", "left_semi").join(ranked.select("item", "place"), "item").select("user", "place")
    free = first_free_places(users, "user", taken, k, n_items, hot_rows).join(ranked, "place")
    return top_k(free.select("user", "item", F.col("pop").cast("double").alias("score"), "place"), ["user"], [F.asc("place")], k).drop("place")


def random_recs(train: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` distinct random unseen items per user, all with score 1."""
    drawn = draw_unseen(train.select("user").distinct(), train, train.select("item").distinct(), k, seed)
    return drawn.select("user", "item", F.lit(1.0).alias("score"), F.col("pick").alias("rank"))
