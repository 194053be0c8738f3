"""Content profiles of users: right with hot users, no row per user, item and feature in a shuffle."""

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import recommend as rc


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_work", [10, 10_000_000])
def test_user_profiles(ratings, spark, hot_work):
    features = [(i, f"f{i % 4}") for i in range(30)] + [(i, "even") for i in range(0, 30, 2)]
    weights = rc.tfidf_items(spark.createDataFrame(features, "item long, feature_id string"))
    nobody = spark.createDataFrame([(None, 3)], "user long, item long")
    train = ratings.select("user", "item").unionByName(nobody)
    got = rc.tfidf_user_profile(train, weights, hot_work)
    want = train.join(weights, "item").groupBy("user", "feature_id").agg(F.avg("weight").alias("weight"))
    assert sorted(map(str, [(r[0], r[1], round(r[2], 9)) for r in got.collect()])) == sorted(map(str, [(r[0], r[1], round(r[2], 9)) for r in want.collect()]))


def test_user_profiles_shuffle_no_row_per_feature(ratings, spark, monkeypatch):
    monkeypatch.setattr(rc, "_TASK_ROWS", 100)
    weights = spark.createDataFrame([(i, f"f{i % 4}", 0.5) for i in range(30)], "item long, feature_id string, weight double")
    shuffles = [line for line in plan(rc.tfidf_user_profile(ratings, weights)).splitlines() if "Exchange hashpartitioning(" in line]
    assert any("hashpartitioning(user#" in line for line in shuffles) and not any("feature_id" in line for line in shuffles)
