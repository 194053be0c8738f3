"""Recommendation lists never pass through the driver as a broadcast."""

from pyspark.sql import functions as F

from tastegrid.operators import metrics as me


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_never_broadcast(spark, ratings, tmp_path):
    ratings.select("user", "item", "rating").write.parquet(f"{tmp_path}/ratings")
    spark.range(200).selectExpr("id AS user").crossJoin(spark.range(10).selectExpr("id AS item", "1D AS score", "CAST(id + 1 AS INT) AS rank")).write.parquet(f"{tmp_path}/lists")
    truth, lists = spark.read.parquet(f"{tmp_path}/ratings"), spark.read.parquet(f"{tmp_path}/lists")
    ev = me.Evaluation(lists, truth, truth, 10, 3.0)
    for frame in (ev.all_hits, ev.gated):
        assert "Broadcast" not in plan(frame)
    groups = truth.select("item").distinct().withColumn("cluster", F.col("item") % 2)
    assert {r["cluster"] for r in ev.rsp(groups).collect()} == {0, 1}
