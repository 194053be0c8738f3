"""Significance tests, fold averages and result tables. Long results are ``(model, k, metric, value)``, per-user
results ``(model, user, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tastegrid.functions.ranking import running_total
from tastegrid.functions.ratios import NAN, ratio
from tastegrid.functions.tails import signed_rank_two_sided, t_two_sided


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("user", F.col("value").alias("a")).join(b.select("user", F.col("value").alias("b")), "user").select((F.col("a") - F.col("b")).alias("d"))


def _t_of(d: str = "d") -> list:
    n = F.count(d)
    return [ratio(F.avg(d), F.stddev_samp(d) / F.sqrt(F.greatest(n, F.lit(1))), NAN).alias("t"), (n - 1).alias("df")]


def paired_ttest(a: DataFrame, b: DataFrame, with_p: bool = True) -> DataFrame:
    """One row (t, df[, p]) over the common users."""
    row = _differences(a, b).agg(*_t_of())
    return row.withColumn("p", t_two_sided(F.col("t"), F.col("df"))) if with_p else row


def _signed_ranks(d: DataFrame, keys: Sequence[str], with_p: bool) -> DataFrame:
    """(keys, w, n[, p]) of differences ``(keys, d)``, all groups of ``keys`` at once.

    Differences are counted per absolute value first; average ranks then follow from running totals over a group's
    distinct values, which range partitions hold, so no group is ever sorted in one task."""
    levels = d.groupBy(*keys, F.abs("d").alias("size")).agg(F.count_if(F.col("d") != 0).alias("m"), F.count_if(F.col("d") > 0).alias("up"))
    placed = running_total(levels, [F.asc("size")], "m", "cum", keys).withColumn("rank", F.col("cum_before") + (F.col("m") + 1) / 2)
    m, up = F.col("m"), F.col("up")
    rows = placed.groupBy(*keys).agg(
        F.when(F.sum("m") > 0, F.least(F.sum(up * F.col("rank")), F.sum((m - up) * F.col("rank")))).alias("w"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(m.cast("double") * m * m - m), F.lit(0.0)).alias("ties"),
    )
    if with_p:
        rows = rows.withColumn("p", signed_rank_two_sided(F.col("w"), F.col("n"), F.col("ties")))
    return rows.drop("ties")


def wilcoxon(a: DataFrame, b: DataFrame, with_p: bool = True) -> DataFrame:
    """One row (w, n[, p]): the smaller signed-rank sum over non-zero differences; no rank for equal lists."""
    return _signed_ranks(_differences(a, b), [], with_p)


TESTS = ("ttest", "wilcoxon")


def compare_all_models(values: DataFrame, with_p: bool = False, test: str = "ttest", keys: Sequence[str] = ()) -> DataFrame:
    """Every two models over their common users, both directions, for every value of ``keys`` (metric, cutoff) at once.

    ``values`` is (model, user, keys, value). 'ttest' gives (model_a, model_b, keys, t, df[, p]), 'wilcoxon' (model_a,
    model_b, keys, w, n[, p]); two models with equal values have no w, n = 0 and a p of NaN. A null or NaN value takes its
    user out of that comparison."""
    if test not in TESTS:
        raise ValueError(f"unknown test {test}; known: {', '.join(TESTS)}")
    keys = list(keys)
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    a = known.select("user", *keys, F.col("model").alias("model_a"), F.col("value").alias("a"))
    b = known.select("user", *keys, F.col("model").alias("model_b"), F.col("value").alias("b"))
    pairs = a.join(b, ["user", *keys]).filter(F.col("model_a") < F.col("model_b")).withColumn("d", F.col("a") - F.col("b"))
    group = ["model_a", "model_b", *keys]
    if test == "ttest":
        rows, found = pairs.groupBy(*group).agg(*_t_of()), ["t", "df"]
        if with_p:
            rows = rows.withColumn("p", t_two_sided(F.col("t"), F.col("df")))
    else:
        rows, found = _signed_ranks(pairs.select(*group, "d"), group, with_p), ["w", "n"]
    found += ["p"] if with_p else []
    mirrored = [(-F.col(c) if c == "t" else F.col(c)).alias(c) for c in found]
    both = F.array(
        F.struct("model_a", "model_b", *keys, *found),
        F.struct(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), *keys, *mirrored),
    )
    return rows.select(F.explode(both).alias("r")).select("r.*")


def average_folds(results: DataFrame) -> DataFrame:
    """Mean and population deviation over folds per model, cutoff and metric."""
    return results.groupBy("model", "k", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def select_best_trial(trials: DataFrame, metric: str) -> DataFrame:
    """(model, trial, value): each model's trial with the best validation value, the first of equals."""
    rows = trials.filter(F.col("metric") == metric)
    best = F.max(F.struct(F.col("value"), (-F.col("trial")).alias("t"))).alias("b")
    return rows.groupBy("model").agg(best).select("model", (-F.col("b.t")).alias("trial"), "b.value")


def results_as_triplets(wide: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Wide result table to (model, metric, value)."""
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), names, "metric", "value")


def wide_results(results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """One row per model (and further keys), one column per metric."""
    return results.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def trials_table(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per configuration (model, trial) with its metrics and times."""
    return wide_results(results, metrics, ("model", "trial"))


def best_from_logs(lines: DataFrame, metric: str = "recall@20") -> DataFrame:
    """(file, value, line): the log line with the highest ``metric`` per file."""
    found = lines.withColumn("v", F.regexp_extract("line", metric.replace(".", r"\.") + r":\s*([0-9.]+)", 1)).filter(F.col("v") != "")
    best = F.max(F.struct(F.col("v").cast("double").alias("v"), "line")).alias("b")
    return found.groupBy("file").agg(best).select("file", F.col("b.v").alias("value"), F.col("b.line").alias("line"))
