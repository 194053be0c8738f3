"""Train / validation / test splits. A split adds ``part`` ('train', 'val', 'test') and, where there are
several, a fold column; ties are broken by item so that every run gives the same split."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.hashing import md5_key
from tastegrid.functions.ranking import HOT_ROWS, exact_quantiles, position_in_group, running_total
from tastegrid.session import materialise, stored

USER = ("user",)


def part_of(split: DataFrame, part: str) -> DataFrame:
    return split.filter(F.col("part") == part).drop("part")


def _part(is_test: Column) -> Column:
    return F.when(is_test, F.lit("test")).otherwise(F.lit("train"))


def _train_size(ratio: float) -> Column:
    return F.floor(F.col("_n") * F.lit(1 - ratio))


def fixed_timestamp(inter: DataFrame, ts: int | Column) -> DataFrame:
    """Rows at or after ``ts`` are the test part."""
    return inter.withColumn("part", _part(F.col("ts") >= (ts if isinstance(ts, Column) else F.lit(ts))))


def best_timestamp_value(inter: DataFrame, min_below: int = 1, min_over: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row ``(ts, users)``: the timestamp at which most users have ``min_below`` rows before and
    ``min_over`` rows at or after it; the largest such timestamp.

    A user is valid on one interval (lo, hi] of timestamps, so a sweep of +1 / -1 over the distinct
    timestamps replaces the timestamps x users scan.
    """
    placed = position_in_group(inter.select("user", "item", "ts"), ["user"], [F.asc("ts"), F.asc("item")], "_p", hot_rows, size="_n")
    low = F.max(F.when(F.col("_p") == min_below, F.col("ts"))) if min_below > 0 else F.lit(None).cast("bigint")
    high = F.max(F.when(F.col("_p") == F.col("_n") - min_over + 1, F.col("ts"))) if min_over > 0 else F.lit(None).cast("bigint")
    spans = placed.groupBy("user").agg(low.alias("lo"), high.alias("hi"))
    if min_below == 0:
        spans = spans.withColumn("lo", inter.agg(F.min("ts") - 1).scalar())
    spans = spans.filter(F.col("lo").isNotNull())
    spans = spans.filter(F.col("lo") < F.col("hi")) if min_over > 0 else spans
    steps = spans.select(F.explode(F.array(F.struct(F.col("lo").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("ts"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    steps = steps.filter(F.col("ts").isNotNull())
    every = inter.select("ts").withColumn("d", F.lit(0)).unionByName(steps.select("ts", "d"))
    flags = every.groupBy("ts").agg(F.sum("d").alias("d"), F.max((F.col("d") == 0).cast("int")).alias("real"))
    swept = running_total(flags, [F.asc("ts")], "d", "valid").filter(F.col("real") == 1)
    best = swept.agg(F.max(F.struct(F.col("valid_before").alias("users"), "ts")).alias("b"))
    return best.select("b.ts", "b.users")


def best_timestamp(inter: DataFrame, min_below: int = 1, min_over: int = 1) -> DataFrame:
    return fixed_timestamp(inter, best_timestamp_value(inter, min_below, min_over).select("ts").scalar())


def temporal_holdout(inter: DataFrame, ratio: float, hot_rows: int = HOT_ROWS, keys: Sequence[str] = USER) -> DataFrame:
    """Each user's latest rows, past floor(n * (1 - ratio)), are the test part. Here and below, ``keys`` are the columns
    whose values make one history."""
    placed = position_in_group(inter, keys, [F.asc("ts"), F.asc("item")], "_p", hot_rows, size="_n")
    return placed.withColumn("part", _part(F.col("_p") > _train_size(ratio))).drop("_p", "_n")


def temporal_leave_n_out(inter: DataFrame, n: int, hot_rows: int = HOT_ROWS, keys: Sequence[str] = USER) -> DataFrame:
    """Each user's ``n`` latest rows are the test part."""
    placed = position_in_group(inter, keys, [F.desc("ts"), F.desc("item")], "_p", hot_rows)
    return placed.withColumn("part", _part(F.col("_p") <= n)).drop("_p")


def _shuffled(inter: DataFrame, folds: int, seed: int, hot_rows: int, keys: Sequence[str]) -> DataFrame:
    folded = stored(inter, "inter").withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    key = md5_key(F.lit(seed), "test_fold", *keys, "item")
    return position_in_group(folded, ["test_fold", *keys], [key, F.asc("item")], "_p", hot_rows, size="_n", late=True)


def random_subsampling(inter: DataFrame, folds: int, ratio: float, seed: int = 42, hot_rows: int = HOT_ROWS, keys: Sequence[str] = USER) -> DataFrame:
    """Per fold and user, n - floor(n * (1 - ratio)) random rows are the test part."""
    placed = _shuffled(inter, folds, seed, hot_rows, keys)
    return placed.withColumn("part", _part(F.col("_p") <= F.col("_n") - _train_size(ratio))).drop("_p", "_n")


def random_leave_n_out(inter: DataFrame, folds: int, n: int, seed: int = 42, hot_rows: int = HOT_ROWS, keys: Sequence[str] = USER) -> DataFrame:
    """Per fold and user, ``n`` random rows are the test part."""
    return _shuffled(inter, folds, seed, hot_rows, keys).withColumn("part", _part(F.col("_p") <= n)).drop("_p", "_n")


def assign_folds(inter: DataFrame, k: int, hot_rows: int = HOT_ROWS, keys: Sequence[str] = USER) -> DataFrame:
    """Test fold of each row: its place in the user's history modulo ``k``."""
    placed = position_in_group(inter, keys, [F.asc("ts"), F.asc("item")], "_p", hot_rows)
    return placed.withColumn("test_fold", ((F.col("_p") - 1) % k).cast("int")).drop("_p")


def k_folds(inter: DataFrame, k: int, hot_rows: int = HOT_ROWS, keys: Sequence[str] = USER) -> DataFrame:
    """All ``k`` train/test pairs as one table with ``test_fold`` and ``part``."""
    own = assign_folds(inter, k, hot_rows, keys).withColumnRenamed("test_fold", "_own")
    every = own.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.withColumn("part", _part(F.col("_own") == F.col("test_fold"))).drop("_own")


def nested(split: DataFrame, ratio: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A temporal hold-out of every train part: its latest rows become 'val'. The split is written out, as it is read three times."""
    split = stored(split, "split")
    keys = ["user", "test_fold"] if "test_fold" in split.columns else ["user"]
    train = split.filter(F.col("part") == "train")
    placed = position_in_group(train, keys, [F.asc("ts"), F.asc("item")], "_p", hot_rows, size="_n")
    inner = placed.withColumn("part", F.when(F.col("_p") > _train_size(ratio), F.lit("val")).otherwise(F.lit("train")))
    return inner.drop("_p", "_n").unionByName(split.filter(F.col("part") != "train"))


def nested_by(split: DataFrame, strategy: Callable[..., DataFrame], *args, **options) -> DataFrame:
    """Every train part of ``split`` split again by any strategy of this module, called with ``args`` and ``options``: its
    test rows become 'val'. ``val_fold`` numbers the inner folds (0 if the strategy makes one); the outer test rows stand
    once, with -1.

    Strategies by user treat a user's rows of each outer fold as a history of its own, all folds in one pass. Those with a
    time limit for all users look at one outer fold after the other, as their limit depends on its rows.
    """
    own = split.columns
    train = split.where("part = 'train'").drop("part").withColumnRenamed("test_fold", "_outer")
    if "keys" in signature(strategy).parameters:
        inner = strategy(train, *args, keys=["_outer", "user"] if "test_fold" in own else USER, **options)
    elif "test_fold" in own:
        train = materialise(train, "train")
        folds = [r["_outer"] for r in train.select("_outer").distinct().collect()]  # a few folds
        inner = reduce(DataFrame.unionByName, [strategy(train.where(F.col("_outer") == f), *args, **options) for f in folds]) if folds else train.withColumn("part", F.lit("train"))
    else:
        inner = strategy(train, *args, **options)
    fold = F.col("test_fold") if "test_fold" in inner.columns else F.lit(0)
    inner = inner.withColumn("val_fold", fold.cast("int")).withColumn("part", F.when(F.col("part") == "test", "val").otherwise(F.col("part"))).drop("test_fold")
    return inner.withColumnRenamed("_outer", "test_fold").select(*own, "val_fold").unionByName(split.where("part = 'test'").withColumn("val_fold", F.lit(-1)))


def global_quantile_split(inter: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """Cut at the timestamp quantiles of the normalised, non-zero ratios; ``x_label`` 0, 1, 2, ..."""
    shares = [r for r in ratios if r > 0]
    cuts, total = [], 0.0
    for r in shares[:-1]:
        total += r / sum(ratios)
        cuts.append(total)
    at = exact_quantiles(inter, "ts", cuts)
    label = F.lit(0)
    for i in range(len(cuts)):
        label = label + (F.col("ts") >= at.select(f"q{i}").scalar()).cast("int")
    return inter.withColumn("x_label", label)


def per_user_ratio_split(inter: DataFrame, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Shuffled rows of a user: under ten, one for validation and one for test; else a fifth, halved."""
    placed = position_in_group(inter, ["user"], [md5_key(F.lit(seed), "user", "item"), F.asc("item")], "_p", hot_rows, size="_n")
    n, p = F.col("_n"), F.col("_p")
    held = F.when(n < 10, F.lit(2)).otherwise(F.floor(n * F.lit(0.2)).cast("int"))
    val = F.when(n < 10, F.lit(1)).otherwise((held / 2).cast("int"))
    label = F.when(p <= n - held, 0).when(p <= n - held + val, 1).otherwise(2)
    return placed.withColumn("x_label", label).drop("_p", "_n")


def split_by_label(labelled: DataFrame, label: int) -> DataFrame:
    return labelled.filter(F.col("x_label") == label).drop("x_label")
