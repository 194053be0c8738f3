"""Positions inside groups, top-k per group and dense ids, none of which sorts one group in one task
when that group is large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.session import materialise

# A group above this many rows is sorted by a range shuffle over many tasks.
HOT_ROWS = 2_000_000


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of every group. Spark plans a group limit before the shuffle, so a hot group
    sends at most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "pos",
    hot_rows: int = HOT_ROWS,
    size: str | None = None,
    late: bool = False,
) -> DataFrame:
    """1-based position of each row in its group and, as ``size``, the rows of the group.

    Group sizes are counted first (with map-side combine). Ordinary groups use one window, so position and
    size cost one shuffle. Groups above ``hot_rows`` are range-partitioned on (keys, order) so a single key
    is spread over tasks; positions are then local position plus the rows of the same key in earlier ranges. ``late``: ordinary
    rows are shuffled before ``order`` is computed, for orders that are longer than the rows (an md5).
    """
    keys = list(keys)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)

    def windowed(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(*keys) if late else rows
        placed = rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return placed if size is None else placed.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))

    if hot.isEmpty():
        return windowed(df)
    hot = materialise(hot, "hot")
    spread = _range_positions(df.join(hot.drop("_n"), keys, "left_semi"), keys, order, out)
    if size is not None:
        spread = spread.join(hot.withColumnRenamed("_n", size), keys)
    return windowed(df.join(hot, keys, "left_anti")).unionByName(spread)


def _range_positions(df: DataFrame, keys: list[str], order: Sequence[Column], out: str) -> DataFrame:
    by = [F.col(c) for c in keys] + list(order)
    ranged = materialise(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_range"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("int"))
        .drop("_local", "_offset", "_range")
    )


def dense_index(df: DataFrame, order: Sequence[str | Column], out: str = "idx", start: int = 0) -> DataFrame:
    """Global dense position of the rows of ``df`` in sort order, without a one-task sort.

    Rows are range-partitioned and sorted; the row's place in its partition comes from
    ``monotonically_increasing_id`` and the partition offsets (one row per partition) are broadcast.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    return number_rows(df.repartitionByRange(*by).sortWithinPartitions(*by), out, start)


def number_rows(df: DataFrame, out: str = "idx", start: int = 0) -> DataFrame:
    """Rows numbered without a gap in the order of partitions and of rows in them, from one writing of ``df``."""
    ranged = materialise(df.withColumn("_m", F.monotonically_increasing_id()), "dense")
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.select(*df.columns, part.cast("int").alias("_part"), place.alias("_place"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return ranged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_place") + F.lit(start)).cast("bigint").alias(out)
    )


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str = "total", keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``out`` (total of ``value`` up to and including the row) and ``<out>_before``, over all rows
    in sort order, or over those of the same ``keys``. Ties in ``order`` must be broken by the caller.

    Rows are range-partitioned on (keys, order), so one key may hold any share of them."""
    keys = list(keys)
    ranged = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum(value).alias("_s"))
        .select(*keys, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_local", F.sum(value).over(local))
        .join(offsets if keys else F.broadcast(offsets), [*keys, "_part"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .withColumn(f"{out}_before", F.col(out) - F.col(value))
        .drop("_local", "_offset", "_part")
    )


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row ``q0, q1, ...``: linear-interpolated quantiles from the counts of distinct values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    steps = running_total(counts, [F.col(column)], "_c", "_cum").withColumn("_n", F.lit(steps_total(counts)))
    picks = []
    for i, q in enumerate(shares):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_cum_before") <= place) & (place < F.col("_cum"))
            picks.append(F.max(F.when(holds, F.col(column).cast("double"))).alias(f"{name}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"w{i}"))
    row = steps.agg(*picks)
    return row.select(*[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(shares))])


def steps_total(counts: DataFrame) -> int:
    return counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n")).first()["n"]


def first_free_places(owners: DataFrame, owner: str, taken: DataFrame, k: int, n_places: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(owner, place)``: each owner's first ``k`` places of 0 .. n_places-1 that are not in ``taken``.

    A taken place moves the k-th free one on only if it lies before it, so an owner needs k places plus
    that many: the result is linear in owners x k plus the taken rows, never owners x places.
    """
    sizes = taken.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    near = materialise(taken.join(sizes, owner).filter(F.col("place") < F.col("n") + k).select(owner, "place"), "near")
    blocking = position_in_group(near, [owner], [F.asc("place")], "j", hot_rows).filter(F.col("place") - (F.col("j") - 1) < k)
    blocked = blocking.groupBy(owner).agg(F.count(F.lit(1)).alias("m"))
    last = F.least(F.coalesce("m", F.lit(0)) + (k - 1), F.lit(n_places - 1)).cast("bigint")
    slots = owners.select(owner).join(blocked, owner, "left").select(owner, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("place"))
    return slots.join(blocking.select(owner, "place"), [owner, "place"], "left_anti")
