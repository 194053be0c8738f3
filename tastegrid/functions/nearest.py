"""Exact nearest vectors and largest products without looking at every pair.

Vectors are put into cells around pivots. Two cells whose angles and lengths cannot reach the score that is asked for are
never brought together, and no vector is copied to a cell that it cannot match. What is left is multiplied block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions.ranking import top_k
from tastegrid.functions.vectors import as_double, k_best
from tastegrid.session import materialise

# Rows of a cell at most (a cell may be uneven by its hash), and pivots at most: they and their angles go to every task.
CELL_ROWS, MOST_PIVOTS = 4096, 512
# Bounds are compared with this much room, so that rounding cannot lose a pair.
_ROOM = 1e-7
DIGITS = 9


def _pivots(tables: list[DataFrame], cell_rows: int, most: int) -> np.ndarray:
    """At most ``most`` directions: rows of the tables by the smallest hashes of their ids, so reruns agree. The result is
    right for any pivots; they only decide how much is pruned."""
    rows = sum(t.count() for t in tables)
    wanted = max(1, min(most, ceil(rows / cell_rows)))
    parts = [t.select(F.xxhash64("id").alias("h"), "vec") for t in tables]
    picked = reduce(DataFrame.unionByName, parts).filter(F.exists("vec", lambda v: v != 0)).orderBy("h", "vec").limit(wanted).collect()
    if not picked:
        return np.zeros((0, 0))
    found = np.unique(np.array([r.vec for r in picked], float), axis=0)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _placed(table: DataFrame, pivots: np.ndarray, cell_rows: int, cosine: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (id, vec, pivot, cell, angle, length) and their cells (cell, pivot, n, least and largest angle and length)."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["vec"].to_list())
            length = np.linalg.norm(x, axis=1)
            unit = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
            near = np.zeros(len(x), int)
            angle = np.zeros(len(x))
            if len(pivots):
                cos = unit @ pivots.T
                near = cos.argmax(axis=1)
                angle = np.where(length > 0, np.arccos(np.clip(cos[np.arange(len(x)), near], -1, 1)), 0.0)
            yield pd.DataFrame({"id": batch["id"], "vec": list(unit if cosine else x), "pivot": near, "angle": angle,
                                "length": (length > 0).astype(float) if cosine else length})

    kind = table.schema["id"].dataType.simpleString()
    rows = materialise(table.mapInPandas(nearest, f"id {kind}, vec array<double>, pivot int, angle double, length double"), "near")
    sizes = rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
    cell = F.col("pivot").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = materialise(rows.join(F.broadcast(sizes), "pivot").withColumn("cell", cell).drop("parts"), "cells")
    ends = [f(c).alias(f"{name}_{c}") for c in ("angle", "length") for name, f in (("least", F.min), ("most", F.max))]
    return rows, rows.groupBy("cell", "pivot").agg(F.count(F.lit(1)).alias("n"), *ends)


def _bound(between: Column, angles: tuple[Column, Column], other: tuple[Column, Column], lengths: tuple[Column, Column], other_lengths: tuple[Column, Column]) -> Column:
    """The largest product there can be: pivots ``between`` apart, angles to the pivots and lengths within their ends."""
    apart = F.greatest(F.lit(0.0), between - angles[1] - other[1], angles[0] - between - other[1], other[0] - between - angles[1])
    cos = F.cos(F.least(apart, F.lit(pi)))
    high = F.when(cos >= 0, lengths[1] * other_lengths[1] * cos).otherwise(lengths[0] * other_lengths[0] * cos)
    return high + F.lit(_ROOM) * (1 + lengths[1] * other_lengths[1])


_Y = ("y", "n", "least_angle", "most_angle", "least_length", "most_length")


def _seen_from(y: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(pivot, between, y, n, ends of y): the cells ``y`` as every pivot of the other side sees them. Pivots are compared
    with each other once, so this is pivots x cells long."""
    n = max(1, len(pivots))
    angles = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.zeros((1, 1))
    p, q = np.divmod(np.arange(n * n), n)
    between = y.sparkSession.createDataFrame(pd.DataFrame({"p": p.astype("int32"), "q": q.astype("int32"), "between": angles.ravel()}))
    return y.join(F.broadcast(between), F.col("pivot") == F.col("q")).select(F.col("p").alias("pivot"), "between", F.col("cell").alias("y"), *_Y[1:])


def _pair_bound() -> Column:
    """The bound of a cell ``x`` against the cell in the row."""
    own = [(F.col(f"x.least_{c}"), F.col(f"x.most_{c}")) for c in ("angle", "length")]
    other = [(F.col(f"s.least_{c}"), F.col(f"s.most_{c}")) for c in ("angle", "length")]
    return _bound(F.col("s.between"), own[0], other[0], own[1], other[1])


def _cell_pairs(x: DataFrame, seen: DataFrame, needed: Column) -> DataFrame:
    """(x, between, y, n, ends of y): the pairs of cells whose bound is at least ``needed``."""
    rows = x.alias("x").join(seen.alias("s"), F.col("x.pivot") == F.col("s.pivot")).filter(_pair_bound() >= needed)
    return rows.select(F.col("x.cell").alias("x"), "s.between", *[f"s.{c}" for c in _Y])


def _own_bound() -> Column:
    """The bound of a single row (id, angle, length) against a cell of the other side."""
    angle, length = F.col("angle"), F.col("length")
    return _bound(F.col("between"), (angle, angle), (F.col("least_angle"), F.col("most_angle")), (length, length), (F.col("least_length"), F.col("most_length")))


def copies_to(rows: DataFrame, pairs: DataFrame, needed: Column) -> DataFrame:
    """(x, y, id, vec): a row of a cell for each cell of the other side that it can match with a score of ``needed``."""
    return rows.withColumnRenamed("cell", "x").join(pairs, "x").filter(_own_bound() >= needed).select("x", "y", "id", "vec")


def cosine_at_least(table: DataFrame, threshold: float, cell_rows: int = CELL_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``(i, j, score)``: every ordered pair, self pairs too, with a cosine of at least ``threshold`` at nine decimals.

    Rows without a vector take no part; the cosine with a zero vector is 0. Pairs of cells are multiplied once and give
    both directions."""
    table = materialise(table.where("vec IS NOT NULL").select("id", as_double("vec").alias("vec")), "table")
    pivots = _pivots([table], cell_rows, most_pivots)
    rows, cells = _placed(table, pivots, cell_rows, True)
    cells = materialise(cells, "ends")
    pairs = materialise(_cell_pairs(cells, _seen_from(cells, pivots), F.lit(threshold)).filter(F.col("x") <= F.col("y")), "pairs")
    ends = cells.select(F.col("cell").alias("y"), *_Y[1:])
    back = pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "between").join(ends, "y")
    left = copies_to(rows, pairs, F.lit(threshold))
    right = copies_to(rows.toDF(*rows.columns), back, F.lit(threshold)).select(F.col("y").alias("x"), F.col("x").alias("y"), "id", "vec")
    kind = table.schema["id"].dataType.simpleString()

    def kernel(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"i": a["id"].iloc[:0], "j": a["id"].iloc[:0], "score": np.zeros(0)})
        found = np.round(np.stack(a["vec"].to_list()) @ np.stack(b["vec"].to_list()).T, DIGITS)
        r, c = np.nonzero(found >= threshold)
        i, j, s = a["id"].to_numpy()[r], b["id"].to_numpy()[c], found[r, c]
        if key[0] == key[1]:
            return pd.DataFrame({"i": i, "j": j, "score": s})
        return pd.DataFrame({"i": np.concatenate([i, j]), "j": np.concatenate([j, i]), "score": np.concatenate([s, s])})

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(kernel, f"i {kind}, j {kind}, score double")


def _multiplied(x: DataFrame, y: DataFrame, pairs: DataFrame, k: int, mask: DataFrame | None, exclude_self: bool) -> DataFrame:
    """(i, j, score): each task's k best of every row of ``x`` (x, y, id, vec) in the cells of ``y`` (cell, id, vec)."""
    if mask is not None:
        at = y.select(F.col("id").alias("j"), F.col("cell").alias("y"))
        hidden = mask.join(at, "j").groupBy(F.col("i").alias("id"), "y").agg(F.collect_set("j").alias("hidden"))
        x = x.join(hidden, ["id", "y"], "left")
    else:
        x = x.withColumn("hidden", F.lit(None))
    to = pairs.select(F.col("x").alias("to_x"), F.col("y").alias("to_y"))  # names of its own: both sides may come from one table
    other = y.select("cell", "id", "vec").join(to, F.col("cell") == F.col("to_y")).drop("cell")
    kinds = [t.schema["id"].dataType.simpleString() for t in (x, y)]

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"i": a["id"].iloc[:0], "j": b["id"].iloc[:0], "score": np.zeros(0)})
        b = b.sort_values("id")
        ids, others = b["id"].to_numpy(), np.stack(b["vec"].to_list())
        got = np.round(np.stack(a["vec"].to_list()) @ others.T, DIGITS)
        ok = a["id"].to_numpy()[:, None] != ids[None, :] if exclude_self else np.ones(got.shape, bool)
        for row, out in enumerate(a["hidden"]):
            if out is not None:
                place = np.searchsorted(ids, out).clip(max=len(ids) - 1)
                ok[row, place[ids[place] == out]] = False
        r, c = k_best(got, ok, k)
        return pd.DataFrame({"i": a["id"].to_numpy()[r], "j": ids[c], "score": got[r, c]})

    return x.groupBy("x", "y").cogroup(other.groupBy("to_x", "to_y")).applyInPandas(kernel, f"i {kinds[0]}, j {kinds[1]}, score double")


def best_products(
    left: DataFrame,
    right: DataFrame,
    k: int,
    mask: DataFrame | None = None,
    cosine: bool = False,
    exclude_self: bool = False,
    cell_rows: int = CELL_ROWS,
    most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """``(i, j, score, rank)``: the k largest products (or cosines) of every row of ``left`` with rows of ``right``, ties by j.

    Two passes. The first scores each cell against the cells in its pivot's direction, until k rows are seen, which gives
    every row a score that its k-th best cannot fall below. The second brings a row only to cells that can still beat it. A row
    whose first cells are masked has no such score yet and goes everywhere. ``mask`` holds pairs (i, j) to leave out;
    rows without a vector take no part."""
    tables = [materialise(t.where("vec IS NOT NULL").select("id", as_double("vec").alias("vec")), "table") for t in (left, right)]
    pivots = _pivots(tables, cell_rows, most_pivots)
    (x, cells_x), (y, cells_y) = (_placed(t, pivots, cell_rows, cosine) for t in tables)
    cells_x = materialise(cells_x, "ends")
    promise = _seen_from(cells_y, pivots)
    likely = F.desc(F.col("most_length") * F.cos("between"))  # the product with a row in the pivot's direction
    before = Window.partitionBy("pivot").orderBy(likely, "y").rowsBetween(Window.unboundedPreceding, -1)
    enough = k + (1 if exclude_self else 0)
    promise = materialise(promise.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) < enough), "promise")
    first = materialise(cells_x.select(F.col("cell").alias("x"), "pivot").join(promise.filter("first"), "pivot").select("x", "y"), "first")
    sent = x.withColumnRenamed("cell", "x").join(first, "x").select("x", "y", "id", "vec")
    found = top_k(_multiplied(sent, y, first, k, mask, exclude_self), ["i"], [F.desc("score"), F.asc("j")], k).drop("rank")
    found = materialise(found, "found")
    floors = found.groupBy(F.col("i").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    x = materialise(x.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    lowest = cells_x.join(x.groupBy("cell").agg(F.min("floor").alias("floor")), "cell")
    later = _cell_pairs(lowest, promise.filter(~F.col("first")), F.col("x.floor"))
    again = materialise(copies_to(x, later, F.col("floor")), "again")
    rest = _multiplied(again, y, again.select("x", "y").distinct(), k, mask, exclude_self)
    return top_k(found.unionByName(rest), ["i"], [F.desc("score"), F.asc("j")], k)
