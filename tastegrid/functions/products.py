"""Products of two sparse matrices held as tables, with no inner index in one task alone."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: An inner index with more than so many pairs of rows is multiplied in blocks instead of being joined.
HOT_PAIRS = 50_000
#: Rows of one hot inner index that a block holds on either side, and rows of all its inner indexes that a task reads.
_PART = 1_000
_ROWS = 500_000
#: Cells of the dense result of a block, and how much of it is made at a time.
_CELLS = 4_000_000


def sparse_product(left: DataFrame, right: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``(i, j, value)``: sum over l of a * b for ``left(i, l, a)`` and ``right(l, j, b)``; pairs without a common l have no row.

    Ordinary inner indexes are joined and added up map-side. One that many rows on both sides have is cut: its left rows
    into parts x and its right rows into parts y by hashes of i and j, every pair of parts is a task, and a task adds up a
    great many inner indexes before it sends anything.
    """
    sizes = left.groupBy("l").agg(F.count(F.lit(1)).alias("m")).join(right.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "l")
    hot = sizes.where(F.col("m") * F.col("n") > hot_pairs)
    count, most_left, most_right, rows_left, rows_right = hot.agg(F.count(F.lit(1)), F.max("m"), F.max("n"), F.sum("m"), F.sum("n")).first()
    value = F.sum(F.col("a") * F.col("b")).alias("value")
    if not count:
        return left.join(right, "l").groupBy("i", "j").agg(value)
    keys = hot.select("l")
    plain = left.join(keys, "l", "left_anti").join(right.join(keys, "l", "left_anti"), "l").groupBy("i", "j").agg(value)
    nx, ny = ceil(most_left / _PART), ceil(most_right / _PART)
    chunks = min(count, ceil(rows_left / nx / _ROWS) + ceil(rows_right / ny / _ROWS))
    blocks = _blocks(left.join(keys, "l", "left_semi"), right.join(keys, "l", "left_semi"), nx, ny, chunks)
    return plain.unionByName(blocks).groupBy("i", "j").agg(F.sum("value").alias("value"))


def _blocks(left: DataFrame, right: DataFrame, nx: int, ny: int, chunks: int) -> DataFrame:
    def part(c: str, n: int):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    a = left.select(part("l", chunks).alias("chunk"), part("i", nx).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y"), "i", "l", F.col("a").cast("double").alias("a"))
    b = right.select(part("l", chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"), part("j", ny).alias("y"), "l", "j", F.col("b").cast("double").alias("b"))

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"i": a["i"].iloc[:0], "j": b["j"].iloc[:0], "value": a["a"].iloc[:0]})  # of the right types
        inner = pd.Index(np.intersect1d(a["l"].unique(), b["l"].unique()))
        sides = []
        for rows, own, value in ((a, "i", "a"), (b, "j", "b")):
            rows = rows[rows["l"].isin(inner)]
            names, at = np.unique(rows[own].to_numpy(), return_inverse=True)
            sides.append((names, at, inner.get_indexer(rows["l"]), rows[value].to_numpy()))
        (ni, ai, al, av), (nj, bj, bl, bv) = sides
        out = []
        step = max(1, _CELLS // max(1, len(nj)))
        for start in range(0, len(ni), step):
            rows = min(step, len(ni) - start)
            total, met = np.zeros((rows, len(nj))), np.zeros((rows, len(nj)), np.float32)
            for at in range(0, len(inner), 512):
                own, other = (ai >= start) & (ai < start + step) & (al >= at) & (al < at + 512), (bl >= at) & (bl < at + 512)
                some, more = np.zeros((rows, 512)), np.zeros((512, len(nj)))
                np.add.at(some, (ai[own] - start, al[own] - at), av[own])
                np.add.at(more, (bl[other] - at, bj[other]), bv[other])
                total += some @ more
                met += (some != 0).astype(np.float32) @ (more != 0).astype(np.float32)
            r, c = np.nonzero(met)
            out.append((ni[r + start], nj[c], total[r, c]))
        return pd.DataFrame(dict(zip(("i", "j", "value"), map(np.concatenate, zip(*out))))) if out else pd.DataFrame({"i": a["i"].iloc[:0], "j": b["j"].iloc[:0], "value": a["a"].iloc[:0]})

    kinds = (left.schema["i"].dataType.simpleString(), right.schema["j"].dataType.simpleString())
    return a.groupBy("chunk", "x", "y").cogroup(b.groupBy("chunk", "x", "y")).applyInPandas(kernel, f"i {kinds[0]}, j {kinds[1]}, value double")
