"""Fitted recommenders: latent factors on MLlib and on distributed algebra, and sparse linear item weights.

Factors are scored by :func:`tastegrid.operators.recommend.factor_recs`: blocked products, training items masked."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from tastegrid.functions.hashing import md5_unit
from tastegrid.functions.pairs import HOT_PROFILE, pair_stats
from tastegrid.functions.products import HOT_PAIRS, sparse_product
from tastegrid.functions.ranking import top_k
from tastegrid.functions.vectors import dot, sum_vectors
from tastegrid.operators.clean import id_map
from tastegrid.operators.recommend import dot_product_recs, factor_recs, full_top_k_unseen, item_knn_scores
from tastegrid.session import materialise


def _als_factors(train: DataFrame, value: str, **params) -> tuple[DataFrame, DataFrame]:
    """User and item factor tables ``(id, vec)`` under the raw ids."""
    users, items = materialise(id_map(train, "user", "u"), "als"), materialise(id_map(train, "item", "i"), "als")
    rows = train.join(users, "user").join(items, "item").select(F.col("u").cast("int"), F.col("i").cast("int"), F.col(value).cast("float").alias("value"))
    model = ALS(userCol="u", itemCol="i", ratingCol="value", coldStartStrategy="nan", **params).fit(rows)
    u = model.userFactors.join(users, F.col("id") == F.col("u")).select(F.col("user").alias("id"), F.col("features").cast("array<double>").alias("vec"))
    i = model.itemFactors.join(items, F.col("id") == F.col("i")).select(F.col("item").alias("id"), F.col("features").cast("array<double>").alias("vec"))
    return u, i


def implicit_als(train: DataFrame, k: int, factors: int = 10, reg: float = 0.1, alpha: float = 1.0, scaling: str = "linear", epsilon: float = 1.0, iterations: int = 10, seed: int = 42) -> DataFrame:
    """Confidence-weighted factorisation; confidence grows with the rating or with ln(1 + rating / epsilon)."""
    value = F.col("rating") if scaling == "linear" else F.log(1 + F.col("rating") / epsilon)
    u, i = _als_factors(train.withColumn("_v", value), "_v", rank=factors, regParam=reg, alpha=alpha, implicitPrefs=True, maxIter=iterations, seed=seed)
    return factor_recs(u, i, train, k)


def nonneg_mf(train: DataFrame, k: int, factors: int = 10, reg: float = 0.1, iterations: int = 10, seed: int = 42) -> DataFrame:
    u, i = _als_factors(train, "rating", rank=factors, regParam=reg, nonnegative=True, maxIter=iterations, seed=seed)
    return factor_recs(u, i, train, k)


def biases(train: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """Global mean, user means of what is left, and item means of what is left after both."""
    mean = train.agg(F.avg("rating")).first()[0] or 0.0
    users = train.groupBy(F.col("user").alias("id")).agg((F.avg("rating") - F.lit(mean)).alias("bias"))
    left = train.join(users.withColumnRenamed("id", "user"), "user").withColumn("_r", F.col("rating") - F.lit(mean) - F.col("bias"))
    items = left.groupBy(F.col("item").alias("id")).agg(F.avg("_r").alias("bias"))
    return mean, users, items


def explicit_mf(train: DataFrame, k: int, factors: int = 10, reg: float = 0.1, iterations: int = 10, seed: int = 42) -> DataFrame:
    """Biased rating factorisation by alternating least squares on the residuals."""
    mean, ub, ib = biases(train)
    residual = (
        train.join(ub.withColumnRenamed("id", "user").withColumnRenamed("bias", "_u"), "user")
        .join(ib.withColumnRenamed("id", "item").withColumnRenamed("bias", "_i"), "item")
        .withColumn("_v", F.col("rating") - F.lit(mean) - F.col("_u") - F.col("_i"))
    )
    u, i = _als_factors(residual, "_v", rank=factors, regParam=reg, maxIter=iterations, seed=seed)
    recs = dot_product_recs(u, i, train, k, ub, ib)
    return recs.withColumn("score", F.col("score") + F.lit(mean))


def normal_equations(train: DataFrame, users: DataFrame, items: DataFrame, value: str, reg: float, alpha: float | None = None, nonnegative: bool = False) -> DataFrame:
    """``user, rows, slope``: how far a user's factors, the last that alternating least squares sets, are from the least
    penalised error given the items': the largest slope per row. ``alpha`` is that of confidences, None for plain ratings;
    with ``nonnegative`` a factor at 0 may have a slope that would push it below.
    """
    k = items.select(F.size("vec").alias("n")).first()["n"]
    rows = train.select("user", "item", F.col(value).cast("float").cast("double").alias("r"))
    rows = rows.join(users.select(F.col("id").alias("user"), F.col("vec").alias("u")), "user").join(items.select(F.col("id").alias("item"), F.col("vec").alias("v")), "item")
    at = dot("u", "v")
    error = F.col("r") - at if alpha is None else (1 + alpha * F.abs("r")) * (F.col("r") > 0).cast("double") - alpha * F.abs("r") * at
    sums = rows.select("user", "u", "r", *[(error * F.col("v")[c]).alias(f"s{c}") for c in range(k)])
    sums = sums.groupBy("user", "u").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("r") > 0).alias("held"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(k)])
    gram = np.zeros((k, k)) if alpha is None else _gram(items, k)
    weight = F.col("rows") if alpha is None else F.col("held")
    slopes = []
    for c in range(k):
        slope = (F.col(f"s{c}") - sum(float(gram[c, d]) * F.col("u")[d] for d in range(k)) - reg * weight * F.col("u")[c]) / F.col("rows")
        slopes.append(F.when((F.col("u")[c] <= 0) & (slope < 0), 0.0).otherwise(F.abs(slope)) if nonnegative else F.abs(slope))
    return sums.select("user", "rows", F.greatest(*slopes).alias("slope"))


# --- truncated SVD ------------------------------------------------------------------------------------


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """width x width matrix of vector products: each batch adds one small matrix."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                m = np.stack(b["vec"].to_list())
                total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(width * width), "v": total.ravel()})

    cells = vectors.select("vec").mapInPandas(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(width * width)
    for row in cells.collect():
        out[row["cell"]] = row["v"]
    return out.reshape(width, width)


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["vec"] = list(np.stack(b["vec"].to_list()) @ matrix)
            yield b

    return vectors.mapInPandas(apply, vectors.schema)


def _orthonormal(vectors: DataFrame, width: int) -> DataFrame:
    values, axes = np.linalg.eigh(_gram(vectors, width))
    scale = np.where(values > values.max() * 1e-14, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return _times(vectors, axes * scale)


def randomised_svd(train: DataFrame, factors: int, value: str = "rating", oversample: int = 10, iterations: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """User vectors U*S and item vectors V of the truncated SVD, as ``(id, vec)`` tables.

    Randomised range finder with power iterations: every step is a join of the interactions with a vector
    table and an element-wise sum; the driver only sees matrices of (factors + oversample) squared.
    """
    d = factors + oversample
    normal = [F.sqrt(-2 * F.log(md5_unit(F.lit(seed), "id", F.lit(2 * c)))) * F.cos(2 * pi * md5_unit(F.lit(seed), "id", F.lit(2 * c + 1))) for c in range(d)]
    q = materialise(train.select(F.col("item").alias("id")).distinct().select("id", F.array(*normal).alias("vec")), "svd")

    def step(vectors: DataFrame, frm: str, to: str) -> DataFrame:
        rows = train.select(frm, to, F.col(value).cast("double").alias("w")).join(vectors.withColumnRenamed("id", frm), frm)
        return sum_vectors(rows, [to], "vec", d, "w").withColumnRenamed(to, "id")

    for _ in range(iterations):
        y = _orthonormal(materialise(step(q, "item", "user"), "svd"), d)
        q = materialise(_orthonormal(materialise(step(y, "user", "item"), "svd"), d), "svd")
    b = materialise(step(q, "item", "user"), "svd")
    values, axes = np.linalg.eigh(_gram(b, d))
    best = axes[:, np.argsort(values)[::-1][:factors]]
    return _times(b, best), _times(q, best)


def pure_svd(train: DataFrame, k: int, factors: int = 10, seed: int = 42) -> DataFrame:
    u, i = randomised_svd(train.withColumn("_one", F.lit(1.0)), factors, "_one", seed=seed)
    return factor_recs(u, i, train, k)


# --- sparse linear item weights -----------------------------------------------------------------------


#: Sweeps after which an item that has not settled is an error; a result is never returned unsettled.
MAX_SWEEPS = 1_000_000


def _solve_item(l1: float, l2: float, tolerance: float):
    """Non-negative elastic net of one item over its active items, by coordinate descent on their products."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["l"] == group["j"]].sort_values("j")
        items = own["j"].to_numpy()
        at = {j: n for n, j in enumerate(items)}
        g = np.zeros((len(items), len(items)))
        off = group[group["l"] != group["j"]]
        a, b = off["j"].map(at).to_numpy(), off["l"].map(at).to_numpy()
        g[a, b] = g[b, a] = off["g"].to_numpy()
        square, pull = own["g"].to_numpy(), own["pull"].to_numpy()
        np.fill_diagonal(g, square)
        w = np.zeros(len(items))
        slope = pull - l1
        for _ in range(MAX_SWEEPS):
            largest = 0.0
            for n in range(len(items)):
                new = max(0.0, (slope[n] + square[n] * w[n]) / (square[n] + l2))
                change = new - w[n]
                if change:
                    slope -= g[:, n] * change
                    w[n] = new
                    largest = max(largest, abs(change))
            if largest < tolerance:
                break
        else:
            raise RuntimeError(f"weights of item {group['i'].iat[0]} have not settled after {MAX_SWEEPS} sweeps; use a larger l2 or tolerance")
        held = w > 0
        return pd.DataFrame({"i": group["i"].iat[0], "j": items[held], "w": w[held]})

    return solve


def slim_weights(
    train: DataFrame, l1: float, l2: float, k: int, batch: int = 40, tolerance: float = 1e-6, hot_profile: int = HOT_PROFILE, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """(i, j, sim, rank): item i regressed on the other items j with non-negative elastic-net weights, k best kept.

    Each item starts from the ``batch`` items that pull most at zero weights. The small problems over active items
    are solved in parallel; then the slopes of all inactive items are checked, and those that would still enter are added,
    until none is left. So the batch bounds a group's size, not the result. Slopes come from the products of the item
    columns, g_ij less the sum over l of w_il g_lj, so users are keys only while those products are made; with ratings and
    weights that are not negative no slope exceeds g_ij, so only pairs that pull at zero weights need one.
    """
    x = materialise(train.select("user", "item", F.col("rating").cast("double").alias("r")), "slim")
    gram = materialise(pair_stats(x, "user", "item", "r", ["dot"], hot_profile=hot_profile).withColumnRenamed("dot", "g"), "slim")
    square = materialise(x.groupBy(F.col("item").alias("j")).agg(F.sum(F.col("r") * F.col("r")).alias("q")), "slim")
    enough = 1e-5 * max(1.0, l1)
    strongest = [F.desc("excess"), F.asc("j")]
    start = gram.select("i", "j", "g", (F.col("g") - l1).alias("excess")).filter(F.col("excess") > enough)
    columns = gram.unionByName(square.select(F.col("j").alias("i"), "j", F.col("q").alias("g"))).select(F.col("i").alias("l"), "j", F.col("g").alias("b"))
    active = top_k(start, ["i"], strongest, batch).select("i", "j")
    while True:
        active = materialise(active, "slim")
        own = active.join(square, "j").join(gram.withColumnRenamed("g", "pull"), ["i", "j"]).select("i", "j", F.col("j").alias("l"), F.col("q").alias("g"), "pull")
        couples = active.join(active.select("i", F.col("j").alias("l")), "i").filter(F.col("j") < F.col("l"))
        couples = couples.join(gram.select(F.col("i").alias("j"), F.col("j").alias("l"), "g"), ["j", "l"]).select("i", "j", "l", "g", F.lit(0.0).alias("pull"))
        kind = train.schema["item"].dataType.simpleString()
        weights = own.unionByName(couples).groupBy("i").applyInPandas(_solve_item(l1, l2, tolerance), f"i {kind}, j {kind}, w double")
        weights = materialise(weights, "slim")
        taken = sparse_product(weights.select("i", F.col("j").alias("l"), F.col("w").alias("a")), columns, hot_pairs)
        slope = F.col("g") - F.coalesce("value", F.lit(0.0))
        late = start.join(taken, ["i", "j"], "left").select("i", "j", (slope - l1).alias("excess")).filter(F.col("excess") > enough).join(active, ["i", "j"], "left_anti")
        late = materialise(top_k(late, ["i"], strongest, batch).select("i", "j"), "slim")
        if late.isEmpty():
            break
        active = active.unionByName(late)
    return top_k(weights.withColumnRenamed("w", "sim"), ["i"], [F.desc("sim"), F.asc("j")], k)


def slim(train: DataFrame, k: int, alpha: float, l1_ratio: float, neighbours: int) -> DataFrame:
    """Top-k recommendations by sparse linear weights; the penalties grow with the number of users."""
    n = train.select("user").distinct().count()
    weights = slim_weights(train, n * alpha * l1_ratio, n * alpha * (1 - l1_ratio), neighbours)
    return full_top_k_unseen(item_knn_scores(train, weights), train, k)
