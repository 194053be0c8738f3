"""Second-order factorisation machine on user, item and item-feature indicators, fitted by alternating exact steps.

Every coefficient lives in a table. With the other coefficients fixed, the prediction is linear in those of one user (and
of one item), so a user's bias and vector are a ridge regression whose normal equations are sums over the user's rows. What
the rows say about an item and its features is in the item's moments, the same kind of sums, so a feature step reads items,
not rows. Sums are combined map-side; the driver sees the mean rating and five numbers per feature step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.hashing import md5_unit
from tastegrid.functions.vectors import sum_vectors
from tastegrid.operators.recommend import dot_product_recs
from tastegrid.session import discard, materialise

SPREAD = 0.1


@dataclass
class Machine:
    """``users``, ``items`` and ``features`` hold ``(id, w, v)``; ``side`` holds what an item and its features come to for
    any user: ``(id, b, vec)``."""

    mean: float
    users: DataFrame
    items: DataFrame
    features: DataFrame
    side: DataFrame
    bags: DataFrame


def _start(ids: DataFrame, kind: str, factors: int, seed: int) -> DataFrame:
    v = F.array(*[(md5_unit(F.lit(seed), F.lit(kind), "id", F.lit(c)) - 0.5) * SPREAD for c in range(factors)])
    return ids.select("id", F.lit(0.0).alias("w"), v.alias("v"))


def moments(rows: DataFrame, key: str, other: str, table: DataFrame, off: str, vec: str, mean: float, factors: int) -> DataFrame:
    """``id, m`` per value of ``key``: with x = (1, vec) of the ``other`` side and t = rating - mean - off, the sums of the
    products of x (upper triangle), of x t and of t t."""
    joined = rows.join(table.select(F.col("id").alias(other), F.col(off).alias("_off"), F.col(vec).alias("_vec")), other)
    x = [F.lit(1.0), *[F.col("_vec")[c] for c in range(factors)]]
    t = F.col("rating") - F.lit(mean) - F.col("_off")
    cells = [x[a] * x[b] for a in range(factors + 1) for b in range(a, factors + 1)] + [c * t for c in x] + [t * t]
    sums = joined.groupBy(F.col(key).alias("id")).agg(*[F.sum(c).alias(f"_{n}") for n, c in enumerate(cells)])
    return sums.select("id", F.array(*[f"_{n}" for n in range(len(cells))]).alias("m"))


def _unpacked(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices, vectors and squares out of the rows of ``moments``."""
    a, b = np.triu_indices(k)
    square = np.zeros((len(m), k, k))
    square[:, a, b] = square[:, b, a] = m[:, : len(a)]
    return square, m[:, len(a) : len(a) + k], m[:, -1]


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def _shift(by: np.ndarray) -> np.ndarray:
    """How a coefficient pair (w, v) moves an item's (b, vec) where the rest of the vector is ``by``: b by w + v by."""
    n, k = by.shape
    out = np.broadcast_to(np.eye(k + 1), (n, k + 1, k + 1)).copy()
    out[:, 0, 1:] = by
    return out


def _solved(sums: DataFrame, reg: float, factors: int) -> DataFrame:
    """``id, w, v``: ridge solutions of the normal equations in ``m``."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                square, right, _ = _unpacked(_rows(b["m"]), factors + 1)
                found = np.linalg.solve(square + reg * np.eye(factors + 1), right[:, :, None])[:, :, 0]
                yield pd.DataFrame({"id": b["id"], "w": found[:, 0], "v": list(found[:, 1:])})

    return sums.mapInPandas(solve, f"id {sums.schema['id'].dataType.simpleString()}, w double, v array<double>")


def _feature_sums(bags: DataFrame, features: DataFrame, factors: int) -> DataFrame:
    """``item, f``: sums over an item's features of w, of v and of the squared lengths of v."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = bags.join(features.withColumnRenamed("id", "feature_id"), "feature_id")
    return sum_vectors(rows.select("item", F.concat(F.array("w"), "v", F.array(square)).alias("f")), ["item"], "f", factors + 2, out="f")


def _with_features(items: DataFrame, bags: DataFrame, features: DataFrame, factors: int) -> DataFrame:
    sums = _feature_sums(bags, features, factors).withColumnRenamed("item", "id")
    return items.join(sums, "id", "left").withColumn("f", F.coalesce("f", F.array_repeat(F.lit(0.0), factors + 2)))


def _item_step(state: DataFrame, reg: float, factors: int) -> DataFrame:
    """``id, m, f, w, v``: each item's own coefficients given its moments ``m`` and feature sums ``f``."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                square, right, _ = _unpacked(_rows(b["m"]), factors + 1)
                f = _rows(b["f"])
                rest = f[:, 1:-1]
                base = np.c_[f[:, 0] + ((rest**2).sum(axis=1) - f[:, -1]) / 2, rest]
                shift = _shift(rest)
                turned = shift.transpose(0, 2, 1)
                left = right - (square @ base[:, :, None])[:, :, 0]
                found = np.linalg.solve(turned @ square @ shift + reg * np.eye(factors + 1), turned @ left[:, :, None])[:, :, 0]
                yield b.assign(w=found[:, 0], v=list(found[:, 1:]))

    return state.mapInPandas(solve, f"id {state.schema['id'].dataType.simpleString()}, m array<double>, f array<double>, w double, v array<double>")


def _side(items: DataFrame) -> DataFrame:
    """``id, b, vec`` from ``id, f, w, v``: an item with its features, as any user meets it."""
    n = F.size("v")
    rest = F.slice("f", 2, n)
    inner = F.aggregate(F.zip_with("v", rest, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x * x)
    b = F.col("w") + F.col("f")[0] + inner + (square - F.element_at("f", -1)) / 2
    return items.select("id", b.alias("b"), F.zip_with("v", rest, lambda x, y: x + y).alias("vec"))


def _feature_step(state: DataFrame, bags: DataFrame, features: DataFrame, reg: float, factors: int) -> DataFrame:
    """``id, w, v``: features moved towards what each of them alone would take, as far as the squared error falls most.

    Features of one item depend on each other, so their single solutions make a direction only. Along it the error is a
    polynomial of degree four whose coefficients are sums over the items."""
    k = factors + 1
    side = _side(state).withColumnRenamed("id", "item")
    held = bags.join(state.select(F.col("id").alias("item"), "m"), "item").join(side, "item").join(features.withColumnRenamed("id", "feature_id"), "feature_id")

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            square, right, _ = _unpacked(_rows(b["m"]), k)
            own = _rows(b["v"])
            rest = _rows(b["vec"]) - own
            base = np.c_[b["b"] - b["w"] - (own * rest).sum(axis=1), rest]
            shift = _shift(rest)
            turned = shift.transpose(0, 2, 1)
            whole = turned @ square @ shift
            left = (turned @ (right - (square @ base[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
            i, j = np.triu_indices(k)
            names, at = np.unique(b["feature_id"].to_numpy(), return_inverse=True)  # added up before they are sent
            sums = np.zeros((len(names), len(i) + k + 1))
            np.add.at(sums, at, np.c_[whole[:, i, j], left, np.zeros(len(b))])
            yield pd.DataFrame({"id": names, "m": list(sums)})

    kind = features.schema["id"].dataType.simpleString()
    sums = held.select("feature_id", "m", "b", "vec", "w", "v").mapInPandas(normal, f"id {kind}, m array<double>")
    width = k * (k + 1) // 2 + k + 1
    alone = _solved(sum_vectors(sums, ["id"], "m", width, out="m"), reg, factors)
    move = features.join(alone.select("id", F.col("w").alias("w1"), F.col("v").alias("v1")), "id")
    move = materialise(move.select("id", "w", "v", (F.col("w1") - F.col("w")).alias("dw"), F.zip_with("v1", "v", lambda x, y: x - y).alias("dv")), "fm")

    def product(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    steps = bags.join(move.withColumnRenamed("id", "feature_id"), "feature_id")
    steps = steps.select("item", F.concat(F.array("dw"), "dv", F.array(product("v", "dv"), product("dv", "dv"))).alias("d"))
    steps = sum_vectors(steps, ["item"], "d", k + 2, out="d").join(side, "item").join(state.select(F.col("id").alias("item"), "m"), "item")

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            square, right, plain = _unpacked(_rows(b["m"]), k)
            d, vec = _rows(b["d"]), _rows(b["vec"])
            turn = d[:, 1:k]
            z0 = np.c_[b["b"], vec]
            z1 = np.c_[d[:, 0] + (vec * turn).sum(axis=1) - d[:, k], turn]
            z2 = np.c_[((turn**2).sum(axis=1) - d[:, k + 1]) / 2, np.zeros_like(turn)]
            through = [(square @ z[:, :, None])[:, :, 0] for z in (z0, z1, z2)]
            cross = [[(p * q).sum() for q in through] for p in (z0, z1, z2)]
            pull = [(right * z).sum() for z in (z0, z1, z2)]
            c = [plain.sum() - 2 * pull[0] + cross[0][0], 2 * (cross[0][1] - pull[1]), cross[1][1] + 2 * (cross[0][2] - pull[2]), 2 * cross[1][2], cross[2][2]]
            yield pd.DataFrame({f"c{n}": [float(x)] for n, x in enumerate(c)})

    sums = steps.select("m", "d", "b", "vec").mapInPandas(along, ", ".join(f"c{n} double" for n in range(5))).agg(*[F.sum(f"c{n}").alias(f"c{n}") for n in range(5)]).first()
    both = move.agg(F.sum(F.col("w") * F.col("dw") + product("v", "dv")), F.sum(F.col("dw") * F.col("dw") + product("dv", "dv"))).first()
    c = np.array([x or 0.0 for x in sums], float) + reg * np.array([0.0, 2 * (both[0] or 0.0), both[1] or 0.0, 0.0, 0.0])
    t = best_step(c)
    return move.select("id", (F.col("w") + t * F.col("dw")).alias("w"), F.zip_with("v", "dv", lambda x, y: x + t * y).alias("v"))


def best_step(c: np.ndarray) -> float:
    """Where in [0, 2] the polynomial with the coefficients ``c`` (lowest power first) is least."""
    turns = np.roots((c[1:] * np.arange(1, len(c)))[::-1])
    tries = [0.0, 2.0, *(float(r.real) for r in turns if abs(r.imag) < 1e-9 and 0 < r.real < 2)]
    return min(tries, key=lambda t: sum(x * t**n for n, x in enumerate(c)))


def fit(train: DataFrame, attributes: DataFrame, factors: int = 8, reg: float = 1.0, sweeps: int = 4, seed: int = 42) -> Machine:
    """Coefficients of the machine that lower the squared error plus ``reg`` times their squares with every step.

    A sweep reads the rows twice: for the items' moments, given the users, and for the users', given the items; users come
    last, so their normal equations hold exactly in the result. Rows without a rating and attributes of items that are not
    in ``train`` are left out; an item without attributes has its own coefficients only.
    """
    rows = materialise(train.where("rating IS NOT NULL").select("user", "item", F.col("rating").cast("double").alias("rating")), "fm")
    mean = rows.agg(F.avg("rating")).first()[0] or 0.0
    ids = rows.select(F.col("item").alias("id")).distinct()
    bags = attributes.select("item", "feature_id").distinct().join(rows.select("item").distinct(), "item", "left_semi")
    bags = materialise(bags, "fm")
    features = materialise(_start(bags.select(F.col("feature_id").alias("id")).distinct(), "feature", factors, seed), "fm")
    users = materialise(_start(rows.select(F.col("user").alias("id")).distinct(), "user", factors, seed), "fm")
    items = ids
    plain = bags.isEmpty()
    for _ in range(sweeps):
        m = moments(rows, "item", "user", users, "w", "v", mean, factors)
        state = materialise(_item_step(_with_features(m, bags, features, factors), reg, factors), "fm")
        if not plain:
            moved = materialise(_feature_step(state, bags, features, reg, factors), "fm")
            discard(features)
            features = moved
        items = materialise(_with_features(state.select("id", "w", "v"), bags, features, factors), "fm")
        side = materialise(_side(items), "fm")
        before, users = users, materialise(_solved(moments(rows, "user", "item", side, "b", "vec", mean, factors), reg, factors), "fm")
        discard(before)
        discard(state)
    return Machine(mean, users, items.select("id", "w", "v"), features, side, bags)


def residuals(rows: DataFrame, model: Machine) -> DataFrame:
    """``user, item, rating, e, pull``: rating less the prediction by the definition, over all coefficients that a row
    switches on, and ``pull``, the sum of all switched-on vectors but the user's."""
    on = rows.select("user", "item", "rating")
    by_item = model.items.select(F.col("id").alias("item"), "w", "v").unionByName(
        model.bags.join(model.features.withColumnRenamed("id", "feature_id"), "feature_id").select("item", "w", "v")
    )
    coefficients = on.join(model.users.withColumnRenamed("id", "user"), "user").unionByName(on.join(by_item, "item").select("user", "item", "rating", "w", "v"))
    long = coefficients.select("user", "item", "rating", "w", F.posexplode("v").alias("c", "x"))
    squares = long.groupBy("user", "item", "rating", "c").agg(F.sum("w").alias("w"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = squares.groupBy("user", "item", "rating").agg(
        F.max("w").alias("w"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("inner"), F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda z: z["s"]).alias("all")
    )
    own = whole.join(model.users.select(F.col("id").alias("user"), F.col("v").alias("own")), "user")
    return own.select("user", "item", "rating", (F.col("rating") - F.lit(model.mean) - F.col("w") - F.col("inner")).alias("e"), F.zip_with("all", "own", lambda x, y: x - y).alias("pull"))


def normal_equations(rows: DataFrame, model: Machine, reg: float) -> DataFrame:
    """``user, rows, slope``: the largest slope of the penalised squared error in a user's coefficients, per row of the user;
    0 where the user's normal equations are met."""
    left = residuals(rows, model).select("user", "e", F.posexplode(F.concat(F.array(F.lit(1.0)), "pull")).alias("c", "x"))
    sums = left.groupBy("user", "c").agg(F.sum(F.col("e") * F.col("x")).alias("s"), F.count(F.lit(1)).alias("rows"))
    own = model.users.select(F.col("id").alias("user"), F.posexplode(F.concat(F.array("w"), "v")).alias("c", "x"))
    slopes = sums.join(own, ["user", "c"]).select("user", "rows", (F.abs(F.col("s") - reg * F.col("x")) / F.col("rows")).alias("slope"))
    return slopes.groupBy("user").agg(F.max("rows").alias("rows"), F.max("slope").alias("slope"))


def factorisation_machine(train: DataFrame, attributes: DataFrame, k: int, factors: int = 8, reg: float = 1.0, iterations: int = 4, seed: int = 42) -> DataFrame:
    """The k best unseen items of every user. For one user and item the machine is a user vector against an item vector
    (item plus its features) and two constants, so the lists come from a product of two vector tables."""
    model = fit(train, attributes, factors, reg, iterations, seed)
    users, items = model.users.select("id", F.col("v").alias("vec")), model.side.select("id", "vec")
    recs = dot_product_recs(users, items, train, k, model.users.select("id", F.col("w").alias("bias")), model.side.select("id", F.col("b").alias("bias")))
    return recs.withColumn("score", F.col("score") + F.lit(model.mean))
