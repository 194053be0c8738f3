"""Filters on ratings and on the size of user and item groups.

Group sizes come from an aggregate (combined map-side) joined back, never from a window over the group,
so one user or item may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.session import discard, materialise, stored


def global_threshold(inter: DataFrame, threshold: float) -> DataFrame:
    return inter.filter(F.col("rating") >= threshold)


def global_average(inter: DataFrame) -> DataFrame:
    return inter.filter(F.col("rating") >= inter.agg(F.avg("rating")).scalar())


def user_average(inter: DataFrame) -> DataFrame:
    means = inter.groupBy("user").agg(F.avg("rating").alias("_mean"))
    return inter.join(means, "user").filter(F.col("rating") >= F.col("_mean")).select(*inter.columns)


def _by_size(inter: DataFrame, column: str, keep: Column) -> DataFrame:
    sizes = inter.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(keep).select(column)
    return inter.join(sizes, column, "left_semi")


def user_k_core(inter: DataFrame, k: int) -> DataFrame:
    return _by_size(inter, "user", F.col("_n") >= k)


def item_k_core(inter: DataFrame, k: int) -> DataFrame:
    return _by_size(inter, "item", F.col("_n") >= k)


def cold_users(inter: DataFrame, threshold: int) -> DataFrame:
    """Users with at most ``threshold`` rows."""
    return _by_size(inter, "user", F.col("_n") <= threshold)


def n_rounds_k_core(inter: DataFrame, k: int, rounds: int) -> DataFrame:
    """A fixed number of user-then-item passes."""
    for _ in range(rounds):
        inter = item_k_core(user_k_core(inter, k), k)
    return inter


def _bounded(n: str, least: int, most: int | None) -> Column:
    ok = F.col(n) >= least
    return ok if most is None else ok & (F.col(n) <= most)


def _fewer(alive: DataFrame, column: str, edges: DataFrame, gone: DataFrame, other: str) -> DataFrame:
    """Sizes ``(column, _n)`` less the rows that are lost with the nodes ``gone(other)``."""
    lost = edges.join(gone.select(other), other, "left_semi").groupBy(column).agg(F.sum("w").alias("_lost"))
    return alive.join(lost, column, "left").select(column, (F.col("_n") - F.coalesce("_lost", F.lit(0))).alias("_n"))


def _survivors(inter: DataFrame, first_round, keep: dict[str, Column], at_once: bool) -> DataFrame:
    """Repeat user and item passes until nothing is dropped, then cut ``inter``. ``keep`` says of a size ``_n`` whether a user
    or an item stays; ``at_once``: both are judged on the same snapshot, otherwise the items after the users.

    The first round is made on the (user, item, rows) edges. After it an edge stands while both its ends do, so only sizes
    are carried: a round reads the edges, takes those of the nodes that it drops and lowers the sizes at their other ends.
    """
    inter = stored(inter, "inter")
    edges = materialise(first_round(inter.groupBy("user", "item").agg(F.count(F.lit(1)).alias("w"))), "core")
    sides = {"user": "item", "item": "user"}
    alive = {c: materialise(edges.groupBy(c).agg(F.sum("w").alias("_n")), "sizes") for c in sides}
    while True:
        drops = {}
        for column, other in sides.items():
            drops[column] = materialise(alive[column].where(~keep[column]), "dropped")
            if not at_once:
                _drop(alive, edges, column, other, keep[column], drops[column])
        if at_once and any(not d.isEmpty() for d in drops.values()):
            for column, other in sides.items():
                lowered = _fewer(alive[column].where(keep[column]), column, edges, drops[other], other)
                alive[column], before = materialise(lowered, "sizes"), alive[column]
                discard(before)
        elif all(d.isEmpty() for d in drops.values()):
            break
        for d in drops.values():
            discard(d)
    return inter.join(alive["user"].select("user"), "user", "left_semi").join(alive["item"].select("item"), "item", "left_semi")


def _drop(alive: dict[str, DataFrame], edges: DataFrame, column: str, other: str, keep: Column, gone: DataFrame) -> None:
    """Takes the nodes ``gone`` out of ``alive`` and lowers the sizes of the other side."""
    if gone.isEmpty():
        return
    for c, sizes in ((column, alive[column].where(keep)), (other, _fewer(alive[other], other, edges, gone, column))):
        alive[c], before = materialise(sizes, "sizes"), alive[c]
        discard(before)


def _pass(edges: DataFrame, column: str, k: int) -> DataFrame:
    sizes = edges.groupBy(column).agg(F.sum("w").alias("_n")).filter(F.col("_n") >= k).select(column)
    return edges.join(sizes, column, "left_semi")


def iterative_k_core(inter: DataFrame, k: int) -> DataFrame:
    """User-then-item passes until nothing is dropped."""
    enough = F.col("_n") >= k
    return _survivors(inter, lambda e: _pass(_pass(e, "user", k), "item", k), {"user": enough, "item": enough}, at_once=False)


def k_core_simultaneous(
    inter: DataFrame, min_user: int, min_item: int, max_user: int | None = None, max_item: int | None = None
) -> DataFrame:
    """Each round judges users and items on the same snapshot and drops both, until nothing is dropped."""
    keep = {"user": _bounded("_n", min_user, max_user), "item": _bounded("_n", min_item, max_item)}

    def first_round(edges: DataFrame) -> DataFrame:
        edges = stored(edges, "core")
        users, items = (edges.groupBy(c).agg(F.sum("w").alias("_n")).filter(keep[c]).select(c) for c in ("user", "item"))
        return edges.join(users, "user", "left_semi").join(items, "item", "left_semi")

    return _survivors(inter, first_round, keep, at_once=True)


STRATEGIES = {
    "global_threshold": global_threshold,
    "global_average": global_average,
    "user_average": user_average,
    "user_k_core": user_k_core,
    "item_k_core": item_k_core,
    "iterative_k_core": iterative_k_core,
    "n_rounds_k_core": n_rounds_k_core,
    "cold_users": cold_users,
    "k_core_simultaneous": k_core_simultaneous,
}


def prefilter(inter: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """A list of strategies applied in order."""
    for name, params in steps:
        inter = STRATEGIES[name](inter, **params)
    return inter
