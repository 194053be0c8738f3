"""Neighbour tables from shared interactions.

Input is long form with one row per (key, member): users as keys give item neighbours, items as keys give
user neighbours, features as keys give content neighbours. Output is ``(i, j, sim)``: the k best j of each i.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.pairs import HOT_PROFILE
from tastegrid.functions.partners import Sides, members, on_columns, partners
from tastegrid.functions.products import HOT_PAIRS, sparse_product
from tastegrid.functions.ranking import dense_index, first_free_places, position_in_group, top_k
from tastegrid.functions.ratios import ratio
from tastegrid.session import materialise


def member_stats(df: DataFrame, member: str, value: str) -> DataFrame:
    """(m, size, total, square) per member."""
    v = F.col(value)
    return df.groupBy(F.col(member).alias("m")).agg(
        F.count(F.lit(1)).cast("double").alias("size"), F.sum(v).alias("total"), F.sum(v * v).alias("square")
    )


# Sums of fractions depend on their order in the last digits; equal neighbours must stay equal.
DIGITS = 9


#: Member statistics that a form reads, of both sides.
_READS = {"cosine": ["square"], "asymmetric": ["square"], "jaccard": ["size"], "dice": ["size"], "tversky": ["size"]}


def _k_best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of ``(i, j, sim)``, ranked."""
    return top_k(pairs, ["i"], [F.desc("sim"), F.asc("j")], k)


def _plain_score(fn: str, stat: str, alpha: float, beta: float):
    def score(p: Sides):
        x = p.get(stat)
        if fn == "dot":
            return x
        a, b = (p.get(f"{_READS.get(fn, ['size'])[0]}_{s}") for s in ("i", "j"))
        if fn == "cosine":
            return p.ratio(x, p.sqrt(a * b))
        if fn == "asymmetric":
            return p.ratio(x, p.power(a, alpha) * p.power(b, 1 - alpha))
        if fn == "jaccard":
            return x / (a + b - x)
        if fn == "dice":
            return 2 * x / (a + b)
        return p.ratio(x, x + alpha * (a - x) + beta * (b - x))

    return score


def similarity(
    df: DataFrame,
    fn: str,
    k: int,
    key: str = "user",
    member: str = "item",
    value: str = "rating",
    alpha: float = 0.5,
    beta: float = 1.0,
    keep_self: bool = False,
    hot_profile: int = HOT_PROFILE,
) -> DataFrame:
    """cosine, dot, asymmetric, jaccard, dice or tversky; the set forms ignore values. A member whose values are all 0 has no
    neighbours but by dot."""
    if fn not in ("cosine", "dot", "asymmetric", "jaccard", "dice", "tversky"):
        raise KeyError(fn)
    setwise = fn in ("jaccard", "dice", "tversky")
    stat = "n" if setwise else "dot"
    reads = _READS.get(fn, [])
    score = _plain_score(fn, stat, alpha, beta)
    sides = member_stats(df, member, value).select(F.col("m").alias("id"), *reads) if reads else None
    table, n_keys = members(df.select(F.col(member).alias("id"), F.col(key).alias("k"), F.col(value).cast("double").alias("v")), sides)
    pairs = partners(table, table, n_keys, [stat], score, k, DIGITS, own=True, about=reads).select("i", "j", "sim")
    if keep_self:
        own = member_stats(df, member, value)
        both = [F.col(c).alias(f"{c}_{s}") for s in ("i", "j") for c in reads]
        own = own.select(F.col("m").alias("i"), F.col("m").alias("j"), F.col("size" if setwise else "square").alias(stat), *both)
        own = own.select("i", "j", F.round(score(on_columns()), DIGITS).alias("sim"))
        pairs = pairs.unionByName(own.filter(F.col("sim") != 0))
    return _k_best(pairs, k)


def similarity_shrunk(
    df: DataFrame,
    fn: str,
    k: int,
    key: str = "user",
    member: str = "item",
    value: str = "rating",
    shrink: float = 0.0,
    normalise: bool = True,
    alpha: float = 0.5,
    beta: float = 1.0,
    row_weights: DataFrame | None = None,
    hot_profile: int = HOT_PROFILE,
) -> DataFrame:
    """Shrunk forms: cosine, adjusted (key mean removed), pearson (member mean removed), asymmetric, jaccard or
    tanimoto, dice, tversky. ``row_weights`` is ``(key, weight)``.

    The k best are taken among all members, and those with similarity 0 then dropped; so a negative
    neighbour counts only where fewer than k members are at or above zero.
    """
    data = df.select(F.col(key).alias("k"), F.col(member).alias("m"), F.col(value).cast("double").alias("v"))
    if fn in ("adjusted", "pearson"):
        by = "k" if fn == "adjusted" else "m"
        data = data.join(data.groupBy(by).agg(F.avg("v").alias("mean")), by).select("k", "m", (F.col("v") - F.col("mean")).alias("v"))
    setwise = fn in ("jaccard", "tanimoto", "dice", "tversky")
    if setwise:
        data = data.withColumn("v", F.lit(1.0))
    weighted = data
    if row_weights is not None:
        w = row_weights.select(F.col(key).alias("k"), F.col("weight").alias("w"))
        weighted = data.join(w, "k").select("k", "m", (F.col("v") * F.sqrt("w")).alias("v"))
    sides = member_stats(data, "m", "v").select(F.col("m").alias("id"), "square")
    extra = shrink + 1e-6

    def score(p: Sides):
        x, qi, qj = p.get("dot"), p.get("square_i"), p.get("square_j")
        if fn in ("jaccard", "tanimoto"):
            return x / (qi + qj - x + extra)
        if fn == "dice":
            return x / (qi + qj + extra)
        if fn == "tversky":
            return x / (x + (qi - x) * alpha + (qj - x) * beta + extra)
        if not normalise:
            return x / shrink if shrink else x
        if fn == "asymmetric":
            return x / (p.power(qi, alpha) * p.power(qj, 1 - alpha) + extra)
        return x / (p.sqrt(qi) * p.sqrt(qj) + extra)

    table, n_keys = members(weighted.withColumnRenamed("m", "id"), sides)
    found = partners(table, table, n_keys, ["dot"], score, k, DIGITS, own=True, about=["square"])
    if fn not in ("adjusted", "pearson"):
        return _k_best(found.select("i", "j", "sim"), k)
    n_members = data.agg(F.countDistinct("m")).scalar()
    at_or_above = (F.col("sim") > 0) | (F.col("rank") + n_members - F.col("nonzero") <= k)
    return _k_best(found.select("i", "j", "sim", "nonzero"), k).filter(at_or_above).drop("nonzero")


# Distance of a pair from shared statistics and member statistics; members count absent values as 0.
# The last entry orders the members that share nothing with i, nearest first.
def _distances(fn: str, u: float) -> tuple[list[str], Callable[[Sides], Any], Column]:
    stats, order = {
        "yule": (["n"], F.lit(0)),
        "kulsinski": (["n"], F.lit(0)),
        "euclidean": (["dot"], F.col("square")),
        "sqeuclidean": (["dot"], F.col("square")),
        "cityblock": (["low"], F.col("total")),
        "braycurtis": (["low"], F.lit(0)),
        "canberra": (["n", "canberra"], F.col("size")),
        "correlation": (["dot"], ratio(F.col("total"), F.sqrt(u * F.col("square") - F.col("total") * F.col("total")))),
        "hamming": (["n", "equal"], F.col("size")),
        "jaccard": (["n"], F.lit(0)),
        "dice": (["n"], F.lit(0)),
        "rogerstanimoto": (["n"], F.col("size")),
        "sokalmichener": (["n"], F.col("size")),
        "sokalsneath": (["n"], F.lit(0)),
        "russellrao": (["n"], F.lit(0)),
    }[fn]

    def distance(p: Sides):
        side = lambda c: (p.get(f"{c}_i"), p.get(f"{c}_j"))
        if fn in ("euclidean", "sqeuclidean"):
            qi, qj = side("square")
            square = p.at_least(qi + qj - 2 * p.get("dot"), 0.0)
            return square if fn == "sqeuclidean" else p.sqrt(p.round(square, 12))  # equal vectors of fractions are at 0
        if fn in ("cityblock", "braycurtis"):
            si, sj = side("total")
            cityblock = si + sj - 2 * p.get("low")
            return cityblock if fn == "cityblock" else p.ratio(cityblock, si + sj)
        if fn == "correlation":
            (si, sj), (qi, qj) = side("total"), side("square")
            return 1 - p.ratio(u * p.get("dot") - si * sj, p.sqrt((u * qi - si * si) * (u * qj - sj * sj)))
        n = p.get("n")
        if fn == "russellrao":
            return (u - n) / u
        ni, nj = side("size")
        ft = ni + nj - 2 * n
        if fn == "yule":
            apart = (ni - n) * (nj - n)
            return p.ratio(2 * apart, n * (u - ni - nj + n) + apart, 0.0)
        if fn == "hamming":
            return (ni + nj - n - p.get("equal")) / u
        return {
            "kulsinski": lambda: (ft - n + u) / (ft + u),
            "canberra": lambda: p.get("canberra") + ft,
            "jaccard": lambda: ft / (n + ft),
            "dice": lambda: ft / (ni + nj),
            "rogerstanimoto": lambda: 2 * ft / (u + ft),
            "sokalmichener": lambda: 2 * ft / (u + ft),
            "sokalsneath": lambda: 2 * ft / (n + 2 * ft),
        }[fn]()

    return stats, distance, order


#: Member statistics that a distance reads where it is not only the size.
_DISTANCE_READS = {"euclidean": ["square"], "sqeuclidean": ["square"], "cityblock": ["total"], "braycurtis": ["total"], "correlation": ["total", "square"], "russellrao": []}
_ALIASES = {"l1": "cityblock", "manhattan": "cityblock", "l2": "euclidean", "minkowski": "euclidean"}


def _standardised(df: DataFrame, key: str, member: str, value: str) -> DataFrame:
    """Values over their key's standard deviation among all members, absent ones as 0. A key with one value for all members
    tells none apart and is left out."""
    members = df.agg(F.countDistinct(member).cast("double")).scalar()
    v = F.col(value).cast("double")
    spread = df.groupBy(key).agg(((F.sum(v * v) - F.sum(v) * F.sum(v) / members) / F.nullif(members - 1, F.lit(0.0))).alias("_s"))
    return df.join(spread.where("_s > 0"), key).select(key, member, (v / F.sqrt("_s")).alias(value))


def chebyshev_similarity(
    df: DataFrame, k: int, key: str = "user", member: str = "item", value: str = "rating", hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """1 / (1 + largest difference) of the full member vectors; of equal ones the member with the smaller largest value, then
    the smaller one, is nearer. Values must not be negative.

    The difference is the largest one on a shared key or the largest value on a key of one side alone. The latter follows
    from levels, the (member, value) histogram: a product of levels by keys counts how many keys of a level the other
    member shares, and the first level, from the top, that it does not share whole is the largest value it lacks.
    """
    rows = df.select(F.col(key).alias("k"), F.col(member).alias("m"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy("m", "v").agg(F.count(F.lit(1)).alias("size"))
    levels = position_in_group(dense_index(sizes, ["m", "v"], "level"), ["m"], [F.desc("v")], "place")
    levels = materialise(levels.select("level", "m", "v", "size", F.col("place").cast("int").alias("place")), "levels")
    at = rows.join(levels.select("m", "v", "level"), ["m", "v"])
    met = sparse_product(
        at.select(F.col("level").alias("i"), F.col("k").alias("l"), F.lit(1.0).alias("a")),
        at.select(F.col("k").alias("l"), F.col("level").alias("j"), F.lit(1.0).alias("b")),
        hot_pairs,
    )
    own = levels.select(F.col("level").alias("i"), F.col("m").alias("mi"), F.col("v").alias("vi"), "size", "place")
    other = levels.select(F.col("level").alias("j"), F.col("m").alias("mj"), F.col("v").alias("vj"))
    by_level = met.join(own, "i").join(other, "j").where("mi <> mj").groupBy("mi", "mj", "place", "size").agg(
        F.sum("value").alias("n"), F.max(F.abs(F.col("vi") - F.col("vj"))).alias("far")
    )
    whole = F.when(F.round("n") == F.col("size"), F.col("place"))
    met_whole = F.aggregate(F.array_sort(F.collect_set(whole)), F.lit(0), lambda s, p: F.when(p == s + 1, p).otherwise(s))
    pairs = by_level.groupBy("mi", "mj").agg(F.max("far").alias("far"), met_whole.alias("upto"))
    top = levels.select(F.col("m").alias("mi"), (F.col("place") - 1).alias("upto"), F.col("v").alias("alone"))
    seen_from = materialise(pairs.join(top, ["mi", "upto"], "left").select("mi", "mj", F.greatest("far", F.coalesce("alone", F.lit(0.0))).alias("d")), "pairs")
    shared = seen_from.unionByName(seen_from.select(F.col("mj").alias("mi"), F.col("mi").alias("mj"), "d")).groupBy("mi", "mj").agg(F.max("d").alias("d"))

    first = levels.where("place = 1").select("m", F.col("v").alias("most"))
    places = materialise(dense_index(first, ["most", "m"], "place"), "places")
    taken = seen_from.select(F.col("mi").alias("i"), F.col("mj").alias("m")).unionByName(first.select(F.col("m").alias("i"), "m"))
    free = first_free_places(first.select(F.col("m").alias("i")), "i", taken.join(places.select("m", "place"), "m").select("i", "place"), k, places.count())
    apart = free.join(places.select("place", F.col("m").alias("mj")), "place").select(F.col("i").alias("mi"), "mj", F.lit(None).cast("double").alias("d"))
    near = shared.unionByName(apart)
    near = near.join(first.select(F.col("m").alias("mi"), F.col("most").alias("most_i")), "mi").join(first.select(F.col("m").alias("mj"), F.col("most").alias("most_j")), "mj")
    distance = F.coalesce("d", F.greatest("most_i", "most_j"))
    scored = near.select(F.col("mi").alias("i"), F.col("mj").alias("j"), F.round(1 / (1 + distance), DIGITS).alias("sim"), "most_j")
    return top_k(scored, ["i"], [F.desc("sim"), F.asc("most_j"), F.asc("j")], k).select("i", "j", "sim", "rank")


def distance_similarity(
    df: DataFrame, fn: str, k: int, key: str = "user", member: str = "item", value: str = "rating", hot_profile: int = HOT_PROFILE
) -> DataFrame:
    """1 / (1 + distance) of the full member vectors, self left out; values must not be negative. minkowski is the one of
    power 2, seuclidean divides by the spread of each key (a member without a key that has any is left out).

    Members that share a key come from the pair table. Of the others only the k nearest matter, and their
    order is the same for every i, so they are the first k free places of one ranked member list. Pairs whose distance is
    not defined (a correlation with a member of the same value for all) are left out.
    """
    fn = _ALIASES.get(fn, fn)
    if fn == "chebyshev":
        return chebyshev_similarity(df, k, key, member, value)
    if fn == "seuclidean":
        df, fn = _standardised(df, key, member, value), "euclidean"
    u = float(df.agg(F.countDistinct(key)).first()[0])
    stats, distance, order = _distances(fn, u)
    reads = _DISTANCE_READS.get(fn, ["size"])
    norms = member_stats(df, member, value)
    places = materialise(dense_index(norms.withColumn("_o", order).where("_o IS NOT NULL"), ["_o", "m"], "place").select("m", "place"), "places")
    sides = norms.select(F.col("m").alias("id"), *reads).join(places.withColumnRenamed("m", "id"), "id", "left")
    table, n_keys = members(df.select(F.col(member).alias("id"), F.col(key).alias("k"), F.col(value).cast("double").alias("v")), sides)
    # a place bars one of the first k free ones only if fewer than k places and those that i meets are before it
    table = table.withColumn("reach", F.col("work") + k)
    found = partners(table, table, n_keys, stats, lambda p: 1 / (1 + distance(p)), k, DIGITS, own=True, keep_zero=True, about=reads, reach="reach")
    found = materialise(found.select("i", "j", "sim", "place"), "partners")
    shared = found.where("place IS NULL").select("i", "j", "sim")
    taken = found.where("place IS NOT NULL").select("i", "place").unionByName(places.select(F.col("m").alias("i"), "place"))
    free = first_free_places(norms.select(F.col("m").alias("i")), "i", taken, k, places.count())
    apart = free.join(places.select("place", F.col("m").alias("j")), "place").select("i", "j", *[F.lit(0.0).alias(s) for s in stats])
    for s in ("i", "j"):
        apart = apart.join(norms.select(F.col("m").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "total", "square")]), s)
    sim = F.round(1 / (1 + distance(on_columns())), DIGITS).alias("sim")
    scored = shared.unionByName(apart.select("i", "j", sim)).where("sim IS NOT NULL")
    return top_k(scored, ["i"], [F.desc("sim"), F.asc("j")], k)
