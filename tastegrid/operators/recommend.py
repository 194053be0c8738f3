"""Recommenders. All end in the same step: leave out training items, keep the k best per user."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tastegrid.functions.nearest import best_products
from tastegrid.functions.pairs import HOT_PROFILE, pair_stats
from tastegrid.functions.partners import entries, members, partners
from tastegrid.functions.ranking import dense_index, first_free_places, number_rows, top_k
from tastegrid.functions.ratios import ratio
from tastegrid.functions.vectors import block_pairs, cosine_block, dense_rows, dot_block, k_best
from tastegrid.operators.similarity import DIGITS, similarity
from tastegrid.session import materialise, stored


def top_k_unseen(scores: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(user, item, score, rank): the k best scored items outside the training part."""
    fresh = scores.select("user", "item", F.round("score", DIGITS).alias("score")).join(train.select("user", "item"), ["user", "item"], "left_anti")
    return top_k(fresh, ["user"], [F.desc("score"), F.asc("item")], k)


def full_top_k_unseen(scores: DataFrame, train: DataFrame, k: int, rest: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """As :func:`top_k_unseen` among all ``items`` (those of the training part by default) for all training users: an item
    without a score has 0, or the user's value in ``rest(user, score)``.

    Only the first k unscored items of a user can be in its list, and they are the first free places in item order, so
    users x items is never built.
    """
    users, seen = train.select("user").distinct(), train.select("user", "item").distinct()
    places = materialise(dense_index((train if items is None else items).select("item").distinct(), ["item"], "place"), "places")
    if hasattr(scores, "sides"):
        fresh, scored = _best_of_product(*scores.sides(), seen, places, k)
        taken = scored.unionByName(seen.join(places, "item").select("user", "place")).distinct()
    else:
        scores = materialise(scores.select("user", "item", F.round("score", DIGITS).alias("score")), "scores")
        fresh = scores.join(seen, ["user", "item"], "left_anti")
        taken = scores.select("user", "item").unionByName(seen).distinct().join(places, "item").select("user", "place")
    free = first_free_places(users, "user", taken, k, places.count()).join(places, "place").select("user", "item")
    base = free.withColumn("score", F.lit(0.0)) if rest is None else free.join(rest.select("user", F.round("score", DIGITS).alias("score")), "user")
    return top_k(fresh.unionByName(base.select("user", "item", "score")), ["user"], [F.desc("score"), F.asc("item")], k)


def _product(left: DataFrame, right: DataFrame, neighbours: str) -> DataFrame:
    """``(user, item, score)``: sum over l of a * b for ``left(user, l, a)`` and ``right(l, item, b)``. The two stay beside the table, so that
    lists of it can be made without its rows; the side ``neighbours`` is computed once for that."""
    scores = left.join(right, "l").groupBy("user", "item").agg(F.sum(F.col("a") * F.col("b")).alias("score"))
    scores.sides = lambda: (stored(left, "left"), right) if neighbours == "left" else (left, stored(right, "right"))
    return scores


def _best_of_product(left: DataFrame, right: DataFrame, seen: DataFrame, places: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best unseen scored items of every user as ``(user, item, score)``, and ``(user, place)`` of scored items with those that may bar
    one of the user's first k free places."""
    sizes = right.where("l IS NOT NULL").groupBy(F.col("l").alias("k")).agg(F.count(F.lit(1)).alias("size"))
    keys = number_rows(sizes.join(left.select(F.col("l").alias("k")), "k", "left_semi"), "key")
    hidden = seen.groupBy(F.col("user").alias("id")).agg(F.collect_list("item").alias("seen"))
    none = F.array().cast(hidden.schema["seen"].dataType)
    own = entries(left.select(F.col("user").alias("id"), F.col("l").alias("k"), F.col("a").cast("double").alias("v")), keys, hidden)
    own = own.withColumn("seen", F.coalesce("seen", none)).withColumn("reach", F.col("work") + F.size("seen") + k)
    others = entries(right.select(F.col("item").alias("id"), F.col("l").alias("k"), F.col("b").cast("double").alias("v")), keys, places.withColumnRenamed("item", "id"))
    found = partners(own, others, keys.count(), ["dot"], lambda p: p.get("dot"), k, DIGITS, keep_zero=True, hidden="seen", reach="reach")
    found = materialise(found, "partners")
    best = found.where("place IS NULL").select(F.col("i").alias("user"), F.col("j").alias("item"), F.col("sim").alias("score"))
    return best, found.where("place IS NOT NULL").select(F.col("i").alias("user"), "place")


def top_k_candidates(scores: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """As :func:`top_k_unseen` with a given candidate set instead of the training mask."""
    allowed = scores.select("user", "item", F.round("score", DIGITS).alias("score")).join(candidates.select("user", "item"), ["user", "item"], "left_semi")
    return top_k(allowed, ["user"], [F.desc("score"), F.asc("item")], k)


def proxy(lists: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Given lists cut at ``k`` first, then reduced to the candidates. A ``model`` column is kept apart."""
    keys = ["model", "user"] if "model" in lists.columns else ["user"]
    cut = top_k(lists, keys, [F.desc("score"), F.asc("item")], k)
    return cut.join(candidates.select("user", "item"), ["user", "item"], "left_semi")


def item_knn_scores(train: DataFrame, neighbours: DataFrame, target: str = "i") -> DataFrame:
    """(user, item, score): ratings times similarity. ``target`` says which side of ``(i, j, sim)`` is scored."""
    source = "j" if target == "i" else "i"
    w = neighbours.select(F.col(source).alias("l"), F.col(target).alias("item"), F.col("sim").alias("b"))
    return _product(train.select("user", F.col("item").alias("l"), F.col("rating").alias("a")), w, "right")


def user_knn_scores(train: DataFrame, neighbours: DataFrame, target: str = "i") -> DataFrame:
    """(user, item, score): similarities times ratings, for user neighbours ``(i, j, sim)``. With target 'i' a user is scored
    from the user's own neighbours j, with 'j' from the users i that have the user among theirs."""
    source = "j" if target == "i" else "i"
    w = neighbours.select(F.col(target).alias("user"), F.col(source).alias("l"), F.col("sim").alias("a"))
    return _product(w, train.select(F.col("user").alias("l"), "item", F.col("rating").alias("b")), "left")


def user_similarity(train: DataFrame, fn: str, k: int, keep_self: bool = True, hot_profile: int = HOT_PROFILE) -> DataFrame:
    """User neighbours; in the plain form a user is among its own neighbours."""
    return similarity(train, fn, k, key="item", member="user", keep_self=keep_self, hot_profile=hot_profile)


# --- attributes ---------------------------------------------------------------------------------------


def stacked_features(train: DataFrame, attributes: DataFrame, weight: float) -> DataFrame:
    """(key, item, rating): attributes with one weight, next to the ratings, as keys of the items."""
    feats = attributes.select(F.concat(F.lit("f"), F.col("feature_id").cast("string")).alias("key"), "item", F.lit(weight).alias("rating"))
    users = train.select(F.concat(F.lit("u"), F.col("user").cast("string")).alias("key"), "item", "rating")
    known = feats.join(train.select("item").distinct(), "item", "left_semi").select("key", "item", "rating")
    return known.unionByName(users.select("key", "item", "rating"))


def bm25_weight(m: DataFrame, row: str, col: str, value: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Values of a sparse matrix reweighted by Okapi BM25, rows as documents and columns as terms."""
    lengths = m.groupBy(row).agg(F.sum(value).alias("_len"))
    n, mean = lengths.agg(F.count(F.lit(1)).cast("double")).scalar(), lengths.agg(F.avg("_len")).scalar()
    df = m.groupBy(col).agg(F.count(F.lit(1)).alias("_df"))
    x, norm = F.col(value), (1.0 - b) + b * ratio(F.col("_len"), mean, 0.0)
    weight = ratio(x * (k1 + 1.0), k1 * norm + x, 0.0) * F.log(n / (1 + F.col("_df")))
    return m.join(lengths, row).join(df, col).select(row, col, weight.alias(value))


def tfidf_sqrt_weight(m: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Square root of the value times ln(rows / (1 + column count))."""
    n = m.agg(F.countDistinct(row).cast("double")).scalar()
    df = m.groupBy(col).agg(F.count(F.lit(1)).alias("_df"))
    return m.join(df, col).select(row, col, (F.sqrt(value) * F.log(n / (1 + F.col("_df")))).alias(value))


FEATURE_WEIGHTS = {"TF_IDF": tfidf_sqrt_weight, "BM25": bm25_weight}


def attribute_item_neighbours(train: DataFrame, attributes: DataFrame, weight: float, fn: str, k: int, feature_weighting: str | None = None) -> DataFrame:
    """Item neighbours from attributes and ratings side by side; 'TF_IDF' or 'BM25' first reweighs the whole matrix with the
    items as its documents."""
    stacked = stacked_features(train, attributes, weight)
    if feature_weighting is not None:
        stacked = FEATURE_WEIGHTS[feature_weighting](stacked, "item", "key", "rating")
    return similarity(stacked, fn, k, key="key")


def tfidf_items(attributes: DataFrame) -> DataFrame:
    """(item, feature_id, weight): ln(items / feature count), scaled to length 1 per item; 0 for an item that has only features of
    all items."""
    n = attributes.agg(F.countDistinct("item").cast("double")).scalar()
    idf = attributes.groupBy("feature_id").agg(F.log(n / F.count(F.lit(1))).alias("idf"))
    rows = attributes.join(idf, "feature_id")
    lengths = rows.groupBy("item").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("len"))
    return rows.join(lengths, "item").select("item", "feature_id", ratio(F.col("idf"), F.col("len"), 0.0).alias("weight"))


#: Features of an item in one array, feature rows that a task combines, and those of a user from which on tasks share the user.
_ARRAY, _TASK_ROWS, HOT_WORK = 2_000, 2_000_000, 10_000_000


def tfidf_user_profile(train: DataFrame, weights: DataFrame, hot_work: int = HOT_WORK) -> DataFrame:
    """(user, feature_id, weight): mean weight over those of the user's items that have the feature.

    An item's features travel to its users as arrays and are expanded and combined there, so a row per user, item and feature
    is never shuffled. A user with more than ``hot_work`` of them is combined map-side instead.
    """
    sizes = weights.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("feature_id"), F.ceil(F.col("n") / _ARRAY)).alias("part")
    cut = weights.join(sizes, "item").groupBy("item", part).agg(F.collect_list(F.struct("feature_id", "weight")).alias("p"))
    cut = materialise(cut.select("item", F.col("p.feature_id").alias("features"), F.col("p.weight").alias("weights")), "profiles")
    owned = train.select("user", "item")
    lengths = cut.groupBy("item").agg(F.sum(F.size("features")).alias("n"))
    work = owned.join(lengths, "item").groupBy("user").agg(F.sum("n").alias("work"))
    total, n_hot = work.agg(F.sum("work"), F.count_if(F.col("work") > hot_work)).first()

    def means(rows: DataFrame) -> DataFrame:
        each = rows.select("user", "weights", F.posexplode("features").alias("at", "feature_id"))
        return each.groupBy("user", "feature_id").agg(F.avg(F.get("weights", "at")).alias("weight"))

    rows = owned.join(cut.hint("merge"), "item")
    tasks = max(1, ceil((total or 0) / _TASK_ROWS))
    if not n_hot:
        return means(rows.repartition(tasks, "user"))
    hot = materialise(work.where(F.col("work") > hot_work).select(F.col("user").alias("hot_user")), "hot_users")
    same = F.col("user").eqNullSafe(F.col("hot_user"))
    return means(rows.join(hot, same, "left_anti").repartition(tasks, "user")).unionByName(means(rows.join(hot, same, "left_semi")))


def binary_user_profile(train: DataFrame, attributes: DataFrame) -> DataFrame:
    """(user, feature_id, 1): all features of the user's items."""
    return train.select("user", "item").join(attributes, "item").select("user", "feature_id").distinct().withColumn("weight", F.lit(1.0))


_BLOCK_SCORES = {"cosine": cosine_block, "dot": dot_block}
# Feature dictionaries up to this size are laid out as dense vectors; larger ones stay in long form.
DENSE_FEATURES = 4096


def _feature_width(profile: DataFrame, attributes: DataFrame) -> int:
    top = profile.select("feature_id").unionByName(attributes.select("feature_id")).agg(F.max("feature_id")).first()[0]
    return int(top) + 1


def profile_user_neighbours(profile: DataFrame, fn: str, k: int, dense_features: int = DENSE_FEATURES) -> DataFrame:
    """User neighbours ``(i, j, sim)`` from ``(user, feature_id, weight)``, a user being its own neighbour.

    Users share almost all features, so small dictionaries are compared as blocks of dense vectors. Users that share no
    feature are no neighbours in either form."""
    d = _feature_width(profile, profile)
    if d <= dense_features:
        vectors = dense_rows(profile, "user", "feature_id", "weight", d)
        near = block_pairs(vectors, vectors, _BLOCK_SCORES[fn], k).withColumnRenamed("score", "sim")
        return near.where(F.round("sim", DIGITS) != 0)
    return similarity(profile, fn, k, key="feature_id", member="user", value="weight", keep_self=True)


def attribute_user_knn_recs(train: DataFrame, profile: DataFrame, fn: str, neighbours: int, k: int, dense_features: int = DENSE_FEATURES) -> DataFrame:
    """Complete lists of unseen items from the ratings of those users that count the user among their nearest by features."""
    near = profile_user_neighbours(profile, fn, neighbours, dense_features)
    return full_top_k_unseen(user_knn_scores(train, near, target="j"), train, k)


def vsm_recs(profile: DataFrame, weights: DataFrame, train: DataFrame, fn: str, k: int, dense_features: int = DENSE_FEATURES) -> DataFrame:
    """Unseen items nearest to the user's feature profile, among all items with a feature; those that share none have 0."""
    d = _feature_width(profile, weights)
    if d <= dense_features:
        users, items = dense_rows(profile, "user", "feature_id", "weight", d), dense_rows(weights, "item", "feature_id", "weight", d)
        return factor_recs(users, items, train, k, _BLOCK_SCORES[fn])
    dots = profile.select("user", "feature_id", F.col("weight").alias("a")).join(weights.select("item", "feature_id", F.col("weight").alias("b")), "feature_id")
    dots = dots.groupBy("user", "item").agg(F.sum(F.col("a") * F.col("b")).alias("score"))
    if fn == "cosine":
        for side, table in (("user", profile), ("item", weights)):
            lengths = table.groupBy(side).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_len"))
            dots = dots.join(lengths, side).withColumn("score", ratio(F.col("score"), F.col("_len"), 0.0)).drop("_len")
    return full_top_k_unseen(dots, train.join(profile.select("user").distinct(), "user", "left_semi"), k, items=weights)


def factor_recs(users: DataFrame, items: DataFrame, train: DataFrame, k: int, score=dot_block) -> DataFrame:
    """Top-k unseen items from vectors ``(id, vec)`` of users and items: blocked products, masked in the block."""
    mask = train.select(F.col("user").alias("i"), F.col("item").alias("j"))
    got = block_pairs(users, items, score, k, mask=mask)
    return got.select(F.col("i").alias("user"), F.col("j").alias("item"), "score", "rank")


def factor_recs_pruned(users: DataFrame, items: DataFrame, train: DataFrame, k: int, **cells: int) -> DataFrame:
    """:func:`factor_recs` by dot products for large catalogues: a user's vector travels only to the item cells that can
    still beat the user's k-th best score (:func:`nearest.best_products`, which takes ``cells``)."""
    mask = train.select(F.col("user").alias("i"), F.col("item").alias("j"))
    got = best_products(users, items, k, mask=mask, **cells)
    return got.select(F.col("i").alias("user"), F.col("j").alias("item"), "score", "rank")


def with_bias(vectors: DataFrame, bias: DataFrame | None, first: bool) -> DataFrame:
    """Vectors extended so that their dot product adds the biases: (vec, b, 1) against (vec, 1, b)."""
    rows = vectors if bias is None else vectors.join(bias.select("id", "bias"), "id", "left")
    b = F.lit(0.0) if bias is None else F.coalesce("bias", F.lit(0.0))
    pair = F.array(b, F.lit(1.0)) if first else F.array(F.lit(1.0), b)
    return rows.select("id", F.concat(F.col("vec").cast("array<double>"), pair).alias("vec"))


def dot_product_recs(users: DataFrame, items: DataFrame, train: DataFrame, k: int, user_bias: DataFrame | None = None, item_bias: DataFrame | None = None) -> DataFrame:
    return factor_recs(with_bias(users, user_bias, True), with_bias(items, item_bias, False), train, k)


# --- co-occurrence models -----------------------------------------------------------------------------


def slope_one_deviations(train: DataFrame, hot_profile: int = HOT_PROFILE) -> DataFrame:
    """(i, j, dev): mean difference of the ratings of i and j over users with both."""
    pairs = pair_stats(train, "user", "item", "rating", ["n", "diff"], hot_profile=hot_profile)
    return pairs.select("i", "j", (F.col("diff") / F.col("n")).alias("dev"))


# Rows of deviations and of ratings that a task of slope one holds, users and items of its block of scores.
_DEVIATIONS, _RATINGS, _BLOCK_USERS, _BLOCK_ITEMS = 2_000_000, 500_000, 2_048, 1_024


def slope_one_recs(train: DataFrame, k: int, deviations: DataFrame | None = None, users_per_block: int = _BLOCK_USERS, items_per_block: int = _BLOCK_ITEMS) -> DataFrame:
    """The k best unseen items of every user by slope one: the user's mean plus the mean deviation of the item from those
    of the user's items that share a user with it; the mean alone where there is none.

    Deviations are written once, an item's as one list, by the task that makes them. A task then has a block of users and reads the lists
    past it, so neither pairs of items nor scores are ever shuffled, and only the k best per user leave. Of the items that have the
    mean alone, only the first k of a user are built.
    """
    if not train.where("user IS NULL OR item IS NULL OR rating IS NULL").isEmpty():
        return _slope_one_with_nulls(train, k, deviations, users_per_block, items_per_block)
    means = train.groupBy("user").agg(F.avg(F.col("rating").cast("double")).alias("score"))
    seen = train.select("user", "item").distinct()
    places = materialise(dense_index(train.select("item").distinct(), ["item"], "place"), "places")
    place = places.withColumnRenamed("item", "id")
    if deviations is None:
        table, n_keys = members(train.select(F.col("item").alias("id"), F.col("user").alias("k"), F.col("rating").cast("double").alias("v")), place)
        others = partners(table, table, n_keys, ["n", "diff"], lambda p: p.get("diff") / p.get("n"), own=True, lists=True)
    else:
        known = deviations.join(places.select(F.col("item").alias("j"), F.col("place").cast("int").alias("key")), "j").where("dev IS NOT NULL")
        others = known.groupBy(F.col("i").alias("id")).agg(F.collect_list(F.struct("key", "dev")).alias("p"))
        others = others.select("id", F.col("p.key").alias("keys"), F.col("p.dev").alias("values")).join(place, "id")
    others = materialise(others.withColumn("no", F.monotonically_increasing_id()), "deviations")
    keys = places.select(F.col("item").alias("k"), F.col("place").alias("key"))
    keys = keys.join(others.select(F.col("id").alias("k"), F.size("keys").cast("bigint").alias("size")), "k")
    about = seen.groupBy("user").agg(F.collect_list("item").alias("seen")).join(means, "user").select(F.col("user").alias("id"), "seen", F.col("score").alias("mean"))
    own = entries(train.select(F.col("user").alias("id"), F.col("item").alias("k"), F.lit(1.0).alias("v")), keys, about)
    own = own.where("seen IS NOT NULL").withColumn("reach", F.col("work") + F.size("seen") + k)
    score = lambda p: p.get("mean_i") + p.get("right") / p.get("n")
    found = partners(own, others, places.count(), ["n", "right"], score, k, DIGITS, keep_zero=True, hidden="seen", about_left=["mean"], reach="reach")
    found = materialise(found, "partners")
    scored = found.where("place IS NULL").select(F.col("i").alias("user"), F.col("j").alias("item"), F.col("sim").alias("score"))
    taken = found.where("place IS NOT NULL").select(F.col("i").alias("user"), "place").unionByName(seen.join(places, "item").select("user", "place")).distinct()
    free = first_free_places(seen.select("user").distinct(), "user", taken, k, places.count()).join(places, "place").select("user", "item")
    rest = free.join(means.select("user", F.round("score", DIGITS).alias("score")), "user")
    return top_k(scored.unionByName(rest.select("user", "item", "score")), ["user"], [F.desc("score"), F.asc("item")], k)


def _slope_one_with_nulls(train: DataFrame, k: int, deviations: DataFrame | None, users_per_block: int, items_per_block: int) -> DataFrame:
    """As :func:`slope_one_recs` for tables with null users, items or ratings: scores that a null takes part in are not defined, in whole
    blocks, and undefined scores are in no list."""
    profiles = materialise(train.select("user", F.col("item").alias("j"), F.col("rating").cast("double").alias("rating")), "profiles")
    dev = slope_one_deviations(train) if deviations is None else deviations
    alone = train.select(F.col("item").alias("i")).distinct().select("i", F.lit(None).cast(train.schema["item"].dataType).alias("j"), F.lit(0.0).alias("dev"))
    dev = materialise(dev.select("i", "j", "dev").unionByName(alone), "deviations")
    n, n_users = profiles.agg(F.count(F.lit(1)), F.approx_count_distinct("user")).first()
    m, n_items = dev.agg(F.count(F.lit(1)), F.approx_count_distinct("i")).first()
    ny = max(1, ceil(m / _DEVIATIONS), ceil(n_items / items_per_block))
    cores = train.sparkSession.sparkContext.defaultParallelism
    nx = max(1, ceil(n / _RATINGS), ceil(n_users / users_per_block), min(ceil(cores / ny), ceil(n_users / 64)))
    part = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    left = profiles.select(part("user", nx).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y"), "user", "j", "rating")
    right = dev.select(F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"), part("i", ny).alias("y"), "i", "j", "dev")

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"user": a["user"].iloc[:0], "item": b["i"].iloc[:0], "score": a["rating"].iloc[:0]})
        users, row = np.unique(a["user"].to_numpy(), return_inverse=True)
        items, col = np.unique(b["i"].to_numpy(), return_inverse=True)
        own, paired = a["j"].to_numpy(), b["j"].notna().to_numpy()
        col, source, gap = col[paired], b["j"].to_numpy()[paired].astype(own.dtype), b["dev"].to_numpy()[paired]
        by_source, by_own = np.argsort(source, kind="stable"), np.argsort(own, kind="stable")
        total, number = np.zeros((len(users), len(items))), np.zeros((len(users), len(items)))
        middle = np.intersect1d(source, own)
        for start in range(0, len(middle), _BLOCK_ITEMS):
            part = middle[start : start + _BLOCK_ITEMS]
            d = by_source[np.searchsorted(source, part[0], "left", sorter=by_source) : np.searchsorted(source, part[-1], "right", sorter=by_source)]
            p = by_own[np.searchsorted(own, part[0], "left", sorter=by_own) : np.searchsorted(own, part[-1], "right", sorter=by_own)]
            p = p[np.isin(own[p], part)]
            d = d[np.isin(source[d], part)]
            worth, there, held = np.zeros((len(part), len(items))), np.zeros((len(part), len(items))), np.zeros((len(users), len(part)))
            at = np.searchsorted(part, source[d]), col[d]
            worth[at], there[at] = gap[d], 1.0
            held[row[p], np.searchsorted(part, own[p])] = 1.0
            total += held @ worth
            number += held @ there
        mean = np.bincount(row, a["rating"].to_numpy()) / np.bincount(row)
        score = np.round(mean[:, None] + np.divide(total, number, out=np.zeros_like(total), where=number > 0), DIGITS)
        unseen = np.ones(score.shape, bool)
        at = np.searchsorted(items, own).clip(max=len(items) - 1)
        here = items[at] == own
        unseen[row[here], at[here]] = False
        r, c = k_best(score, unseen, k)
        return pd.DataFrame({"user": users[r], "item": items[c], "score": score[r, c]})

    kinds = [train.schema[c].dataType.simpleString() for c in ("user", "item")]
    best = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(kernel, f"user {kinds[0]}, item {kinds[1]}, score double")
    return top_k(best, ["user"], [F.desc("score"), F.asc("item")], k)


def rp3beta_neighbours(train: DataFrame, alpha: float, beta: float, k: int, normalise: bool = False, hot_profile: int = HOT_PROFILE) -> DataFrame:
    """(i, j, sim): two random-walk steps from item i to item j, damped by the popularity of j; the k best per i,
    optionally scaled to sum 1, then the k best per j."""
    totals = train.groupBy("user").agg(F.sum("rating").alias("total"))
    walk = train.join(totals, "user").select("user", "item", F.pow(ratio(F.col("rating"), F.col("total"), 0.0), alpha).alias("step"))
    degree = train.groupBy(F.col("item").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("deg"))
    table, n_keys = members(walk.select(F.col("item").alias("id"), F.col("user").alias("k"), F.col("step").alias("v")), degree)
    score = lambda p: p.power(p.get("deg_i"), -alpha) * p.get("right") * p.power(p.get("deg_j"), -beta)
    pairs = partners(table, table, n_keys, ["right"], score, k, 12, own=True, about=["deg"])
    rows = materialise(top_k(pairs.select("i", "j", "sim"), ["i"], [F.desc("sim"), F.asc("j")], k).drop("rank"), "walks")
    if normalise:
        rows = rows.join(rows.groupBy("i").agg(F.sum("sim").alias("_s")), "i").select("i", "j", ratio(F.col("sim"), F.col("_s"), 0.0).alias("sim"))
    return top_k(rows, ["j"], [F.desc("sim"), F.asc("i")], k).drop("rank")


def gram_matrix(train: DataFrame, l2: float, hot_profile: int = HOT_PROFILE) -> DataFrame:
    """(i, j, value): products of the item columns; on the diagonal the item count plus ``l2``."""
    off = pair_stats(train, "user", "item", "rating", ["dot"], hot_profile=hot_profile).select("i", "j", F.col("dot").alias("value"))
    counts = train.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    return off.unionByName(counts.select(F.col("item").alias("i"), F.col("item").alias("j"), (F.col("c") + F.lit(l2)).alias("value")))
