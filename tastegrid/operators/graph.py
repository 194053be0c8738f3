"""Interaction and similarity graphs as edge tables ``(src, dst, weight)``, and propagation over them.

In graphs of users and items together, user ``u`` is node ``2u`` and item ``i`` is node ``2i + 1``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions.edge_blocks import EdgeBlocks
from tastegrid.functions.hashing import md5_int, md5_unit
from tastegrid.functions.nearest import best_products, cosine_at_least
from tastegrid.functions.pairs import HOT_PROFILE, pair_stats
from tastegrid.functions.ranking import dense_index, position_in_group, top_k
from tastegrid.functions.vectors import block_pairs, block_totals, cosine_block, dot, mean_vector, norm, normalised, shrunk_cosine_block, sum_vectors
from tastegrid.session import materialise

EPS = 1e-7


def user_node(c: str = "user") -> Column:
    return F.col(c) * 2


def item_node(c: str = "item") -> Column:
    return F.col(c) * 2 + 1


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse."""
    there = F.struct("src", "dst", "weight")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select(F.explode(F.array(there, back)).alias("e")).select("e.*")


def interaction_edges(train: DataFrame) -> DataFrame:
    """One edge of weight 1 from user node to item node per pair."""
    return train.select(user_node().alias("src"), item_node().alias("dst")).distinct().withColumn("weight", F.lit(1.0))


def _degree(edges: DataFrame, column: str, out: str, weighted: bool = False) -> DataFrame:
    agg = F.sum("weight") if weighted else F.count(F.lit(1)).cast("double")
    return edges.groupBy(column).agg(agg.alias(out))


def edge_norm(edges: DataFrame, eps: float = EPS) -> DataFrame:
    """Edges weighted by the inverse root degrees of both ends, one direction."""
    ds, dd = _degree(edges, "src", "_s"), _degree(edges, "dst", "_d")
    weight = F.pow(F.col("_s") + eps, -0.5) * F.pow(F.col("_d") + eps, -0.5)
    return edges.join(ds, "src").join(dd, "dst").select("src", "dst", weight.alias("weight"))


def norm_adjacency(train: DataFrame) -> DataFrame:
    """Symmetric normalised user-item adjacency, both directions."""
    return both_ways(edge_norm(interaction_edges(train)))


def laplacian(edges: DataFrame, mode: str = "sym", masked: bool = False) -> DataFrame:
    """Edge weights by weighted out-degree: 'none', 'sym' or 'rw'. A node without positive degree counts 0.

    ``masked`` (with 'sym') first zeroes weights of one, and lifts results to at least 1e-7."""
    if mode == "none":
        return edges
    degree = _degree(edges, "src", "_s", weighted=True)
    rows = edges.join(degree, "src")
    if mode == "rw":
        return rows.select("src", "dst", (F.when(F.col("_s") != 0, F.col("weight") / F.col("_s")).otherwise(0.0)).alias("weight"))
    rows = rows.join(degree.select(F.col("src").alias("dst"), F.col("_s").alias("_d")), "dst", "left")

    def root(c: str) -> Column:
        return F.when(F.col(c) > 0, F.pow(c, F.lit(-0.5))).otherwise(0.0)

    weight = F.when(F.col("weight") + 1e-6 > 1.0, 0.0).otherwise(F.col("weight")) if masked else F.col("weight")
    weight = root("_s") * weight * root("_d")
    return rows.select("src", "dst", (F.greatest(weight, F.lit(1e-7)) if masked else weight).alias("weight"))


def adjacency(train: DataFrame, kind: str) -> DataFrame:
    """User-item adjacency: 'plain' A, 'norm' D^-1(A+I), 'gcmc' D^-1 A, 'pre' D^-1/2 A D^-1/2, 'mean' D^-1 A + I."""
    edges = both_ways(interaction_edges(train))
    own = edges.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    if kind == "plain":
        return edges
    if kind == "norm":
        return laplacian(edges.unionByName(own), "rw")
    if kind == "gcmc":
        return laplacian(edges, "rw")
    if kind == "pre":
        return edge_norm(edges, 1e-8)
    if kind == "mean":
        return laplacian(edges, "rw").unionByName(own)
    raise ValueError(kind)


# --- similarity graphs over vectors (id, vec) ---------------------------------------------------------


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("score").alias("weight"))


def cosine_matrix(vectors: DataFrame) -> DataFrame:
    """Every pair's cosine: the result itself is quadratic, so it is meant for catalogues, not users."""
    return _edges(block_pairs(vectors, vectors, cosine_block))


def cosine_edges(vectors: DataFrame, at_least: float, **cells: int) -> DataFrame:
    """Pairs with a cosine of at least ``at_least``, both directions and self pairs; pairs that cannot reach it are not
    computed (:func:`nearest.cosine_at_least`, which takes ``cells``)."""
    return _edges(cosine_at_least(vectors, at_least, **cells))


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """The k most similar of each row, the row itself among them."""
    return _edges(block_pairs(vectors, vectors, cosine_block, k))


def knn_graph_pruned(vectors: DataFrame, k: int, **cells: int) -> DataFrame:
    """:func:`knn_graph` for large tables: a vector travels only to the cells that can hold a nearer one."""
    return _edges(best_products(vectors, vectors, k, cosine=True, **cells))


def unit_weights(edges: DataFrame) -> DataFrame:
    """Edges counted as 1 and normalised by the rows' edge counts at both ends."""
    rows = _degree(edges, "src", "_s")
    other = rows.select(F.col("src").alias("dst"), F.col("_s").alias("_d"))
    weight = F.pow(F.col("_s") + EPS, -0.5) * F.pow(F.coalesce("_d", F.lit(0.0)) + EPS, -0.5)
    return edges.join(rows, "src").join(other, "dst", "left").select("src", "dst", weight.alias("weight"))


def knn_graph_unweighted(vectors: DataFrame, k: int) -> DataFrame:
    return unit_weights(knn_graph(vectors, k))


def _outer(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.withColumnRenamed("weight", "wa"), b.withColumnRenamed("weight", "wb")
    return x.join(y, ["src", "dst"], "full_outer")


def fused_graph(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """share * a + (1 - share) * b."""
    mix = F.lit(share) * F.coalesce("wa", F.lit(0.0)) + F.lit(1 - share) * F.coalesce("wb", F.lit(0.0))
    return _outer(a, b).select("src", "dst", mix.alias("weight"))


def max_pool_graph(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger weight of an edge in either graph."""
    return _outer(a, b).select("src", "dst", F.greatest("wa", "wb").alias("weight"))


def _sum_graphs(*graphs: DataFrame) -> DataFrame:
    whole = graphs[0]
    for g in graphs[1:]:
        whole = whole.unionByName(g)
    return whole.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def mean_cosine(vectors: DataFrame, dim: int) -> float:
    """Mean cosine over all ordered pairs: the squared length of the mean unit vector, no pairs needed."""
    row = mean_vector(vectors.select(normalised("vec").alias("vec")), "vec", dim).first()
    return float(sum(x * x for x in row["mean_vec"]))


def mean_masked_knn(a: DataFrame, b: DataFrame, k: int, dim_a: int, dim_b: int) -> tuple[DataFrame, DataFrame]:
    """k-nearest graphs of two modalities over pairs at or above the mean similarity in both, normalised."""
    least_a, least_b = mean_cosine(a, dim_a), mean_cosine(b, dim_b)
    joint = a.join(b.withColumnRenamed("vec", "other"), "id").select("id", F.concat("vec", "other").alias("vec"))

    def masked(first: bool):
        def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            sa, sb = cosine_block(x[:, :dim_a], y[:, :dim_a]), cosine_block(x[:, dim_a:], y[:, dim_a:])
            return np.where((sa >= least_a) & (sb >= least_b), sa if first else sb, -np.inf)

        return score

    graphs = [block_pairs(joint, joint, masked(first), k, keep=np.isfinite) for first in (True, False)]
    return unit_weights(_edges(graphs[0])), unit_weights(_edges(graphs[1]))


def content_knn_scores(train: DataFrame, vectors: DataFrame, k: int, shrink: float) -> DataFrame:
    """(user, item, score): sum over the user's items of their shrunk similarity to the item, k nearest per item."""
    near = block_pairs(vectors, vectors, shrunk_cosine_block(shrink), k)
    w = near.select(F.col("i").alias("item"), F.col("j").alias("target"), F.col("score").alias("sim"))
    own = train.select("user", "item").distinct()
    return own.join(w, "item").groupBy("user", F.col("target").alias("item")).agg(F.sum("sim").alias("score"))


# --- co-occurrence and session graphs -----------------------------------------------------------------


def user_cooccurrence(train: DataFrame, k: int = 200, hot_profile: int = HOT_PROFILE) -> DataFrame:
    """(src, dst, weight, rank): users by number of shared items, the k best."""
    pairs = pair_stats(train.select("user", "item").distinct(), "item", "user", stats=["n"], hot_profile=hot_profile)
    best = top_k(pairs, ["i"], [F.desc("n"), F.asc("j")], k)
    return best.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("n").alias("weight"), "rank")


def sample_neighbours(neighbours: DataFrame, k: int, mode: str = "softmax", seed: int = 42, nodes: DataFrame | None = None) -> DataFrame:
    """Exactly ``k`` neighbours per node from a ranked table: the first k, shorter lists padded by random repeats.

    Weights are the softmax of the neighbour weights or 1 / k. Of ``nodes(src)``, those without a neighbour have k slots of
    weight 0 that point to the first node. The first k are written out, so the neighbours are computed once."""
    first = materialise(neighbours.filter(F.col("rank") <= k), "neighbours")
    sampled = _sampled_slots(first, k, mode, seed)
    if nodes is not None:
        alone = nodes.select("src").distinct().join(first.select("src").distinct(), "src", "left_anti")
        alone = alone.select("src", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"), F.lit(nodes.agg(F.min("src")).scalar()).alias("dst"), F.lit(0.0).alias("weight"))
        return sampled.unionByName(alone)
    return sampled


def _sampled_slots(first: DataFrame, k: int, mode: str, seed: int) -> DataFrame:
    sizes = first.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
    pick = F.when(F.col("slot") <= F.col("n"), F.col("slot")).otherwise(md5_int(F.lit(seed), "src", "slot") % F.col("n") + 1)
    rows = slots.withColumn("rank", pick.cast("int")).join(first, ["src", "rank"]).select("src", "slot", "dst", "weight")
    if mode == "mean":
        return rows.withColumn("weight", F.lit(1.0 / k))
    slots_of = Window.partitionBy("src")  # k rows each
    powers = rows.withColumn("e", F.exp(F.col("weight") - F.max("weight").over(slots_of)))
    return powers.select("src", "slot", "dst", (F.col("e") / F.sum("e").over(slots_of)).alias("weight"))


def session_item_graph(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Item graph with a loop on every item, normalised."""
    loops = items.select(F.col("item").alias("src"), F.col("item").alias("dst"), F.lit(1.0).alias("weight"))
    return unit_weights(loops.unionByName(edges.select("src", "dst", "weight")))


def degree_edge_pruning(train: DataFrame, drop: float, seed: int = 42) -> DataFrame:
    """A weighted sample of the edges without replacement, likelier for low degrees, normalised again.

    Exponential keys -ln(u) / weight order the edges; the first n in a distributed order are the sample."""
    edges = edge_norm(interaction_edges(train))
    keyed = edges.withColumn("key", -F.log(md5_unit(F.lit(seed), "src", "dst")) / F.col("weight"))
    placed = dense_index(keyed, ["key", "src", "dst"], "place")
    n = int(placed.count() * (1.0 - drop))
    kept = placed.filter(F.col("place") < n).select("src", "dst", F.lit(1.0).alias("weight"))
    return both_ways(edge_norm(kept))


# --- propagation --------------------------------------------------------------------------------------


def _half(c: str) -> Column:
    """0 for a user node, 1 for an item node."""
    return F.pmod(F.col(c), F.lit(2))


def layers(edges: DataFrame, vectors: DataFrame, count: int, dim: int, half: Callable[[str], Column] | None = None) -> list[DataFrame]:
    """X, AX, A^2 X, ...; every layer is written out, so later ones do not compute earlier ones again. Edges are cut into
    grid blocks once, and a layer moves vectors per block, not per edge."""
    blocks = EdgeBlocks(edges, dim, half=half)
    out = [materialise(vectors.select("id", "vec"), "layer")]
    for _ in range(count):
        out.append(materialise(blocks.step(out[-1]), "layer"))
    return out


def _add(tables: Sequence[DataFrame], dim: int) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return sum_vectors(whole, ["id"], "vec", dim)


def propagate(edges: DataFrame, vectors: DataFrame, count: int, dim: int) -> DataFrame:
    """Mean of the vectors and their ``count`` propagated layers, over a graph of user and item nodes."""
    return _add(layers(edges, vectors, count, dim, _half), dim).withColumn("vec", F.transform("vec", lambda x: x / (count + 1)))


def propagate_cosine_refined(edges: DataFrame, vectors: DataFrame, count: int, dim: int) -> DataFrame:
    """Sum of layers, each node's layer scaled by its cosine to the node's own vector before it goes on. The graph is one of
    user and item nodes."""
    blocks = EdgeBlocks(edges, dim, half=_half)
    first = materialise(vectors.select("id", F.col("vec").alias("own")), "layer")
    now, out = first.select("id", F.col("own").alias("vec")), []
    for _ in range(count):
        moved = blocks.step(now).join(first, "id")
        lengths = F.greatest(norm("vec"), F.lit(1e-8)) * F.greatest(norm("own"), F.lit(1e-8))
        moved = moved.withColumn("c", dot("vec", "own") / lengths).select("id", F.transform("vec", lambda x: x * F.col("c")).alias("vec"))
        now = materialise(moved, "layer")
        out.append(now)
    return _add(out, dim)


def item_graph_smoothing(item_edges: DataFrame, vectors: DataFrame, count: int, dim: int) -> DataFrame:
    """The last of ``count`` steps over an item graph."""
    return layers(item_edges, vectors, count, dim)[-1]


def add_vectors(a: DataFrame, b: DataFrame, dim: int) -> DataFrame:
    return _add([a.select("id", "vec"), b.select("id", "vec")], dim)


def user_profiles(train: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """(id, vec) per user: sum of the item vectors over the number of items."""
    own = train.select("user", "item").distinct()
    sums = sum_vectors(own.join(items.withColumnRenamed("id", "item"), "item"), ["user"], "vec", dim)
    counts = own.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(counts, "user").select(F.col("user").alias("id"), F.transform("vec", lambda x: x * (1 / (F.col("n") + EPS))).alias("vec"))


def user_modal_profile(train: DataFrame, items: DataFrame, count: int, dim: int) -> DataFrame:
    """User profiles and item vectors as nodes, after ``count`` propagation steps."""
    users = user_profiles(train, items, dim).select(user_node("id").alias("id"), "vec")
    nodes = users.unionByName(items.select(item_node("id").alias("id"), "vec"))
    return layers(norm_adjacency(train), nodes, count, dim, _half)[-1]


# --- statistics of representations --------------------------------------------------------------------


def alignment(train: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Mean squared distance of the unit vectors of each interaction's user and item."""
    u = users.select(F.col("id").alias("user"), normalised("vec").alias("a"))
    i = items.select(F.col("id").alias("item"), normalised("vec").alias("b"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = train.select("user", "item").distinct().join(u, "user").join(i, "item")
    return pairs.agg(F.avg(gap).alias("value"))


def uniformity(vectors: DataFrame, t: float = 2.0) -> DataFrame:
    """Log of the mean over pairs of exp(-t * squared distance) of unit vectors; a task returns one number."""
    n = vectors.agg(F.count(F.lit(1))).scalar()

    def total(a: np.ndarray, b: np.ndarray) -> float:
        return np.exp(-t * (2 - 2 * cosine_block(a, b))).sum()

    sums = block_totals(vectors, total).agg(F.sum("total").alias("s"))
    return sums.select(F.log((F.col("s") - n) / (n * (n - 1))).alias("value"))


def embedding_moments(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, mean, variance) over all cells of each representation."""
    out = None
    for name, t in tables.items():
        cells = t.select(F.explode("vec").alias("v")).agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))
        row = cells.select(F.lit(name).alias("name"), "mean", "variance")
        out = row if out is None else out.unionByName(row)
    return out


def moment_gap(moments: DataFrame) -> DataFrame:
    """Sum over pairs of representations of the absolute differences of means and of variances."""
    a, b = moments.alias("a"), moments.alias("b")
    gap = F.abs(F.col("a.mean") - F.col("b.mean")) + F.abs(F.col("a.variance") - F.col("b.variance"))
    return a.join(b, F.col("a.name") < F.col("b.name")).agg(F.sum(gap).alias("value"))


def item_users_neighbour(train: DataFrame, chunk: int = 1000) -> DataFrame:
    """(item, part, users): the users of each item in id order, in lists of at most ``chunk``."""
    placed = position_in_group(train.select("item", "user").distinct(), ["item"], [F.asc("user")], "p")
    parts = placed.withColumn("part", F.floor((F.col("p") - 1) / chunk).cast("int"))
    return parts.groupBy("item", "part").agg(F.sort_array(F.collect_list("user")).alias("users"))


# --- graphs from user interest ------------------------------------------------------------------------


def interest_graph(train: DataFrame, first: DataFrame, second: DataFrame, k_interest: int, k: int, dim: int) -> DataFrame:
    """Item graph of the first modality from user interest, plus its nearest-neighbour graph.

    A user's targets are the ``k_interest`` items nearest to the sum of the unit vectors of the user's items, in
    either modality. Each (own item, target) pair adds the pair's similarity once per user.
    """
    own = train.select("user", "item").distinct()
    units = {m: materialise(t.select("id", normalised("vec").alias("vec")), "unit") for m, t in (("a", first), ("b", second))}
    targets = None
    for unit in units.values():
        sums = sum_vectors(own.join(unit.withColumnRenamed("id", "item"), "item"), ["user"], "vec", dim).withColumnRenamed("user", "id")
        best = block_pairs(sums, unit, lambda x, y: x @ y.T, k_interest).select(F.col("i").alias("user"), F.col("j").alias("target"))
        targets = best if targets is None else targets.unionByName(best)
    targets = targets.distinct()
    unit = units["a"]
    known = own.join(unit.select(F.col("id").alias("item")), "item", "left_semi")
    counts = known.join(targets, "user").groupBy("item", "target").agg(F.count(F.lit(1)).alias("c"))
    sims = counts.join(unit.select(F.col("id").alias("item"), F.col("vec").alias("x")), "item")
    sims = sims.join(unit.select(F.col("id").alias("target"), F.col("vec").alias("y")), "target")
    interest = sims.select(F.col("item").alias("src"), F.col("target").alias("dst"), (F.col("c") * dot("x", "y")).alias("weight"))
    return _sum_graphs(laplacian(interest.filter(F.col("weight") != 0), "sym"), laplacian(knn_graph(first, k), "sym"))


def attractive_augmentation(train: DataFrame, first: DataFrame, second: DataFrame, extra: int, dim: int) -> DataFrame:
    """User-item adjacency plus half of a normalised graph to the items most like the user's own in both modalities.

    A user with n items gets the n + ``extra`` best (own item, item) pairs by the product of similarities. Every
    own item pairs with itself at product 1, the maximum, so n of them are fixed and only the ``extra`` best others
    are searched, among ``extra`` neighbours per item.
    """
    joint = first.join(second.withColumnRenamed("vec", "other"), "id").select("id", F.concat("vec", "other").alias("vec"))

    def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return cosine_block(x[:, :dim], y[:, :dim]) * cosine_block(x[:, dim:], y[:, dim:])

    near = block_pairs(joint, joint, score, extra, exclude_self=True).select(F.col("i").alias("item"), F.col("j").alias("target"), "score")
    own = train.select("user", "item").distinct().join(joint.select(F.col("id").alias("item")), "item", "left_semi")
    others = top_k(own.join(near, "item"), ["user"], [F.desc("score"), F.asc("item"), F.asc("target")], extra)
    pulled = own.select("user", "item", F.lit(1.0).alias("score")).unionByName(others.select("user", F.col("target").alias("item"), "score"))
    edges = pulled.groupBy(user_node().alias("src"), item_node().alias("dst")).agg(F.sum("score").alias("weight"))
    half = laplacian(both_ways(edges), "sym").withColumn("weight", F.col("weight") / 2)
    return _sum_graphs(norm_adjacency(train), half)
