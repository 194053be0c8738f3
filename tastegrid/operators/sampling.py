"""Negative sampling and training rows.

A random pick is an md5 of (seed, what, who, draw number) taken modulo the catalogue size, so it is
repeatable on any cluster. A negative is the first draw that the user has not seen: a few draws are
joined against the seen pairs, and only rows whose draws were all rejected draw again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.hashing import md5_int, md5_key
from tastegrid.functions.pairs import pair_stats
from tastegrid.functions.ranking import dense_index, position_in_group, running_total, top_k
from tastegrid.session import materialise

_BLOCK_ITEMS = 1024


def unseen(users: DataFrame, items: DataFrame, seen: DataFrame, n_items: int | None = None) -> DataFrame:
    """(user, item) for every catalogue item the user has not seen.

    The catalogue is held as arrays of about a thousand items; a user row meets each array once and the
    user's seen items of that block are taken out of it, so pairs exist only in the result.
    """
    n_items = items.count() if n_items is None else n_items
    n_blocks = max(1, ceil(n_items / _BLOCK_ITEMS))

    def block(c: str):
        return F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int").alias("block")

    blocks = items.select("item", block("item")).groupBy("block").agg(F.collect_set("item").alias("all"))
    known = seen.select("user", "item", block("item")).groupBy("user", "block").agg(F.collect_set("item").alias("known"))
    slots = users.select("user", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    return (
        slots.join(known, ["user", "block"], "left")
        .join(blocks, "block")
        .select("user", F.explode(F.when(F.col("known").isNull(), F.col("all")).otherwise(F.array_except("all", "known"))).alias("item"))
    )


def unseen_gaps(users: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """``user, lo, hi, n, least, most, total``: the items that each user has not seen, as runs of places lo .. hi in item
    order, with their number, first and last item and the sum of their ids. A user has at most one run more than seen
    items, so the result is as long as ``seen`` plus ``users``, never users x items.

    The catalogue knows the running totals of its ids and each item's neighbours; a run between two seen items then is the
    difference of what they carry. Seen items of a user are numbered (a user may hold any share of the rows) and each meets
    the one before it by (user, number).
    """
    catalogue = running_total(items.select("item").distinct().withColumn("id", F.col("item").cast("decimal(38,0)")), [F.col("item")], "id", "upto")
    catalogue = materialise(dense_index(catalogue.select("item", "upto"), ["item"], "place"), "catalogue")
    after = catalogue.select((F.col("place") - 1).alias("place"), F.col("item").alias("next"))
    ahead = catalogue.select((F.col("place") + 1).alias("place"), F.col("item").alias("last"), F.col("upto").alias("before"))
    catalogue = materialise(catalogue.join(after, "place", "left").join(ahead, "place", "left"), "catalogue")
    size, first, end, whole = catalogue.agg(F.count(F.lit(1)), F.min("item"), F.max("item"), F.max("upto")).first()
    if not size:
        return users.select("user", *[F.lit(0).cast("bigint").alias(c) for c in ("lo", "hi", "n")], *[F.lit(None).cast("bigint").alias(c) for c in ("least", "most", "total")]).limit(0)
    held = seen.select("user", "item").distinct().join(users.select("user").distinct(), "user", "left_semi").join(catalogue, "item")
    held = materialise(position_in_group(held, ["user"], [F.asc("place")], "j", size="m"), "held")

    def run(lo: Column, hi: Column, least: Column, most: Column, total: Column) -> list[Column]:
        return ["user", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), (hi - lo + 1).cast("bigint").alias("n"), least.alias("least"), most.alias("most"), total.cast("bigint").alias("total")]

    earlier = held.select("user", (F.col("j") + 1).alias("j"), F.col("place").alias("p"), F.col("next").alias("p_next"), F.col("upto").alias("p_upto"))
    inner = held.join(earlier, ["user", "j"], "left")
    start = F.coalesce(F.col("p") + 1, F.lit(0))
    below = inner.select(*run(start, F.col("place") - 1, F.coalesce("p_next", F.lit(first)), F.col("last"), F.col("before") - F.coalesce("p_upto", F.lit(0)))).where("n > 0")
    above = held.where(F.col("j") == F.col("m")).select(*run(F.col("place") + 1, F.lit(size - 1), F.col("next"), F.lit(end), F.lit(whole) - F.col("upto"))).where("n > 0")
    fresh = users.select("user").distinct().join(held.select("user").distinct(), "user", "left_anti")
    return below.unionByName(above).unionByName(fresh.select(*run(F.lit(0), F.lit(size - 1), F.lit(first), F.lit(end), F.lit(whole))))


def numbered(items: DataFrame) -> tuple[DataFrame, int]:
    """Catalogue with dense ids ``(item, idx)`` and its size."""
    catalogue = dense_index(items.select("item").distinct(), ["item"])
    return catalogue, catalogue.count()


def draw_unseen(users: DataFrame, seen: DataFrame, items: DataFrame, n: int, seed: int = 42, draws: int | None = None) -> DataFrame:
    """``n`` distinct random unseen items per user: ``(user, item, pick)``, pick from 1.

    Users whose draws did not give enough (they have seen nearly everything) get all their unseen items in
    md5 order instead, so nobody is short unless the catalogue is.
    """
    catalogue, n_items = numbered(items)
    draws = 2 * n + 16 if draws is None else draws
    pairs = seen.select("user", "item").distinct()
    tries = users.select("user", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("t")).withColumn(
        "idx", md5_int(F.lit(seed), "user", "t") % n_items
    )
    hits = tries.join(catalogue, "idx").join(pairs, ["user", "item"], "left_anti").groupBy("user", "item").agg(F.min("t").alias("t"))
    picks = materialise(top_k(hits, ["user"], [F.asc("t")], n, "pick").select("user", "item", "pick"), "draws")
    got = picks.groupBy("user").agg(F.count(F.lit(1)).alias("got"))
    known = pairs.join(catalogue, "item", "left_semi").groupBy("user").agg(F.count(F.lit(1)).alias("known"))
    short = (
        users.select("user")
        .join(got, "user", "left")
        .join(known, "user", "left")
        .filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(n), F.lit(n_items) - F.coalesce("known", F.lit(0))))
        .select("user")
    )
    if short.isEmpty():
        return picks
    rest = unseen(short, catalogue.select("item"), pairs.join(short, "user", "left_semi"), n_items)
    exact = top_k(rest, ["user"], [md5_key(F.lit(seed), "user", "item"), F.asc("item")], n, "pick")
    return picks.join(short, "user", "left_anti").unionByName(exact)


def random_negatives(train: DataFrame, test: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` items per user outside both parts."""
    both = train.select("user", "item").unionByName(test.select("user", "item"))
    return draw_unseen(train.select("user").distinct(), both, train.select("item").distinct(), n, seed).select("user", "item")


def candidate_mask(negatives: DataFrame, test: DataFrame) -> DataFrame:
    """Evaluation candidates: the negatives and the test items."""
    return negatives.select("user", "item").unionByName(test.select("user", "item")).distinct()


def first_unseen(
    rows: DataFrame,
    row_key: Sequence[str],
    owner: str,
    seen: DataFrame,
    catalogue: DataFrame,
    n_items: int,
    seed: int,
    tag: str,
    out: str = "negative",
    draws: int = 3,
    met: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Adds to each row a uniform item that its owner has not seen. ``seen`` is ``(owner, item)``, or ``met`` gives those of
    some distinct ``(owner, out)`` pairs that are seen.

    Every row draws once and is written with whether its owner has seen the item, so accepted rows move no more. Rejected
    ones draw again, ``draws`` times, then twice as often and so on; owners who have seen everything must be taken out before.
    """
    known = seen.select(F.col(owner), F.col("item").alias(out)).distinct() if met is None else None

    def tried(open_rows: DataFrame, tries: Column) -> DataFrame:
        idx = md5_int(F.lit(seed), F.lit(tag), *row_key, "_t") % n_items
        drawn = open_rows.withColumn("_t", tries).withColumn("idx", idx).join(catalogue.withColumnRenamed("item", out), "idx").drop("idx")
        hit = known
        if met is not None:
            drawn = materialise(drawn, "drawn")
            hit = met(drawn.select(owner, out).distinct())
        return drawn.join(hit.withColumn("_hit", F.lit(True)), [owner, out], "left")

    first = materialise(tried(rows, F.lit(0)).select(*rows.columns, out, "_hit"), "negatives")
    done, start = first.where("_hit IS NULL").drop("_hit"), 1
    open_rows = first.where("_hit").select(*rows.columns)
    while not open_rows.isEmpty():
        fresh = tried(open_rows, F.explode(F.sequence(F.lit(start), F.lit(start + draws - 1)))).where("_hit IS NULL")
        better = fresh.groupBy(*rows.columns).agg(F.min(F.struct("_t", out)).alias("_f")).select(*rows.columns, F.col(f"_f.{out}").alias(out))
        better = materialise(better, "negatives")
        done = done.unionByName(better)
        open_rows = materialise(open_rows.join(better.select(*row_key), list(row_key), "left_anti"), "redraw")
        start, draws = start + draws, draws * 2
    return done


class Sampler:
    """Profile positions and the numbered catalogue of a training part, written once for many samplers."""

    def __init__(self, train: DataFrame, seed: int = 42):
        self.seed = seed
        self.train = train
        self.catalogue, self.n_items = numbered(train)
        self.seen = train.select("user", "item")
        profile = position_in_group(train.select("user", "item", "rating"), ["user"], [F.asc("item")], "pos")
        self.profile = materialise(profile.withColumn("pos", F.col("pos") - 1), "profile")
        sizes = self.profile.groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < self.n_items)
        self.users = dense_index(sizes, ["user"], "u")
        self.n_users = self.users.count()

    def events(self, events: int) -> DataFrame:
        """(event, user, n): users drawn uniformly, those who have seen everything left out."""
        spark = self.train.sparkSession
        return (
            spark.range(events)
            .withColumnRenamed("id", "event")
            .withColumn("u", md5_int(F.lit(self.seed), F.lit("user"), "event") % self.n_users)
            .join(self.users, "u")
            .drop("u")
        )

    def positives(self, events: DataFrame) -> DataFrame:
        """(event, user, item, rating): a uniform profile item per event."""
        placed = events.withColumn("pos", (md5_int(F.lit(self.seed), F.lit("item"), "event") % F.col("n")).cast("int"))
        return placed.join(self.profile, ["user", "pos"]).select("event", "user", "item", "rating")

    def negatives(self, rows: DataFrame, row_key: Sequence[str], out: str = "negative") -> DataFrame:
        return first_unseen(rows, row_key, "user", self.seen, self.catalogue, self.n_items, self.seed, "neg", out)

    def pairwise(self, events: int) -> DataFrame:
        """(event, user, item, negative) with uniform user, positive and negative."""
        return self.negatives(self.positives(self.events(events)).drop("rating"), ["event"])

    def per_interaction(self) -> DataFrame:
        """(user, item, negative): one negative per training row."""
        rows = self.seen.distinct().join(self.users.select("user"), "user", "left_semi")
        return self.negatives(rows, ["user", "item"])

    def pointwise(self, events: int, ratio: int = 1, ratings: bool = False) -> DataFrame:
        """(event, user, item, label): positive with probability 1 / (1 + ratio). The label is 1 or 0, or the
        rating or 0."""
        drawn = self.events(events).withColumn("coin", md5_int(F.lit(self.seed), F.lit("coin"), "event") % (ratio + 1))
        good = self.positives(drawn.filter(F.col("coin") == 0))
        label = F.col("rating") if ratings else F.lit(1.0)
        bad = self.negatives(drawn.filter(F.col("coin") != 0).select("event", "user"), ["event"], "item")
        return good.select("event", "user", "item", label.alias("label")).unionByName(bad.withColumn("label", F.lit(0.0)))

    def positives_plus_negatives(self, m: int) -> DataFrame:
        """(user, item, label): every positive and ``m`` unseen items for each, repeats allowed."""
        rows = self.seen.distinct().join(self.users.select("user"), "user", "left_semi").withColumnRenamed("item", "of")
        rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(m))))
        bad = self.negatives(rows, ["user", "of", "draw"], "item").select("user", "item", F.lit(0.0).alias("label"))
        return self.seen.withColumn("label", F.lit(1.0)).unionByName(bad)

    def positives_plus_linear(self, m: int) -> DataFrame:
        """(user, item, label): every positive, and the set of ``m`` catalogue draws for each, seen or not."""
        rows = self.seen.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(m))))
        drawn = rows.select("user", (md5_int(F.lit(self.seed), F.lit("linear"), "user", "item", "draw") % self.n_items).alias("idx"))
        bad = drawn.join(self.catalogue, "idx").select("user", "item").distinct().withColumn("label", F.lit(0.0))
        return self.seen.withColumn("label", F.lit(1.0)).unionByName(bad)

    def zero_reconstruction(self, events: int, share_zero: float, share_mask: float) -> DataFrame:
        """(event, user, kind, item): for each drawn user the items reconstructed as zero ('zero') and the mask
        ('mask': own items and random unseen ones). Repeated draws count once."""
        base = self.events(events).select("event", "user")

        def drawn(share: float, kind: str) -> DataFrame:
            n = int(share * self.n_items)
            rows = base.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("kind", F.lit(kind))
            return self.negatives(rows, ["event", "kind", "draw"], "item").select("event", "user", "kind", "item").distinct()

        own = base.join(self.seen, "user").select("event", "user", F.lit("mask").alias("kind"), "item")
        return drawn(share_zero, "zero").unionByName(drawn(share_mask, "mask")).unionByName(own)

    def with_profile(self, rows: DataFrame) -> DataFrame:
        """Each sampled row with the user's profile row in long form (profile_item, profile_rating)."""
        profile = self.profile.select("user", F.col("item").alias("profile_item"), F.col("rating").alias("profile_rating"))
        return rows.join(profile, "user")

    def indicator_rows(self, rows: DataFrame, features: DataFrame) -> DataFrame:
        """(event, column): the set columns of user one-hot, item one-hot and item feature multi-hot, side by side."""
        users = dense_index(self.seen.select("user").distinct(), ["user"], "column")
        n_users = users.count()
        first_feature = n_users + self.n_items
        items = self.catalogue.select("item", (F.col("idx") + n_users).alias("column"))
        feats = features.select("item", (F.col("feature_id") + first_feature).alias("column"))
        return (
            rows.join(users, "user").select("event", "column")
            .unionByName(rows.join(items, "item").select("event", "column"))
            .unionByName(rows.join(feats, "item").select("event", "column"))
        )


def two_hop_neighbours(train: DataFrame, of: str = "user", hot_profile: int = 2000) -> DataFrame:
    """(i, j) users sharing an item, or items sharing a user, self left out."""
    other = "item" if of == "user" else "user"
    edges = train.select("user", "item").distinct()
    return pair_stats(edges, other, of, stats=["n"], hot_profile=hot_profile).select("i", "j")


def neighbourhood_samples(train: DataFrame, of: str = "item", seed: int = 42) -> DataFrame:
    """(id, neighbour, stranger): one random neighbour and one random non-neighbour; both 0 where an id has no
    neighbour or more than 80 % of the catalogue as neighbours. Neighbours are counted where they are combined and never
    written; whether a stranger is one is asked of the edges of the two."""
    other = "item" if of == "user" else "user"
    edges = train.select(F.col(of).alias("id"), F.col(other).alias("by")).distinct()
    catalogue, n = numbered(train.select(F.col(of).alias("item")))
    near = two_hop_neighbours(train, of)
    key = md5_key(F.lit(seed), F.lit("near"), "i", "j")
    picked = near.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key.alias("h"), F.col("j").alias("j"))).alias("p"))
    usable = picked.filter(F.col("n") / F.lit(float(n)) <= 0.8).select(F.col("i").alias("id"), F.col("p.j").alias("neighbour"))

    def met(pairs: DataFrame) -> DataFrame:
        """Pairs that share one of ``by``: the edges of id that stranger has too."""
        shared = pairs.where("id <> stranger").join(edges, "id").join(edges.withColumnRenamed("id", "stranger"), ["stranger", "by"], "left_semi")
        return shared.select("id", "stranger").distinct()

    usable = materialise(usable, "usable")
    full = first_unseen(usable, ["id"], "id", edges, catalogue, n, seed, "far", "stranger", met=met)
    ids = catalogue.select(F.col("item").alias("id"))
    return ids.join(full, "id", "left").select(
        "id", F.coalesce("neighbour", F.lit(0)).alias("neighbour"), F.coalesce("stranger", F.lit(0)).alias("stranger")
    )
