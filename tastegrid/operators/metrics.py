"""Evaluation of recommendation lists ``(user, item, score, rank)`` against test rows.

Everything per user comes from one frame keyed by (cutoff, user): hits are found by one join of the lists
with the relevant test rows, which is small, and are then summed per user for all cutoffs at once. Users
with lists but no hit stay in it with zeros. A metric is a column over that frame.

Lists are joined by merge: popular lists repeat the same items and lie in files far below the broadcast limit, however many
rows they have, and a broadcast of them would pass whole through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce
from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions.ranking import running_total, top_k
from tastegrid.functions.ratios import NAN, ratio
from tastegrid.functions.vectors import product_ranks
from tastegrid.operators.unpersonalised import item_popularity, short_head
from tastegrid.session import materialise, stored


def binary_relevance(test: DataFrame, threshold: float) -> DataFrame:
    return test.filter(F.col("rating") >= threshold)


def gain(threshold: float) -> Column:
    """Graded gain of a relevant rating: 2^(rating - threshold + 1) - 1."""
    return F.pow(F.lit(2.0), F.col("rating") - F.lit(threshold) + 1) - 1


def discounted_relevance(test: DataFrame, threshold: float) -> DataFrame:
    return binary_relevance(test, threshold).withColumn("gain", gain(threshold))


def log_discount(rank: str | Column) -> Column:
    """Discount of a rank counted from 1."""
    return F.lit(log(2.0)) / F.log((F.col(rank) if isinstance(rank, str) else rank) + 1)


def _lookup(values: Sequence[float], index: Column) -> Column:
    """values[index] for an index from 0."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int"))


def _ratio(a: Column, b: Column) -> Column:
    return ratio(a, b, 0.0)


class Evaluation:
    """Lists, test part and training part at one or more cutoffs."""

    def __init__(self, recs: DataFrame, test: DataFrame, train: DataFrame, cutoffs: int | Sequence[int], threshold: float = 0.0):
        self.full = recs.select("user", "item", "score", "rank")
        self.test, self.train, self.threshold = test, train, threshold
        self.cutoffs = [cutoffs] if isinstance(cutoffs, int) else sorted(cutoffs)
        self.k = self.cutoffs[-1]
        self.recs = self.full.filter(F.col("rank") <= self.k)
        self.rel = discounted_relevance(test, threshold).select("user", "item", "rating", "gain")
        self._discounts = [0.0]
        self._harmonics = [0.0]
        for r in range(1, self.k + 1):
            self._discounts.append(self._discounts[-1] + log(2.0) / log(r + 1.0))
            self._harmonics.append(self._harmonics[-1] + 1.0 / r)

    # --- shared frames ---

    @cached_property
    def all_hits(self) -> DataFrame:
        """Relevant rows of the full lists, with ``p``, the hit's place among the user's hits."""
        order = Window.partitionBy("user").orderBy("rank")
        return self.full.hint("merge").join(self.rel, ["user", "item"]).withColumn("p", F.row_number().over(order))

    @cached_property
    def hits(self) -> DataFrame:
        return self.all_hits.filter(F.col("rank") <= self.k)

    @cached_property
    def rel_counts(self) -> DataFrame:
        return self.rel.groupBy("user").agg(F.count(F.lit(1)).alias("n_rel"))

    @cached_property
    def list_lengths(self) -> DataFrame:
        """(user, n_recs) of the lists cut at the largest cutoff."""
        return self.recs.groupBy("user").agg(F.count(F.lit(1)).alias("n_recs")).hint("merge")

    @cached_property
    def gated(self) -> DataFrame:
        """Users with a list and at least one relevant test row: (user, n_recs, n_rel)."""
        return self.list_lengths.join(self.rel_counts, "user")

    def _cut(self, df: DataFrame) -> DataFrame:
        """One copy of each row per cutoff ``k`` that reaches its rank."""
        return df.withColumn("k", F.explode(F.array(*[F.lit(c) for c in self.cutoffs]))).filter(F.col("rank") <= F.col("k"))

    @cached_property
    def frame(self) -> DataFrame:
        """Per (k, user): list length, relevant rows and everything summed over hits."""
        disc, r, k = log_discount("rank"), F.col("rank"), F.col("k")
        sums = (
            self._cut(self.hits)
            .groupBy("k", "user")
            .agg(
                F.count(F.lit(1)).cast("double").alias("hits"),
                F.min("rank").alias("first"),
                F.sum(F.col("gain") * disc).alias("dcg"),
                F.sum(disc).alias("dcg_binary"),
                F.sum(_lookup(self._harmonics, k) - _lookup(self._harmonics, r - 1)).alias("precisions"),
                F.sum((k - r + 1).cast("double")).alias("recalls"),
            )
        )
        ideal = top_k(self.rel.select("user", "gain", "item"), ["user"], [F.desc("gain"), F.asc("item")], self.k)
        ideal = self._cut(ideal).groupBy("k", "user").agg(F.sum(F.col("gain") * disc).alias("idcg"))
        base = self.gated.withColumn("k", F.explode(F.array(*[F.lit(c) for c in self.cutoffs])))
        zero = {c: 0.0 for c in ("hits", "dcg", "dcg_binary", "precisions", "recalls")}
        return (
            base.join(sums, ["k", "user"], "left")
            .join(ideal, ["k", "user"], "left")
            .withColumn("n_recs", F.least("n_recs", "k"))
            .na.fill(zero)
        )

    # --- per-user metrics as columns of the frame ---

    def column(self, metric: str) -> Column:
        hits, k, n_rel = F.col("hits"), F.col("k"), F.col("n_rel")
        precision, recall = hits / k, hits / n_rel
        return {
            "Precision": precision,
            "Recall": recall,
            "HR": (hits > 0).cast("double"),
            "F1": _ratio(2 * precision * recall, precision + recall),
            "nDCG": _ratio(F.col("dcg"), F.col("idcg")),
            "nDCGRendle2020": F.col("dcg_binary") / _lookup(self._discounts, F.least(n_rel, k)),
            "MRR": F.coalesce(1.0 / F.col("first"), F.lit(0.0)),
            "MAP": F.col("precisions") / k,
            "MAR": F.col("recalls") / (k * n_rel),
            "NumRetrieved": F.col("n_recs").cast("double"),
        }[metric]

    def dsc(self, first: str = "Precision", second: str = "Recall", beta: float = 1.0) -> Column:
        """Weighted harmonic mean of two per-user metrics; beta 1 is the extended F1."""
        a, b, w = self.column(first), self.column(second), beta * beta
        return _ratio((1 + w) * a * b, w * a + b)

    def per_user(self, metrics: dict[str, Column] | Sequence[str]) -> DataFrame:
        """(k, user, <metrics>)."""
        if not isinstance(metrics, dict):
            metrics = {m: self.column(m) for m in metrics}
        return self.frame.select("k", "user", *[c.alias(m) for m, c in metrics.items()])

    def values(self, metrics: dict[str, Column] | Sequence[str]) -> DataFrame:
        """(k, <metrics>): means over users."""
        users = self.per_user(metrics)
        names = [c for c in users.columns if c not in ("k", "user")]
        return users.groupBy("k").agg(*[F.avg(c).alias(c) for c in names])

    # --- metrics over full lists ---

    @cached_property
    def auc_terms(self) -> DataFrame:
        """(user, rank, n_rel, term) per hit of the full lists: the share of the user's negatives ranked after it."""
        n_items = self.train.agg(F.countDistinct("item")).scalar()
        profiles = self.train.groupBy("user").agg(F.countDistinct("item").alias("n_train"))
        terms = self.all_hits.join(self.rel_counts, "user").join(profiles, "user", "left")
        negatives = n_items - F.coalesce("n_train", F.lit(0)) - F.col("n_rel") + 1
        return terms.select("user", "rank", "n_rel", ((negatives - (F.col("rank") - 1) + (F.col("p") - 1)) / negatives).alias("term"))

    def auc(self) -> DataFrame:
        """Mean over all hits of all users."""
        return self.auc_terms.agg(F.avg("term").alias("value"))

    def gauc(self) -> DataFrame:
        return self._grouped_auc(self.auc_terms, F.col("n_rel"))

    def lauc(self) -> DataFrame:
        return self._grouped_auc(self.auc_terms.filter(F.col("rank") <= self.k), F.least(F.col("n_rel"), F.lit(self.k)))

    def _grouped_auc(self, terms: DataFrame, size: Column) -> DataFrame:
        sums = terms.groupBy("user").agg(F.sum("term").alias("s"))
        users = self.gated.join(sums, "user", "left")
        return users.agg(F.avg(F.coalesce("s", F.lit(0.0)) / size).alias("value"))

    def _error_sums(self) -> DataFrame:
        err = F.col("score") - F.col("rating")
        sums = self.all_hits.groupBy("user").agg(F.sum(F.abs(err)).alias("abs"), F.sum(err * err).alias("sq"))
        return self.gated.join(sums, "user", "left").na.fill(0.0, ["abs", "sq"])

    def rating_errors(self) -> DataFrame:
        """One row MAE, MSE, RMSE over the relevant rows of all users; missing ones add nothing."""
        n_rel = self.rel.agg(F.count(F.lit(1))).scalar()
        total = self._error_sums().agg(F.sum("abs").alias("a"), F.sum("sq").alias("s"))
        return total.select((F.col("a") / n_rel).alias("MAE"), (F.col("s") / n_rel).alias("MSE"), F.sqrt(F.col("s") / n_rel).alias("RMSE"))

    def rating_errors_per_user(self) -> DataFrame:
        n = F.col("n_rel")
        return self._error_sums().select("user", (F.col("abs") / n).alias("MAE"), (F.col("sq") / n).alias("MSE"), F.sqrt(F.col("sq") / n).alias("RMSE"))

    # --- coverage ---

    def item_coverage(self) -> DataFrame:
        return self.recs.agg(F.countDistinct("item").alias("value"))

    def user_coverage(self) -> DataFrame:
        return self.list_lengths.agg(F.count(F.lit(1)).alias("value"))

    def user_coverage_at_n(self) -> DataFrame:
        return self.list_lengths.agg(F.count_if(F.col("n_recs") >= self.k).alias("value"))

    # --- diversity ---

    def gini(self, clusters: DataFrame | None = None) -> DataFrame:
        """Gini index of how often items are recommended, per user cluster if ``(user, cluster)`` is given.

        Items with the same count form a run of places whose terms sum in closed form, so only the distinct
        counts (about the square root of the list rows at most) are put in order.
        """
        n_items = self.train.agg(F.countDistinct("item")).scalar()
        recs = self.recs.hint("merge").join(clusters, "user") if clusters is not None else self.recs.withColumn("cluster", F.lit(0))
        levels = recs.groupBy("cluster", "item").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("m"))
        before = Window.partitionBy("cluster").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("cluster")
        m, start = F.col("m"), F.coalesce(F.sum("m").over(before), F.lit(0))
        runs = levels.withColumn("start", start).withColumn("n", F.sum("m").over(whole)).withColumn("total", F.sum(F.col("c") * m).over(whole))
        at = 2 * (m * F.col("start") + m * (m - 1) / 2) + m * (2 * (n_items - F.col("n") + 1) - n_items - 1)
        summed = runs.groupBy("cluster").agg(F.sum(at * F.col("c") / F.col("total")).alias("s"))
        out = summed.select("cluster", (1 - ratio(F.col("s"), n_items - 1, NAN)).alias("value"))
        return out if clusters is not None else out.select("value")

    def shannon_entropy(self) -> DataFrame:
        per_item = self.recs.join(self.list_lengths, "user").groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.col("n_recs")).alias("w"))
        total = self.recs.agg(F.count(F.lit(1))).scalar()
        users = self.list_lengths.agg(F.count(F.lit(1))).scalar()
        return per_item.agg((F.sum(F.col("w") * -F.log2(F.col("c") / total)) / users).alias("value"))

    def srecall(self, features: DataFrame) -> DataFrame:
        """Share of the training items' features found among a user's hits, averaged."""
        known = features.join(self.train.select("item").distinct(), "item", "left_semi").agg(F.countDistinct("feature_id")).scalar()
        found = self.hits.join(features, "item").groupBy("user").agg(F.countDistinct("feature_id").alias("f"))
        return self.gated.join(found, "user", "left").agg(F.avg(_ratio(F.coalesce("f", F.lit(0)), known)).alias("value"))

    # --- novelty and popularity ---

    @cached_property
    def popularity(self) -> DataFrame:
        return item_popularity(self.train)

    def _novelty(self, novelty: Column, unseen: Column, graded: bool) -> DataFrame:
        rel = F.col("gain") if graded else F.lit(1.0)
        scored = self.hits.join(self.popularity, "item", "left")
        worth = F.when(F.col("pop").isNull(), unseen).otherwise(novelty)
        sums = scored.groupBy("user").agg(F.sum(rel * log_discount("rank") * worth).alias("s"))
        users = self.gated.join(sums, "user", "left")
        return users.agg(F.avg(F.coalesce("s", F.lit(0.0)) / _lookup(self._discounts, F.col("n_recs"))).alias("value"))

    def epc(self, graded: bool = False) -> DataFrame:
        """Discounted popularity complement of the hits."""
        users = self.train.agg(F.countDistinct("user")).scalar()
        return self._novelty(1 - F.col("pop") / users, F.lit(1.0), graded)

    def efd(self, graded: bool = False) -> DataFrame:
        """Discounted self-information of the hits."""
        total = self.popularity.agg(F.sum("pop")).scalar()
        least = self.popularity.agg(F.min("pop")).scalar()
        return self._novelty(-F.log2(F.col("pop") / total), -F.log2(least / total), graded)

    def arp(self) -> DataFrame:
        """Mean popularity of the list, averaged over users."""
        lists = self.recs.join(self.popularity, "item", "left").groupBy("user").agg((F.sum(F.coalesce("pop", F.lit(0))) / F.count(F.lit(1))).alias("v"))
        return lists.agg(F.avg("v").alias("value"))

    @cached_property
    def _tail_flags(self) -> DataFrame:
        """(item, tail): 1 for long-tail items, 0 for the short head."""
        head = short_head(self.train).select("item", F.lit(0).alias("head"))
        return self.popularity.join(head, "item", "left").select("item", F.coalesce("head", F.lit(1)).alias("tail"))

    def _tail_counts(self) -> DataFrame:
        return (
            self.recs.join(self._tail_flags, "item", "left")
            .groupBy("user")
            .agg(F.sum(F.coalesce("tail", F.lit(0))).cast("double").alias("t"), F.count(F.lit(1)).alias("n"))
        )

    def aplt(self) -> DataFrame:
        return self._tail_counts().agg(F.avg(F.col("t") / F.col("n")).alias("value"))

    def aclt(self) -> DataFrame:
        return self._tail_counts().agg(F.avg("t").alias("value"))

    def clustered_aplt(self, clusters: DataFrame) -> DataFrame:
        return self._tail_counts().join(clusters, "user").groupBy("cluster").agg(F.avg(F.col("t") / F.col("n")).alias("value"))

    def clustered(self, metric: str, clusters: DataFrame) -> DataFrame:
        """A per-user metric averaged within each user cluster."""
        return self.per_user([metric]).join(clusters, "user").groupBy("cluster").agg(F.avg(metric).alias("value"))

    # --- opportunity and parity over item groups ---

    def reo(self, groups: DataFrame) -> DataFrame:
        """(group, value): recommended relevant over recommendable relevant rows of each item group."""
        owners = self.gated.select("user")
        num = self.hits.select("user", "item").distinct().join(groups, "item").groupBy("cluster").agg(F.count(F.lit(1)).alias("num"))
        open_rel = self.rel.join(owners, "user", "left_semi").join(self.train.select("user", "item"), ["user", "item"], "left_anti")
        den = open_rel.join(groups, "item").groupBy("cluster").agg(F.count(F.lit(1)).alias("den"))
        return den.join(num, "cluster", "left").select("cluster", (F.coalesce("num", F.lit(0)) / F.col("den")).alias("value"))

    def rsp(self, groups: DataFrame) -> DataFrame:
        """(group, value): recommended rows over recommendable rows of each item group. The latter are group size
        times users less the training rows inside the group, never a list of pairs."""
        users = self.list_lengths.agg(F.count(F.lit(1))).scalar()
        shown = self.recs.groupBy("item").agg(F.count(F.lit(1)).alias("c")).hint("merge")
        num = shown.join(groups, "item").groupBy("cluster").agg(F.sum("c").alias("num"))
        seen = self.train.select("user", "item").distinct().join(self.list_lengths, "user", "left_semi")
        seen = seen.join(groups, "item").groupBy("cluster").agg(F.count(F.lit(1)).alias("seen"))
        size = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
        joined = size.join(num, "cluster", "left").join(seen, "cluster", "left")
        den = F.col("size") * users - F.coalesce("seen", F.lit(0))
        return joined.select("cluster", ratio(F.coalesce("num", F.lit(0)), den, NAN).alias("value"))

    @staticmethod
    def spread(groups: DataFrame) -> DataFrame:
        """Population standard deviation over mean of the group values; NaN if all are 0."""
        return groups.agg(ratio(F.stddev_pop("value"), F.avg("value"), NAN).alias("value"))

    def popularity_groups(self, ratio: float = 0.8) -> DataFrame:
        """(item, cluster): short head 0, long tail 1."""
        head = short_head(self.train, ratio).select("item", F.lit(0).alias("h"))
        return self.popularity.join(head, "item", "left").select("item", F.coalesce("h", F.lit(1)).alias("cluster"))

    def pop_reo(self, ratio: float = 0.8) -> DataFrame:
        return self.spread(self.reo(self.popularity_groups(ratio)))

    def pop_rsp(self, ratio: float = 0.8) -> DataFrame:
        return self.spread(self.rsp(self.popularity_groups(ratio)))

    # --- differences between clusters ---

    @staticmethod
    def mean_difference(per_cluster: DataFrame) -> DataFrame:
        """Mean absolute difference over cluster pairs, from running counts over the distinct values in order; NaN for less
        than two clusters."""
        levels = per_cluster.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("m"))
        levels = materialise(levels, "levels")
        n = levels.agg(F.sum("m")).scalar()
        placed = running_total(levels, [F.asc("value")], "m", "cum")
        total = F.sum(F.col("value") * F.col("m") * (2 * F.col("cum_before") + F.col("m") - n))
        return placed.agg(ratio(total, F.max(n) * (F.max(n) - 1) / 2, NAN).alias("value"))

    def user_mad_rating(self, clusters: DataFrame) -> DataFrame:
        means = self.recs.join(self.gated, "user", "left_semi").groupBy("user").agg(F.avg("score").alias("v"))
        return self.mean_difference(means.join(clusters, "user").groupBy("cluster").agg(F.avg("v").alias("value")))

    def user_mad_ranking(self, clusters: DataFrame) -> DataFrame:
        return self.mean_difference(self.clustered("nDCG", clusters))

    def _item_mad(self, clusters: DataFrame, worth: Column) -> DataFrame:
        shown = self.recs.join(self.gated, "user", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("c"))
        won = self.hits.groupBy("item").agg(F.sum(worth).alias("g"))
        value = F.coalesce("g", F.lit(0.0)) / F.col("c")
        per_item = shown.join(won, "item", "left").select("item", value.alias("v"))
        return self.mean_difference(per_item.join(clusters, "item").groupBy("cluster").agg(F.avg("v").alias("value")))

    def item_mad_rating(self, clusters: DataFrame) -> DataFrame:
        return self._item_mad(clusters, F.col("score"))

    def item_mad_ranking(self, clusters: DataFrame) -> DataFrame:
        return self._item_mad(clusters, F.col("gain"))

    # --- bias disparity ---

    @staticmethod
    def _disparity(rows: DataFrame, users: DataFrame, items: DataFrame, out: str) -> DataFrame:
        """Every user group against every item category, both numbered from 0: the category's part of the group's rows over
        its part of the items. NaN for a group without rows or a category without items."""
        u, i = users.withColumnRenamed("cluster", "user_cluster"), items.withColumnRenamed("cluster", "item_cluster")
        counts = rows.hint("merge").join(u, "user").join(i, "item").groupBy("user_cluster", "item_cluster").agg(F.count(F.lit(1)).alias("c"))
        totals = counts.groupBy("user_cluster").agg(F.sum("c").alias("total"))
        share = i.groupBy("item_cluster").agg(F.count(F.lit(1)).alias("size"))
        n_items = items.agg(F.count(F.lit(1))).scalar()
        first = F.lit(0).cast("bigint")
        grid = u.agg(F.max("user_cluster").alias("groups"), F.lit(i.agg(F.max("item_cluster")).scalar()).alias("categories"))
        grid = grid.withColumn("user_cluster", F.explode(F.sequence(first, F.col("groups").cast("bigint")))).withColumn("item_cluster", F.explode(F.sequence(first, F.col("categories").cast("bigint"))))
        joined = grid.join(totals, "user_cluster", "left").join(share, "item_cluster", "left").join(counts, ["user_cluster", "item_cluster"], "left")
        value = ratio(ratio(F.coalesce("c", F.lit(0)), F.col("total"), NAN), F.col("size") / n_items, NAN)
        return joined.select("user_cluster", "item_cluster", value.alias(out))

    def bias_recommended(self, users: DataFrame, items: DataFrame) -> DataFrame:
        return self._disparity(self.recs, users, items, "value")

    def bias_source(self, users: DataFrame, items: DataFrame) -> DataFrame:
        return self._disparity(self.train.select("user", "item"), users, items, "value")

    def bias_disparity(self, users: DataFrame, items: DataFrame) -> DataFrame:
        keys = ["user_cluster", "item_cluster"]
        got = self.bias_recommended(users, items).withColumnRenamed("value", "br")
        source = self.bias_source(users, items).withColumnRenamed("value", "bs")
        return got.join(source, keys).select(*keys, ratio(F.col("br") - F.col("bs"), F.col("bs"), NAN).alias("value"))

    # --- curves over all n up to the cutoff ---

    @cached_property
    def _hit_table(self) -> DataFrame:
        """Hits counted by (rank, place among hits, relevant rows capped at K): at most K^3 rows for any data."""
        return (
            self.hits.join(self.rel_counts, "user")
            .groupBy("rank", "p", F.least("n_rel", F.lit(self.k)).alias("m"))
            .agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum(1 / F.col("n_rel")).alias("share"))
        )

    def curves(self) -> DataFrame:
        """(n, recall, recall2, hr, precision, ndcg, map) for n = 1..K, means over users."""
        users = self.gated.agg(F.count(F.lit(1))).scalar()
        total = self.gated.agg(F.sum("n_rel")).scalar()
        n, r, m = F.col("n"), F.col("rank"), F.least("m", "n")
        reach = self._hit_table.withColumn("n", F.explode(F.sequence(r, F.lit(self.k))))
        summed = reach.groupBy("n").agg(
            F.sum("share").alias("recall"),
            F.sum("c").alias("all"),
            F.sum(F.when(F.col("p") == 1, F.col("c")).otherwise(0.0)).alias("first"),
            F.sum(F.col("c") * log_discount("rank") / _lookup(self._discounts, m)).alias("ndcg"),
            F.sum(F.col("c") * F.col("p") / r / m).alias("ap"),
        )
        every = self.train.sparkSession.range(1, self.k + 1).select(F.col("id").cast("int").alias("n"))
        return (
            every.join(summed, "n", "left")
            .na.fill(0.0)
            .select(
                "n",
                (F.col("recall") / users).alias("recall"),
                (F.col("all") / total).alias("recall2"),
                (F.col("first") / users).alias("hr"),
                (F.col("all") / n / users).alias("precision"),
                (F.col("ndcg") / users).alias("ndcg"),
                (F.col("ap") / users).alias("map"),
            )
        )


def eval_error(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean squared error of predicted scores on the truth rows."""
    both = predictions.hint("merge").join(truth.select("user", "item", "rating"), ["user", "item"])
    return both.agg(F.avg(F.pow(F.col("score") - F.col("rating"), 2)).alias("value"))


# Metrics of the per-user frame, at every cutoff in one pass.
SIMPLE = ["Precision", "Recall", "HR", "F1", "nDCG", "nDCGRendle2020", "MRR", "MAP", "MAR", "NumRetrieved"]
# One value of the whole lists at a cutoff.
WHOLE = {
    "DSC": lambda ev, x: ev.values({"value": ev.dsc("Precision", "Recall", 1.0)}),
    "ExtendedF1": lambda ev, x: ev.values({"value": ev.dsc("nDCG", "MRR", 1.0)}),
    "AUC": lambda ev, x: ev.auc(),
    "GAUC": lambda ev, x: ev.gauc(),
    "LAUC": lambda ev, x: ev.lauc(),
    "MAE": lambda ev, x: ev.rating_errors().select(F.col("MAE").alias("value")),
    "MSE": lambda ev, x: ev.rating_errors().select(F.col("MSE").alias("value")),
    "RMSE": lambda ev, x: ev.rating_errors().select(F.col("RMSE").alias("value")),
    "ItemCoverage": lambda ev, x: ev.item_coverage(),
    "UserCoverage": lambda ev, x: ev.user_coverage(),
    "UserCoverageAtN": lambda ev, x: ev.user_coverage_at_n(),
    "Gini": lambda ev, x: ev.gini(),
    "SEntropy": lambda ev, x: ev.shannon_entropy(),
    "EPC": lambda ev, x: ev.epc(),
    "ExtendedEPC": lambda ev, x: ev.epc(graded=True),
    "EFD": lambda ev, x: ev.efd(),
    "ExtendedEFD": lambda ev, x: ev.efd(graded=True),
    "ARP": lambda ev, x: ev.arp(),
    "APLT": lambda ev, x: ev.aplt(),
    "ACLT": lambda ev, x: ev.aclt(),
    "PopREO": lambda ev, x: ev.pop_reo(),
    "PopRSP": lambda ev, x: ev.pop_rsp(),
    "ExtendedPopREO": lambda ev, x: ev.pop_reo(x.get("pop_ratio", 0.8)),
    "ExtendedPopRSP": lambda ev, x: ev.pop_rsp(x.get("pop_ratio", 0.8)),
    "SRecall": lambda ev, x: ev.srecall(x["features"]),
    "UserMADrating": lambda ev, x: ev.user_mad_rating(x["user_clusters"]),
    "UserMADranking": lambda ev, x: ev.user_mad_ranking(x["user_clusters"]),
    "ItemMADrating": lambda ev, x: ev.item_mad_rating(x["item_clusters"]),
    "ItemMADranking": lambda ev, x: ev.item_mad_ranking(x["item_clusters"]),
    "REO": lambda ev, x: ev.spread(ev.reo(x["item_clusters"])),
    "RSP": lambda ev, x: ev.spread(ev.rsp(x["item_clusters"])),
}
# A value for each group.
GROUPED = {
    "clustered_nDCG": lambda ev, x: ev.clustered("nDCG", x["user_clusters"]),
    "clustered_Recall": lambda ev, x: ev.clustered("Recall", x["user_clusters"]),
    "clustered_APLT": lambda ev, x: ev.clustered_aplt(x["user_clusters"]),
    "clustered_GiniIndex": lambda ev, x: ev.gini(x["user_clusters"]),
    "BiasDisparityBR": lambda ev, x: ev.bias_recommended(x["user_clusters"], x["item_clusters"]),
    "BiasDisparityBS": lambda ev, x: ev.bias_source(x["user_clusters"], x["item_clusters"]),
    "BiasDisparityBD": lambda ev, x: ev.bias_disparity(x["user_clusters"], x["item_clusters"]),
}
REGISTRY = [*SIMPLE, *WHOLE, *GROUPED]


def known_metrics(names: Sequence[str]) -> list[str]:
    """The registry's spelling of the names, whose case does not matter; names it does not have are left out."""
    by_lower = {m.lower(): m for m in REGISTRY}
    return [by_lower[n.lower()] for n in names if n.lower() in by_lower]


def evaluate(
    recs: DataFrame,
    test: DataFrame,
    train: DataFrame,
    cutoffs: Sequence[int],
    metrics: Sequence[str],
    threshold: float = 0.0,
    val: DataFrame | None = None,
    val_recs: DataFrame | None = None,
    **inputs,
) -> DataFrame:
    """(part, k, metric, value) for any metrics of :data:`REGISTRY` at all cutoffs; without a validation part its rows
    repeat the test's.

    ``inputs`` are what some metrics need: ``features(item, feature_id)``, ``user_clusters(user, cluster)``,
    ``item_clusters(item, cluster)``, ``pop_ratio``; a missing one is a ``KeyError``. A metric with a value per group has
    the group in its name: ``clustered_nDCG[2]``, ``BiasDisparityBR[1,0]``.
    """
    names = known_metrics(metrics)
    simple = [n for n in names if n in SIMPLE]

    def long(lists: DataFrame, truth: DataFrame) -> DataFrame:
        parts = [Evaluation(lists, truth, train, cutoffs, threshold).values(simple).unpivot(["k"], simple, "metric", "value")] if simple else []
        for k in cutoffs:
            ev = Evaluation(lists, truth, train, k, threshold)
            for n in names:
                if n in WHOLE:
                    parts.append(WHOLE[n](ev, inputs).select(F.lit(k).alias("k"), F.lit(n).alias("metric"), F.col("value").cast("double")))
                elif n in GROUPED:
                    found = GROUPED[n](ev, inputs)
                    group = F.concat_ws(",", *[F.col(c).cast("string") for c in found.columns if c != "value"])
                    parts.append(found.select(F.lit(k).alias("k"), F.concat(F.lit(f"{n}["), group, F.lit("]")).alias("metric"), F.col("value").cast("double")))
        return reduce(DataFrame.unionByName, parts)

    tested = long(recs, test)
    if val is None:
        return tested.withColumn("part", F.explode(F.array(F.lit("test"), F.lit("val"))))
    checked = long(recs if val_recs is None else val_recs, val)
    return tested.withColumn("part", F.lit("test")).unionByName(checked.withColumn("part", F.lit("val")))


# --- metrics over the whole catalogue -------------------------------------------------------------------


def catalogue_ranks(users: DataFrame, items: DataFrame, test: DataFrame, train: DataFrame) -> DataFrame:
    """``(user, item, score, rank)`` of the test rows alone, ranked among all training items that their user has not seen, for
    vectors ``(id, vec)`` of users and items. The lists themselves are never made."""
    known = train.select(F.col("item").alias("id")).distinct()
    seen = train.select(F.col("user").alias("i"), F.col("item").alias("j"))
    wanted = test.select(F.col("user").alias("i"), F.col("item").alias("j"))
    return product_ranks(users, items.join(known, "id", "left_semi"), wanted, seen).select(
        F.col("i").alias("user"), F.col("j").alias("item"), "score", "rank"
    )


def catalogue_metrics(users: DataFrame, items: DataFrame, test: DataFrame, train: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """One row ``AUC, GAUC, LAUC, MAE, MSE, RMSE`` of lists that hold every unseen training item of every user with a vector."""
    users, items = stored(users, "users"), stored(items, "items")  # read several times, and what makes them may be large
    relevant = binary_relevance(test, threshold)
    ev = Evaluation(materialise(catalogue_ranks(users, items, relevant, train), "ranks"), test, train, k, threshold)
    n = items.join(train.select(F.col("item").alias("id")).distinct(), "id", "left_semi").agg(F.count(F.lit(1))).scalar()
    own = train.join(items.select(F.col("id").alias("item")), "item", "left_semi").groupBy("user").agg(F.countDistinct("item").alias("n"))
    lengths = users.select(F.col("id").alias("user")).join(own, "user", "left").select("user", (n - F.coalesce("n", F.lit(0))).alias("n"))
    ev.list_lengths = lengths.where("n > 0").select("user", F.least("n", F.lit(k)).alias("n_recs"))
    ev.gated, ev.auc_terms = materialise(ev.gated, "gated"), materialise(ev.auc_terms, "terms")
    out = ev.auc().withColumnRenamed("value", "AUC")
    for name, value in (("GAUC", ev.gauc()), ("LAUC", ev.lauc())):
        out = out.withColumn(name, value.scalar())
    errors = materialise(ev.rating_errors(), "errors")
    return out.withColumns({c: errors.select(c).scalar() for c in errors.columns})
