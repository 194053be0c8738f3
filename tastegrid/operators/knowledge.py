"""Knowledge-graph triples ``(s, p, o)`` and feature selection over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.ranking import dense_index


def filter_properties(triples: DataFrame, properties: Sequence[str], additive: bool = True) -> DataFrame:
    """Keep (additive) or drop the listed predicates; an empty list changes nothing."""
    if not properties:
        return triples
    listed = F.col("p").isin(list(properties))
    return triples.filter(listed if additive else ~listed)


def _frequent(rows: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(keep).select(*keys)
    return rows.join(counts, list(keys), "left_semi")


def feature_occurrence(triples: DataFrame, threshold: int) -> DataFrame:
    """Triples whose (predicate, object) occurs more than ``threshold`` times."""
    return _frequent(triples, ["p", "o"], F.col("_n") > threshold)


def second_hop(triples: DataFrame, more: DataFrame, threshold: int) -> DataFrame:
    """(s, p1, o1, p2, o2): objects continued as subjects, (p1, p2, o2) occurring more than ``threshold`` times.

    The counts need no joined rows: each side is counted per shared object first, so a popular object adds one
    product per (p1, p2, o2), and only surviving features are joined out."""
    left = triples.select("s", F.col("p").alias("p1"), F.col("o").alias("o1"))
    right = more.select(F.col("s").alias("o1"), F.col("p").alias("p2"), F.col("o").alias("o2"))
    heads = left.groupBy("p1", "o1").agg(F.count(F.lit(1)).alias("c1"))
    tails = right.groupBy("o1", "p2", "o2").agg(F.count(F.lit(1)).alias("c2"))
    ways = heads.join(tails, "o1")
    counts = ways.groupBy("p1", "p2", "o2").agg(F.sum(F.col("c1") * F.col("c2")).alias("n"))
    kept = ways.join(counts.filter(F.col("n") > threshold), ["p1", "p2", "o2"], "left_semi").select("p1", "o1", "p2", "o2", "c2")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c2")))
    return left.join(kept, ["p1", "o1"]).select("s", "p1", "o1", "p2", "o2", copies.alias("_c")).drop("_c")


def rare_share_filter(triples: DataFrame, threshold: float, mapped: DataFrame | None = None) -> DataFrame:
    """Triples of mapped subjects whose (predicate, object) is missing from at most ``threshold`` of the subjects."""
    rows = triples if mapped is None else triples.join(mapped.select("s").distinct(), "s", "left_semi")
    subjects = rows.agg(F.countDistinct("s")).scalar()
    return _frequent(rows, ["p", "o"], 1 - F.col("_n") / subjects <= threshold)


def reciprocal_triples(triples: DataFrame) -> DataFrame:
    """The triples and their inverses."""
    back = triples.select(F.col("o").alias("s"), F.concat(F.lit("inverse_"), "p").alias("p"), F.col("s").alias("o"))
    return triples.select("s", "p", "o").unionByName(back)


def entity_index(triples: DataFrame) -> DataFrame:
    """(name, idx) of all subjects and objects in name order."""
    names = triples.select(F.explode(F.array("s", "o")).alias("name")).distinct()
    return dense_index(names, ["name"])


def predicate_index(triples: DataFrame) -> DataFrame:
    return dense_index(triples.select(F.col("p").alias("name")).distinct(), ["name"])


def index_triples(triples: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """Triples in dense ids; other columns stay."""
    rest = [c for c in triples.columns if c not in ("s", "p", "o")]
    for column, ids in (("s", entities), ("p", predicates), ("o", entities)):
        triples = triples.join(ids.select(F.col("name").alias(column), F.col("idx").alias(f"_{column}")), column)
    return triples.select(*[F.col(f"_{c}").alias(c) for c in ("s", "p", "o")], *rest)


def inverse_predicates(predicates: DataFrame) -> DataFrame:
    """(idx, inverse): dense ids of each predicate and its inverse, both ways."""
    named = predicates.select(F.concat(F.lit("inverse_"), "name").alias("name"), F.col("idx").alias("a"))
    pairs = named.join(predicates, "name").select("a", F.col("idx").alias("b"))
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("idx", "inverse")


def entities_beside(triples: DataFrame, items: DataFrame) -> DataFrame:
    """(name): entities that are no items."""
    names = triples.select(F.explode(F.array("s", "o")).alias("name")).distinct()
    return names.join(items.select(F.col("item").alias("name")), "name", "left_anti")


def filter_by_items(triples: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples with an item as head and an item or listed entity as tail."""
    heads = items.select(F.col("item").alias("s"))
    tails = items.select(F.col("item").alias("o")).unionByName(entities.select(F.col("name").alias("o"))).distinct()
    return triples.join(heads, "s", "left_semi").join(tails, "o", "left_semi").select("s", "p", "o")


def private_ids(items: DataFrame, entities: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, idx) of entities, counted on after the items, and of relations from 1."""
    n_items = items.select("item").distinct().count()
    return dense_index(entities.select("name"), ["name"], start=n_items), dense_index(triples.select(F.col("p").alias("name")).distinct(), ["name"], start=1)


def map_items_to_entities(items: DataFrame, entities: DataFrame) -> DataFrame:
    """(item, idx): dense entity id of the item's name, -1 where there is none. ``items`` is ``(item, name)``."""
    return items.join(entities, "name", "left").select("item", F.coalesce("idx", F.lit(-1)).alias("idx"))


def filter_by_subject(triples: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples with an item as subject; then the items among their entities, and the entities beside them."""
    known = triples.select(F.explode(F.array("s", "o")).alias("item")).distinct()
    items = items.select("item").distinct().join(known, "item", "left_semi")
    kept = triples.join(items.select(F.col("item").alias("s")), "s", "left_semi").select("s", "p", "o")
    left = kept.select(F.explode(F.array("s", "o")).alias("item")).distinct()
    return kept, items.join(left, "item", "left_semi"), entities_beside(kept, items)


def merged_index(sets: dict[str, DataFrame]) -> DataFrame:
    """(part, s, p, o) in dense ids over all the sets together."""
    whole = None
    for name, t in sets.items():
        rows = t.select(F.lit(name).alias("part"), "s", "p", "o")
        whole = rows if whole is None else whole.unionByName(rows)
    return index_triples(whole, entity_index(whole), predicate_index(whole))


def select_features(
    features: DataFrame, chains: DataFrame, items: DataFrame, properties: Sequence[str], additive: bool = True, threshold: int = 10
) -> DataFrame:
    """(item, feature_id) of known items: features whose chain starts with an allowed property and that occur more
    than ``threshold`` times. ``chains`` is ``(feature_id, chain)`` with an array; items left empty vanish."""
    known = features.join(items.select("item").distinct(), "item", "left_semi")
    if properties:
        listed = F.element_at("chain", 1).isin(list(properties))
        allowed = chains.filter(listed if additive else ~listed).select("feature_id")
        known = known.join(allowed, "feature_id", "left_semi")
    return _frequent(known, ["feature_id"], F.col("_n") > threshold).select("item", "feature_id")
