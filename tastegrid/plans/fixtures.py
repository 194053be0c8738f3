"""Recommender-shaped views over the benchmark tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tastegrid.functions.ranking import top_k
from tastegrid.operators import split as sp
from tastegrid.operators import unpersonalised as un
from tastegrid.session import materialise

TOP_K = 20
THRESHOLD = 4.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def written(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A stage table that many queries of one session share, written once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialise(build(), name)
    return _WRITTEN[key]


def raw_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per purchased line: user, item, rating 1..5, day number, and the line's tie columns."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("item"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).cast("bigint").alias("ts"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").cast("bigint").alias("line"),
    )


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    return raw_ratings(spark, sf).groupBy("user", "item").agg(F.max("rating").alias("rating"), F.max("ts").alias("ts"))


def holdout(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "holdout", lambda: sp.temporal_holdout(materialise(interactions(spark, sf), "interactions"), 0.2))


def train(spark: SparkSession, sf: str) -> DataFrame:
    return sp.part_of(holdout(spark, sf), "train")


def test(spark: SparkSession, sf: str) -> DataFrame:
    return sp.part_of(holdout(spark, sf), "test")


def recs(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "recs", lambda: un.most_popular(train(spark, sf), TOP_K))


def recs_random(spark: SparkSession, sf: str) -> DataFrame:
    """A second model's lists: random unseen items."""
    return written(spark, sf, "recs_random", lambda: un.random_recs(train(spark, sf), TOP_K, seed=7))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """(item, feature) strings: brand, type and size."""
    return parts(spark, sf).select(
        F.col("p_partkey").alias("item"),
        F.explode(
            F.array(
                F.concat(F.lit("b:"), "p_brand"),
                F.concat(F.lit("t:"), "p_type"),
                F.concat(F.lit("s:"), F.col("p_size").cast("string")),
            )
        ).alias("feature"),
    )


def attribute_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(item, feature_id): the features numbered in string order (under a hundred of them)."""
    att = attributes(spark, sf)
    ids = att.select("feature").distinct().withColumn(
        "feature_id", (F.row_number().over(Window.orderBy("feature")) - 1).cast("bigint")
    )
    return att.join(ids, "feature").select("item", "feature_id")


def item_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(item, cluster) by part type, numbered from 0."""
    part = parts(spark, sf).select("p_partkey", "p_type")
    ids = part.select("p_type").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("p_type")) - 1).cast("bigint"))
    return part.join(ids, "p_type").select(F.col("p_partkey").alias("item"), "cluster")


def user_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(user, cluster) by market segment, numbered from 0."""
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    ids = cust.select("c_mktsegment").distinct().withColumn(
        "cluster", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("bigint")
    )
    return cust.join(ids, "c_mktsegment").select(F.col("c_custkey").alias("user"), "cluster")


def visual(spark: SparkSession, sf: str) -> DataFrame:
    """(id, vec): the embedding table as the first modality."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def textual(spark: SparkSession, sf: str) -> DataFrame:
    """(id, vec): a second modality, an element-wise bend of the first."""
    return visual(spark, sf).withColumn("vec", F.transform("vec", lambda x: x + x * x * F.lit(5.0)))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Knowledge graph (s, p, o): part to brand, type and supplier, supplier to nation, nation to region."""
    part = parts(spark, sf)
    sub = F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("s")
    brand = part.select(sub, F.lit("brand").alias("p"), F.col("p_brand").alias("o"))
    kind = part.select(sub, F.lit("type").alias("p"), F.col("p_type").alias("o"))
    supply = (
        table(spark, sf, "lineitem")
        .select("l_partkey", "l_suppkey")
        .distinct()
        .select(
            F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("s"),
            F.lit("supplier").alias("p"),
            F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("o"),
        )
    )
    nation = table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("s"),
        F.lit("nation").alias("p"),
        F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("o"),
    )
    region = table(spark, sf, "nation").select(
        F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("s"),
        F.lit("region").alias("p"),
        F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("o"),
    )
    return brand.unionByName(kind).unionByName(supply).unionByName(nation).unionByName(region)


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """(name, keywords): labelled keyword strings as a vision model would write them."""
    key = F.col("p_partkey")
    text = (
        F.when(
            F.col("p_size") > 45,
            F.concat(F.lit("[category] {"), "p_type", F.lit("} ,  [] {"), "p_brand", F.lit("},"), F.lit(" [Purpose]  {"), "p_name", F.lit("}..")),
        )
        .when(F.col("p_size") > 40, F.concat(F.lit("[Category] {"), "p_type", F.lit("/other, extra}, [Shape] {"), "p_brand", F.lit("}.")))
        .when(F.col("p_size") < 2, F.lit("  "))
        .otherwise(
            F.concat(F.lit("[Category] {"), "p_type", F.lit("}, [Pet Type] {"), "p_brand", F.lit("}, [Purpose] {"), "p_name", F.lit("}."))
        )
    )
    return parts(spark, sf).select(F.concat(F.lit("img"), key.cast("string"), F.lit(".jpg")).alias("name"), text.alias("keywords"))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """(item, title, brand, categories, description), some of them null by size."""
    return parts(spark, sf).select(
        F.col("p_partkey").alias("item"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("title"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_size") % 3 != 0, F.array("p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))).alias("categories"),
        F.when(F.col("p_size") % 4 != 0, F.concat("p_name", F.lit("\n"), F.lower("p_type"))).alias("description"),
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


# The same views in SQL: name -> definition. Other views may be named inside.
VIEWS: dict[str, str] = {
    "raw_ratings": """
        SELECT o_custkey AS user, l_partkey AS item, ceil(l_quantity / 10)::DOUBLE AS rating,
               date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS ts,
               l_orderkey AS orderkey, l_linenumber::BIGINT AS line
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "interactions": "SELECT user, item, max(rating) AS rating, max(ts) AS ts FROM raw_ratings GROUP BY user, item",
    "holdout": """
        SELECT user, item, rating, ts,
               CASE WHEN row_number() OVER (PARTITION BY user ORDER BY ts, item)
                         > floor(count(*) OVER (PARTITION BY user) * (1 - 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS part
        FROM interactions""",
    "train": "SELECT user, item, rating, ts FROM holdout WHERE part = 'train'",
    "test": "SELECT user, item, rating, ts FROM holdout WHERE part = 'test'",
    "pop": "SELECT item, count(DISTINCT user)::BIGINT AS pop FROM train GROUP BY item",
    "train_users": "SELECT user, count(DISTINCT item) AS n FROM train GROUP BY user",
    "recs": """
        SELECT user, item, score, rank FROM (
          SELECT u.user, p.item, p.pop::DOUBLE AS score,
                 row_number() OVER (PARTITION BY u.user ORDER BY p.pop DESC, p.item) AS rank
          FROM train_users u CROSS JOIN pop p
          WHERE u.n + 20 < (SELECT count(*) FROM pop)
            AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user = u.user AND t.item = p.item))
        WHERE rank <= 20""",
    "rel": "SELECT user, item, rating FROM test WHERE rating >= 4",
    "attributes": """
        SELECT p_partkey AS item, unnest(['b:' || p_brand, 't:' || p_type, 's:' || p_size::VARCHAR]) AS feature FROM part""",
    "attribute_ids": """
        SELECT item, (dense_rank() OVER (ORDER BY feature) - 1)::BIGINT AS feature_id FROM attributes""",
    "item_clusters": "SELECT p_partkey AS item, (dense_rank() OVER (ORDER BY p_type) - 1)::BIGINT AS cluster FROM part",
    "user_clusters": "SELECT c_custkey AS user, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS cluster FROM customer",
    "visual": "SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings",
    "textual": "SELECT id, list_transform(vec, lambda x: x + x * x * 5.0::DOUBLE) AS vec FROM visual",
    "visual_long": "SELECT id, unnest(range(len(vec))) AS dim, unnest(vec) AS value FROM visual",
    "textual_long": "SELECT id, unnest(range(len(vec))) AS dim, unnest(vec) AS value FROM textual",
    "triples": """
        SELECT 'part/' || p_partkey AS s, 'brand' AS p, p_brand AS o FROM part
        UNION ALL SELECT 'part/' || p_partkey, 'type', p_type FROM part
        UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier', 'supplier/' || l_suppkey FROM lineitem
        UNION ALL SELECT 'supplier/' || s_suppkey, 'nation', 'nation/' || s_nationkey FROM supplier
        UNION ALL SELECT 'nation/' || n_nationkey, 'region', 'region/' || n_regionkey FROM nation""",
    "keywords": """
        SELECT 'img' || p_partkey || '.jpg' AS name,
               CASE WHEN p_size > 45 THEN '[category] {' || p_type || '} ,  [] {' || p_brand || '}, [Purpose]  {' || p_name || '}..'
                    WHEN p_size > 40 THEN '[Category] {' || p_type || '/other, extra}, [Shape] {' || p_brand || '}.'
                    WHEN p_size < 2 THEN '  '
                    ELSE '[Category] {' || p_type || '}, [Pet Type] {' || p_brand || '}, [Purpose] {' || p_name || '}.' END AS keywords
        FROM part""",
    "metadata": """
        SELECT p_partkey AS item, CASE WHEN p_size % 5 <> 0 THEN p_name END AS title,
               CASE WHEN p_size % 7 <> 0 THEN p_brand END AS brand,
               CASE WHEN p_size % 3 <> 0 THEN [p_type, 'size ' || p_size] END AS categories,
               CASE WHEN p_size % 4 <> 0 THEN p_name || chr(10) || lower(p_type) END AS description
        FROM part""",
    "reviews": "SELECT doc_id AS id, text FROM documents",
}
_HEAVY = {"interactions", "holdout", "train", "test", "pop", "recs", "rel", "triples"}


def _named(text: str) -> list[str]:
    """Views named in a piece of SQL, quoted strings aside."""
    words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "''", text)))
    return [v for v in VIEWS if v in words]


@cache
def _needs(name: str) -> tuple[str, ...]:
    return tuple(v for v in _named(VIEWS[name]) if v != name)


def with_views(body: str) -> str:
    """Put the views that ``body`` names, and those they need, in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in _needs(name):
            visit(need)
        ordered.append(name)

    for view in _named(body):
        visit(view)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{v} AS {'MATERIALIZED ' if v in _HEAVY else ''}({VIEWS[v].strip()})" for v in ordered)
    body = body.strip()
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if match:
        return f"WITH {'RECURSIVE ' if match.group(1) else ''}{ctes},\n{body[match.end():]}"
    return f"WITH {ctes}\n{body}"
