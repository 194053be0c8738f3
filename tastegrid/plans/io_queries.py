"""Queries on files: each writes a table derived from the data in the format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import clean as cl
from tastegrid.operators import graph as gr
from tastegrid.operators import sampling as ns
from tastegrid.operators import split as sp
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import longs, query
from tastegrid.plans.prepare_queries import _draw_sql
from tastegrid.session import fresh_path
from tastegrid.sources import files as io

_RATED = "user", "item", "rating", "ts"


def _text(df, spark, name):
    """Lines written as text files in the shared folder."""
    path = fresh_path(spark, name)
    df.write.text(path)
    return path


def _as_tsv(df, spark, name, header=False):
    path = fresh_path(spark, name)
    io.write_tsv(df, path, header)
    return path


@query("io01_read_interactions", "SELECT user, item, rating, ts FROM interactions")
def io01(spark, sf):
    return io.read_interactions(spark, _as_tsv(fx.interactions(spark, sf).select(*_RATED), spark, "io01"))


@query("io01_read_interactions_without_time", "SELECT user, item, rating FROM train")
def io01_no_ts(spark, sf):
    return io.read_interactions(spark, _as_tsv(fx.train(spark, sf).select("user", "item", "rating", F.lit(None).cast("long").alias("ts")), spark, "io01"))


@query("io02_read_fixed_split", "SELECT user, item, rating, ts, part FROM holdout")
def io02(spark, sf):
    paths = [_as_tsv(p.select(*_RATED), spark, "io02") for p in (fx.train(spark, sf), fx.test(spark, sf))]
    return io.read_fixed_split(spark, *paths)


def _nested(spark, sf):
    folds = sp.random_leave_n_out(fx.interactions(spark, sf), 2, 3)
    return sp.nested(folds, 0.2).withColumn("val_fold", F.lit(0))


_NESTED = """WITH f AS MATERIALIZED (SELECT user, item, rating, ts, f AS test_fold, row_number() OVER (PARTITION BY user, f ORDER BY md5(concat_ws('|', 42, f, user, item)), item) AS p FROM interactions, range(2) t(f)),
    tr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user, test_fold ORDER BY ts, item) AS q, count(*) OVER (PARTITION BY user, test_fold) AS n FROM f WHERE p > 3)
    SELECT user, item, rating, ts, test_fold::INTEGER AS test_fold, 0 AS val_fold, CASE WHEN q > floor(n * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS part FROM tr
    UNION ALL SELECT user, item, rating, ts, test_fold::INTEGER, 0, 'test' FROM f WHERE p <= 3"""


@query("io03_read_split_hierarchy", _NESTED)
def io03(spark, sf):
    path = fresh_path(spark, "io03")
    io.write_split_hierarchy(_nested(spark, sf).select(*_RATED, "test_fold", "val_fold", "part"), path)
    return io.read_split_hierarchy(spark, path)


@query("io03_read_nested_folders", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY ts, item) AS p, count(*) OVER (PARTITION BY user) AS n FROM train)
    SELECT user, item, rating, ts, 0 AS test_fold, 0 AS val_fold, CASE WHEN p > floor(n * (1 - 0.25::DOUBLE)) THEN 'val' ELSE 'train' END AS part FROM t
    UNION ALL SELECT user, item, rating, ts, 0, -1, 'test' FROM test""")
def io03_folders(spark, sf):
    root, split = fresh_path(spark, "io03n"), sp.nested(fx.holdout(spark, sf), 0.25)
    for part, folder in (("train", "0/0"), ("val", "0/0"), ("test", "0")):
        io.write_tsv(sp.part_of(split, part).select(*_RATED), f"{root}/{folder}/{part}.tsv")
    return io.read_nested_folders(spark, root).na.fill(-1, ["val_fold"])


@query("io04_write_split_hierarchy", f"SELECT test_fold, val_fold, part, count(*) AS rows, sum(rating) AS total FROM ({_NESTED}) GROUP BY ALL")
def io04(spark, sf):
    path = fresh_path(spark, "io04")
    io.write_split_hierarchy(_nested(spark, sf).select(*_RATED, "test_fold", "val_fold", "part"), path)
    return io.read_split_hierarchy(spark, path).groupBy("test_fold", "val_fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("rating").alias("total"))


_LABELLED = "SELECT user, item, CASE part WHEN 'train' THEN 0 ELSE 2 END AS x_label FROM holdout"


@query("io05_read_labelled", _LABELLED)
def io05(spark, sf):
    rows = fx.holdout(spark, sf).select(F.col("user").alias("userID"), "rating", F.col("item").alias("itemID"), F.when(F.col("part") == "train", 0).otherwise(2).alias("x_label"))
    return io.read_labelled(spark, _as_tsv(rows, spark, "io05", header=True))


@query("io06_write_labelled", f"{_LABELLED} UNION ALL SELECT user, item, 1 FROM rel")
def io06(spark, sf):
    path = fresh_path(spark, "io06")
    te = fx.test(spark, sf)
    io.write_labelled(fx.train(spark, sf), te.filter(F.col("rating") >= fx.THRESHOLD), te, path)
    return io.read_labelled(spark, path)


def _attribute_lines(spark, sf):
    """Lines item, features; every first feature is written twice."""
    lists = fx.attribute_ids(spark, sf).groupBy("item").agg(F.sort_array(F.collect_list("feature_id")).alias("f"))
    return lists.select(F.concat_ws("\t", F.col("item").cast("string"), F.array_join(F.col("f").cast("array<string>"), "\t"), F.col("f")[0].cast("string")))


@query("io07_read_attributes", "SELECT item, feature_id FROM attribute_ids")
def io07(spark, sf):
    return io.read_attributes(spark, _text(_attribute_lines(spark, sf), spark, "io07"))


@query("io08_read_onehot", "SELECT item, feature_id FROM attribute_ids")
def io08(spark, sf):
    att = fx.attribute_ids(spark, sf)
    width = att.agg(F.max("feature_id")).first()[0] + 1
    held = att.groupBy("item").agg(F.collect_set("feature_id").alias("f"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.array_contains("f", c.cast("long")).cast("int").cast("string"))
    return io.read_onehot(spark, _text(held.select(F.concat_ws("\t", F.col("item").cast("string"), F.array_join(cells, "\t"))), spark, "io08"))


@query("io09_read_triples", "SELECT s, p, o FROM triples")
def io09(spark, sf):
    return io.read_triples(spark, _as_tsv(fx.triples(spark, sf), spark, "io09"))


@query("io10_read_int_triples", "SELECT DISTINCT user AS s, 0::BIGINT AS p, item AS o FROM raw_ratings")
def io10(spark, sf):
    lines = fx.raw_ratings(spark, sf).select(F.concat_ws(" ", F.col("user").cast("string"), F.lit("0"), F.col("item").cast("string")))
    return io.read_int_triples(spark, _text(lines, spark, "io10"))


@query("io11_read_feature_chains", """SELECT p_partkey AS feature_id, p_brand || '|' || p_type || '|' || p_name AS chain FROM part""")
def io11(spark, sf):
    lines = fx.parts(spark, sf).select(F.concat(F.col("p_partkey").cast("string"), F.lit("\t<"), F.concat_ws("><", "p_brand", "p_type", "p_name"), F.lit(">")))
    return io.read_feature_chains(spark, _text(lines, spark, "io11")).withColumn("chain", F.array_join("chain", "|"))


@query("io12_read_properties", "SELECT p_name AS property FROM part WHERE p_size <> 7")
def io12(spark, sf):
    lines = fx.parts(spark, sf).select(F.when(F.col("p_size") == 7, F.concat(F.lit("#"), "p_name")).otherwise(F.col("p_name")))
    return io.read_properties(spark, _text(lines, spark, "io12"))


_DENSE = "ids AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM rel))"


def _dense(spark, sf):
    return cl.id_map(fx.test(spark, sf).filter(F.col("rating") >= fx.THRESHOLD), "item")


_NEAR = """near AS (SELECT src, dst, weight FROM (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.vec, b.vec), 9) AS weight,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id) AS r FROM visual a CROSS JOIN visual b) WHERE r <= 5)"""


@query("io13_read_neighbour_json", f"WITH {_DENSE}, {_NEAR} SELECT x.idx AS src, y.idx AS dst FROM near JOIN ids x ON x.item = src JOIN ids y ON y.item = dst")
def io13(spark, sf):
    lists = gr.knn_graph(fx.visual(spark, sf), 5).groupBy("src").agg(F.collect_list("dst").alias("d"))
    lines = lists.select(F.to_json(F.create_map(F.col("src").cast("string"), "d")))
    return io.read_neighbour_json(spark, _text(lines, spark, "io13"), _dense(spark, sf))


@query("io14_read_pair_json", f"WITH {_DENSE}, {_NEAR} SELECT x.idx AS src, y.idx AS dst, round(weight, 6) AS first, round(weight * 2, 6) AS second FROM near JOIN ids x ON x.item = src JOIN ids y ON y.item = dst")
def io14(spark, sf):
    edges = gr.knn_graph(fx.visual(spark, sf), 5)
    lines = edges.select(F.to_json(F.create_map(F.concat_ws("_", F.col("src").cast("string"), F.col("dst").cast("string")), F.array("weight", F.col("weight") * 2))))
    got = io.read_pair_json(spark, _text(lines, spark, "io14"), _dense(spark, sf))
    return got.select("src", "dst", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[1], 6).alias("second"))


@query("io15_read_embeddings", f"WITH {_DENSE} SELECT idx, item, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings JOIN ids ON item = vec_id")
def io15(spark, sf):
    got = io.read_embeddings(spark, f"{sf}/embeddings.parquet", _dense(spark, sf), "vec_id", "embedding")
    return longs(got.select("idx", "item", F.posexplode("vec").alias("dim", "value")), "dim").withColumn("value", F.col("value").cast("double"))


@query("io16_read_clusters", "SELECT item AS id, cluster FROM item_clusters")
def io16(spark, sf):
    return io.read_clusters(spark, _as_tsv(fx.item_clusters(spark, sf), spark, "io16"))


_RECS = "SELECT user, item, score, row_number() OVER (PARTITION BY user ORDER BY score DESC, item)::INTEGER AS rank FROM recs"


@query("io17_read_recs", _RECS)
def io17(spark, sf):
    return io.read_recs(spark, _as_tsv(fx.recs(spark, sf).select("user", "item", "score"), spark, "io17"))


@query("io17_read_rec_folder", f"WITH {_draw_sql('train', 20, 7)} SELECT 'popular' AS model, user, item, score FROM recs UNION ALL SELECT 'random', user, item, 1.0 FROM picks WHERE pick <= 20")
def io17_folder(spark, sf):
    root = fresh_path(spark, "io17")
    io.write_recs(fx.recs(spark, sf), f"{root}/popular.tsv")
    io.write_recs(fx.recs_random(spark, sf), f"{root}/random.tsv")
    return io.read_rec_folder(spark, root)


@query("io18_write_recs", "SELECT user, item, score FROM recs")
def io18(spark, sf):
    path = fresh_path(spark, "io18")
    io.write_recs(fx.recs(spark, sf), path)
    return io.read_recs(spark, path).drop("rank")


_NEGATIVES = _draw_sql("interactions", 10, 42)


@query("io19_read_fixed_negatives", f"WITH {_NEGATIVES} SELECT user, item FROM picks WHERE pick <= 10 AND item IN (SELECT item FROM rel)")
def io19(spark, sf):
    path = fresh_path(spark, "io19")
    io.write_negatives(ns.random_negatives(fx.train(spark, sf), fx.test(spark, sf), 10), path)
    return io.read_fixed_negatives(spark, path, fx.test(spark, sf).filter(F.col("rating") >= fx.THRESHOLD))


@query("io20_write_negatives", f"WITH {_NEGATIVES} SELECT '(' || user || ',)' || chr(9) || string_agg(item::VARCHAR, chr(9) ORDER BY item) AS line FROM picks WHERE pick <= 10 GROUP BY user")
def io20(spark, sf):
    path = fresh_path(spark, "io20")
    io.write_negatives(ns.random_negatives(fx.train(spark, sf), fx.test(spark, sf), 10), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("io22_write_topk_long", "SELECT user, rank::INTEGER AS rank, item FROM recs")
def io22(spark, sf):
    return io.topk_long(io.wide_topk(fx.recs(spark, sf), fx.TOP_K))


@query("io23_write_id_maps", """SELECT 'user' AS kind, user AS raw, row_number() OVER (ORDER BY user) - 1 AS idx FROM (SELECT DISTINCT user FROM interactions)
    UNION ALL SELECT 'item', item, row_number() OVER (ORDER BY item) - 1 FROM (SELECT DISTINCT item FROM interactions)""")
def io23(spark, sf):
    inter, root = fx.interactions(spark, sf), fresh_path(spark, "io23")
    io.write_id_maps(cl.id_map(inter, "user"), cl.id_map(inter, "item"), root)
    users, items = spark.read.parquet(f"{root}/users"), spark.read.parquet(f"{root}/items")
    return users.select(F.lit("user").alias("kind"), F.col("user").alias("raw"), "idx").unionByName(items.select(F.lit("item").alias("kind"), F.col("item").alias("raw"), "idx"))


@query("io24_read_word_tokens", "SELECT doc_id AS id, unnest(range(len(w)))::INTEGER AS pos, unnest(list_transform(w, lambda x: len(x))) AS token FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def io24(spark, sf):
    """Tokens are the lengths of the words of a document."""
    words = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    lines = fx.reviews(spark, sf).select(F.to_json(F.create_map(F.col("id").cast("string"), words)))
    return io.read_word_tokens(spark, _text(lines, spark, "io24"))


@query("io25_read_interaction_embeddings", "SELECT user, item, round(list_sum(vec), 6) AS total FROM train JOIN visual ON id = item")
def io25(spark, sf):
    rows = fx.train(spark, sf).withColumn("key", F.col("item"))
    got = io.read_interaction_embeddings(rows, fx.visual(spark, sf))
    return got.select("user", "item", (F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"))


@query("io26_read_triples_header", "SELECT s, p, o FROM triples")
def io26(spark, sf):
    return io.read_triples_header(spark, _as_tsv(fx.triples(spark, sf).toDF("subject", "predicate", "object"), spark, "io26", header=True))
