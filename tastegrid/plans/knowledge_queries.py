"""Queries on knowledge-graph triples."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tastegrid.operators import knowledge as kg
from tastegrid.operators import recommend as rc
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import query, rounded


@query("kg01_filter_properties", "SELECT s, p, o FROM triples WHERE p IN ('brand', 'nation')")
def kg01(spark, sf):
    return kg.filter_properties(fx.triples(spark, sf), ["brand", "nation"])


@query("kg01_filter_properties_drop", "SELECT s, p, o FROM triples WHERE p NOT IN ('supplier')")
def kg01_drop(spark, sf):
    return kg.filter_properties(fx.triples(spark, sf), ["supplier"], additive=False)


_CHAINS = """chains AS (SELECT DISTINCT feature_id, CASE left(feature, 1) WHEN 'b' THEN 'brand' WHEN 't' THEN 'type' ELSE 'size' END AS first
    FROM (SELECT item, feature, (dense_rank() OVER (ORDER BY feature) - 1)::BIGINT AS feature_id FROM attributes))"""


def _chains(spark, sf):
    first = F.element_at(F.create_map(*[F.lit(x) for x in ("b", "brand", "t", "type", "s", "size")]), F.substring("feature", 1, 1))
    names = fx.attributes(spark, sf).select("feature").distinct()
    ids = names.withColumn("feature_id", (F.row_number().over(Window.orderBy("feature")) - 1).cast("bigint"))
    return ids.select("feature_id", F.array(first, F.expr("substring(feature, 3)")).alias("chain"))


@query("kg02_select_features", f"""WITH {_CHAINS}, known AS (SELECT item, feature_id FROM attribute_ids JOIN chains USING (feature_id) WHERE first IN ('brand', 'size') AND item IN (SELECT item FROM rel))
    SELECT item, feature_id FROM known WHERE feature_id IN (SELECT feature_id FROM known GROUP BY feature_id HAVING count(*) > 35)""")
def kg02(spark, sf):
    items = fx.test(spark, sf).filter(F.col("rating") >= fx.THRESHOLD)
    return kg.select_features(fx.attribute_ids(spark, sf), _chains(spark, sf), items, ["brand", "size"], threshold=35)


@query("kg03_feature_occurrence", "SELECT s, p, o FROM (SELECT *, count(*) OVER (PARTITION BY p, o) AS n FROM triples) WHERE n > 75")
def kg03(spark, sf):
    return kg.feature_occurrence(fx.triples(spark, sf), 75)


@query("kg04_second_hop", """WITH j AS (SELECT a.s, a.p AS p1, a.o AS o1, b.p AS p2, b.o AS o2 FROM triples a JOIN triples b ON a.o = b.s)
    SELECT s, p1, o1, p2, o2 FROM (SELECT *, count(*) OVER (PARTITION BY p1, p2, o2) AS n FROM j) WHERE n > 2000""")
def kg04(spark, sf):
    t = fx.triples(spark, sf)
    return kg.second_hop(t, t, 2000)


@query("kg05_rare_share_filter", """WITH t AS (SELECT s, p, o FROM triples WHERE s LIKE 'part/%'), n AS (SELECT count(DISTINCT s) AS n FROM t)
    SELECT s, p, o FROM (SELECT *, count(*) OVER (PARTITION BY p, o) AS c FROM t), n WHERE 1 - c / n <= 0.97::DOUBLE""")
def kg05(spark, sf):
    t = fx.triples(spark, sf)
    return kg.rare_share_filter(t, 0.97, t.filter(F.col("s").startswith("part/")))


@query("kg06_reciprocal_triples", "SELECT s, p, o FROM triples UNION ALL SELECT o, 'inverse_' || p, s FROM triples")
def kg06(spark, sf):
    return kg.reciprocal_triples(fx.triples(spark, sf))


_INDEX = """ents AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT s AS name FROM triples UNION SELECT o FROM triples)),
    preds AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT p AS name FROM triples))"""


@query("kg07_index_entities", f"""WITH {_INDEX} SELECT a.idx AS s, b.idx AS p, c.idx AS o FROM triples t JOIN ents a ON a.name = t.s JOIN preds b ON b.name = t.p JOIN ents c ON c.name = t.o""")
def kg07(spark, sf):
    t = fx.triples(spark, sf)
    return kg.index_triples(t, kg.entity_index(t), kg.predicate_index(t))


@query("kg07_inverse_predicates", """WITH r AS (SELECT p AS name FROM triples UNION SELECT 'inverse_' || p FROM triples), preds AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM r),
    m AS (SELECT a.idx AS a, b.idx AS b FROM preds a JOIN preds b ON b.name = 'inverse_' || a.name) SELECT a AS idx, b AS inverse FROM m UNION ALL SELECT b, a FROM m""")
def kg07_inverse(spark, sf):
    return kg.inverse_predicates(kg.predicate_index(kg.reciprocal_triples(fx.triples(spark, sf))))


_ITEMS = "kitems AS (SELECT DISTINCT 'part/' || item AS item FROM rel)"


def _items(spark, sf):
    rel = fx.test(spark, sf).filter(F.col("rating") >= fx.THRESHOLD)
    return rel.select(F.concat(F.lit("part/"), F.col("item").cast("string")).alias("item")).distinct()


@query("kg08_filter_by_items", f"""WITH {_ITEMS}, beside AS (SELECT name FROM (SELECT s AS name FROM triples UNION SELECT o FROM triples) WHERE name NOT IN (SELECT item FROM kitems))
    SELECT s, p, o FROM triples WHERE s IN (SELECT item FROM kitems) AND (o IN (SELECT item FROM kitems) OR o IN (SELECT name FROM beside))""")
def kg08(spark, sf):
    t, items = fx.triples(spark, sf), _items(spark, sf)
    return kg.filter_by_items(t, items, kg.entities_beside(t, items))


@query("kg08_private_ids", f"""WITH {_ITEMS}, beside AS (SELECT name FROM (SELECT s AS name FROM triples UNION SELECT o FROM triples) WHERE name NOT IN (SELECT item FROM kitems))
    SELECT 'entity' AS kind, name, row_number() OVER (ORDER BY name) - 1 + (SELECT count(*) FROM kitems) AS idx FROM beside
    UNION ALL SELECT 'relation', name, row_number() OVER (ORDER BY name) FROM (SELECT DISTINCT p AS name FROM triples)""")
def kg08_ids(spark, sf):
    t, items = fx.triples(spark, sf), _items(spark, sf)
    entities, relations = kg.private_ids(items, kg.entities_beside(t, items), t)
    return entities.withColumn("kind", F.lit("entity")).unionByName(relations.withColumn("kind", F.lit("relation")))


@query("kg09_map_items_to_entities", f"""WITH {_INDEX} SELECT p_partkey AS item, coalesce(idx, -1) AS idx FROM part LEFT JOIN ents ON name = CASE WHEN p_size > 40 THEN 'unknown' ELSE 'part/' || p_partkey END""")
def kg09(spark, sf):
    name = F.when(F.col("p_size") > 40, F.lit("unknown")).otherwise(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")))
    items = fx.parts(spark, sf).select(F.col("p_partkey").alias("item"), name.alias("name"))
    return kg.map_items_to_entities(items, kg.entity_index(fx.triples(spark, sf)))


@query("kg10_kg_tfidf_profiles", """WITH f AS (SELECT replace(s, 'part/', '')::BIGINT AS item, p || '>' || o AS feature_id FROM triples WHERE s LIKE 'part/%'),
    idf AS (SELECT feature_id, ln((SELECT count(DISTINCT item) FROM f) / count(*)) AS idf FROM f GROUP BY feature_id),
    lens AS (SELECT item, sqrt(sum(idf * idf)) AS len FROM f JOIN idf USING (feature_id) GROUP BY item)
    SELECT user, feature_id, round(avg(idf / len), 6) AS weight FROM train JOIN f USING (item) JOIN idf USING (feature_id) JOIN lens USING (item) GROUP BY user, feature_id""")
def kg10(spark, sf):
    own = fx.triples(spark, sf).filter(F.col("s").startswith("part/"))
    feats = own.select(F.replace("s", F.lit("part/"), F.lit("")).cast("bigint").alias("item"), F.concat_ws(">", "p", "o").alias("feature_id"))
    return rounded(rc.tfidf_user_profile(fx.train(spark, sf), rc.tfidf_items(feats)), "weight")


_SUBJECT = f"""{_ITEMS}, known AS (SELECT s AS name FROM triples UNION SELECT o FROM triples), its AS (SELECT item FROM kitems WHERE item IN (SELECT name FROM known)),
    kept AS MATERIALIZED (SELECT s, p, o FROM triples WHERE s IN (SELECT item FROM its))"""


@query("kg11_filter_by_subject", f"WITH {_SUBJECT} SELECT s, p, o FROM kept")
def kg11(spark, sf):
    return kg.filter_by_subject(fx.triples(spark, sf), _items(spark, sf))[0]


@query("kg11_entities_beside", f"WITH {_SUBJECT} SELECT name FROM (SELECT s AS name FROM kept UNION SELECT o FROM kept) WHERE name NOT IN (SELECT item FROM its)")
def kg11_rest(spark, sf):
    return kg.filter_by_subject(fx.triples(spark, sf), _items(spark, sf))[2]


@query("kg12_merged_index", f"""WITH {_INDEX}, parts AS (SELECT CASE WHEN p IN ('brand', 'type') THEN 'train' WHEN p = 'supplier' THEN 'dev' ELSE 'test' END AS part, s, p, o FROM triples)
    SELECT part, a.idx AS s, b.idx AS p, c.idx AS o FROM parts t JOIN ents a ON a.name = t.s JOIN preds b ON b.name = t.p JOIN ents c ON c.name = t.o""")
def kg12(spark, sf):
    t = fx.triples(spark, sf)
    return kg.merged_index({
        "train": kg.filter_properties(t, ["brand", "type"]), "dev": kg.filter_properties(t, ["supplier"]), "test": kg.filter_properties(t, ["nation", "region"]),
    })
