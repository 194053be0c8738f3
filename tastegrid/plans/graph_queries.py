"""Queries on graphs, propagation and multimodal features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.functions.vectors import explode_vector, mean_vector
from tastegrid.operators import features as ft
from tastegrid.operators import graph as gr
from tastegrid.operators import recommend as rc
from tastegrid.operators import similarity as si
from tastegrid.operators.clean import id_map
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import longs, query, rounded
from tastegrid.plans.recommend_queries import _full_top

DIM = 64


def _r(df):
    return df.select("src", "dst", F.round("weight", 9).alias("weight"))


_E = "1e-7::DOUBLE"
_ADJ = f"""pairs AS (SELECT DISTINCT user, item FROM train), du AS (SELECT user, count(*) AS d FROM pairs GROUP BY user),
    di AS (SELECT item, count(*) AS d FROM pairs GROUP BY item),
    normed AS MATERIALIZED (SELECT user * 2 AS src, item * 2 + 1 AS dst, (du.d + {_E}) ** -0.5::DOUBLE * (di.d + {_E}) ** -0.5::DOUBLE AS weight
      FROM pairs JOIN du USING (user) JOIN di USING (item)),
    adj AS MATERIALIZED (SELECT src, dst, weight FROM normed UNION ALL SELECT dst, src, weight FROM normed)"""
_OUT = "SELECT src, dst, round(weight, 9) AS weight FROM"


@query("gr01_norm_adjacency", f"WITH {_ADJ} {_OUT} adj")
def gr01(spark, sf):
    return _r(gr.norm_adjacency(fx.train(spark, sf)))


@query("gr02_edge_norm", f"WITH {_ADJ} {_OUT} normed")
def gr02(spark, sf):
    return _r(gr.edge_norm(gr.interaction_edges(fx.train(spark, sf))))


def _sims(modality: str) -> str:
    """All-pairs cosines of a modality."""
    m = modality[0]
    return f"""{m}sim AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.vec, b.vec), 9) AS weight FROM {modality} a CROSS JOIN {modality} b)"""


def _knn(modality: str, k: int) -> str:
    m = modality[0]
    return f"""{_sims(modality)}, {m}knn AS MATERIALIZED (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM {m}sim) WHERE rank <= {k})"""


def _laplace(source: str, out: str, masked: bool = False) -> str:
    w = "CASE WHEN weight + 1e-6 > 1.0 THEN 0.0::DOUBLE ELSE weight END" if masked else "weight"
    value = f"CASE WHEN a.d > 0 THEN a.d ** -0.5::DOUBLE ELSE 0 END * {w} * CASE WHEN b.d > 0 THEN b.d ** -0.5::DOUBLE ELSE 0 END"
    return f"""{out}_d AS MATERIALIZED (SELECT src AS node, sum(weight) AS d FROM {source} GROUP BY src),
      {out} AS MATERIALIZED (SELECT src, dst, {f'greatest({value}, 1e-7)' if masked else value} AS weight FROM {source} JOIN {out}_d a ON a.node = src LEFT JOIN {out}_d b ON b.node = dst)"""


def _lap(name: str, mode: str, masked: bool, sql: str):
    @query(name, sql)
    def run(spark, sf):
        return _r(gr.laplacian(gr.knn_graph(fx.visual(spark, sf), 10), mode, masked))


_lap("gr03_laplacian_sym", "sym", False, f"WITH {_knn('visual', 10)}, {_laplace('vknn', 'l')} {_OUT} l")
_lap("gr03_laplacian_masked", "sym", True, f"WITH {_knn('visual', 10)}, {_laplace('vknn', 'l', True)} {_OUT} l")
_lap("gr03_laplacian_rw", "rw", False, f"WITH {_knn('visual', 10)}, d AS (SELECT src, sum(weight) AS d FROM vknn GROUP BY src), l AS (SELECT src, dst, weight / d AS weight FROM vknn JOIN d USING (src)) {_OUT} l")


@query("gr04_cosine_matrix", f"WITH {_sims('visual')} {_OUT} vsim")
def gr04(spark, sf):
    return _r(gr.cosine_matrix(fx.visual(spark, sf)))


@query("gr04_cosine_at_least", f"WITH {_sims('visual')} {_OUT} vsim WHERE weight >= 0.3")
def gr04_at_least(spark, sf):
    return _r(gr.cosine_edges(fx.visual(spark, sf), 0.3))


@query("gr05_knn_graph_pruned", f"WITH {_knn('visual', 10)} {_OUT} vknn")
def gr05_pruned(spark, sf):
    return _r(gr.knn_graph_pruned(fx.visual(spark, sf), 10))


@query("gr05_knn_graph", f"WITH {_knn('visual', 10)} {_OUT} vknn")
def gr05(spark, sf):
    return _r(gr.knn_graph(fx.visual(spark, sf), 10))


def _unit(source: str, out: str) -> str:
    return f"""{out}_n AS (SELECT src AS node, count(*) AS d FROM {source} GROUP BY src),
      {out} AS MATERIALIZED (SELECT src, dst, (a.d + {_E}) ** -0.5::DOUBLE * (coalesce(b.d, 0) + {_E}) ** -0.5::DOUBLE AS weight FROM {source} JOIN {out}_n a ON a.node = src LEFT JOIN {out}_n b ON b.node = dst)"""


@query("gr06_knn_graph_unweighted", f"WITH {_knn('visual', 10)}, {_unit('vknn', 'g')} {_OUT} g")
def gr06(spark, sf):
    return _r(gr.knn_graph_unweighted(fx.visual(spark, sf), 10))


def _two(spark, sf, k=10):
    return gr.knn_graph(fx.visual(spark, sf), k), gr.knn_graph(fx.textual(spark, sf), k)


_TWO = f"{_knn('visual', 10)}, {_knn('textual', 10)}"
_FUSED = """fused AS MATERIALIZED (SELECT coalesce(v.src, t.src) AS src, coalesce(v.dst, t.dst) AS dst, 0.3::DOUBLE * coalesce(v.weight, 0) + (1 - 0.3::DOUBLE) * coalesce(t.weight, 0) AS weight
    FROM vknn v FULL JOIN tknn t ON v.src = t.src AND v.dst = t.dst)"""


@query("gr07_fused_graph", f"WITH {_TWO}, {_FUSED} SELECT src, dst, round(weight, 12) AS weight FROM fused")
def gr07(spark, sf):
    return gr.fused_graph(*_two(spark, sf), 0.3).withColumn("weight", F.round("weight", 12))


@query("gr08_max_pool_graph", f"""WITH {_TWO}, g AS (SELECT coalesce(v.src, t.src) AS src, coalesce(v.dst, t.dst) AS dst, greatest(v.weight, t.weight) AS weight
    FROM vknn v FULL JOIN tknn t ON v.src = t.src AND v.dst = t.dst) {_OUT} g""")
def gr08(spark, sf):
    return _r(gr.max_pool_graph(*_two(spark, sf)))


@query("gr09_mean_masked_knn", f"""WITH {_sims('visual')}, {_sims('textual')},
    means AS (SELECT (SELECT avg(weight) FROM vsim) AS mv, (SELECT avg(weight) FROM tsim) AS mt),
    both_ok AS (SELECT v.src, v.dst, v.weight AS wv, t.weight AS wt FROM vsim v JOIN tsim t USING (src, dst), means WHERE v.weight >= mv AND t.weight >= mt),
    a AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY wv DESC, dst) AS r FROM both_ok) WHERE r <= 8),
    b AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY wt DESC, dst) AS r FROM both_ok) WHERE r <= 8),
    {_unit('a', 'ga')}, {_unit('b', 'gb')}
    SELECT 'visual' AS modality, src, dst, round(weight, 9) AS weight FROM ga UNION ALL SELECT 'textual', src, dst, round(weight, 9) FROM gb""")
def gr09(spark, sf):
    a, b = gr.mean_masked_knn(fx.visual(spark, sf), fx.textual(spark, sf), 8, DIM, DIM)
    return _r(a).withColumn("modality", F.lit("visual")).unionByName(_r(b).withColumn("modality", F.lit("textual")))


@query("gr10_content_knn_scores", f"""WITH lens AS (SELECT id, vec, sqrt(list_dot_product(vec, vec)) AS l FROM visual),
    s AS (SELECT a.id AS i, b.id AS j, round(list_dot_product(a.vec, b.vec) / (a.l * b.l + 1.0), 9) AS sim FROM lens a CROSS JOIN lens b),
    near AS (SELECT i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM s) WHERE r <= 10),
    scores AS (SELECT t.user, n.j AS item, sum(n.sim) AS score FROM (SELECT DISTINCT user, item FROM train) t JOIN near n ON n.i = t.item GROUP BY ALL) {_full_top(20, items="SELECT id AS item FROM visual")}""")
def gr10(spark, sf):
    tr = fx.train(spark, sf)
    items = fx.visual(spark, sf)
    return rc.full_top_k_unseen(gr.content_knn_scores(tr, items, 10, 1.0), tr, 20, items=items.withColumnRenamed("id", "item"))


_COOC = """cooc AS MATERIALIZED (SELECT src, dst, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM (
      SELECT a.user AS src, b.user AS dst, count(*)::DOUBLE AS weight FROM train a JOIN train b ON a.item = b.item AND a.user <> b.user GROUP BY ALL)) WHERE rank <= 200)"""


@query("gr11_user_cooccurrence", f"WITH {_COOC} SELECT src, dst, weight, rank::INTEGER AS rank FROM cooc")
def gr11(spark, sf):
    return gr.user_cooccurrence(fx.train(spark, sf), 200)


def _sampled(mode: str, weight: str):
    @query(f"gr12_sample_neighbours_{mode}", f"""WITH {_COOC}, low AS (SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY rank) AS rank FROM cooc WHERE weight >= 4),
        firsts AS (SELECT * FROM low WHERE rank <= 10), n AS (SELECT src, count(*) AS n FROM firsts GROUP BY src),
        slots AS (SELECT src, slot, CASE WHEN slot <= n THEN slot ELSE ('0x' || substr(md5(concat_ws('|', 42, src, slot)), 1, 8))::BIGINT % n + 1 END AS rank FROM n, range(1, 11) t(slot)),
        picked AS (SELECT src, slot, dst, weight FROM slots JOIN firsts USING (src, rank))
        SELECT src, slot::INTEGER AS slot, dst, round({weight}, 9) AS weight FROM picked
        UNION ALL SELECT user, slot::INTEGER, (SELECT min(user) FROM train_users), 0 FROM train_users, range(1, 11) t(slot) WHERE user NOT IN (SELECT src FROM n)""")
    def run(spark, sf):
        from tastegrid.functions.ranking import top_k

        strong = gr.user_cooccurrence(fx.train(spark, sf), 200).filter(F.col("weight") >= 4).drop("rank")
        ranked = top_k(strong, ["src"], [F.desc("weight"), F.asc("dst")], 200)
        return gr.sample_neighbours(ranked, 10, mode, nodes=fx.train(spark, sf).select(F.col("user").alias("src"))).withColumn("weight", F.round("weight", 9))


_sampled("mean", "0.1::DOUBLE")
_sampled("softmax", "exp(weight) / sum(exp(weight)) OVER (PARTITION BY src)")


@query("gr13_session_item_graph", f"""WITH {_knn('visual', 10)}, g0 AS (SELECT id AS src, id AS dst FROM visual UNION ALL SELECT src, dst FROM vknn WHERE src <> dst), {_unit('g0', 'g')} {_OUT} g""")
def gr13(spark, sf):
    edges = gr.knn_graph(fx.visual(spark, sf), 10).filter(F.col("src") != F.col("dst"))
    return _r(gr.session_item_graph(edges, fx.visual(spark, sf).select(F.col("id").alias("item"))))


@query("gr14_degree_edge_pruning", f"""WITH {_ADJ},
    keyed AS (SELECT src, dst, -ln((('0x' || substr(md5(concat_ws('|', 42, src, dst)), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0) / weight AS key FROM normed),
    kept AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY key, src, dst) AS place FROM keyed) WHERE place <= floor((SELECT count(*) FROM normed) * (1.0 - 0.3::DOUBLE))),
    ks AS (SELECT src, count(*) AS d FROM kept GROUP BY src), kd AS (SELECT dst, count(*) AS d FROM kept GROUP BY dst),
    g AS (SELECT src, dst, (ks.d + {_E}) ** -0.5::DOUBLE * (kd.d + {_E}) ** -0.5::DOUBLE AS weight FROM kept JOIN ks USING (src) JOIN kd USING (dst))
    {_OUT} g UNION ALL SELECT dst, src, round(weight, 9) FROM g""")
def gr14(spark, sf):
    return _r(gr.degree_edge_pruning(fx.train(spark, sf), 0.3))


def _nodes(spark, sf):
    """Node vectors: items with the mean where they have none, users as the mean of their items' own vectors."""
    tr, vis = fx.train(spark, sf), fx.visual(spark, sf)
    items, _ = ft.impute_mean(vis, tr.select("item").distinct(), DIM)
    users = gr.user_profiles(tr, vis, DIM)
    return users.select(gr.user_node("id").alias("id"), "vec").unionByName(items.select(gr.item_node("id").alias("id"), "vec"))


_FILLED = """means AS (SELECT dim, avg(value) AS value FROM visual_long WHERE id IN (SELECT item FROM pop) GROUP BY dim),
    filled AS MATERIALIZED (SELECT id, dim, value FROM visual_long WHERE id IN (SELECT item FROM pop)
      UNION ALL SELECT item, dim, value FROM (SELECT item FROM pop WHERE item NOT IN (SELECT id FROM visual)), means)"""
_PROFILES = f"profiles AS MATERIALIZED (SELECT user, dim, sum(value) * (1 / (max(d) + {_E})) AS value FROM pairs JOIN visual_long ON id = item JOIN du USING (user) GROUP BY user, dim)"
_X0 = f"""{_FILLED}, {_PROFILES}, x0 AS MATERIALIZED (SELECT user * 2 AS id, dim, value FROM profiles UNION ALL SELECT id * 2 + 1, dim, value FROM filled)"""


def _steps(first: str, edges: str, n: int, name: str = "x") -> str:
    out, prev = [], first
    for layer in range(1, n + 1):
        out.append(f"{name}{layer} AS MATERIALIZED (SELECT src AS id, dim, sum(weight * value) AS value FROM {edges} JOIN {prev} ON {prev}.id = dst GROUP BY src, dim)")
        prev = f"{name}{layer}"
    return ", ".join(out)


def _long(df):
    return explode_vector(df, ["id"], "vec", 9)


_LONG = "SELECT id, dim, CASE WHEN round(value, 9) = 0 THEN 0 ELSE round(value, 9) END AS value FROM"


@query("gr15_propagate", f"""WITH {_ADJ}, {_X0}, {_steps('x0', 'adj', 2)},
    m AS (SELECT id, dim, sum(value) / 3 AS value FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) GROUP BY id, dim) {_LONG} m""")
def gr15(spark, sf):
    return _long(gr.propagate(gr.norm_adjacency(fx.train(spark, sf)), _nodes(spark, sf), 2, DIM))


def _refined(prev: str, out: str) -> str:
    return f"""{out}_m AS MATERIALIZED (SELECT src AS id, dim, sum(weight * value) AS value FROM adj JOIN {prev} ON {prev}.id = dst GROUP BY src, dim),
      {out}_c AS (SELECT a.id, sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))) AS c FROM {out}_m a JOIN x0 b ON a.id = b.id AND a.dim = b.dim GROUP BY a.id),
      {out} AS MATERIALIZED (SELECT id, dim, value * c AS value FROM {out}_m JOIN {out}_c USING (id))"""


@query("gr16_propagate_cosine_refined", f"""WITH {_ADJ}, {_X0}, {_refined('x0', 'x1')}, {_refined('x1', 'x2')},
    m AS (SELECT id, dim, sum(value) AS value FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2) GROUP BY id, dim) {_LONG} m""")
def gr16(spark, sf):
    return _long(gr.propagate_cosine_refined(gr.norm_adjacency(fx.train(spark, sf)), _nodes(spark, sf), 2, DIM))


@query("gr17_item_graph_smoothing", f"""WITH {_TWO}, {_unit('vknn', 'gv')}, {_unit('tknn', 'gt')},
    mm AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, 0.3::DOUBLE * weight AS weight FROM gv UNION ALL SELECT src, dst, (1 - 0.3::DOUBLE) * weight FROM gt) GROUP BY ALL),
    {_steps('visual_long', 'mm', 2, 's')},
    m AS (SELECT id, dim, s2.value + v.value AS value FROM s2 JOIN visual_long v USING (id, dim)) {_LONG} m""")
def gr17(spark, sf):
    v, t = _two(spark, sf)
    graph = gr.fused_graph(gr.unit_weights(v), gr.unit_weights(t), 0.3)
    vis = fx.visual(spark, sf)
    return _long(gr.add_vectors(gr.item_graph_smoothing(graph, vis, 2, DIM), vis, DIM))


@query("gr18_user_modal_profile", f"""WITH {_ADJ}, {_PROFILES},
    x0 AS MATERIALIZED (SELECT user * 2 AS id, dim, value FROM profiles UNION ALL SELECT id * 2 + 1, dim, value FROM visual_long), {_steps('x0', 'adj', 1)} {_LONG} x1""")
def gr18(spark, sf):
    return _long(gr.user_modal_profile(fx.train(spark, sf), fx.visual(spark, sf), 1, DIM))


@query("gr19_alignment", f"""WITH {_ADJ}, {_PROFILES},
    ul AS (SELECT user, sqrt(sum(value * value)) AS l FROM profiles GROUP BY user), il AS (SELECT id AS item, sqrt(sum(value * value)) AS l FROM visual_long GROUP BY id),
    d AS (SELECT p.user, p.item, sum((a.value / ul.l - b.value / il.l) ** 2) AS d FROM pairs p JOIN profiles a ON a.user = p.user JOIN visual_long b ON b.id = p.item AND b.dim = a.dim
          JOIN ul ON ul.user = p.user JOIN il ON il.item = p.item GROUP BY ALL) SELECT round(avg(d), 6) AS value FROM d""")
def gr19(spark, sf):
    tr, vis = fx.train(spark, sf), fx.visual(spark, sf)
    return rounded(gr.alignment(tr, gr.user_profiles(tr, vis, DIM), vis), "value")


@query("gr20_uniformity", """SELECT round(ln(avg(exp(-2 * (2 - 2 * list_cosine_similarity(a.vec, b.vec))))), 6) AS value FROM visual a JOIN visual b ON a.id < b.id""")
def gr20(spark, sf):
    return rounded(gr.uniformity(fx.visual(spark, sf)), "value")


@query("gr21_item_users_neighbour", """WITH p AS (SELECT item, user, (row_number() OVER (PARTITION BY item ORDER BY user) - 1) // 10 AS part FROM (SELECT DISTINCT item, user FROM train))
    SELECT item, part::INTEGER AS part, string_agg(user::VARCHAR, ' ' ORDER BY user) AS users FROM p GROUP BY item, part""")
def gr21(spark, sf):
    lists = gr.item_users_neighbour(fx.train(spark, sf), 10)
    return lists.withColumn("users", F.array_join(F.col("users").cast("array<string>"), " "))


def _interest(m: str) -> str:
    """Targets of each user in one modality, given unit vectors ``{m}u``."""
    return f"""{m}p AS MATERIALIZED (SELECT user, dim, sum(value) AS value FROM pairs JOIN {m}u ON id = item GROUP BY user, dim),
      {m}s AS (SELECT p.user, u.id AS target, round(sum(p.value * u.value), 9) AS s FROM {m}p p JOIN {m}u u USING (dim) GROUP BY ALL),
      {m}t AS (SELECT user, target FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY s DESC, target) AS r FROM {m}s) WHERE r <= 5)"""


def _unit_long(modality: str) -> str:
    m = modality[0]
    return f"{m}u AS MATERIALIZED (SELECT id, dim, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM {modality}_long)"


@query("gr22_interest_graph", f"""WITH {_ADJ}, {_unit_long('visual')}, {_unit_long('textual')}, {_interest('v')}, {_interest('t')},
    targets AS (SELECT user, target FROM vt UNION SELECT user, target FROM tt),
    c AS MATERIALIZED (SELECT p.item, t.target, count(*) AS c FROM pairs p JOIN targets t USING (user) WHERE p.item IN (SELECT id FROM visual) GROUP BY ALL),
    {_knn('visual', 10)}, interest AS MATERIALIZED (SELECT item AS src, target AS dst, c * list_cosine_similarity(x.vec, y.vec) AS weight
      FROM c JOIN visual x ON x.id = item JOIN visual y ON y.id = target), {_laplace('interest', 'li')}, {_laplace('vknn', 'lk')},
    g AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM li UNION ALL SELECT * FROM lk) GROUP BY ALL) {_OUT} g""")
def gr22(spark, sf):
    return _r(gr.interest_graph(fx.train(spark, sf), fx.visual(spark, sf), fx.textual(spark, sf), 5, 10, DIM))


@query("gr23_attractive_augmentation", f"""WITH {_ADJ}, prods AS MATERIALIZED (SELECT a.id AS item, b.id AS target,
      round(list_cosine_similarity(a.vec, b.vec) * list_cosine_similarity(c.vec, d.vec), 9) AS s
      FROM visual a CROSS JOIN visual b JOIN textual c ON c.id = a.id JOIN textual d ON d.id = b.id),
    own AS (SELECT user, item, count(*) OVER (PARTITION BY user) AS n FROM pairs WHERE item IN (SELECT id FROM visual)),
    ranked AS (SELECT o.user, o.n, o.item, p.target, s, row_number() OVER (PARTITION BY o.user ORDER BY s DESC, o.item <> p.target, o.item, p.target) AS r FROM own o JOIN prods p USING (item)),
    e0 AS (SELECT user * 2 AS src, target * 2 + 1 AS dst, sum(CASE WHEN item = target THEN 1.0::DOUBLE ELSE s END) AS weight FROM ranked WHERE r <= n + 3 GROUP BY ALL),
    e AS MATERIALIZED (SELECT src, dst, weight FROM e0 UNION ALL SELECT dst, src, weight FROM e0), {_laplace('e', 'l')},
    g AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM adj UNION ALL SELECT src, dst, weight / 2 FROM l) GROUP BY ALL) {_OUT} g""")
def gr23(spark, sf):
    return _r(gr.attractive_augmentation(fx.train(spark, sf), fx.visual(spark, sf), fx.textual(spark, sf), 3, DIM))


_PLAIN_ADJ = """pairs AS (SELECT DISTINCT user * 2 AS u, item * 2 + 1 AS i FROM train), a AS MATERIALIZED (SELECT u AS src, i AS dst, 1.0::DOUBLE AS weight FROM pairs UNION ALL SELECT i, u, 1.0 FROM pairs),
    d AS (SELECT src AS node, sum(weight) AS d FROM a GROUP BY src)"""
_KINDS = {
    "plain": "a",
    "norm": "(SELECT src, dst, 1 / (d + 1) AS weight FROM (SELECT src, dst FROM a UNION ALL SELECT node, node FROM d) JOIN d ON node = src)",
    "gcmc": "(SELECT src, dst, 1 / d AS weight FROM a JOIN d ON node = src)",
    "pre": "(SELECT src, dst, (x.d + 1e-8) ** -0.5::DOUBLE * (y.d + 1e-8) ** -0.5::DOUBLE AS weight FROM a JOIN d x ON x.node = src JOIN d y ON y.node = dst)",
    "mean": "(SELECT src, dst, 1 / d AS weight FROM a JOIN d ON node = src UNION ALL SELECT node, node, 1.0 FROM d)",
}


def _kind(kind: str):
    @query(f"gr24_adjacency_{kind}", f"WITH {_PLAIN_ADJ} {_OUT} {_KINDS[kind]}")
    def run(spark, sf):
        return _r(gr.adjacency(fx.train(spark, sf), kind))


for _k in _KINDS:
    _kind(_k)


@query("gr25_embedding_moments", """WITH m AS (SELECT 'visual' AS name, avg(value) AS mean, var_samp(value) AS variance FROM visual_long
      UNION ALL SELECT 'textual', avg(value), var_samp(value) FROM textual_long)
    SELECT name, round(mean, 6) AS mean, round(variance, 6) AS variance FROM m
    UNION ALL SELECT 'gap', round(sum(abs(a.mean - b.mean) + abs(a.variance - b.variance)), 6), 0.0 FROM m a JOIN m b ON a.name < b.name""")
def gr25(spark, sf):
    moments = gr.embedding_moments({"visual": fx.visual(spark, sf), "textual": fx.textual(spark, sf)})
    gap = gr.moment_gap(moments).select(F.lit("gap").alias("name"), F.col("value").alias("mean"), F.lit(0.0).alias("variance"))
    return rounded(moments.unionByName(gap), "mean", "variance")


# --- multimodal features ------------------------------------------------------------------------------


@query("mm01_impute_mean", f"WITH {_FILLED} {_LONG} filled")
def mm01(spark, sf):
    return _long(ft.impute_mean(fx.visual(spark, sf), fx.train(spark, sf).select("item").distinct(), DIM)[0])


@query("mm01_missing_items", "SELECT item AS id FROM pop WHERE item NOT IN (SELECT id FROM visual)")
def mm01_missing(spark, sf):
    return ft.impute_mean(fx.visual(spark, sf), fx.train(spark, sf).select("item").distinct(), DIM)[1]


@query("mm02_overlay_imputed", f"""WITH o AS (SELECT v.id, v.dim, CASE WHEN l.label < 3 THEN t.value ELSE v.value END AS value FROM visual_long v
    JOIN (SELECT vec_id AS id, label FROM embeddings) l USING (id) JOIN textual_long t ON t.id = v.id AND t.dim = v.dim) {_LONG} o""")
def mm02(spark, sf):
    missing = fx.table(spark, sf, "embeddings").filter(F.col("label") < 3).select(F.col("vec_id").alias("id"))
    return _long(ft.overlay_imputed(fx.visual(spark, sf), missing, fx.textual(spark, sf)))


def _fuse(how: str, sql: str):
    @query(f"mm03_fuse_{how}", sql)
    def run(spark, sf):
        return _long(ft.fuse(fx.visual(spark, sf), fx.textual(spark, sf), how))


_fuse("concat", f"WITH c AS (SELECT * FROM visual_long UNION ALL SELECT id, dim + 64, value FROM textual_long) {_LONG} c")
for _how, _op in (("sum", "v.value + t.value"), ("mul", "v.value * t.value"), ("mean", "(v.value + t.value) / 2")):
    _fuse(_how, f"WITH c AS (SELECT v.id, v.dim, {_op} AS value FROM visual_long v JOIN textual_long t ON t.id = v.id AND t.dim = v.dim) {_LONG} c")


@query("mm04_minmax_normalise", f"WITH c AS (SELECT id, dim, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS value FROM visual_long WINDOW w AS (PARTITION BY id)) {_LONG} c")
def mm04(spark, sf):
    return _long(fx.visual(spark, sf).withColumn("vec", ft.minmax_normalise("vec")))


@query("mm04_zscore", f"WITH c AS (SELECT id, dim, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM visual_long WINDOW w AS (PARTITION BY dim)) {_LONG} c")
def mm04z(spark, sf):
    vis = fx.visual(spark, sf)
    moments = ft.dimension_moments(vis, DIM).first()
    return _long(vis.withColumn("vec", ft.zscore(moments["mean"], moments["std"])))


@query("mm05_concat_modalities", f"""WITH t AS (SELECT x.* FROM textual_long x JOIN embeddings e ON e.vec_id = x.id WHERE label <> 1), v AS (SELECT x.* FROM visual_long x JOIN embeddings e ON e.vec_id = x.id WHERE label <> 2),
    c AS (SELECT * FROM v UNION ALL SELECT id, dim + CASE WHEN id IN (SELECT id FROM v) THEN 64 ELSE 0 END, value FROM t) {_LONG} c""")
def mm05(spark, sf):
    labels = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    a = fx.visual(spark, sf).join(labels.filter(F.col("label") != 2), "id", "left_semi")
    b = fx.textual(spark, sf).join(labels.filter(F.col("label") != 1), "id", "left_semi")
    return _long(ft.concat_modalities(a, b))


@query("mm06_remap_embeddings", f"""WITH ids AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM test WHERE rating >= 5)),
    c AS (SELECT idx AS id, dim, value FROM visual_long v JOIN ids ON item = v.id) {_LONG} c""")
def mm06(spark, sf):
    ids = id_map(fx.test(spark, sf).filter(F.col("rating") >= 5), "item")
    return _long(ft.remap_embeddings(fx.visual(spark, sf), ids))


@query("mm07_w2v_lookup", """WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
    vectors AS (SELECT DISTINCT ON (word) word, id FROM (SELECT w.word, e.vec_id AS id FROM (SELECT string_split(p_name, ' ')[1] AS word, p_partkey FROM part) w JOIN embeddings e ON e.vec_id = p_partkey) ORDER BY word, id),
    vl AS (SELECT word, dim, value FROM vectors JOIN visual_long USING (id)), m AS (SELECT dim, avg(value) AS value FROM vl GROUP BY dim),
    c AS (SELECT word, dim, value FROM vl UNION ALL SELECT word, dim, value FROM words, m WHERE word NOT IN (SELECT word FROM vectors))
    SELECT word, dim, CASE WHEN round(value, 9) = 0 THEN 0 ELSE round(value, 9) END AS value FROM c""")
def mm07(spark, sf):
    """First words of part names have a vector (that of their lowest part with one); the other words have none."""
    part = fx.parts(spark, sf)
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    own = part.select(F.split("p_name", " ")[0].alias("word"), F.col("p_partkey").alias("id")).join(fx.visual(spark, sf), "id")
    vectors = own.groupBy("word").agg(F.min_by("vec", "id").alias("vec"))
    return explode_vector(ft.word_vectors(words, vectors, DIM), ["word"], "vec", 9)
