"""Queries on neighbours, content profiles, graphs walks and factor models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import factor_models as fm
from tastegrid.operators import factorisation_machine as machine
from tastegrid.operators import recommend as rc
from tastegrid.operators import similarity as si
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import longs, query, r6, rounded

# Pair tables in SQL. ``pairs``: shared statistics of item pairs; ``ms``: member statistics.
_PAIRS = """pairs AS MATERIALIZED (SELECT a.item AS i, b.item AS j, count(*)::DOUBLE AS n, sum(a.rating * b.rating) AS dot,
      sum(least(a.rating, b.rating)) AS low, sum(a.rating - b.rating) AS diff, sum((a.rating = b.rating)::INTEGER)::DOUBLE AS equal,
      sum(abs(a.rating - b.rating) / (abs(a.rating) + abs(b.rating))) AS canberra
    FROM data a JOIN data b ON a.key = b.key AND a.item <> b.item GROUP BY a.item, b.item),
    ms AS MATERIALIZED (SELECT item AS m, count(*)::DOUBLE AS size, sum(rating) AS total, sum(rating * rating) AS square FROM data GROUP BY item),
    sided AS (SELECT p.*, x.size AS ni, y.size AS nj, x.total AS si, y.total AS sj, x.square AS qi, y.square AS qj
      FROM pairs p JOIN ms x ON x.m = p.i JOIN ms y ON y.m = p.j)"""
_DATA = "data AS MATERIALIZED (SELECT user AS key, item, rating FROM train)"
_DATA_T = "data AS MATERIALIZED (SELECT item AS key, user AS item, rating FROM train)"


def _best(formula: str, k: int, source: str = "sided", extra: str = "") -> str:
    return f"""best AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank
        FROM (SELECT i, j, round({formula}, 9) AS sim FROM {source} {extra}) WHERE sim <> 0),
      sim AS MATERIALIZED (SELECT i, j, sim, rank FROM best WHERE rank <= {k})"""


_OUT = "SELECT i, j, sim, rank::INTEGER AS rank FROM sim"


def _neighbours(df):
    return df.select("i", "j", "sim", "rank")


_PLAIN = {
    "cosine": "dot / sqrt(qi * qj)",
    "dot": "dot",
    "asymmetric": "dot / (qi ** 0.3::DOUBLE * qj ** (1 - 0.3::DOUBLE))",
    "jaccard": "n / (ni + nj - n)",
    "dice": "2 * n / (ni + nj)",
    "tversky": "n / (n + 0.3::DOUBLE * (ni - n) + 1.0::DOUBLE * (nj - n))",
}


def _plain(fn: str):
    @query(f"rc05_item_similarity_{fn}", f"WITH {_DATA}, {_PAIRS}, {_best(_PLAIN[fn], 20)} {_OUT}")
    def run(spark, sf):
        return _neighbours(si.similarity(fx.train(spark, sf), fn, 20, alpha=0.3))


for _fn in _PLAIN:
    _plain(_fn)

_E = "(10 + 1e-6::DOUBLE)"
_SHRUNK = {
    "cosine": f"dot / (sqrt(qi) * sqrt(qj) + {_E})",
    "asymmetric": f"dot / (qi ** 0.3::DOUBLE * qj ** (1 - 0.3::DOUBLE) + {_E})",
    "jaccard": f"n / (ni + nj - n + {_E})",
    "dice": f"n / (ni + nj + {_E})",
    "tversky": f"n / (n + (ni - n) * 0.3::DOUBLE + (nj - n) * 1.0::DOUBLE + {_E})",
}


def _shrunk(fn: str):
    @query(f"rc06_item_similarity_shrunk_{fn}", f"WITH {_DATA}, {_PAIRS}, {_best(_SHRUNK[fn], 20)} {_OUT}")
    def run(spark, sf):
        return _neighbours(si.similarity_shrunk(fx.train(spark, sf), fn, 20, shrink=10.0, alpha=0.3))


for _fn in _SHRUNK:
    _shrunk(_fn)


def _centred(fn: str, by: str):
    @query(f"rc06_item_similarity_shrunk_{fn}", f"""WITH data AS MATERIALIZED (SELECT user AS key, item, rating - avg(rating) OVER (PARTITION BY {by}) AS rating FROM train),
        {_PAIRS}, best AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank, count(*) OVER (PARTITION BY i) AS nonzero
          FROM (SELECT i, j, round(dot / (sqrt(qi) * sqrt(qj) + {_E}), 9) AS sim FROM sided) WHERE sim <> 0),
        sim AS (SELECT * FROM best WHERE rank <= 20 AND (sim > 0 OR rank + (SELECT count(*) FROM ms) - nonzero <= 20)) {_OUT}""")
    def run(spark, sf):
        return _neighbours(si.similarity_shrunk(fx.train(spark, sf), fn, 20, shrink=10.0))


_centred("adjusted", "user")
_centred("pearson", "item")


@query("rc06_item_similarity_shrunk_row_weights", f"""WITH data AS MATERIALIZED (SELECT user AS key, item, rating FROM train),
    uw AS (SELECT user, count(*)::DOUBLE AS w FROM train GROUP BY user),
    ms AS (SELECT item AS m, sum(rating * rating) AS square FROM data GROUP BY item),
    weighted AS (SELECT i, j, dot, x.square AS qi, y.square AS qj FROM (
        SELECT a.item AS i, b.item AS j, sum(w * a.rating * b.rating) AS dot FROM data a JOIN data b ON a.key = b.key AND a.item <> b.item JOIN uw ON uw.user = a.key GROUP BY ALL) p
        JOIN ms x ON x.m = p.i JOIN ms y ON y.m = p.j),
    {_best(f"dot / (sqrt(qi) * sqrt(qj) + {_E})", 20, "weighted")} {_OUT}""")
def rc06_weights(spark, sf):
    tr = fx.train(spark, sf)
    weights = tr.groupBy("user").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return _neighbours(si.similarity_shrunk(tr, "cosine", 20, shrink=10.0, row_weights=weights))


_FT = "(ni + nj - 2 * n)"
_DISTANCES = {
    "euclidean": "sqrt(greatest(qi + qj - 2 * dot, 0))",
    "manhattan": "si + sj - 2 * low",
    "braycurtis": "(si + sj - 2 * low) / (si + sj)",
    "canberra": f"canberra + {_FT}",
    "correlation": "1 - (u * dot - si * sj) / sqrt((u * qi - si * si) * (u * qj - sj * sj))",
    "hamming": "(ni + nj - n - equal) / u",
    "jaccard": f"{_FT} / (n + {_FT})",
    "rogerstanimoto": f"2 * {_FT} / (u + {_FT})",
    "sokalsneath": f"2 * {_FT} / (n + 2 * {_FT})",
    "russellrao": "(u - n) / u",
    "yule": "coalesce(2 * (ni - n) * (nj - n) / nullif(n * (u - ni - nj + n) + (ni - n) * (nj - n), 0), 0)",
    "kulsinski": "(ni + nj - 3 * n + u) / (ni + nj - 2 * n + u)",
    "seuclidean": "sqrt(round(greatest(qi + qj - 2 * dot, 0), 12))",
}
_SPREAD = """spread AS (SELECT user AS key, (sum(rating * rating) - sum(rating) * sum(rating) / m) / (m - 1) AS s
      FROM train, (SELECT count(DISTINCT item)::DOUBLE AS m FROM train) GROUP BY user, m),
    data AS MATERIALIZED (SELECT t.user AS key, item, rating / sqrt(s) AS rating FROM train t JOIN spread ON key = t.user AND s > 0)"""


def _distance(fn: str):
    @query(f"rc07_distance_similarity_{fn}", f"""WITH {_SPREAD if fn == "seuclidean" else _DATA}, {_PAIRS}, nu AS (SELECT count(DISTINCT key)::DOUBLE AS u FROM data),
        every AS (SELECT x.m AS i, y.m AS j, coalesce(n, 0) AS n, coalesce(dot, 0) AS dot, coalesce(low, 0) AS low, coalesce(equal, 0) AS equal,
            coalesce(canberra, 0) AS canberra, x.size AS ni, y.size AS nj, x.total AS si, y.total AS sj, x.square AS qi, y.square AS qj, u
          FROM ms x JOIN ms y ON x.m <> y.m LEFT JOIN pairs p ON p.i = x.m AND p.j = y.m, nu),
        {_best(f"1 / (1 + {_DISTANCES[fn]})", 20, "every")} {_OUT}""")
    def run(spark, sf):
        return _neighbours(si.distance_similarity(fx.train(spark, sf), fn, 20))


for _fn in _DISTANCES:
    _distance(_fn)


@query("rc07_distance_similarity_chebyshev", f"""WITH {_DATA}, ms AS (SELECT item AS m, max(rating) AS most FROM data GROUP BY item),
    half AS (SELECT a.item AS i, m.m AS j, most, max(abs(a.rating - coalesce(b.rating, 0))) AS d
      FROM data a JOIN ms m ON m.m <> a.item LEFT JOIN data b ON b.key = a.key AND b.item = m.m GROUP BY a.item, m.m, most),
    whole AS (SELECT x.i, x.j, x.most, round(1 / (1 + greatest(x.d, y.d)), 9) AS sim FROM half x JOIN half y ON y.i = x.j AND y.j = x.i),
    sim AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, most, j) AS rank FROM whole QUALIFY rank <= 20) {_OUT}""")
def rc07_chebyshev(spark, sf):
    return _neighbours(si.distance_similarity(fx.train(spark, sf), "chebyshev", 20))


def _recs(df):
    return df.select("user", "item", "score", "rank")


def _top(k: int, scores: str = "scores") -> str:
    """Top-k of ``scores`` outside the training part; scores are compared at nine decimals in both engines."""
    return f"""SELECT user, item, score, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank
        FROM (SELECT user, item, round(score, 9) AS score FROM {scores}) s
        WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user = s.user AND t.item = s.item)) WHERE rank <= {k}"""


def _full_top(k: int, rest: str = "0", items: str = "SELECT DISTINCT item FROM train") -> str:
    """As :func:`_top` over all items of the training part: those without a score have ``rest``."""
    return f"""SELECT user, item, score, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank
        FROM (SELECT u.user, p.item, round(coalesce(s.score, {rest}), 9) AS score FROM (SELECT DISTINCT user FROM train) u CROSS JOIN ({items}) p
          LEFT JOIN scores s ON s.user = u.user AND s.item = p.item) s
        WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user = s.user AND t.item = s.item)) WHERE rank <= {k}"""


@query("rc01_top_k", f"WITH scores AS (SELECT u.user, p.item, ((u.user * 31 + p.item * 17) % 101)::DOUBLE AS score FROM train_users u CROSS JOIN pop p) {_top(20)}")
def rc01(spark, sf):
    tr = fx.train(spark, sf)
    users, items = (tr.select(F.col(c).alias("id")).distinct().select("id", F.array(F.col("id").cast("double")).alias("vec")) for c in ("user", "item"))
    return _recs(rc.factor_recs(users, items, tr, 20, lambda u, i: (u * 31 + i.T * 17) % 101))  # scored in blocks, k best of each


_ITEM_KNN = f"{_DATA}, {_PAIRS}, {_best(_PLAIN['cosine'], 20)}"


@query("rc08_item_knn", f"""WITH {_ITEM_KNN}, scores AS (SELECT t.user, s.i AS item, sum(t.rating * s.sim) AS score FROM train t JOIN sim s ON s.j = t.item GROUP BY ALL) {_full_top(20)}""")
def rc08(spark, sf):
    tr = fx.train(spark, sf)
    return _recs(rc.full_top_k_unseen(rc.item_knn_scores(tr, si.similarity(tr, "cosine", 20)), tr, 20))


@query("rc09_user_knn", f"""WITH {_DATA_T}, {_PAIRS},
    own AS (SELECT i, j, dot / sqrt(qi * qj) AS sim FROM sided UNION ALL SELECT m, m, square / sqrt(square * square) FROM ms),
    {_best("sim", 30, "own")}, scores AS (SELECT s.i AS user, t.item, sum(t.rating * s.sim) AS score FROM train t JOIN sim s ON s.j = t.user GROUP BY ALL) {_full_top(20)}""")
def rc09(spark, sf):
    tr = fx.train(spark, sf)
    return _recs(rc.full_top_k_unseen(rc.user_knn_scores(tr, rc.user_similarity(tr, "cosine", 30)), tr, 20))


@query("rc09_user_knn_shrunk", f"""WITH {_DATA_T}, {_PAIRS}, {_best(_SHRUNK["cosine"], 30)},
    scores AS (SELECT s.i AS user, t.item, sum(t.rating * s.sim) AS score FROM train t JOIN sim s ON s.j = t.user GROUP BY ALL) {_full_top(20)}""")
def rc09_shrunk(spark, sf):
    tr = fx.train(spark, sf)
    near = si.similarity_shrunk(tr, "cosine", 30, key="item", member="user", shrink=10.0)
    return _recs(rc.full_top_k_unseen(rc.user_knn_scores(tr, near), tr, 20))


@query("rc10_attribute_item_knn", f"""WITH data AS MATERIALIZED (SELECT 'u' || user AS key, item, rating FROM train
      UNION ALL SELECT 'f' || feature_id, item, 2.0 FROM attribute_ids WHERE item IN (SELECT item FROM pop)),
    {_PAIRS}, {_best(_PLAIN['cosine'], 20)} {_OUT}""")
def rc10(spark, sf):
    return _neighbours(rc.attribute_item_neighbours(fx.train(spark, sf), fx.attribute_ids(spark, sf), 2.0, "cosine", 20))


_STACKED = """raw AS MATERIALIZED (SELECT 'u' || user AS key, item, rating FROM train
      UNION ALL SELECT 'f' || feature_id, item, 2.0 FROM attribute_ids WHERE item IN (SELECT item FROM pop)),
    kd AS (SELECT key, count(*) AS df FROM raw GROUP BY key), il AS (SELECT item, sum(rating) AS len FROM raw GROUP BY item),
    ig AS (SELECT count(*) AS n, avg(len) AS mean FROM il)"""


@query("rc10_attribute_item_knn_tfidf", f"""WITH {_STACKED},
    data AS MATERIALIZED (SELECT key, item, sqrt(rating) * ln(n / (1 + df)) AS rating FROM raw JOIN kd USING (key), ig),
    {_PAIRS}, {_best(_PLAIN['cosine'], 20)} {_OUT}""")
def rc10_tfidf(spark, sf):
    return _neighbours(rc.attribute_item_neighbours(fx.train(spark, sf), fx.attribute_ids(spark, sf), 2.0, "cosine", 20, "TF_IDF"))


@query("rc10_attribute_item_knn_bm25_recs", f"""WITH {_STACKED},
    data AS MATERIALIZED (SELECT key, item, rating * 2.2 / (1.2 * (0.25 + 0.75 * len / mean) + rating) * ln(n / (1 + df)) AS rating
      FROM raw JOIN kd USING (key) JOIN il USING (item), ig),
    {_PAIRS}, {_best(_PLAIN['cosine'], 20)},
    scores AS (SELECT t.user, s.i AS item, sum(t.rating * s.sim) AS score FROM train t JOIN sim s ON s.j = t.item GROUP BY ALL) {_full_top(20)}""")
def rc10_bm25(spark, sf):
    tr = fx.train(spark, sf)
    near = rc.attribute_item_neighbours(tr, fx.attribute_ids(spark, sf), 2.0, "cosine", 20, "BM25")
    return _recs(rc.full_top_k_unseen(rc.item_knn_scores(tr, near), tr, 20))


@query("rc11_bm25_weight", """WITH l AS (SELECT item, sum(rating) AS len FROM train GROUP BY item), d AS (SELECT user, count(*) AS df FROM train GROUP BY user),
    g AS (SELECT count(*) AS n, avg(len) AS mean FROM l)
    SELECT item, user, round(rating * 2.2 / (1.2 * (0.25 + 0.75 * len / mean) + rating) * ln(n / (1 + df)), 6) AS rating
    FROM train JOIN l USING (item) JOIN d USING (user), g""")
def rc11(spark, sf):
    return rounded(rc.bm25_weight(fx.train(spark, sf), "item", "user", "rating"), "rating")


@query("rc12_tfidf_sqrt_weight", """WITH d AS (SELECT user, count(*) AS df FROM train GROUP BY user)
    SELECT item, user, round(sqrt(rating) * ln((SELECT count(*) FROM pop) / (1 + df)), 6) AS rating FROM train JOIN d USING (user)""")
def rc12(spark, sf):
    return rounded(rc.tfidf_sqrt_weight(fx.train(spark, sf), "item", "user", "rating"), "rating")


_TFIDF = """idf AS (SELECT feature_id, ln((SELECT count(DISTINCT item) FROM attribute_ids) / count(*)) AS idf FROM attribute_ids GROUP BY feature_id),
    lens AS (SELECT item, sqrt(sum(idf * idf)) AS len FROM attribute_ids JOIN idf USING (feature_id) GROUP BY item),
    weights AS MATERIALIZED (SELECT item, feature_id, idf / len AS weight FROM attribute_ids JOIN idf USING (feature_id) JOIN lens USING (item)),
    profile AS MATERIALIZED (SELECT user, feature_id, avg(weight) AS weight FROM train JOIN weights USING (item) GROUP BY user, feature_id)"""


@query("rc13_attribute_user_knn", f"""WITH {_TFIDF},
    l AS (SELECT user, sqrt(sum(weight * weight)) AS len FROM profile GROUP BY user),
    sided AS (SELECT a.user AS i, b.user AS j, round(sum(a.weight * b.weight) / max(x.len) / max(y.len), 9) AS c FROM profile a JOIN profile b USING (feature_id)
      JOIN l x ON x.user = a.user JOIN l y ON y.user = b.user GROUP BY a.user, b.user),
    {_best("c", 20)} {_OUT}""")
def rc13(spark, sf):
    profile = rc.tfidf_user_profile(fx.train(spark, sf), rc.tfidf_items(fx.attribute_ids(spark, sf)))
    return _neighbours(rc.profile_user_neighbours(profile, "cosine", 20))


_NEAR_USERS = """l AS (SELECT user, sqrt(sum(weight * weight)) AS len FROM {profile} GROUP BY user),
    sided AS (SELECT a.user AS i, b.user AS j, round(sum(a.weight * b.weight) / max(x.len) / max(y.len), 9) AS c FROM {profile} a JOIN {profile} b USING (feature_id)
      JOIN l x ON x.user = a.user JOIN l y ON y.user = b.user GROUP BY a.user, b.user)"""
_FROM_NEAR = "scores AS (SELECT s.j AS user, t.item, sum(t.rating * s.sim) AS score FROM train t JOIN sim s ON s.i = t.user GROUP BY ALL)"


@query("rc13_attribute_user_knn_recs", f"""WITH {_TFIDF}, {_NEAR_USERS.format(profile='profile')}, {_best('c', 20)}, {_FROM_NEAR} {_full_top(20)}""")
def rc13_recs(spark, sf):
    tr = fx.train(spark, sf)
    profile = rc.tfidf_user_profile(tr, rc.tfidf_items(fx.attribute_ids(spark, sf)))
    return _recs(rc.attribute_user_knn_recs(tr, profile, "cosine", 20, 20))


@query("rc13_attribute_user_knn_binary_recs", f"""WITH bin AS MATERIALIZED (SELECT DISTINCT user, feature_id, 1.0::DOUBLE AS weight FROM train JOIN attribute_ids USING (item)),
    {_NEAR_USERS.format(profile='bin')}, {_best('c', 20)}, {_FROM_NEAR} {_full_top(20)}""")
def rc13_binary_recs(spark, sf):
    tr = fx.train(spark, sf)
    return _recs(rc.attribute_user_knn_recs(tr, rc.binary_user_profile(tr, fx.attribute_ids(spark, sf)), "cosine", 20, 20))


@query("rc13_attribute_user_knn_binary", """SELECT DISTINCT user, feature_id, 1.0::DOUBLE AS weight FROM train JOIN attribute_ids USING (item)""")
def rc13_binary(spark, sf):
    return rc.binary_user_profile(fx.train(spark, sf), fx.attribute_ids(spark, sf))


@query("rc14_tfidf_items", f"WITH {_TFIDF} SELECT item, feature_id, round(weight, 6) AS weight FROM weights")
def rc14(spark, sf):
    return rounded(rc.tfidf_items(fx.attribute_ids(spark, sf)), "weight")


@query("rc15_tfidf_user_profile", f"WITH {_TFIDF} SELECT user, feature_id, round(weight, 6) AS weight FROM profile")
def rc15(spark, sf):
    return rounded(rc.tfidf_user_profile(fx.train(spark, sf), rc.tfidf_items(fx.attribute_ids(spark, sf))), "weight")


@query("rc16_vsm_scores", f"""WITH {_TFIDF}, ul AS (SELECT user, sqrt(sum(weight * weight)) AS len FROM profile GROUP BY user),
    dots AS (SELECT user, item, sum(p.weight * w.weight) AS d FROM profile p JOIN weights w USING (feature_id) GROUP BY user, item),
    il AS (SELECT item, sqrt(sum(weight * weight)) AS len FROM weights GROUP BY item),
    scores AS (SELECT user, item, d / ul.len / il.len AS score FROM dots JOIN ul USING (user) JOIN il USING (item))
    SELECT user, item, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank
      FROM (SELECT user, item, round(score, 9) AS score FROM scores) s WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user = s.user AND t.item = s.item)) WHERE rank <= 20""")
def rc16(spark, sf):
    tr, weights = fx.train(spark, sf), rc.tfidf_items(fx.attribute_ids(spark, sf))
    return _recs(rc.vsm_recs(rc.tfidf_user_profile(tr, weights), weights, tr, "cosine", 20))


_SLOPE = f"{_DATA}, {_PAIRS}, means AS (SELECT user, avg(rating) AS mean FROM train GROUP BY user), dev AS MATERIALIZED (SELECT i, j, diff / n AS dev FROM pairs)"


@query("rc17_slope_one", f"""WITH {_SLOPE},
    scores AS (SELECT user, item, mean + shift AS score FROM (SELECT t.user, d.i AS item, avg(dev) AS shift FROM train t JOIN dev d ON d.j = t.item GROUP BY ALL) JOIN means USING (user)) {_full_top(20, "(SELECT mean FROM means WHERE means.user = u.user)")}""")
def rc17(spark, sf):
    tr = fx.train(spark, sf)
    return _recs(rc.slope_one_recs(tr, 20))


@query("rc17_slope_one_deviations", f"WITH {_SLOPE} SELECT i, count(*) AS pairs, CASE WHEN abs(sum(dev)) < 5e-7 THEN 0 ELSE round(sum(dev), 6) END AS total, round(max(dev), 6) AS most FROM dev GROUP BY i")
def rc17_dev(spark, sf):
    dev = rc.slope_one_deviations(fx.train(spark, sf))
    return dev.groupBy("i").agg(F.count(F.lit(1)).alias("pairs"), r6(F.sum("dev")).alias("total"), r6(F.max("dev")).alias("most"))


@query("rc18_rp3beta", f"""WITH walk AS MATERIALIZED (SELECT user, item, (rating / sum(rating) OVER (PARTITION BY user)) ** 0.8::DOUBLE AS step FROM train),
    deg AS (SELECT item, count(*)::DOUBLE AS d FROM train GROUP BY item),
    w AS (SELECT a.item AS i, b.item AS j, sum(b.step) AS s FROM walk a JOIN walk b ON a.user = b.user AND a.item <> b.item GROUP BY ALL),
    raw AS (SELECT i, j, round(x.d ** -0.8::DOUBLE * s * y.d ** -0.6::DOUBLE, 12) AS sim FROM w JOIN deg x ON x.item = i JOIN deg y ON y.item = j),
    rws AS MATERIALIZED (SELECT i, j, sim / sum(sim) OVER (PARTITION BY i) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM raw) WHERE r <= 20),
    cls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) AS r FROM rws) WHERE r <= 20),
    scores AS (SELECT t.user, c.j AS item, sum(t.rating * c.sim) AS score FROM train t JOIN cls c ON c.i = t.item GROUP BY ALL) {_full_top(20)}""")
def rc18(spark, sf):
    tr = fx.train(spark, sf)
    near = rc.rp3beta_neighbours(tr, 0.8, 0.6, 20, normalise=True)
    return _recs(rc.full_top_k_unseen(rc.item_knn_scores(tr, near, target="j"), tr, 20))


@query("rc19_gram_matrix", f"""WITH {_DATA}, {_PAIRS}, g AS (SELECT i, j, dot AS value FROM pairs UNION ALL SELECT m, m, size + 100 FROM ms)
    SELECT i, count(*) AS cells, sum(value) AS total, max(value) AS most, sum(value * j) AS moment FROM g GROUP BY i""")
def rc19(spark, sf):
    g = rc.gram_matrix(fx.train(spark, sf), 100.0)
    return g.groupBy("i").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"), F.max("value").alias("most"), F.sum(F.col("value") * F.col("j")).alias("moment")
    )


@query("rc04_proxy", f"""WITH x AS (SELECT user, item, score, rank FROM recs WHERE rank <= 10)
    SELECT x.user, x.item, x.score, x.rank::INTEGER AS rank FROM x JOIN test t ON t.user = x.user AND t.item = x.item""")
def rc04(spark, sf):
    given = fx.recs(spark, sf).withColumn("score", F.col("score"))
    return rc.proxy(given.drop("rank"), fx.test(spark, sf), 10)


def _model_recs(name: str, build):
    @query(name)
    def run(spark, sf):
        return _recs(build(spark, sf))


_model_recs("rc20_slim", lambda spark, sf: fm.slim(fx.train(spark, sf), 20, 0.04, 0.5, 100))
_model_recs("rc21_pure_svd", lambda spark, sf: fm.pure_svd(fx.train(spark, sf), 20))
_model_recs("rc22_implicit_als", lambda spark, sf: fm.implicit_als(fx.train(spark, sf), 20, alpha=10.0))
_model_recs("rc22_implicit_als_log", lambda spark, sf: fm.implicit_als(fx.train(spark, sf), 20, scaling="log"))
_model_recs("rc23_explicit_mf", lambda spark, sf: fm.explicit_mf(fx.train(spark, sf), 20))
_model_recs("rc23_nonneg_mf", lambda spark, sf: fm.nonneg_mf(fx.train(spark, sf), 20))
_model_recs("rc24_factorization_machine", lambda spark, sf: machine.factorisation_machine(fx.train(spark, sf), fx.attribute_ids(spark, sf), 20))


_MET = "SELECT user, count(*) AS rows, TRUE AS met FROM train GROUP BY user"


def _met(slopes):
    """Factors are single floats, so slopes per row are 0 to about five digits."""
    return slopes.select("user", "rows", (F.col("slope") < 1e-4).alias("met"))


@query("rc21_svd_orthonormal", "SELECT a::INTEGER AS a, b::INTEGER AS b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM range(10) x(a), range(10) y(b)")
def rc21_orthonormal(spark, sf):
    _, items = fm.randomised_svd(fx.train(spark, sf).withColumn("one", F.lit(1.0)), 10, "one")
    long = items.select("id", F.posexplode("vec").alias("a", "x"))
    pairs = long.join(long.select("id", F.col("a").alias("b"), F.col("x").alias("y")), "id")
    return rounded(pairs.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("value")), "value")


@query("rc21_svd_users", _MET)
def rc21_users(spark, sf):
    """A user's vector is the sum of those of the user's items: the matrix times the item vectors."""
    tr = fx.train(spark, sf)
    users, items = fm.randomised_svd(tr.withColumn("one", F.lit(1.0)), 10, "one")
    sums = tr.join(items.select(F.col("id").alias("item"), F.posexplode("vec").alias("c", "x")), "item").groupBy("user", "c").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("rows"))
    own = users.select(F.col("id").alias("user"), F.posexplode("vec").alias("c", "u"))
    return sums.join(own, ["user", "c"]).groupBy("user").agg(F.max("rows").alias("rows"), (F.max(F.abs(F.col("s") - F.col("u"))) < 1e-9).alias("met"))


@query("rc22_als_normal_equations", _MET)
def rc22_normal(spark, sf):
    tr = fx.train(spark, sf)
    users, items = fm._als_factors(tr, "rating", rank=10, regParam=0.1, alpha=10.0, implicitPrefs=True, maxIter=10, seed=42)
    return _met(fm.normal_equations(tr, users, items, "rating", 0.1, alpha=10.0))


@query("rc23_als_normal_equations", _MET)
def rc23_normal(spark, sf):
    tr = fx.train(spark, sf)
    users, items = fm._als_factors(tr, "rating", rank=10, regParam=0.1, maxIter=10, seed=42)
    return _met(fm.normal_equations(tr, users, items, "rating", 0.1))


@query("rc23_nonneg_optimality", _MET)
def rc23_nonneg(spark, sf):
    tr = fx.train(spark, sf)
    users, items = fm._als_factors(tr, "rating", rank=10, regParam=0.1, nonnegative=True, maxIter=10, seed=42)
    return _met(fm.normal_equations(tr, users, items, "rating", 0.1, nonnegative=True))


@query("rc24_fm_normal_equations", _MET)
def rc24_normal(spark, sf):
    """Every user's coefficients against the normal equations, with residuals made by the definition of the machine."""
    tr = fx.train(spark, sf)
    model = machine.fit(tr, fx.attribute_ids(spark, sf), sweeps=2, reg=1.0)
    return machine.normal_equations(tr, model, 1.0).select("user", "rows", (F.col("slope") < 1e-8).alias("met"))


_SCORES = """
    WITH uv AS (SELECT t.user, list_transform(range(64), lambda d: 0.0::DOUBLE) AS z FROM train_users t),
    ul AS (SELECT user, dim, sum(rating * value) AS value FROM train JOIN visual_long ON id = item GROUP BY user, dim),
    ub AS (SELECT user, avg(rating) AS b FROM train GROUP BY user),
    ib AS (SELECT item, avg(rating) AS b FROM train GROUP BY item),
    dots AS (SELECT u.user, v.id AS item, sum(u.value * v.value) AS d FROM ul u JOIN visual_long v USING (dim) GROUP BY ALL),
    scores AS (SELECT user, item, d + coalesce(ub.b, 0) + coalesce(ib.b, 0) AS score FROM dots LEFT JOIN ub USING (user) LEFT JOIN ib USING (item))
    """
_DOTS = _SCORES + _top(20)


def _dot_sides(spark, sf):
    """Users as the sum of their items' vectors and items as theirs, both with the mean rating as bias."""
    from tastegrid.functions.vectors import sum_vectors

    tr, items = fx.train(spark, sf), fx.visual(spark, sf)
    rows = tr.join(items.withColumnRenamed("id", "item"), "item")
    users = sum_vectors(rows, ["user"], "vec", 64, "rating").withColumnRenamed("user", "id")
    ub = tr.groupBy(F.col("user").alias("id")).agg(F.avg("rating").alias("bias"))
    ib = tr.groupBy(F.col("item").alias("id")).agg(F.avg("rating").alias("bias"))
    return users, items, tr, ub, ib


def biased_sides(spark, sf):
    """Vectors of users and items whose products are the scores."""
    users, items, _, ub, ib = _dot_sides(spark, sf)
    return rc.with_bias(users, ub, True), rc.with_bias(items, ib, False)


@query("rc25_dot_product_scores", _DOTS)
def rc25(spark, sf):
    users, items, tr, ub, ib = _dot_sides(spark, sf)
    return _recs(rc.dot_product_recs(users, items, tr, 20, ub, ib))


@query("rc25_dot_product_scores_pruned", _DOTS)
def rc25_pruned(spark, sf):
    users, items, tr, ub, ib = _dot_sides(spark, sf)
    return _recs(rc.factor_recs_pruned(rc.with_bias(users, ub, True), rc.with_bias(items, ib, False), tr, 20))
