"""Queries on evaluation metrics: the popular lists at cutoff 10, relevance from rating 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import metrics as me
from tastegrid.operators import split as sp
from tastegrid.operators import unpersonalised as un
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import BODIES, longs, query, rounded
from tastegrid.session import materialise
from tastegrid.plans.prepare_queries import _HEAD, _draw_sql
from tastegrid.plans.recommend_queries import _SCORES, biased_sides

K = 10


def _one(df):
    return df.select(F.round("value", 6).alias("value"))


def _ev(spark, sf, cutoffs=K):
    return me.Evaluation(fx.recs(spark, sf), fx.test(spark, sf), fx.train(spark, sf), cutoffs, fx.THRESHOLD)


# Views shared by the SQL: cut lists, relevant counts, gated users and hits (full lists in ``all_hits``).
_EV = f"""lists AS (SELECT user, item, score, rank FROM recs WHERE rank <= {K}),
    lens AS (SELECT user, count(*) AS n_recs FROM lists GROUP BY user),
    rels AS (SELECT user, count(*) AS n_rel FROM rel GROUP BY user),
    gated AS (SELECT user, n_recs, n_rel FROM lens JOIN rels USING (user)),
    all_hits AS (SELECT r.user, r.item, r.score, r.rank, l.rating, 2 ** (l.rating - 3) - 1 AS gain, ln(2) / ln(r.rank + 1) AS disc,
                        row_number() OVER (PARTITION BY r.user ORDER BY r.rank) AS p
                 FROM recs r JOIN rel l ON r.user = l.user AND r.item = l.item),
    hits AS (SELECT * FROM all_hits WHERE rank <= {K})"""


def _per_user(agg: str, value: str) -> str:
    """Average over gated users of ``value`` on hit sums."""
    return f"""WITH {_EV}, s AS (SELECT user, {agg} FROM hits GROUP BY user)
        SELECT round(avg({value}), 6) AS value FROM gated LEFT JOIN s USING (user)"""


_IDEAL = f"""ideal AS (SELECT user, sum((2 ** (rating - 3) - 1) * ln(2) / ln(r + 1)) AS idcg FROM
    (SELECT user, rating, row_number() OVER (PARTITION BY user ORDER BY rating DESC) AS r FROM rel) WHERE r <= {K} GROUP BY user)"""
_P, _R = f"(coalesce(h, 0) / {K})", "(coalesce(h, 0) / n_rel)"
_SIMPLE_SQL = {
    "me01_precision": ("Precision", _per_user("count(*) AS h", _P)),
    "me02_recall": ("Recall", _per_user("count(*) AS h", _R)),
    "me03_hr": ("HR", _per_user("count(*) AS h", "CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END")),
    "me04_f1": ("F1", _per_user("count(*) AS h", f"CASE WHEN h > 0 THEN 2 * {_P} * {_R} / ({_P} + {_R}) ELSE 0 END")),
    "me07_ndcg": ("nDCG", f"""WITH {_EV}, {_IDEAL}, s AS (SELECT user, sum(gain * disc) AS dcg FROM hits GROUP BY user)
        SELECT round(avg(coalesce(dcg, 0) / idcg), 6) AS value FROM gated LEFT JOIN s USING (user) JOIN ideal USING (user)"""),
    "me08_ndcg_rendle2020": ("nDCGRendle2020", _per_user(
        "sum(disc) AS dcg", f"coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, {K}) + 1), lambda r: ln(2) / ln(r + 1)))")),
    "me09_mrr": ("MRR", _per_user("min(rank) AS f", "coalesce(1.0 / f, 0)")),
    "me10_map": ("MAP", f"""WITH {_EV}, reach AS (SELECT h.user, n, count(*) / n AS pn FROM hits h, range(1, {K + 1}) t(n) WHERE h.rank <= n GROUP BY h.user, n),
        s AS (SELECT user, sum(pn) / {K} AS v FROM reach GROUP BY user) SELECT round(avg(coalesce(v, 0)), 6) AS value FROM gated LEFT JOIN s USING (user)"""),
    "me11_mar": ("MAR", f"""WITH {_EV}, reach AS (SELECT h.user, n, count(*) AS c FROM hits h, range(1, {K + 1}) t(n) WHERE h.rank <= n GROUP BY h.user, n),
        s AS (SELECT user, sum(c) AS c FROM reach GROUP BY user) SELECT round(avg(coalesce(c, 0) / n_rel / {K}), 6) AS value FROM gated LEFT JOIN s USING (user)"""),
    "me22_num_retrieved": ("NumRetrieved", f"WITH {_EV} SELECT round(avg(n_recs), 6) AS value FROM gated"),
}


def _simple(name: str, metric: str, sql: str):
    @query(name, sql)
    def run(spark, sf):
        ev = _ev(spark, sf)
        return _one(ev.values({"value": ev.column(metric)}))


for _name, (_metric, _sql) in _SIMPLE_SQL.items():
    _simple(_name, _metric, _sql)


@query("me00_per_user_values", f"""WITH {_EV}, {_IDEAL},
    s AS (SELECT user, count(*) AS h, min(rank) AS f, sum(gain * disc) AS dcg FROM hits GROUP BY user)
    SELECT user, round({_P}, 6) AS "Precision", round({_R}, 6) AS "Recall", coalesce(round(1.0 / f, 6), 0)::DOUBLE AS "MRR",
           round(coalesce(dcg, 0) / idcg, 6) AS "nDCG" FROM gated LEFT JOIN s USING (user) JOIN ideal USING (user)""")
def me00(spark, sf):
    names = ["Precision", "Recall", "MRR", "nDCG"]
    return rounded(_ev(spark, sf).per_user(names).drop("k"), *names)


def _dsc_sql(w: float) -> str:
    return _per_user("count(*) AS h", f"CASE WHEN h > 0 THEN (1 + {w}) * {_P} * {_R} / ({w} * {_P} + {_R}) ELSE 0 END")


@query("me05_dsc", _dsc_sql(4.0))
def me05(spark, sf):
    ev = _ev(spark, sf)
    return _one(ev.values({"value": ev.dsc("Precision", "Recall", 2.0)}))


@query("me06_extended_f1", f"""WITH {_EV}, {_IDEAL}, s AS (SELECT user, sum(gain * disc) AS dcg, min(rank) AS f FROM hits GROUP BY user),
    v AS (SELECT coalesce(dcg, 0) / idcg AS a, coalesce(1.0 / f, 0) AS b FROM gated LEFT JOIN s USING (user) JOIN ideal USING (user))
    SELECT round(avg(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END), 6) AS value FROM v""")
def me06(spark, sf):
    ev = _ev(spark, sf)
    return _one(ev.values({"value": ev.dsc("nDCG", "MRR", 1.0)}))


_AUC = f"""{_EV}, profiles AS (SELECT user, count(DISTINCT item) AS n_train FROM train GROUP BY user),
    terms AS (SELECT h.user, h.rank, n_rel, (neg - (h.rank - 1) + (p - 1)) / neg AS term FROM
      (SELECT h.*, n_rel, (SELECT count(*) FROM pop) - coalesce(n_train, 0) - n_rel + 1 AS neg
       FROM all_hits h JOIN rels USING (user) LEFT JOIN profiles USING (user)) h)"""


@query("me12_auc", f"WITH {_AUC} SELECT round(avg(term), 6) AS value FROM terms")
def me12(spark, sf):
    return _one(_ev(spark, sf).auc())


@query("me13_gauc", f"""WITH {_AUC}, s AS (SELECT user, sum(term) AS s FROM terms GROUP BY user)
    SELECT round(avg(coalesce(s, 0) / n_rel), 6) AS value FROM gated LEFT JOIN s USING (user)""")
def me13(spark, sf):
    return _one(_ev(spark, sf).gauc())


@query("me14_lauc", f"""WITH {_AUC}, s AS (SELECT user, sum(term) AS s FROM terms WHERE rank <= {K} GROUP BY user)
    SELECT round(avg(coalesce(s, 0) / least(n_rel, {K})), 6) AS value FROM gated LEFT JOIN s USING (user)""")
def me14(spark, sf):
    return _one(_ev(spark, sf).lauc())


def _error(name: str, metric: str, expr: str):
    @query(name, f"WITH {_EV} SELECT round({expr.format(n='(SELECT count(*) FROM rel)')}, 6) AS value FROM all_hits")
    def run(spark, sf):
        return _ev(spark, sf).rating_errors().select(F.round(metric, 6).alias("value"))


_error("me15_mae", "MAE", "sum(abs(score - rating)) / {n}")
_error("me16_mse", "MSE", "sum((score - rating) ** 2) / {n}")
_error("me17_rmse", "RMSE", "sqrt(sum((score - rating) ** 2) / {n})")


@query("me17_rmse_per_user", f"""WITH {_EV}, s AS (SELECT user, sum(abs(score - rating)) AS a, sum((score - rating) ** 2) AS q FROM all_hits GROUP BY user)
    SELECT user, round(coalesce(a, 0) / n_rel, 6) AS "MAE", round(coalesce(q, 0) / n_rel, 6) AS "MSE",
           round(sqrt(coalesce(q, 0) / n_rel), 6) AS "RMSE" FROM gated LEFT JOIN s USING (user)""")
def me17_users(spark, sf):
    return rounded(_ev(spark, sf).rating_errors_per_user(), "MAE", "MSE", "RMSE")


# Every user's whole list by vectors with biases, and the relevant rows in it.
_FULL = _SCORES + """, lists AS (SELECT user, item, round(score, 9) AS score, row_number() OVER (PARTITION BY user ORDER BY round(score, 9) DESC, item) AS rank
      FROM scores s JOIN pop USING (item) WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user = s.user AND t.item = s.item)),
    all_hits AS MATERIALIZED (SELECT l.user, l.item, l.score, l.rank, r.rating, row_number() OVER (PARTITION BY l.user ORDER BY l.rank) AS p
      FROM lists l JOIN rel r ON l.user = r.user AND l.item = r.item)"""


@query("me12_catalogue_ranks", f"{_FULL} SELECT user, item, round(score, 6) AS score, rank FROM all_hits")
def me12_ranks(spark, sf):
    users, items = biased_sides(spark, sf)
    relevant = me.binary_relevance(fx.test(spark, sf), fx.THRESHOLD)
    return rounded(me.catalogue_ranks(users, items, relevant, fx.train(spark, sf)), "score")


@query("me12_catalogue_metrics", f"""{_FULL}, rels AS (SELECT user, count(*) AS n_rel FROM rel GROUP BY user),
    gated AS (SELECT user, n_rel FROM rels WHERE user IN (SELECT user FROM lists)),
    profiles AS (SELECT user, count(DISTINCT item) AS n_train FROM train GROUP BY user),
    terms AS (SELECT user, rank, score, rating, (neg - (rank - 1) + (p - 1)) / neg AS term FROM
      (SELECT h.*, (SELECT count(*) FROM pop) - coalesce(n_train, 0) - n_rel + 1 AS neg FROM all_hits h JOIN rels USING (user) LEFT JOIN profiles USING (user))),
    s AS (SELECT user, sum(term) AS g, sum(term) FILTER (rank <= {K}) AS l FROM terms GROUP BY user),
    m AS (SELECT avg(coalesce(g, 0) / n_rel) AS g, avg(coalesce(l, 0) / least(n_rel, {K})) AS l FROM gated LEFT JOIN s USING (user)),
    e AS (SELECT avg(term) AS auc, sum(abs(score - rating)) / (SELECT count(*) FROM rel) AS mae, sum((score - rating) ** 2) / (SELECT count(*) FROM rel) AS mse FROM terms)
    SELECT round(auc, 6) AS "AUC", round(m.g, 6) AS "GAUC", round(m.l, 6) AS "LAUC", round(mae, 6) AS "MAE", round(mse, 6) AS "MSE", round(sqrt(mse), 6) AS "RMSE" FROM e, m""")
def me12_catalogue(spark, sf):
    users, items = biased_sides(spark, sf)
    out = me.catalogue_metrics(users, items, fx.test(spark, sf), fx.train(spark, sf), K, fx.THRESHOLD)
    return rounded(out, *out.columns)


@query("me18_eval_error", "WITH h AS (SELECT r.score, t.rating FROM recs r JOIN test t ON r.user = t.user AND r.item = t.item) SELECT round(avg((score - rating) ** 2), 6) AS value FROM h")
def me18(spark, sf):
    return _one(me.eval_error(fx.recs(spark, sf), fx.test(spark, sf)))


@query("me19_item_coverage", f"WITH {_EV} SELECT count(DISTINCT item) AS value FROM lists")
def me19(spark, sf):
    return _ev(spark, sf).item_coverage()


@query("me20_user_coverage", f"WITH {_EV} SELECT count(DISTINCT user) AS value FROM lists")
def me20(spark, sf):
    return _ev(spark, sf).user_coverage()


@query("me21_user_coverage_at_n", f"WITH {_EV} SELECT count(*) AS value FROM lens WHERE n_recs >= {K}")
def me21(spark, sf):
    return _ev(spark, sf).user_coverage_at_n()


def _gini_sql(cluster: str, source: str) -> str:
    return f"""counts AS (SELECT {cluster} AS cluster, item, count(*) AS c FROM {source} GROUP BY ALL),
      placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c, item) - 1 AS j, count(*) OVER (PARTITION BY cluster) AS n,
                        sum(c) OVER (PARTITION BY cluster) AS total, (SELECT count(*) FROM pop) AS ni FROM counts),
      g AS (SELECT cluster, 1 - sum((2 * (j + ni - n + 1) - ni - 1) * (c / total)) / (max(ni) - 1) AS value FROM placed GROUP BY cluster)"""


@query("me23_gini", f"WITH {_EV}, {_gini_sql('0', 'lists')} SELECT round(value, 6) AS value FROM g")
def me23(spark, sf):
    return _one(_ev(spark, sf).gini())


@query("me24_shannon_entropy", f"""WITH {_EV},
    i AS (SELECT item, count(*) AS c, sum(1 / n_recs) AS w FROM lists JOIN lens USING (user) GROUP BY item)
    SELECT round(sum(w * -log2(c / (SELECT count(*) FROM lists))) / (SELECT count(*) FROM lens), 6) AS value FROM i""")
def me24(spark, sf):
    return _one(_ev(spark, sf).shannon_entropy())


@query("me25_srecall", f"""WITH {_EV},
    s AS (SELECT user, count(DISTINCT feature_id) AS f FROM hits JOIN attribute_ids USING (item) GROUP BY user),
    known AS (SELECT count(DISTINCT feature_id) AS n FROM attribute_ids WHERE item IN (SELECT item FROM pop))
    SELECT round(avg(coalesce(f, 0) / n), 6) AS value FROM gated LEFT JOIN s USING (user), known""")
def me25(spark, sf):
    return _one(_ev(spark, sf).srecall(fx.attribute_ids(spark, sf)))


def _novelty_sql(novelty: str, graded: bool) -> str:
    return f"""WITH {_EV}, nov AS (SELECT item, {novelty} AS nov FROM pop),
        s AS (SELECT user, sum({'gain' if graded else '1'} * disc * nov) AS s FROM hits JOIN nov USING (item) GROUP BY user),
        norms AS (SELECT user, sum(ln(2) / ln(rank + 1)) AS norm FROM lists GROUP BY user)
        SELECT round(avg(coalesce(s, 0) / norm), 6) AS value FROM gated JOIN norms USING (user) LEFT JOIN s USING (user)"""


_EPC = "1 - pop / (SELECT count(*) FROM train_users)"
_EFD = "-log2(pop / (SELECT sum(pop) FROM pop))"


@query("me26_epc", _novelty_sql(_EPC, False))
def me26(spark, sf):
    return _one(_ev(spark, sf).epc())


@query("me26_extended_epc", _novelty_sql(_EPC, True))
def me26x(spark, sf):
    return _one(_ev(spark, sf).epc(graded=True))


@query("me27_efd", _novelty_sql(_EFD, False))
def me27(spark, sf):
    return _one(_ev(spark, sf).efd())


@query("me27_extended_efd", _novelty_sql(_EFD, True))
def me27x(spark, sf):
    return _one(_ev(spark, sf).efd(graded=True))


@query("me28_arp", f"WITH {_EV}, l AS (SELECT user, avg(pop) AS v FROM lists JOIN pop USING (item) GROUP BY user) SELECT round(avg(v), 6) AS value FROM l")
def me28(spark, sf):
    return _one(_ev(spark, sf).arp())


# Random lists reach the long tail, popular ones never do.
def _ev_random(spark, sf, cutoffs=K):
    return me.Evaluation(fx.recs_random(spark, sf), fx.test(spark, sf), fx.train(spark, sf), cutoffs, fx.THRESHOLD)


_RANDOM_LISTS = f"""{_draw_sql('train', 20, 7)}, recs_random AS MATERIALIZED (SELECT user, item, 1.0::DOUBLE AS score, pick AS rank FROM picks WHERE pick <= 20)"""
_EVR = f"{_RANDOM_LISTS}, {_EV.replace('FROM recs', 'FROM recs_random')}"
_TAIL = f"{_HEAD}, tail AS (SELECT item FROM pop WHERE item NOT IN (SELECT item FROM head))"
_TAILED = f"""WITH {_EVR}, {_TAIL}, t AS (SELECT user, count(tail.item) AS t, count(*) AS n FROM lists LEFT JOIN tail USING (item) GROUP BY user)"""


@query("me29_aplt", f"{_TAILED} SELECT round(avg(t / n), 6) AS value FROM t")
def me29(spark, sf):
    return _one(_ev_random(spark, sf).aplt())


@query("me29_aclt", f"{_TAILED} SELECT round(avg(t), 6) AS value FROM t")
def me29c(spark, sf):
    return _one(_ev_random(spark, sf).aclt())


def _groups_sql(head_ratio: str) -> str:
    head = _HEAD.replace("0.8::DOUBLE", head_ratio)
    return f"{head}, groups AS (SELECT item, CASE WHEN item IN (SELECT item FROM head) THEN 0 ELSE 1 END AS cluster FROM pop)"


_REO = """num AS (SELECT cluster, count(*) AS num FROM hits JOIN groups USING (item) GROUP BY cluster),
    den AS (SELECT cluster, count(*) AS den FROM rel JOIN groups USING (item) WHERE user IN (SELECT user FROM gated)
            AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user = rel.user AND t.item = rel.item) GROUP BY cluster),
    pr AS (SELECT cluster, coalesce(num, 0) / den AS value FROM den LEFT JOIN num USING (cluster))"""
_RSP = """num AS (SELECT cluster, count(*) AS num FROM lists JOIN groups USING (item) GROUP BY cluster),
    den AS (SELECT cluster, count(*) AS den FROM lens l CROSS JOIN groups g
            WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user = l.user AND t.item = g.item) GROUP BY cluster),
    pr AS (SELECT cluster, coalesce(num, 0) / den AS value FROM den LEFT JOIN num USING (cluster))"""
_SPREAD = "SELECT round(stddev_pop(value) / avg(value), 6) AS value FROM pr"


@query("me30_pop_reo", f"WITH {_EVR}, {_groups_sql('0.8::DOUBLE')}, {_REO} {_SPREAD}")
def me30(spark, sf):
    return _one(_ev_random(spark, sf).pop_reo())


@query("me30_extended_pop_reo", f"WITH {_EVR}, {_groups_sql('0.3::DOUBLE')}, {_REO} {_SPREAD}")
def me30x(spark, sf):
    return _one(_ev_random(spark, sf).pop_reo(0.3))


@query("me31_pop_rsp", f"WITH {_EVR}, {_groups_sql('0.8::DOUBLE')}, {_RSP} {_SPREAD}")
def me31(spark, sf):
    return _one(_ev_random(spark, sf).pop_rsp())


@query("me31_extended_pop_rsp", f"WITH {_EVR}, {_groups_sql('0.3::DOUBLE')}, {_RSP} {_SPREAD}")
def me31x(spark, sf):
    return _one(_ev_random(spark, sf).pop_rsp(0.3))


_CLUSTER_GROUPS = "groups AS (SELECT item, cluster FROM item_clusters)"
_WITH_SPREAD = "SELECT cluster, round(value, 6) AS value FROM pr UNION ALL SELECT -1, round(stddev_pop(value) / avg(value), 6) FROM pr"


def _with_spread(groups):
    """The group values and, as cluster -1, their spread."""
    return rounded(groups.unionByName(me.Evaluation.spread(groups).select(F.lit(-1).cast("bigint").alias("cluster"), "value")), "value")


@query("me32_reo", f"WITH {_EVR}, {_CLUSTER_GROUPS}, {_REO} {_WITH_SPREAD}")
def me32(spark, sf):
    return _with_spread(_ev_random(spark, sf).reo(fx.item_clusters(spark, sf)))


@query("me33_rsp", f"WITH {_EVR}, {_CLUSTER_GROUPS}, {_RSP} {_WITH_SPREAD}")
def me33(spark, sf):
    return _with_spread(_ev_random(spark, sf).rsp(fx.item_clusters(spark, sf)))


_PAIRS = "SELECT round(avg(abs(a.value - b.value)), 6) AS value FROM pc a JOIN pc b ON a.cluster < b.cluster"


@query("me34_user_mad_rating", f"""WITH {_EV}, v AS (SELECT user, avg(score) AS v FROM lists WHERE user IN (SELECT user FROM gated) GROUP BY user),
    pc AS (SELECT cluster, avg(v) AS value FROM v JOIN user_clusters USING (user) GROUP BY cluster) {_PAIRS}""")
def me34(spark, sf):
    return _one(_ev(spark, sf).user_mad_rating(fx.user_clusters(spark, sf)))


_NDCG_USER = f"{_IDEAL}, s AS (SELECT user, sum(gain * disc) AS dcg FROM hits GROUP BY user), nd AS (SELECT user, coalesce(dcg, 0) / idcg AS v FROM gated LEFT JOIN s USING (user) JOIN ideal USING (user))"


@query("me34_user_mad_ranking", f"""WITH {_EV}, {_NDCG_USER},
    pc AS (SELECT cluster, avg(v) AS value FROM nd JOIN user_clusters USING (user) GROUP BY cluster) {_PAIRS}""")
def me34r(spark, sf):
    return _one(_ev(spark, sf).user_mad_ranking(fx.user_clusters(spark, sf)))


def _item_mad_sql(worth: str) -> str:
    return f"""WITH {_EVR}, c AS (SELECT item, count(*) AS c FROM lists WHERE user IN (SELECT user FROM gated) GROUP BY item),
        g AS (SELECT item, sum({worth}) AS g FROM hits GROUP BY item),
        pc AS (SELECT cluster, avg(coalesce(g, 0) / c) AS value FROM c LEFT JOIN g USING (item) JOIN item_clusters USING (item) GROUP BY cluster) {_PAIRS}"""


@query("me35_item_mad_rating", _item_mad_sql("score"))
def me35(spark, sf):
    return _one(_ev_random(spark, sf).item_mad_rating(fx.item_clusters(spark, sf)))


@query("me35_item_mad_ranking", _item_mad_sql("gain"))
def me35r(spark, sf):
    return _one(_ev_random(spark, sf).item_mad_ranking(fx.item_clusters(spark, sf)))


def _disparity_sql(rows: str, out: str, by: int = 1) -> str:
    """The whole grid; with ``by`` 2 every second group and category is empty."""
    users, items = f"(SELECT user, cluster * {by} AS cluster FROM user_clusters)", f"(SELECT item, cluster * {by} AS cluster FROM item_clusters)"
    return f"""{out}_c AS (SELECT u.cluster AS user_cluster, i.cluster AS item_cluster, count(*) AS c FROM {rows} x
          JOIN {users} u ON u.user = x.user JOIN {items} i ON i.item = x.item GROUP BY ALL),
        {out}_t AS (SELECT user_cluster, sum(c) AS total FROM {out}_c GROUP BY user_cluster),
        {out}_s AS (SELECT cluster AS item_cluster, count(*) / (SELECT count(*) FROM item_clusters) AS share FROM {items} GROUP BY cluster),
        {out}_g AS (SELECT a AS user_cluster, b AS item_cluster FROM range((SELECT max(cluster) + 1 FROM {users})) x(a), range((SELECT max(cluster) + 1 FROM {items})) y(b)),
        {out} AS (SELECT g.user_cluster, g.item_cluster, coalesce(coalesce(c, 0) / total / share, 'nan'::DOUBLE) AS value
          FROM {out}_g g LEFT JOIN {out}_t t USING (user_cluster) LEFT JOIN {out}_s s USING (item_cluster)
          LEFT JOIN {out}_c c ON c.user_cluster = g.user_cluster AND c.item_cluster = g.item_cluster)"""


@query("me36_bias_disparity_br", f"WITH {_EV}, {_disparity_sql('lists', 'br')} SELECT user_cluster, item_cluster, round(value, 6) AS value FROM br")
def me36(spark, sf):
    return rounded(_ev(spark, sf).bias_recommended(fx.user_clusters(spark, sf), fx.item_clusters(spark, sf)), "value")


@query("me36_bias_disparity_with_empty_groups", f"WITH {_EV}, {_disparity_sql('lists', 'br', 2)} SELECT user_cluster, item_cluster, isnan(value) AS empty, CASE WHEN isnan(value) THEN 0 ELSE round(value, 6) END AS value FROM br")
def me36_empty(spark, sf):
    users, items = (t.withColumn("cluster", F.col("cluster") * 2) for t in (fx.user_clusters(spark, sf), fx.item_clusters(spark, sf)))
    got = _ev(spark, sf).bias_recommended(users, items)
    return got.select("user_cluster", "item_cluster", F.isnan("value").alias("empty"), F.when(F.isnan("value"), 0.0).otherwise(F.round("value", 6)).alias("value"))


@query("me37_bias_disparity_bs", f"WITH {_disparity_sql('train', 'bs')} SELECT user_cluster, item_cluster, round(value, 6) AS value FROM bs")
def me37(spark, sf):
    return rounded(_ev(spark, sf).bias_source(fx.user_clusters(spark, sf), fx.item_clusters(spark, sf)), "value")


@query("me38_bias_disparity_bd", f"""WITH {_EV}, {_disparity_sql('lists', 'br')}, {_disparity_sql('train', 'bs')}
    SELECT user_cluster, item_cluster, round((br.value - bs.value) / bs.value, 6) AS value FROM br JOIN bs USING (user_cluster, item_cluster)""")
def me38(spark, sf):
    return rounded(_ev(spark, sf).bias_disparity(fx.user_clusters(spark, sf), fx.item_clusters(spark, sf)), "value")


@query("me39_clustered_ndcg", f"WITH {_EV}, {_NDCG_USER} SELECT cluster, round(avg(v), 6) AS value FROM nd JOIN user_clusters USING (user) GROUP BY cluster")
def me39(spark, sf):
    return rounded(_ev(spark, sf).clustered("nDCG", fx.user_clusters(spark, sf)), "value")


@query("me39_clustered_recall", f"""WITH {_EV}, s AS (SELECT user, count(*) AS h FROM hits GROUP BY user)
    SELECT cluster, round(avg({_R}), 6) AS value FROM gated LEFT JOIN s USING (user) JOIN user_clusters USING (user) GROUP BY cluster""")
def me39r(spark, sf):
    return rounded(_ev(spark, sf).clustered("Recall", fx.user_clusters(spark, sf)), "value")


@query("me39_clustered_aplt", f"{_TAILED} SELECT cluster, round(avg(t / n), 6) AS value FROM t JOIN user_clusters USING (user) GROUP BY cluster")
def me39a(spark, sf):
    return rounded(_ev_random(spark, sf).clustered_aplt(fx.user_clusters(spark, sf)), "value")


@query("me40_clustered_gini", f"WITH {_EV}, lc AS (SELECT item, cluster FROM lists JOIN user_clusters USING (user)), {_gini_sql('cluster', 'lc')} SELECT cluster, round(value, 6) AS value FROM g")
def me40(spark, sf):
    return rounded(_ev(spark, sf).gini(fx.user_clusters(spark, sf)), "value")


_CURVE = f"""{_EV}, grid AS (SELECT user, n_rel, n FROM gated, range(1, {K + 1}) t(n)),
    reach AS (SELECT g.user, g.n, n_rel, count(h.rank) AS h, coalesce(sum(disc), 0) AS dcg, coalesce(sum(h.p / h.rank), 0) AS ap
           FROM grid g LEFT JOIN hits h ON h.user = g.user AND h.rank <= g.n GROUP BY ALL)"""
_CURVES = {
    "me41_mm_recall_hr_precision": (["recall", "hr", "precision"], "round(avg(h / n_rel), 6) AS recall, round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr, round(avg(h / n), 6) AS precision"),
    "me42_mm_recall2": (["recall2"], "round(sum(h) / sum(n_rel), 6) AS recall2"),
    "me43_mm_ndcg": (["ndcg"], "round(avg(dcg / list_sum(list_transform(range(1, least(n_rel, n) + 1), lambda r: ln(2) / ln(r + 1)))), 6) AS ndcg"),
    "me44_mm_map": (["map"], "round(avg(ap / least(n_rel, n)), 6) AS map"),
}


def _curve(name: str, columns: list[str], select: str):
    @query(name, f"WITH {_CURVE} SELECT n, {select} FROM reach GROUP BY n")
    def run(spark, sf):
        return longs(rounded(_ev(spark, sf).curves().select("n", *columns), *columns), "n")


for _name, (_columns, _select) in _CURVES.items():
    _curve(_name, _columns, _select)


def _cut_sql(metric: str, k: int) -> str:
    value = {"Precision": f"coalesce(h, 0) / {k}", "Recall": _R}[metric]
    return f"SELECT {k} AS k, '{metric}' AS metric, avg({value}) AS v FROM gated LEFT JOIN (SELECT user, count(*) AS h FROM all_hits WHERE rank <= {k} GROUP BY user) USING (user)"


@query("me45_evaluate_many_cutoffs", f"""WITH {_EV}, r AS ({' UNION ALL '.join(_cut_sql(m, k) for m in ('Precision', 'Recall') for k in (5, 10, 20))})
    SELECT p AS part, k::INTEGER AS k, metric, round(v, 6) AS value FROM r, (VALUES ('test'), ('val')) q(p)""")
def me45(spark, sf):
    out = me.evaluate(fx.recs(spark, sf), fx.test(spark, sf), fx.train(spark, sf), [5, 10, 20], ["precision", "RECALL", "unknown"], fx.THRESHOLD)
    return rounded(out, "value")


# Every single-valued metric by name, next to the SQL of its own query over the same lists.
_ALL = {
    "AUC": "me12_auc", "GAUC": "me13_gauc", "LAUC": "me14_lauc", "MAE": "me15_mae", "MSE": "me16_mse", "RMSE": "me17_rmse", "ItemCoverage": "me19_item_coverage",
    "UserCoverage": "me20_user_coverage", "UserCoverageAtN": "me21_user_coverage_at_n", "Gini": "me23_gini", "SEntropy": "me24_shannon_entropy", "SRecall": "me25_srecall",
    "EPC": "me26_epc", "ExtendedEPC": "me26_extended_epc", "EFD": "me27_efd", "ExtendedEFD": "me27_extended_efd", "ARP": "me28_arp", "APLT": "me29_aplt", "ACLT": "me29_aclt",
    "PopREO": "me30_pop_reo", "PopRSP": "me31_pop_rsp", "ExtendedF1": "me06_extended_f1", "UserMADrating": "me34_user_mad_rating", "UserMADranking": "me34_user_mad_ranking",
    "ItemMADrating": "me35_item_mad_rating", "ItemMADranking": "me35_item_mad_ranking",
}
_ALL_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, value::DOUBLE AS value FROM ({BODIES[q].replace(_EVR, _EV)})" for m, q in _ALL.items())


@query("me45_evaluate_all", f"SELECT p AS part, {K}::INTEGER AS k, metric, round(value, 6) AS value FROM ({_ALL_SQL}), (VALUES ('test'), ('val')) q(p)")
def me45_all(spark, sf):
    inputs = {"features": fx.attribute_ids(spark, sf), "user_clusters": fx.user_clusters(spark, sf), "item_clusters": fx.item_clusters(spark, sf)}
    out = me.evaluate(fx.recs(spark, sf), fx.test(spark, sf), fx.train(spark, sf), [K], list(_ALL), fx.THRESHOLD, **inputs)
    return rounded(out, "value")


@query("re01_binary_relevance", "SELECT user, item, rating FROM rel")
def re01(spark, sf):
    return me.binary_relevance(fx.test(spark, sf), fx.THRESHOLD).select("user", "item", "rating")


@query("re02_discounted_relevance", "SELECT user, item, (2 ** (rating - 3) - 1)::DOUBLE AS gain FROM rel")
def re02(spark, sf):
    return me.discounted_relevance(fx.test(spark, sf), fx.THRESHOLD).select("user", "item", "gain")


@query("re03_log_discount", "SELECT user, item, round(ln(2) / ln(rank + 1), 6) AS discount FROM recs")
def re03(spark, sf):
    return fx.recs(spark, sf).select("user", "item", F.round(me.log_discount("rank"), 6).alias("discount"))


_FLAG = """WITH top AS (SELECT * FROM recs WHERE rank <= 20), rels AS (SELECT user, count(*) AS n_rel FROM rel GROUP BY user),
    h AS (SELECT r.user, count(*) AS h, sum((2 ** (l.rating - 3) - 1) * ln(2) / ln(r.rank + 1)) AS dcg FROM top r JOIN rel l ON r.user = l.user AND r.item = l.item GROUP BY r.user),
    ideal AS (SELECT user, sum((2 ** (rating - 3) - 1) * ln(2) / ln(r + 1)) AS idcg FROM
      (SELECT user, rating, row_number() OVER (PARTITION BY user ORDER BY rating DESC) AS r FROM rel) WHERE r <= 20 GROUP BY user),
    u AS (SELECT DISTINCT user FROM top)
    SELECT 20 AS k, round(avg(coalesce(h, 0) / n_rel), 6) AS "Recall", round(avg(coalesce(dcg, 0) / idcg), 6) AS "nDCG",
           round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS "HR"
    FROM u JOIN rels USING (user) JOIN ideal USING (user) LEFT JOIN h USING (user)"""


@query("entry_holdout_popular_eval", _FLAG)
def flagship(spark, sf):
    """From the raw tables to the three headline metrics; interactions and split are each written once."""
    inter = materialise(fx.interactions(spark, sf), "interactions")
    split = materialise(sp.temporal_holdout(inter, 0.2), "split")
    train, test = sp.part_of(split, "train"), sp.part_of(split, "test")
    ev = me.Evaluation(un.most_popular(train, 20), test, train, 20, fx.THRESHOLD)
    return rounded(ev.values(["Recall", "nDCG", "HR"]), "Recall", "nDCG", "HR")
