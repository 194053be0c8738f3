"""Queries on cleaning, prefilters, splits, sampling and popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import clean as cl
from tastegrid.operators import prefilter as pf
from tastegrid.operators import sampling as ns
from tastegrid.operators import split as sp
from tastegrid.operators import unpersonalised as un
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import longs, query, rounded

# --- cleaning -----------------------------------------------------------------------------------------


@query("cl01_drop_incomplete_and_dup", """
    SELECT user, item, ts, orderkey, line, rating FROM (
      SELECT *, row_number() OVER (PARTITION BY user, item, ts ORDER BY orderkey, line, rating) AS rn
      FROM raw_ratings WHERE user IS NOT NULL AND item IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1""")
def cl01(spark, sf):
    return cl.drop_incomplete_and_dup(fx.raw_ratings(spark, sf), ["orderkey", "line"])


@query("cl02_binarize", "SELECT user, item, 1.0::DOUBLE AS rating, ts FROM interactions")
def cl02(spark, sf):
    return cl.binarize(fx.interactions(spark, sf).withColumn("rating", F.lit(None).cast("double")))


@query("cl03_last_rating_wins", """
    SELECT user, item, rating, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY user, item ORDER BY ts DESC, orderkey DESC, line DESC, rating DESC) AS rn
      FROM raw_ratings) WHERE rn = 1""")
def cl03(spark, sf):
    return cl.last_rating_wins(fx.raw_ratings(spark, sf), ["ts", "orderkey", "line"])


@query("cl04_reindex", """
    SELECT (dense_rank() OVER (ORDER BY user) - 1)::BIGINT AS user_idx,
           (dense_rank() OVER (ORDER BY item) - 1)::BIGINT AS item_idx, rating, ts FROM interactions""")
def cl04(spark, sf):
    return cl.reindex(fx.interactions(spark, sf))


@query("cl05_dataset_stats", """
    SELECT users, items, rows, round(1 - rows / (users * items), 6) AS sparsity,
           round(rows / users, 6) AS per_user, round(rows / items, 6) AS per_item
    FROM (SELECT count(DISTINCT user) AS users, count(DISTINCT item) AS items, count(*) AS rows FROM interactions)""")
def cl05(spark, sf):
    return rounded(cl.dataset_stats(fx.interactions(spark, sf)), "sparsity", "per_user", "per_item")


@query("cl06_drop_cold_users", """
    SELECT * FROM test WHERE user IN (SELECT user FROM train WHERE rating >= 5)""")
def cl06(spark, sf):
    return cl.drop_cold_users(fx.test(spark, sf), fx.train(spark, sf).filter(F.col("rating") >= 5))


def _align_sql(base: str, out: str, rounds: int = 8) -> str:
    """The same fixed point, written out round by round."""
    steps = [f"u0 AS (SELECT DISTINCT user FROM {base})", f"i0 AS (SELECT DISTINCT item FROM {base})",
             "pairs AS (SELECT DISTINCT user, item FROM test WHERE rating >= 5)",
             "known AS (SELECT id AS item FROM visual)"]
    for r in range(rounds):
        live = f"SELECT p.user, p.item FROM pairs p JOIN u{r} USING (user) JOIN i{r} USING (item) JOIN known USING (item)"
        steps.append(f"p{r} AS MATERIALIZED ({live})")
        steps.append(f"u{r + 1} AS MATERIALIZED (SELECT DISTINCT user FROM p{r})")
        steps.append(f"i{r + 1} AS MATERIALIZED (SELECT DISTINCT item FROM p{r})")
    return (f"WITH {', '.join(steps)} SELECT x.* FROM {out} x "
            f"WHERE user IN (SELECT user FROM u{rounds}) AND item IN (SELECT item FROM i{rounds})")


def _sides(spark, sf):
    loved = fx.test(spark, sf).filter(F.col("rating") >= 5).select("user", "item").distinct()
    return [fx.visual(spark, sf).select(F.col("id").alias("item")), loved]


@query("cl07_align_side_info", _align_sql("interactions", "interactions"))
def cl07(spark, sf):
    return cl.align_side_info(fx.interactions(spark, sf), _sides(spark, sf))[0]


@query("cl08_align_with_train", _align_sql("train", "test"))
def cl08(spark, sf):
    return cl.align_with_train(fx.train(spark, sf), [fx.test(spark, sf)], _sides(spark, sf))[1][0]


@query("cl09_reindex_features", """
    SELECT i.idx, m.title, m.brand FROM metadata m
    JOIN (SELECT item, (row_number() OVER (ORDER BY item) - 1)::BIGINT AS idx
          FROM (SELECT DISTINCT item FROM test WHERE rating >= 5)) i USING (item)""")
def cl09(spark, sf):
    ids = cl.id_map(fx.test(spark, sf).filter(F.col("rating") >= 5), "item")
    return cl.reindex_features(fx.metadata(spark, sf).select("item", "title", "brand"), ids)


@query("cl10_feature_item_diff", """
    SELECT id AS item FROM visual WHERE id NOT IN (SELECT item FROM test WHERE rating >= 5)""")
def cl10(spark, sf):
    feats = fx.visual(spark, sf).withColumnRenamed("id", "item")
    return cl.feature_item_diff(feats, fx.test(spark, sf).filter(F.col("rating") >= 5))


@query("cl11_compose_item_text", """
    SELECT item, replace(coalesce(title, ' ') || ' ' || coalesce(brand, ' ') || ' '
             || CASE WHEN categories IS NULL THEN '' ELSE array_to_string(categories, ' ') || ' ' END
             || coalesce(description, ' '), chr(10), ' ') AS text FROM metadata""")
def cl11(spark, sf):
    return fx.metadata(spark, sf).select("item", cl.compose_item_text().alias("text"))


@query("cl12_count_null_combinations", """
    SELECT count(*) FILTER (title IS NULL) AS no_title, count(*) FILTER (description IS NULL) AS no_description,
           count(*) FILTER (description IS NULL AND title IS NULL) AS no_both,
           count(*) FILTER (description IS NULL AND title IS NULL AND brand IS NULL) AS no_three,
           count(*) FILTER (description IS NULL AND title IS NULL AND brand IS NULL AND categories IS NULL) AS no_four
    FROM metadata""")
def cl12(spark, sf):
    return cl.count_null_combinations(fx.metadata(spark, sf))


@query("cl13_merge_splits", "SELECT count(*) AS rows, count(DISTINCT item) AS items FROM interactions")
def cl13(spark, sf):
    whole = cl.merge_splits(fx.train(spark, sf), fx.test(spark, sf))
    return whole.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("item").alias("items"))


# --- prefilters ---------------------------------------------------------------------------------------


@query("pf01_global_threshold", "SELECT * FROM interactions WHERE rating >= 3")
def pf01(spark, sf):
    return pf.global_threshold(fx.interactions(spark, sf), 3.0)


@query("pf02_global_average", "SELECT * FROM interactions WHERE rating >= (SELECT avg(rating) FROM interactions)")
def pf02(spark, sf):
    return pf.global_average(fx.interactions(spark, sf))


@query("pf03_user_average", """
    SELECT user, item, rating, ts FROM (SELECT *, avg(rating) OVER (PARTITION BY user) AS m FROM interactions) WHERE rating >= m""")
def pf03(spark, sf):
    return pf.user_average(fx.interactions(spark, sf))


@query("pf04_user_k_core", """
    SELECT user, item, rating, ts FROM (SELECT *, count(*) OVER (PARTITION BY user) AS n FROM interactions) WHERE n >= 40""")
def pf04(spark, sf):
    return pf.user_k_core(fx.interactions(spark, sf), 40)


@query("pf04_item_k_core", """
    SELECT user, item, rating, ts FROM (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM interactions) WHERE n >= 30""")
def pf04_item(spark, sf):
    return pf.item_k_core(fx.interactions(spark, sf), 30)


def _core_sql(rounds: int, user_rule: str, item_rule: str, both: bool) -> str:
    steps = ["r0 AS (SELECT * FROM interactions)"]
    for r in range(rounds):
        if both:
            steps.append(f"r{r + 1} AS MATERIALIZED (SELECT * EXCLUDE (nu, ni) FROM (SELECT *, count(*) OVER (PARTITION BY user) AS nu, "
                         f"count(*) OVER (PARTITION BY item) AS ni FROM r{r}) WHERE {user_rule} AND {item_rule})")
        else:
            steps.append(f"h{r} AS MATERIALIZED (SELECT * EXCLUDE (nu) FROM (SELECT *, count(*) OVER (PARTITION BY user) AS nu FROM r{r}) WHERE {user_rule})")
            steps.append(f"r{r + 1} AS MATERIALIZED (SELECT * EXCLUDE (ni) FROM (SELECT *, count(*) OVER (PARTITION BY item) AS ni FROM h{r}) WHERE {item_rule})")
    return f"WITH {', '.join(steps)} SELECT user, item, rating, ts FROM r{rounds}"


@query("pf05_iterative_k_core", _core_sql(12, "nu >= 23", "ni >= 23", False))
def pf05(spark, sf):
    return pf.iterative_k_core(fx.interactions(spark, sf), 23)


@query("pf06_n_rounds_k_core", _core_sql(2, "nu >= 25", "ni >= 25", False))
def pf06(spark, sf):
    return pf.n_rounds_k_core(fx.interactions(spark, sf), 25, 2)


@query("pf07_cold_users", """
    SELECT user, item, rating, ts FROM (SELECT *, count(*) OVER (PARTITION BY user) AS n FROM interactions) WHERE n <= 35""")
def pf07(spark, sf):
    return pf.cold_users(fx.interactions(spark, sf), 35)


@query("pf08_k_core_simultaneous", _core_sql(12, "nu BETWEEN 15 AND 60", "ni >= 15", True))
def pf08(spark, sf):
    return pf.k_core_simultaneous(fx.interactions(spark, sf), 15, 15, max_user=60)


@query("pf00_prefilter_list", """
    WITH a AS (SELECT * FROM interactions WHERE rating >= 2)
    SELECT user, item, rating, ts FROM (SELECT *, count(*) OVER (PARTITION BY user) AS n FROM a) WHERE n >= 30""")
def pf00(spark, sf):
    return pf.prefilter(fx.interactions(spark, sf), [("global_threshold", {"threshold": 2.0}), ("user_k_core", {"k": 30})])


# --- splits -------------------------------------------------------------------------------------------


@query("sp01_fixed_timestamp", """
    SELECT *, CASE WHEN ts >= 10000 THEN 'test' ELSE 'train' END AS part FROM interactions""")
def sp01(spark, sf):
    return sp.fixed_timestamp(fx.interactions(spark, sf), 10000)


_BEST_TS = """
    numbered AS (SELECT user, ts, row_number() OVER (PARTITION BY user ORDER BY ts, item) AS p, count(*) OVER (PARTITION BY user) AS n FROM interactions),
    spans AS (SELECT user, max(CASE WHEN p = 5 THEN ts END) AS lo, max(CASE WHEN p = n - 5 + 1 THEN ts END) AS hi FROM numbered GROUP BY user),
    stamps AS (SELECT DISTINCT ts FROM interactions),
    scored AS (SELECT s.ts, count(x.user) AS users FROM stamps s LEFT JOIN spans x ON x.lo < s.ts AND s.ts <= x.hi GROUP BY s.ts),
    best AS (SELECT ts, users FROM scored ORDER BY users DESC, ts DESC LIMIT 1)"""


@query("sp02_best_timestamp_value", f"WITH {_BEST_TS} SELECT ts, users::BIGINT AS users FROM best")
def sp02_value(spark, sf):
    return longs(sp.best_timestamp_value(fx.interactions(spark, sf), 5, 5), "users")


@query("sp02_best_timestamp", f"""WITH {_BEST_TS}
    SELECT user, item, rating, ts, CASE WHEN ts >= (SELECT ts FROM best) THEN 'test' ELSE 'train' END AS part FROM interactions""")
def sp02(spark, sf):
    return sp.best_timestamp(fx.interactions(spark, sf), 5, 5)


@query("sp03_temporal_holdout", "SELECT * FROM holdout")
def sp03(spark, sf):
    return sp.temporal_holdout(fx.interactions(spark, sf), 0.2)


@query("sp04_temporal_leave_n_out", """
    SELECT user, item, rating, ts, CASE WHEN row_number() OVER (PARTITION BY user ORDER BY ts DESC, item DESC) <= 2
           THEN 'test' ELSE 'train' END AS part FROM interactions""")
def sp04(spark, sf):
    return sp.temporal_leave_n_out(fx.interactions(spark, sf), 2)


_SHUFFLED = """shuffled AS (
      SELECT user, item, rating, ts, f::INTEGER AS test_fold,
             row_number() OVER (PARTITION BY user, f ORDER BY md5(concat_ws('|', 42, f, user, item)), item) AS p,
             count(*) OVER (PARTITION BY user, f) AS n
      FROM interactions, range(2) t(f))"""


@query("sp05_random_subsampling", f"""WITH {_SHUFFLED}
    SELECT user, item, rating, ts, test_fold, CASE WHEN p <= n - floor(n * (1 - 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM shuffled""")
def sp05(spark, sf):
    return sp.random_subsampling(fx.interactions(spark, sf), 2, 0.2)


@query("sp06_random_leave_n_out", f"""WITH {_SHUFFLED}
    SELECT user, item, rating, ts, test_fold, CASE WHEN p <= 3 THEN 'test' ELSE 'train' END AS part FROM shuffled""")
def sp06(spark, sf):
    return sp.random_leave_n_out(fx.interactions(spark, sf), 2, 3)


@query("sp07_k_folds", """
    WITH own AS (SELECT *, (row_number() OVER (PARTITION BY user ORDER BY ts, item) - 1) % 5 AS o FROM interactions)
    SELECT user, item, rating, ts, f::INTEGER AS test_fold, CASE WHEN o = f THEN 'test' ELSE 'train' END AS part
    FROM own, range(5) t(f)""")
def sp07(spark, sf):
    return sp.k_folds(fx.interactions(spark, sf), 5)


@query("sp08_nested", """
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY ts, item) AS p, count(*) OVER (PARTITION BY user) AS n FROM train)
    SELECT user, item, rating, ts, CASE WHEN p > floor(n * (1 - 0.25::DOUBLE)) THEN 'val' ELSE 'train' END AS part FROM t
    UNION ALL SELECT user, item, rating, ts, 'test' FROM test""")
def sp08(spark, sf):
    return sp.nested(fx.holdout(spark, sf), 0.25)


@query("sp08_nested_k_folds", f"""WITH {_SHUFFLED},
    o AS MATERIALIZED (SELECT user, item, rating, ts, test_fold, CASE WHEN p <= n - floor(n * (1 - 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM shuffled),
    own AS (SELECT *, (row_number() OVER (PARTITION BY test_fold, user ORDER BY ts, item) - 1) % 3 AS f FROM o WHERE part = 'train')
    SELECT user, item, rating, ts, test_fold, CASE WHEN own.f = t.f THEN 'val' ELSE 'train' END AS part, t.f::INTEGER AS val_fold FROM own, range(3) t(f)
    UNION ALL SELECT *, -1 FROM o WHERE part = 'test'""")
def sp08_k_folds(spark, sf):
    """Two random hold-outs, each validated by three folds."""
    return sp.nested_by(sp.random_subsampling(fx.interactions(spark, sf), 2, 0.2), sp.k_folds, 3)


@query("sp08_nested_random", """
    WITH s AS (SELECT user, item, rating, ts, f, row_number() OVER (PARTITION BY f, user ORDER BY md5(concat_ws('|', 7, f, user, item)), item) AS p FROM train, range(2) t(f))
    SELECT user, item, rating, ts, CASE WHEN p <= 2 THEN 'val' ELSE 'train' END AS part, f::INTEGER AS val_fold FROM s
    UNION ALL SELECT user, item, rating, ts, 'test', -1 FROM test""")
def sp08_random(spark, sf):
    """The temporal hold-out, validated twice by two random rows of every user."""
    return sp.nested_by(fx.holdout(spark, sf), sp.random_leave_n_out, 2, 2, seed=7)


@query("sp08_nested_timestamp", f"""WITH {_SHUFFLED},
    o AS MATERIALIZED (SELECT user, item, rating, ts, test_fold, CASE WHEN p <= 3 THEN 'test' ELSE 'train' END AS part FROM shuffled)
    SELECT user, item, rating, ts, test_fold, CASE WHEN part = 'test' THEN 'test' WHEN ts >= 9900 THEN 'val' ELSE 'train' END AS part, CASE WHEN part = 'test' THEN -1 ELSE 0 END AS val_fold FROM o""")
def sp08_timestamp(spark, sf):
    return sp.nested_by(sp.random_leave_n_out(fx.interactions(spark, sf), 2, 3), sp.fixed_timestamp, 9900)


@query("sp09_global_quantile_split", """
    WITH q AS (SELECT quantile_cont(ts, 0.8) AS a, quantile_cont(ts, 0.8 + 0.1) AS b FROM interactions)
    SELECT user, item, rating, ts, CASE WHEN ts < a THEN 0 WHEN ts < b THEN 1 ELSE 2 END::INTEGER AS x_label FROM interactions, q""")
def sp09(spark, sf):
    return sp.global_quantile_split(fx.interactions(spark, sf), [0.8, 0.1, 0.1])


@query("sp10_per_user_ratio_split", """
    WITH s AS (SELECT user, item, rating, ts, count(*) OVER (PARTITION BY user) AS n,
                      row_number() OVER (PARTITION BY user ORDER BY md5(concat_ws('|', 42, user, item)), item) AS p FROM interactions),
    h AS (SELECT *, CASE WHEN n < 10 THEN 2 ELSE floor(n * 0.2::DOUBLE)::INTEGER END AS held FROM s),
    v AS (SELECT *, CASE WHEN n < 10 THEN 1 ELSE held // 2 END AS val FROM h)
    SELECT user, item, rating, ts, CASE WHEN p <= n - held THEN 0 WHEN p <= n - held + val THEN 1 ELSE 2 END::INTEGER AS x_label FROM v""")
def sp10(spark, sf):
    return sp.per_user_ratio_split(fx.interactions(spark, sf))


@query("sp11_split_by_label", """
    WITH q AS (SELECT quantile_cont(ts, 0.8) AS a, quantile_cont(ts, 0.8 + 0.1) AS b FROM interactions)
    SELECT user, item, rating, ts FROM interactions, q WHERE ts >= a AND ts < b""")
def sp11(spark, sf):
    return sp.split_by_label(sp.global_quantile_split(fx.interactions(spark, sf), [0.8, 0.1, 0.1]), 1)


# --- popularity ---------------------------------------------------------------------------------------

_HEAD = """covered AS (SELECT item, pop, sum(pop) OVER (ORDER BY pop DESC, item ROWS UNBOUNDED PRECEDING) - pop AS before FROM pop),
    head AS (SELECT item, pop FROM covered WHERE before < 0.8::DOUBLE * (SELECT count(*) FROM train))"""


@query("po01_item_popularity", "SELECT item, pop FROM pop")
def po01(spark, sf):
    return un.item_popularity(fx.train(spark, sf))


@query("po02_short_head", f"WITH {_HEAD} SELECT item, pop FROM head")
def po02(spark, sf):
    return un.short_head(fx.train(spark, sf), 0.8)


@query("po03_long_tail", f"WITH {_HEAD} SELECT item, pop FROM pop WHERE item NOT IN (SELECT item FROM head)")
def po03(spark, sf):
    return un.long_tail(fx.train(spark, sf), 0.8)


@query("rc02_most_popular", "SELECT user, item, score, rank::INTEGER AS rank FROM recs")
def rc02(spark, sf):
    return un.most_popular(fx.train(spark, sf), 20)


def _pick(seed: int, tag: str, *keys: str) -> str:
    """md5 of seed, tag and keys as an integer in SQL."""
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {tag}{', ' if keys and tag else ''}{', '.join(keys)})), 1, 8))::BIGINT"


_CATALOGUE = "catalogue AS MATERIALIZED (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM train)), size AS (SELECT count(*) AS n FROM catalogue)"


def _draw_sql(seen: str, n: int, seed: int) -> str:
    return f"""{_CATALOGUE},
    tries AS (SELECT u.user, t, {_pick(seed, '', 'u.user', 't')} % (SELECT n FROM size) AS idx FROM train_users u, range({2 * n + 16}) r(t)),
    drawn_hits AS (SELECT user, item, min(t) AS t FROM tries JOIN catalogue USING (idx)
             WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user = tries.user AND s.item = catalogue.item) GROUP BY user, item),
    picks AS (SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY t) AS pick FROM drawn_hits)"""


@query("rc03_random_recs", f"WITH {_draw_sql('train', 10, 42)} SELECT user, item, 1.0::DOUBLE AS score, pick::INTEGER AS rank FROM picks WHERE pick <= 10")
def rc03(spark, sf):
    return un.random_recs(fx.train(spark, sf), 10)


# --- negative sampling and training rows --------------------------------------------------------------


@query("ns01_unrated_candidates", """
    SELECT u.user, count(*) AS n, min(p.item) AS least, max(p.item) AS most, sum(p.item)::BIGINT AS total
    FROM train_users u CROSS JOIN pop p
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user = u.user AND t.item = p.item) GROUP BY u.user""")
def ns01(spark, sf):
    tr = fx.train(spark, sf)
    runs = ns.unseen_gaps(tr.select("user"), tr.select("item"), tr)
    return runs.groupBy("user").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))


@query("ns02_random_negatives", f"WITH {_draw_sql('interactions', 10, 42)} SELECT user, item FROM picks WHERE pick <= 10")
def ns02(spark, sf):
    return ns.random_negatives(fx.train(spark, sf), fx.test(spark, sf), 10)


@query("ns03_candidate_mask", f"""WITH {_draw_sql('interactions', 10, 42)}
    SELECT user, item FROM picks WHERE pick <= 10 UNION SELECT user, item FROM test""")
def ns03(spark, sf):
    tr, te = fx.train(spark, sf), fx.test(spark, sf)
    return ns.candidate_mask(ns.random_negatives(tr, te, 10), te)


# Draws listed by the SQL for each negative; far more than the first round of the engine needs.
_TRIES = 24


def _negative_sql(rows: str, keys: str, out: str) -> str:
    """Rows with their first unseen draw."""
    return f"""SELECT * EXCLUDE (rn, t, idx) FROM (
        SELECT x.*, c.item AS {out}, row_number() OVER (PARTITION BY {keys} ORDER BY x.t) AS rn
        FROM (SELECT r.*, t, {_pick(42, "'neg'", *[k.strip() for k in keys.split(',')], 't')} % (SELECT n FROM size) AS idx FROM {rows} r, range({_TRIES}) q(t)) x
        JOIN catalogue c USING (idx)
        WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user = x.user AND s.item = c.item)) WHERE rn = 1"""


_SAMPLER = f"""{_CATALOGUE},
    profile AS MATERIALIZED (SELECT user, item, rating, row_number() OVER (PARTITION BY user ORDER BY item) - 1 AS pos FROM train),
    drawable AS MATERIALIZED (SELECT user, n, row_number() OVER (ORDER BY user) - 1 AS u FROM train_users WHERE n < (SELECT n FROM size)),
    event_at AS MATERIALIZED (SELECT e AS event, {_pick(42, "'user'", 'e')} % (SELECT count(*) FROM drawable) AS u FROM range(EVENTS) r(e)),
    events_drawn AS MATERIALIZED (SELECT event, user, n, {_pick(42, "'item'", 'event')} % n AS pos FROM event_at JOIN drawable USING (u)),
    positives AS MATERIALIZED (SELECT event, user, item, rating FROM events_drawn JOIN profile USING (user, pos))"""


_EPOCH = "(SELECT count(*) FROM train)"
_ONE_EACH = "(SELECT count(*) FROM train_users)"


def _sampler_sql(events: str, body: str) -> str:
    return f"WITH {_SAMPLER.replace('EVENTS', events)}, {body}"


def _sampler(spark, sf):
    return ns.Sampler(fx.train(spark, sf))


def _n_events(spark, sf):
    """As many draws as there are training rows: one epoch."""
    return fx.train(spark, sf).count()


def _n_users(spark, sf):
    """As many draws as there are users."""
    return fx.train(spark, sf).select("user").distinct().count()


_PAIRWISE = f"base AS (SELECT event, user, item FROM positives), triples_drawn AS ({_negative_sql('base', 'event', 'negative')})"


@query("ns04_pairwise_triples", _sampler_sql(_EPOCH, f"{_PAIRWISE} SELECT event, user, item, negative FROM triples_drawn"))
def ns04(spark, sf):
    return _sampler(spark, sf).pairwise(_n_events(spark, sf))


@query("ns05_pairwise_per_interaction", _sampler_sql("1", f"base AS (SELECT user, item AS of FROM train), drawn AS ({_negative_sql('base', 'user, of', 'negative')}) SELECT user, of AS item, negative FROM drawn"))
def ns05(spark, sf):
    return _sampler(spark, sf).per_interaction()


def _pointwise_sql(ratio: int, label: str) -> str:
    return _sampler_sql(_EPOCH, f"""coins AS (SELECT event, user, {_pick(42, "'coin'", 'event')} % {ratio + 1} AS coin FROM events_drawn),
        base AS (SELECT event, user FROM coins WHERE coin <> 0), drawn AS ({_negative_sql('base', 'event', 'item')})
        SELECT p.event, p.user, p.item, {label} AS label FROM positives p JOIN coins c USING (event) WHERE coin = 0
        UNION ALL SELECT event, user, item, 0.0::DOUBLE FROM drawn""")


@query("ns06_pointwise_pos_neg", _pointwise_sql(1, "1.0::DOUBLE"))
def ns06(spark, sf):
    return _sampler(spark, sf).pointwise(_n_events(spark, sf))


@query("ns07_pointwise_ratings", _pointwise_sql(3, "rating"))
def ns07(spark, sf):
    return _sampler(spark, sf).pointwise(_n_events(spark, sf), ratio=3, ratings=True)


@query("ns08_positives_plus_m_negatives", _sampler_sql("1", f"""
    base AS (SELECT user, item AS of, d AS draw FROM train, range(1, 3) q(d)), drawn AS ({_negative_sql('base', 'user, of, draw', 'item')})
    SELECT user, item, 1.0::DOUBLE AS label FROM train UNION ALL SELECT user, item, 0.0 FROM drawn"""))
def ns08(spark, sf):
    return _sampler(spark, sf).positives_plus_negatives(2)


@query("ns09_positives_plus_linear_negatives", f"""WITH {_CATALOGUE},
    d AS (SELECT t.user, {_pick(42, "'linear'", 't.user', 't.item', 'd')} % (SELECT n FROM size) AS idx FROM train t, range(1, 3) q(d))
    SELECT user, item, 1.0::DOUBLE AS label FROM train
    UNION ALL SELECT DISTINCT user, item, 0.0::DOUBLE FROM d JOIN catalogue USING (idx)""")
def ns09(spark, sf):
    return _sampler(spark, sf).positives_plus_linear(2)


@query("ns10_zero_reconstruction_masks", _sampler_sql(_ONE_EACH, f"""
    base AS (SELECT event, user, k AS kind, d AS draw FROM events_drawn, (VALUES ('zero', 0.01), ('mask', 0.02)) w(k, share),
             range(1, 1 + (SELECT n FROM size)) q(d) WHERE d <= floor(share::DOUBLE * (SELECT n FROM size))),
    drawn AS ({_negative_sql('base', 'event, kind, draw', 'item')})
    SELECT DISTINCT event, user, kind, item FROM drawn
    UNION ALL SELECT e.event, e.user, 'mask', t.item FROM events_drawn e JOIN train t USING (user)"""))
def ns10(spark, sf):
    return _sampler(spark, sf).zero_reconstruction(_n_users(spark, sf), 0.01, 0.02)


@query("ns11_positive_samples_with_ratings", _sampler_sql(_ONE_EACH, """
    x AS (SELECT 1) SELECT p.event, p.user, p.item, p.rating, t.item AS profile_item, t.rating AS profile_rating
    FROM positives p JOIN train t USING (user)"""))
def ns11(spark, sf):
    s = _sampler(spark, sf)
    return s.with_profile(s.positives(s.events(_n_users(spark, sf))))


def _two_hop_sql(of: str, by: str) -> str:
    return f"""SELECT a.{of} AS id, count(DISTINCT b.{of}) AS neighbours, sum(DISTINCT b.{of})::BIGINT AS total
        FROM train a JOIN train b ON a.{by} = b.{by} AND a.{of} <> b.{of} GROUP BY a.{of}"""


def _two_hop(spark, sf, of):
    pairs = ns.two_hop_neighbours(fx.train(spark, sf), of)
    return pairs.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"), F.sum("j").alias("total"))


@query("ns12_two_hop_users", _two_hop_sql("user", "item"))
def ns12(spark, sf):
    return _two_hop(spark, sf, "user")


@query("ns12_two_hop_items", _two_hop_sql("item", "user"))
def ns12_items(spark, sf):
    return _two_hop(spark, sf, "item")


@query("ns13_neighbourhood_samples", f"""WITH {_CATALOGUE},
    near AS MATERIALIZED (SELECT DISTINCT a.item AS i, b.item AS j FROM train a JOIN train b ON a.user = b.user AND a.item <> b.item),
    sized AS (SELECT i AS id, count(*) AS n, arg_min(j, md5(concat_ws('|', 42, 'near', i, j))) AS neighbour FROM near GROUP BY i),
    base AS (SELECT id, neighbour FROM sized WHERE n / (SELECT n FROM size) <= 0.8),
    far AS (SELECT id, neighbour, stranger FROM (
        SELECT x.id, x.neighbour, c.item AS stranger, row_number() OVER (PARTITION BY x.id ORDER BY t) AS rn
        FROM (SELECT b.*, t, {_pick(42, "'far'", 'id', 't')} % (SELECT n FROM size) AS idx FROM base b, range(200) q(t)) x
        JOIN catalogue c USING (idx) WHERE NOT EXISTS (SELECT 1 FROM near s WHERE s.i = x.id AND s.j = c.item)) WHERE rn = 1)
    SELECT c.item AS id, coalesce(neighbour, 0) AS neighbour, coalesce(stranger, 0) AS stranger FROM catalogue c LEFT JOIN far ON far.id = c.item""")
def ns13(spark, sf):
    return ns.neighbourhood_samples(fx.train(spark, sf), "item")


_INDICATORS = """
    users_at AS (SELECT user, row_number() OVER (ORDER BY user) - 1 AS c FROM train_users),
    widths AS (SELECT (SELECT count(*) FROM train_users) AS nu, (SELECT n FROM size) AS ni),
    wide AS (SELECT event, c AS "column" FROM sampled JOIN users_at USING (user)
        UNION ALL SELECT event, idx + nu FROM sampled JOIN catalogue USING (item), widths
        UNION ALL SELECT event, feature_id + nu + ni FROM sampled JOIN attribute_ids USING (item), widths)"""


@query("ns14_wide_features", _sampler_sql(_EPOCH, f"sampled AS (SELECT event, user, item FROM positives), {_INDICATORS} SELECT event, \"column\" FROM wide"))
def ns14(spark, sf):
    s = _sampler(spark, sf)
    return s.indicator_rows(s.positives(s.events(_n_events(spark, sf))), fx.attribute_ids(spark, sf))


@query("ns15_pairwise_with_profile", _sampler_sql(_ONE_EACH, f"""{_PAIRWISE}
    SELECT x.event, x.user, x.item, x.negative, t.item AS profile_item, t.rating AS profile_rating FROM triples_drawn x JOIN train t USING (user)"""))
def ns15(spark, sf):
    s = _sampler(spark, sf)
    return s.with_profile(s.pairwise(_n_users(spark, sf)))


@query("ns16_fm_rows", _sampler_sql(_EPOCH, f"""
    coins AS (SELECT event, user, {_pick(42, "'coin'", 'event')} % 2 AS coin FROM events_drawn),
    base AS (SELECT event, user FROM coins WHERE coin <> 0), drawn AS ({_negative_sql('base', 'event', 'item')}),
    sampled AS MATERIALIZED (SELECT p.event, p.user, p.item, 1.0::DOUBLE AS label FROM positives p JOIN coins c USING (event) WHERE coin = 0
        UNION ALL SELECT event, user, item, 0.0::DOUBLE FROM drawn), {_INDICATORS}
    SELECT event, "column", label FROM wide JOIN sampled USING (event)"""))
def ns16(spark, sf):
    s = _sampler(spark, sf)
    rows = s.pointwise(_n_events(spark, sf))
    return s.indicator_rows(rows, fx.attribute_ids(spark, sf)).join(rows.select("event", "label"), "event")
