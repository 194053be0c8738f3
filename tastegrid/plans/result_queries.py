"""Queries on significance tests and result tables. Folds are user clusters; models are the popular lists, the
popular lists at half length, and random lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import metrics as me
from tastegrid.operators import results as rs
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import query, rounded
from tastegrid.plans.prepare_queries import _draw_sql
from tastegrid.session import fresh_path
from tastegrid.sources import files as io

_METRICS = ["Precision", "Recall", "MRR"]
_MODELS = f"""{_draw_sql('train', 20, 7)}, rels AS (SELECT user, count(*) AS n_rel FROM rel GROUP BY user),
    lists AS (SELECT 'popular' AS model, user, item, rank, 10 AS k FROM recs WHERE rank <= 10 UNION ALL SELECT 'short', user, item, rank, 5 FROM recs WHERE rank <= 5
      UNION ALL SELECT 'random', user, item, pick, 10 FROM picks WHERE pick <= 10),
    owners AS (SELECT DISTINCT model, k, user FROM lists),
    hit AS (SELECT l.model, l.user, count(*) AS h, min(l.rank) AS f FROM lists l JOIN rel r ON r.user = l.user AND r.item = l.item GROUP BY ALL),
    users AS MATERIALIZED (SELECT model, k, user, coalesce(h, 0) / k AS "Precision", coalesce(h, 0) / n_rel AS "Recall", coalesce(1.0::DOUBLE / f, 0) AS "MRR"
      FROM owners JOIN rels USING (user) LEFT JOIN hit USING (model, user)),
    folded AS MATERIALIZED (SELECT model, k, cluster AS fold, avg("Precision") AS "Precision", avg("Recall") AS "Recall", avg("MRR") AS "MRR" FROM users JOIN user_clusters USING (user) GROUP BY ALL),
    long AS MATERIALIZED (UNPIVOT folded ON "Precision", "Recall", "MRR" INTO NAME metric VALUE value)"""


def _users(spark, sf):
    """(model, k, user, metrics) of the three models."""
    te, tr = fx.test(spark, sf), fx.train(spark, sf)
    out = None
    for model, lists, k in (("popular", fx.recs(spark, sf), 10), ("short", fx.recs(spark, sf), 5), ("random", fx.recs_random(spark, sf), 10)):
        rows = me.Evaluation(lists, te, tr, k, fx.THRESHOLD).per_user(_METRICS).withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    return out


def _values(spark, sf, metric):
    return _users(spark, sf).select("model", "user", F.col(metric).alias("value"))


def _long(spark, sf):
    """(model, k, fold, metric, value)."""
    folds = _users(spark, sf).join(fx.user_clusters(spark, sf), "user").groupBy("model", "k", F.col("cluster").alias("fold"))
    return folds.agg(*[F.avg(m).alias(m) for m in _METRICS]).unpivot(["model", "k", "fold"], _METRICS, "metric", "value")


def _pair(spark, sf, metric="Precision"):
    v = _values(spark, sf, metric)
    return [v.filter(F.col("model") == m) for m in ("popular", "random")]


_D = """d AS (SELECT a."Precision" - b."Precision" AS d FROM users a JOIN users b USING (user) WHERE a.model = 'popular' AND b.model = 'random')"""


@query("st01_paired_ttest", f"WITH {_MODELS}, {_D} SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM d")
def st01(spark, sf):
    return rounded(rs.paired_ttest(*_pair(spark, sf), with_p=False), "t")


# p of Student's t for whole degrees of freedom: a finite sum over the angle whose tangent is |t| / sqrt(df).
def _t_p_sql(rows: str, keys: str = "") -> str:
    """CTE ``tp``: the rows of ``rows`` (keys, t, df) with p."""
    return f"""ang AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM {rows}),
      terms AS (SELECT *, unnest(range(0, CASE WHEN df % 2 = 1 THEN (df - 1) // 2 ELSE df // 2 END)) AS j FROM ang),
      sums AS (SELECT {keys}t, df, sum(exp(CASE WHEN df % 2 = 1 THEN lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos(th))
          ELSE lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + 2 * j * ln(cos(th)) END)) AS s FROM terms GROUP BY ALL),
      tp AS (SELECT ang.*, 1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * coalesce(s, 0)) ELSE sin(th) * s END AS p
        FROM ang LEFT JOIN sums USING ({keys}t, df))"""


# p of the signed ranks for many differences: the normal law's series over positive terms.
def _w_p_sql(rows: str, keys: str = "") -> str:
    """CTE ``wp``: the rows of ``rows`` (keys, w, n, ties) with p; more than 50 differences, or ties, are the normal law's case."""
    return f"""dev AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt((n * (n + 1.0::DOUBLE) * (2 * n + 1) - ties / 2) / 24) / sqrt(2) AS x FROM {rows}),
      parts AS (SELECT *, unnest(range(0, 400)) AS j FROM dev WHERE n > 0 AND x > 0),
      added AS (SELECT {keys}w, n, ties, sum(exp(j * ln(2) + (2 * j + 1) * ln(x) - x * x - (lgamma(2 * j + 2) - lgamma(j + 1) - j * ln(2)))) AS s FROM parts GROUP BY ALL),
      wp AS (SELECT dev.*, CASE WHEN n = 0 THEN 'nan'::DOUBLE ELSE 1 - 2 / sqrt(pi()) * coalesce(s, 0) END AS p FROM dev LEFT JOIN added USING ({keys}w, n, ties))"""


@query("st01_paired_ttest_p", f"""WITH {_MODELS}, {_D}, t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM d),
    {_t_p_sql('t')} SELECT round(t, 6) AS t, df, round(p, 6) + 0 AS p FROM tp""")
def st01_p(spark, sf):
    return rounded(rs.paired_ttest(*_pair(spark, sf)), "t", "p")


@query("st02_wilcoxon", f"""WITH {_MODELS}, {_D}, z AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0),
    r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM z)
    SELECT least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS w, count(*) AS n FROM r""")
def st02(spark, sf):
    return rs.wilcoxon(*_pair(spark, sf), with_p=False)


@query("st02_wilcoxon_p", f"""WITH {_MODELS}, {_D}, z AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0),
    r AS (SELECT d, a, count(*) OVER (PARTITION BY a) AS m, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM z),
    ws AS (SELECT least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS w, count(*) AS n, sum(m * m - 1)::DOUBLE AS ties FROM r),
    {_w_p_sql('ws')} SELECT w, n, round(p, 6) + 0 AS p FROM wp""")
def st02_p(spark, sf):
    return rounded(rs.wilcoxon(*_pair(spark, sf)), "p")


@query("st03_compare_all_models", f"""WITH {_MODELS}, d AS (SELECT a.model AS model_a, b.model AS model_b, a."Recall" - b."Recall" AS d FROM users a JOIN users b ON a.user = b.user AND a.model <> b.model)
    SELECT model_a, model_b, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM d GROUP BY model_a, model_b""")
def st03(spark, sf):
    return rounded(rs.compare_all_models(_values(spark, sf, "Recall")), "t")


_ALL_D = """vals AS (UNPIVOT (SELECT model, user, "Precision", "Recall", "MRR" FROM users) ON "Precision", "Recall", "MRR" INTO NAME metric VALUE value),
    d AS (SELECT a.model AS model_a, b.model AS model_b, metric, a.value - b.value AS d FROM vals a JOIN vals b USING (user, metric) WHERE a.model <> b.model)"""


def _all_values(spark, sf):
    return _users(spark, sf).unpivot(["model", "user"], _METRICS, "metric", "value")


@query("st03_compare_all_metrics_ttest", f"""WITH {_MODELS}, {_ALL_D},
    t AS (SELECT model_a, model_b, metric, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM d GROUP BY ALL), {_t_p_sql('t', 'model_a, model_b, metric, ')}
    SELECT model_a, model_b, metric, round(t, 6) AS t, df, round(p, 6) + 0 AS p FROM tp""")
def st03_ttest(spark, sf):
    return rounded(rs.compare_all_models(_all_values(spark, sf), True, "ttest", ["metric"]), "t", "p")


@query("st03_compare_all_metrics_wilcoxon", f"""WITH {_MODELS}, {_ALL_D}, z AS (SELECT *, abs(d) AS a FROM d WHERE d <> 0),
    r AS (SELECT *, count(*) OVER (PARTITION BY model_a, model_b, metric, a) AS m, rank() OVER (PARTITION BY model_a, model_b, metric ORDER BY a) + (count(*) OVER (PARTITION BY model_a, model_b, metric, a) - 1) / 2 AS r FROM z),
    ws AS (SELECT model_a, model_b, metric, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, count(*) AS n, sum(m * m - 1)::DOUBLE AS ties FROM r GROUP BY ALL),
    {_w_p_sql('ws', 'model_a, model_b, metric, ')} SELECT model_a, model_b, metric, w, n, round(p, 6) + 0 AS p FROM wp""")
def st03_wilcoxon(spark, sf):
    return rounded(rs.compare_all_models(_all_values(spark, sf), True, "wilcoxon", ["metric"]), "p")


@query("st04_average_folds", f"WITH {_MODELS} SELECT model, k, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM long GROUP BY ALL")
def st04(spark, sf):
    return rounded(rs.average_folds(_long(spark, sf)), "mean", "std")


@query("st05_select_best_trial", f"""WITH {_MODELS} SELECT model, trial, round(value, 6) AS value FROM (SELECT model, fold AS trial, value, row_number() OVER (PARTITION BY model ORDER BY value DESC, fold) AS r
    FROM long WHERE metric = 'Recall') WHERE r = 1""")
def st05(spark, sf):
    return rounded(rs.select_best_trial(_long(spark, sf).withColumnRenamed("fold", "trial"), "Recall"), "value")


_WIDE = 'wide AS (SELECT model, round(avg("Precision"), 6) AS "Precision", round(avg("Recall"), 6) AS "Recall", round(avg("MRR"), 6) AS "MRR" FROM users GROUP BY model)'


def _wide(spark, sf):
    return rounded(_users(spark, sf).groupBy("model").agg(*[F.avg(m).alias(m) for m in _METRICS]), *_METRICS)


@query("st06_results_as_triplets", f'WITH {_MODELS}, {_WIDE} SELECT model, metric, value FROM (UNPIVOT wide ON "Precision", "Recall", "MRR" INTO NAME metric VALUE value)')
def st06(spark, sf):
    return rs.results_as_triplets(_wide(spark, sf))


@query("st07_trials_table", f'WITH {_MODELS} SELECT model, fold AS trial, round("Precision", 6) AS "Precision", round("Recall", 6) AS "Recall", round("MRR", 6) AS "MRR" FROM folded')
def st07(spark, sf):
    return rounded(rs.trials_table(_long(spark, sf).withColumnRenamed("fold", "trial"), _METRICS), *_METRICS)


@query("st08_select_best_from_logs", f"""WITH {_MODELS}, l AS (SELECT user % 100000 AS line_no, model AS file, round("Recall", 4) AS v, 'user ' || lpad(user::VARCHAR, 8, '0') || ' recall@20: ' || printf('%.4f', "Recall") AS line FROM users)
    SELECT file, round(v, 4) AS value, line FROM (SELECT file, v, line, row_number() OVER (PARTITION BY file ORDER BY v DESC, line DESC) AS r FROM l) WHERE r = 1""")
def st08(spark, sf):
    root = fresh_path(spark, "logs")
    rows = _users(spark, sf).withColumn("text", F.concat(F.lit("user "), F.lpad(F.col("user").cast("string"), 8, "0"), F.lit(" recall@20: "), F.format_string("%.4f", "Recall")))
    for model in ("popular", "short", "random"):
        rows.filter(F.col("model") == model).select("text").write.text(f"{root}/{model}")
    return rs.best_from_logs(io.read_log_lines(spark, root))


@query("io21_write_results", f"WITH {_MODELS}, {_WIDE} SELECT model, \"MRR\", \"Precision\", \"Recall\" FROM wide")
def io21(spark, sf):
    path = fresh_path(spark, "io21")
    long = rs.results_as_triplets(_wide(spark, sf))
    io.write_tsv(rs.wide_results(long, sorted(_METRICS)), path, header=True)
    return spark.read.options(sep="\t", header=True).schema("model string, MRR double, Precision double, Recall double").csv(path)
