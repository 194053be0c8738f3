"""p-values against integrals and enumeration, comparisons of all models against one pair at a time."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.functions.ranking import running_total
from tastegrid.functions.tails import normal_two_sided, signed_rank_two_sided, t_two_sided
from tastegrid.operators import results as rs


def column(spark, data, schema, expression):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i long, {schema}")
    return [r.p for r in rows.select("i", expression.alias("p")).orderBy("i").collect()]


def t_by_integral(t, df):
    """Twice the density's integral from |t|, in x = 1 / (1 + u) so that the tail is finite."""
    x = (np.arange(400_000) + 0.5) / 400_000
    u = abs(t) + (1 - x) / x
    log_density = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(u * u / df)
    return 2 * float(np.mean(np.exp(log_density) / (x * x)))


def test_t_against_the_integral_of_its_density(spark):
    cases = [(t, df) for df in (1, 2, 3, 7, 30, 151, 4000, 100_000) for t in (0.01, 0.5, 1.0, 2.0, -2.5, 6.0)]
    got = column(spark, cases, "t double, df long", t_two_sided(F.col("t"), F.col("df")))
    for (t, df), p in zip(cases, got):
        assert p == pytest.approx(t_by_integral(t, df), rel=1e-5, abs=1e-9), (t, df)


def test_t_of_very_many_users_is_the_normal_law(spark):
    cases = [(z, 1_000_000_000) for z in (0.1, 1.0, 1.959964, 4.0)]
    got = column(spark, cases, "t double, df long", t_two_sided(F.col("t"), F.col("df")))
    assert got == [pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6) for z, _ in cases]


def test_t_at_its_edges(spark):
    cases = [(None, 5), (float("nan"), 5), (1.0, 0), (float("inf"), 5), (float("-inf"), 5), (0.0, 5), (1.0, None)]
    got = column(spark, cases, "t double, df long", t_two_sided(F.col("t"), F.col("df")))
    assert [math.isnan(p) for p in got] == [True, True, True, False, False, False, True]
    assert got[3:6] == [0.0, 0.0, 1.0]


def test_normal_tail(spark):
    cases = [(z,) for z in (0.0, 1e-6, 0.3, -1.0, 2.0, 2.8284, 2.8285, 5.0, 12.0, 30.0)]
    got = column(spark, cases, "z double", normal_two_sided(F.col("z")))
    assert got == [pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-10) for (z,) in cases]


def test_few_signed_ranks_by_enumeration(spark):
    cases, want = [], []
    for n in (1, 2, 5, 9):
        sums = [sum(r for r, up in zip(range(1, n + 1), signs) if up) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            cases.append((float(w), n, 0.0))
            want.append(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))
    got = column(spark, cases, "w double, n long, ties double", signed_rank_two_sided(F.col("w"), F.col("n"), F.col("ties")))
    assert got == [pytest.approx(p) for p in want]


def test_signed_ranks_with_ties_many_or_none(spark):
    def normal(w, n, ties):
        return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) / math.sqrt(2))

    cases = [(3.0, 8, 6.0), (500.0, 51, 0.0), (1e9, 100_000, 60.0)]
    got = column(spark, [*cases, (None, 0, 0.0)], "w double, n long, ties double", signed_rank_two_sided(F.col("w"), F.col("n"), F.col("ties")))
    assert got[:3] == [pytest.approx(normal(*c)) for c in cases] and math.isnan(got[3])


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(3)
    data = [(m, u, k, name, rnd.randrange(6) / 5) for m in "abc" for u in range(60) for k in (5, 10) for name in ("x", "y") if rnd.random() < 0.9]
    data += [("d", u, 5, "x", v) for m, u, k, name, v in data if (m, k, name) == ("a", 5, "x")]  # the same values as a
    data += [("e", 1, 5, "x", None), ("e", 2, 5, "x", float("nan")), ("e", 3, 5, "x", 0.4)]
    return spark.createDataFrame(data, "model string, user long, k long, metric string, value double").cache()


@pytest.mark.parametrize("test, one", [("ttest", rs.paired_ttest), ("wilcoxon", rs.wilcoxon)])
def test_all_models_at_once_equal_one_pair_at_a_time(spark, values, test, one):
    rows = rs.compare_all_models(values, True, test, ["k", "metric"]).collect()
    found = {(r.model_a, r.model_b, r.k, r.metric): r for r in rows}
    assert len(found) == len(rows)
    wanted = {(a, b, k, m) for a, b in itertools.permutations("abc", 2) for k in (5, 10) for m in "xy"}
    wanted |= {(a, b, 5, "x") for a, b in itertools.permutations("abcd", 2)}
    assert wanted <= set(found)
    for a, b, k, metric in [("a", "b", 10, "y"), ("c", "a", 5, "x"), ("a", "d", 5, "x")]:
        part = values.filter((F.col("k") == k) & (F.col("metric") == metric)).select("model", "user", "value")
        row = one(*[part.filter(F.col("model") == m) for m in (a, b)]).first().asDict()
        got = found[a, b, k, metric].asDict()
        for c, v in row.items():
            assert got[c] == (pytest.approx(v, nan_ok=True) if v is not None else None), c
        assert found[b, a, k, metric].p == pytest.approx(got["p"], nan_ok=True)


def test_null_and_nan_values_take_no_part(spark, values):
    rows = rs.compare_all_models(values, True, "wilcoxon", ["k", "metric"]).filter("model_a = 'e'").collect()
    assert rows and all(r.n <= 1 for r in rows)


def test_no_values_give_no_comparison(spark, values):
    for test in rs.TESTS:
        assert rs.compare_all_models(values.limit(0), True, test, ["k"]).collect() == []
    with pytest.raises(ValueError):
        rs.compare_all_models(values, test="sign")


def test_totals_within_keys_when_one_key_holds_most_rows(spark):
    rnd = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 7}", i, rnd.randrange(9)) for i in range(900)]
    rows = running_total(spark.createDataFrame(data, "key string, at long, v long"), [F.asc("at")], "v", "t", ["key"]).collect()
    want, sums = {}, {}
    for key, at, v in data:
        sums[key] = sums.get(key, 0) + v
        want[at] = (sums[key], sums[key] - v)
    assert {r["at"]: (r.t, r.t_before) for r in rows} == want
