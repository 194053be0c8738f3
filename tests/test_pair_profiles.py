"""Pairs whose profiles travel as arrays: right with hot keys and members, one shuffle by member."""

import itertools
from collections import defaultdict

import pytest

from tastegrid.functions import pairs as pairs_module
from tastegrid.functions.pairs import pair_stats
from tastegrid.operators import similarity as si


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_profile", [6, 2_000])
@pytest.mark.parametrize("hot_work", [20, 10_000_000])
def test_pairs_with_member_columns(ratings, hot_profile, hot_work):
    sides = si.member_stats(ratings, "item", "rating").select("m", "size")
    got = pair_stats(ratings, "user", "item", "rating", ["dot", "diff"], hot_profile=hot_profile, sides=sides, hot_work=hot_work)
    profiles, size, want = defaultdict(dict), defaultdict(int), defaultdict(lambda: [0.0, 0.0])
    for r in ratings.collect():
        profiles[r["user"]][r["item"]] = r["rating"]
        size[r["item"]] += 1
    for p in profiles.values():
        for i, j in itertools.permutations(p, 2):
            want[i, j][0] += p[i] * p[j]
            want[i, j][1] += p[i] - p[j]
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(r["i"], r["j"]): [r["dot"], r["diff"]] for r in rows} == dict(want)
    assert all((r["size_i"], r["size_j"]) == (size[r["i"]], size[r["j"]]) for r in rows)


def test_null_keys_and_members_make_no_pairs(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), (5, None, 1.0), (5, 1, 4.0), (5, 3, None)], "user long, item long, rating double")
    got = pair_stats(df, "user", "item", "rating", ["n", "dot"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 1.0, None), (3, 1, 1.0, None)]


@pytest.mark.parametrize("fn", ["cosine", "jaccard"])
def test_neighbours_shuffle_profiles_by_member_only(ratings, fn, monkeypatch):
    monkeypatch.setattr(pairs_module, "_TASK_ROWS", 100)
    for near in (si.similarity(ratings, fn, 3), si.similarity_shrunk(ratings, fn, 3, shrink=1.0)):
        text = plan(near)
        assert text.count("Exchange hashpartitioning(") == 1 and "Join" not in text
