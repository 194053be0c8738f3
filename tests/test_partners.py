"""Pairs made by reading a table past blocks of it: against brute force with every limit set low."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from tastegrid.functions import partners as partners_module
from tastegrid.functions.partners import members, partners, rounded
from tastegrid.operators import metrics as me
from tastegrid.operators import recommend as rc
from tastegrid.operators import similarity as si


@pytest.fixture(params=["plain", "small steps", "cells"])
def limits(request, monkeypatch):
    if request.param != "plain":
        monkeypatch.setattr(partners_module, "BLOCK_ROWS", 300)
        monkeypatch.setattr(partners_module, "_STEP_ROWS", 5)
        monkeypatch.setattr(partners_module, "_WAITING", 3)
    if request.param == "cells":
        monkeypatch.setattr(partners_module, "_CELLS_PER_ROW", 1_000)


def members_of(ratings, sides=None):
    return members(ratings.selectExpr("item AS id", "user AS k", "rating AS v"), sides)


def profiles_of(ratings):
    profiles = defaultdict(dict)
    for r in ratings.collect():
        profiles[r["user"]][r["item"]] = r["rating"]
    return profiles


def test_all_pairs(ratings, limits):
    table, n = members_of(ratings)
    want = defaultdict(lambda: [0.0, 0.0, 0.0])
    for p in profiles_of(ratings).values():
        for i, j in itertools.permutations(p, 2):
            want[i, j][0] += p[i] * p[j]
            want[i, j][1] += p[i]
            want[i, j][2] = max(want[i, j][2], abs(p[i] - p[j]))
    got = partners(table, table, n, ["dot", "left", "far"], own=True).collect()
    assert len(got) == len(want)
    assert {(r["i"], r["j"]): [r["dot"], r["left"], r["far"]] for r in got} == dict(want)


@pytest.mark.parametrize("named", [False, True])
def test_best_with_places(ratings, limits, named):
    rows = ratings.selectExpr("user", "CONCAT('item ', repeat('x', CAST(item % 3 AS INT)), item) AS item" if named else "item", "rating")
    table, n = members_of(rows, rows.selectExpr("item AS id", "dense_rank() OVER (ORDER BY xxhash64(item)) - 1L AS place").distinct())
    got = partners(table.selectExpr("*", "work + 3 AS reach"), table, n, ["dot"], lambda p: p.get("dot"), 3, own=True, reach="reach").collect()
    dot = defaultdict(float)
    for p in profiles_of(rows).values():
        for i, j in itertools.permutations(p, 2):
            dot[i, j] += p[i] * p[j]
    items = sorted({i for i, _ in dot})
    best = {(i, j) for i in items for j in sorted((j for j in items if (i, j) in dot), key=lambda j: (-dot[i, j], j))[:3]}
    assert {(r["i"], r["j"]) for r in got if r["place"] is None} == best
    assert all(r["nonzero"] == sum(i == r["i"] for i, _ in dot) for r in got if r["place"] is None)
    place = {r["id"]: r["place"] for r in table.collect()}
    for i in items:
        met, told = {place[j] for j in items if (i, j) in dot}, {r["place"] for r in got if r["i"] == i and r["place"] is not None}
        free = lambda barred: [p for p in range(200) if p not in barred and p != place[i]][:3]  # noqa: E731, B023
        assert told <= met and free(told) == free(met)


def test_pairs_are_not_shuffled(ratings):
    """Only the k best of a member leave the tasks: nothing is expanded before the one exchange."""
    for near in (si.similarity(ratings, "cosine", 3), si.similarity_shrunk(ratings, "asymmetric", 3, shrink=1.0)):
        text = near._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in text and "Generate" not in text and text.count("Exchange hashpartitioning(") == 1


def test_slope_one_shuffles_no_pairs(ratings, monkeypatch):
    """Deviations are lists by item when they are written, and no table of item pairs or scores is."""
    kept, real = [], rc.materialise
    monkeypatch.setattr(rc, "materialise", lambda df, name: kept.append((name, df)) or real(df, name))
    rc.slope_one_recs(ratings, 3).collect()
    made = dict(kept)
    assert made["deviations"].count() <= 30 and "array" in made["deviations"].schema["keys"].dataType.simpleString()
    assert made["partners"].where("place IS NULL").count() <= 40 * 3


def test_errors_of_lists_take_no_broadcast(spark, ratings):
    lists = spark.createDataFrame([(1, 2, 3.0)], "user long, item long, score double")
    text = me.eval_error(lists, ratings)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_null_values_leave_pairs_undefined(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (2, 1, 3.0), (2, 3, 4.0), (None, 3, 1.0), (3, 4, 1.0)], "user long, item long, rating double")
    got = {(r["i"], r["j"]): r["sim"] for r in si.distance_similarity(df, "euclidean", 9).collect()}
    assert (1, 2) not in got and got[1, 3] == pytest.approx(1 / (1 + np.sqrt(13 + 17 - 24)))


def test_rounding_is_half_away_from_zero():
    assert rounded(np.array([0.0009765625, -0.0009765625, 1e12 + 0.25, np.nan]), 9)[:3].tolist() == [0.000976563, -0.000976563, 1e12 + 0.25]


@pytest.mark.parametrize("by", ["items", "users"])
def test_lists_of_a_product_without_its_rows(ratings, limits, by, spark, monkeypatch):
    """Lists of neighbour scores equal those of the scored rows, null ids included, and the rows are never asked for."""
    odd = spark.createDataFrame([(None, 3, 2.0), (1, None, 4.0), (2, 29, None)], "user long, item long, rating double")
    train = ratings.select("user", "item", "rating").where("NOT (user = 2 AND item = 29)").unionByName(odd)
    if by == "items":
        scores = rc.item_knn_scores(train, si.similarity(train, "cosine", 3))
    else:
        scores = rc.user_knn_scores(train, rc.user_similarity(train, "cosine", 4))
    want = rc.full_top_k_unseen(scores.select("*"), train, 7).collect()
    kept, real = [], rc.materialise
    monkeypatch.setattr(rc, "materialise", lambda df, name: kept.append((name, df)) or real(df, name))
    got = rc.full_top_k_unseen(scores, train, 7)
    assert sorted(got.collect(), key=str) == sorted(want, key=str)
    assert "scores" not in {name for name, _ in kept}
