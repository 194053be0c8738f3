"""Ranks of wanted pairs among all products, against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.functions import vectors as v
from tastegrid.functions.vectors import product_ranks
from tastegrid.operators import metrics as me

VEC = "id long, vec array<double>"


def tables(spark):
    rnd = random.Random(2)
    users = {u: [float(rnd.randrange(-2, 3)) for _ in range(3)] for u in range(12)}  # small whole numbers: many ties
    items = {i: [float(rnd.randrange(-2, 3)) for _ in range(3)] for i in range(50)}
    seen = {(u, i) for u in users for i in rnd.sample(range(50), 10)}
    wanted = {(u, i) for u in users for i in rnd.sample(range(55), 40 if u == 3 else 5)}  # user 3 is hot, items from 50 have no vector
    return users, items, seen, wanted


def plain(users, items, seen, wanted):
    out = {}
    for u, a in users.items():
        score = {i: sum(x * y for x, y in zip(a, b)) for i, b in items.items() if (u, i) not in seen}
        place = {i: n for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i)), 1)}
        out |= {(u, i): (score[i], place[i]) for i in score if (u, i) in wanted}
    return out


@pytest.mark.parametrize("block", [7, None])
def test_against_sorting(spark, block):
    users, items, seen, wanted = tables(spark)
    pairs = "i long, j long"
    got = product_ranks(
        spark.createDataFrame([*users.items()], VEC), spark.createDataFrame([*items.items()], VEC).repartition(3),
        spark.createDataFrame([*wanted, next(iter(wanted))], pairs), spark.createDataFrame([*seen], pairs), block=block, most_wanted=6,
    ).collect()
    assert {(r.i, r.j): (r.score, r["rank"]) for r in got} == plain(users, items, seen, wanted)
    assert len({(r.i, r.j) for r in got}) == len(got)


def test_empty_sides_and_text_ids(spark):
    left = spark.createDataFrame([("u", [1.0])], "id string, vec array<double>")
    right = spark.createDataFrame([("a", [1.0]), ("b", [3.0]), ("c", [2.0])], "id string, vec array<double>")
    pairs = spark.createDataFrame([("u", "a"), ("u", "c"), ("v", "a")], "i string, j string")
    none = pairs.limit(0)
    assert sorted(tuple(r) for r in product_ranks(left, right, pairs, none).collect()) == [("u", "a", 1.0, 3), ("u", "c", 2.0, 2)]
    assert product_ranks(left, right, none, none).count() == 0 and product_ranks(left, right.limit(0), pairs, none).count() == 0


def test_metrics_are_those_of_whole_lists(spark):
    users, items, seen, wanted = tables(spark)
    vectors = [spark.createDataFrame([*side.items()], VEC) for side in (users, items)]
    train = spark.createDataFrame([(u, i, 1.0) for u, i in seen], "user long, item long, rating double")
    test = spark.createDataFrame([(u, i, float(i % 5)) for u, i in wanted - seen], "user long, item long, rating double")
    known = {i for _, i in seen}
    lists = []
    for u, a in users.items():
        score = {i: sum(x * y for x, y in zip(a, items[i])) for i in known if (u, i) not in seen}
        lists += [(u, i, score[i], n) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i)), 1)]
    ev = me.Evaluation(spark.createDataFrame(lists, "user long, item long, score double, rank long"), test, train, 10, 2.0)
    got = me.catalogue_metrics(*vectors, test, train, 10, 2.0).first()
    want = {"AUC": ev.auc(), "GAUC": ev.gauc(), "LAUC": ev.lauc()}
    assert {c: got[c] for c in want} == pytest.approx({c: v.first()[0] for c, v in want.items()})
    assert [got[c] for c in ("MAE", "MSE", "RMSE")] == pytest.approx(list(ev.rating_errors().first()))


@pytest.mark.parametrize("sorted_from", [0, 2, 48])
def test_places_are_counted_as_right_rows_stream_by(monkeypatch, sorted_from):
    """Few scores at a time, compared or in order; NaN is behind all numbers, hidden rows do not count."""
    monkeypatch.setattr(v, "_CELLS", 64)
    monkeypatch.setattr(v._Places, "sorted_from", sorted_from)
    rnd = random.Random(4)
    x, y = ([[float(rnd.randrange(-2, 3)) for _ in range(2)] for _ in range(n)] for n in (20, 50))
    y[7][0] = y[8][0] = float("nan")
    x[3] = [0.1, 0.2]
    score = np.round(np.array(x) @ np.array(y).T, 9)
    asked = [sorted(rnd.sample(range(50), rnd.randrange(1, 6))) for _ in x]
    hidden = [sorted(set(rnd.sample(range(50), 6)) - set(a)) for a in asked]
    places = v._Places(9)
    for a, b in ((0, 9), (9, 20)):
        columns = {"id": np.arange(a, b), "vec": x[a:b], "asked": asked[a:b], "score": [list(score[i, asked[i]]) for i in range(a, b)], "hidden": hidden[a:b]}
        places.batches.append(v.pa.RecordBatch.from_pydict({c: v.pa.array(c_, v.pa.list_(v.pa.int64())) if c == "hidden" else v.pa.array(c_) for c, c_ in columns.items()}))
    places.close_left()
    for at in range(0, 50, 16):
        places.meet(v.pa.array(np.arange(50)[at : at + 16]), np.array(y[at : at + 16]))
    got = {(i, j): n for part in places.rows() for i, j, n in zip(part[0].to_pylist(), part[1].to_pylist(), part[3].tolist())}
    want = {}
    for i, js in enumerate(asked):
        order = sorted(set(range(50)) - set(hidden[i]), key=lambda j: (np.isnan(score[i, j]), 0 if np.isnan(score[i, j]) else -score[i, j], j))
        want |= {(i, j): order.index(j) for j in js}
    assert got == want


def test_vectors_are_made_once(spark):
    """What makes the vectors of users and items is not in the plan of the metrics any more."""
    users, items = (spark.range(n).select("id", F.array(F.sin("id")).alias("vec")) for n in (6, 9))
    train = spark.createDataFrame([(u, i, 1.0) for u in range(6) for i in range(9) if (u + i) % 3], "user long, item long, rating double")
    test = spark.createDataFrame([(u, u + 3, 5.0) for u in range(6)], "user long, item long, rating double")
    out = me.catalogue_metrics(users, items, test, train, 3, 2.0)
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1
