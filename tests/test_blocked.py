"""Blocked products, slope one in blocks, runs of unseen items, the factorisation machine: next to plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tastegrid.functions import products
from tastegrid.operators import factor_models, factorisation_machine as machine, recommend as rc, sampling as ns


@pytest.mark.parametrize("hot, part, rows", [(10**9, 1000, 10**6), (0, 3, 40), (20, 2, 10**6)])
def test_sparse_product(spark, monkeypatch, hot, part, rows):
    monkeypatch.setattr(products, "_PART", part)
    monkeypatch.setattr(products, "_ROWS", rows)
    monkeypatch.setattr(products, "_CELLS", 30)
    rnd = random.Random(3)
    left = {(rnd.randrange(25), rnd.choice([0, 0, 0, rnd.randrange(12)])): rnd.uniform(0.1, 1) for _ in range(90)}
    right = {(rnd.choice([0, 0, rnd.randrange(12)]), f"j{rnd.randrange(30)}"): rnd.uniform(0.1, 1) for _ in range(90)}
    want = defaultdict(float)
    for (i, l), a in left.items():  # noqa: E741
        for (m, j), b in right.items():
            if l == m:
                want[i, j] += a * b
    got = products.sparse_product(
        spark.createDataFrame([(i, l, a) for (i, l), a in left.items()], "i long, l long, a double"),  # noqa: E741
        spark.createDataFrame([(l, j, b) for (l, j), b in right.items()], "l long, j string, b double"),  # noqa: E741
        hot,
    ).collect()
    assert {(r.i, r.j) for r in got} == set(want) and len(got) == len(want)
    assert max(abs(r.value - want[r.i, r.j]) for r in got) < 1e-9


def test_sparse_product_of_nothing(spark):
    a, b = spark.createDataFrame([(1, 2, 3.0)], "i long, l long, a double"), spark.createDataFrame([], "l long, j long, b double")
    assert products.sparse_product(a, b).count() == 0 and products.sparse_product(a, b, 0).count() == 0


@pytest.mark.parametrize("users, items", [(2_048, 1_024), (4, 3)])
def test_slope_one_in_blocks(spark, ratings, users, items):
    rows = [(r.user, r.item, r.rating) for r in ratings.collect()] + [(77, 500, 2.0)]  # an item that nobody else has, alone in its profile
    profile = defaultdict(dict)
    for u, i, x in rows:
        profile[u][i] = x
    catalogue = sorted({i for _, i, _ in rows})
    dev = {}
    for i in catalogue:
        for j in catalogue:
            both = [p[i] - p[j] for p in profile.values() if i in p and j in p]
            if i != j and both:
                dev[i, j] = sum(both) / len(both)
    want = set()
    for u, p in profile.items():
        mean = sum(p.values()) / len(p)
        scores = []
        for i in catalogue:
            if i not in p:
                own = [dev[i, j] for j in p if (i, j) in dev]
                scores.append((-round(mean + (sum(own) / len(own) if own else 0.0), 9), i))
        want |= {(u, i, n + 1) for n, (_, i) in enumerate(sorted(scores)[:5])}
    frame = spark.createDataFrame(rows, "user long, item long, rating double")
    got = rc.slope_one_recs(frame, 5, users_per_block=users, items_per_block=items).collect()
    assert {(r.user, r.item, r["rank"]) for r in got} == want


def test_slim_slopes_with_hot_items(spark, ratings):
    """A user with every item and an item that all users have, once joined and once in blocks."""
    one, two = ({(r.i, r.j): r.sim for r in factor_models.slim_weights(ratings, 2.0, 1.0, 1000, batch=2, tolerance=1e-10, hot_pairs=h).collect()} for h in (10**9, 0))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-6


def test_runs_of_unseen_items(spark):
    rnd = random.Random(4)
    items = sorted(rnd.sample(range(-50, 500), 40))
    seen = {u: set(rnd.sample(items, rnd.choice([1, 5, 20, 39]))) for u in range(12)} | {90: set(items), 91: {items[0]}, 92: {items[-1]}}
    pairs = spark.createDataFrame([(u, i) for u, s in seen.items() for i in [*s, *list(s)[:1]]], "user long, item long")
    users = spark.createDataFrame([(u,) for u in [*seen, 100]], "user long")
    runs = ns.unseen_gaps(users, spark.createDataFrame([(i,) for i in items * 2], "item long"), pairs).collect()
    places = defaultdict(list)
    for r in runs:
        own = items[r.lo : r.hi + 1]
        assert (r.n, r.least, r.most, r.total) == (len(own), own[0], own[-1], sum(own))
        places[r.user] += own
    for u in [*seen, 100]:
        assert sorted(places[u]) == [i for i in items if i not in seen.get(u, ())]
    assert len(runs) <= sum(len(s) + 1 for s in seen.values()) + 1
    assert ns.unseen_gaps(users, spark.createDataFrame([], "item long"), pairs).count() == 0


def test_factorisation_machine(spark, ratings):
    rows = ratings.select("user", "item", "rating")
    attributes = spark.createDataFrame([(i, f) for i in range(29) for f in {i % 3, 3 + i % 4, 7 + i % 2}] + [(999, 1), (3, 0)], "item long, feature_id long")

    def loss(model):
        error = sum(r.e**2 for r in machine.residuals(rows, model).collect())
        squares = sum(r.w**2 + sum(x * x for x in r.v) for t in (model.users, model.items, model.features) for r in t.collect())
        return error + 0.5 * squares

    first, third = (machine.fit(rows, attributes, factors=3, reg=0.5, sweeps=n) for n in (1, 3))
    assert loss(third) < loss(first)
    met = machine.normal_equations(rows, third, 0.5).collect()
    assert len(met) == 40 and max(r.slope for r in met) < 1e-9
    # what a user and an item come to, by the sides, is what the definition says
    side, users = {r.id: r for r in third.side.collect()}, {r.id: r for r in third.users.collect()}
    for r in machine.residuals(rows, third).collect():
        p = third.mean + users[r.user].w + side[r.item].b + np.dot(users[r.user].v, side[r.item].vec)
        assert abs(r.rating - p - r.e) < 1e-9
    assert {r.id for r in third.features.collect()} == set(range(9))
    recs = machine.factorisation_machine(rows, attributes, 3, factors=2, iterations=1).collect()
    own = {(r.user, r.item) for r in rows.collect()}
    assert recs and not own & {(r.user, r.item) for r in recs}


def test_factorisation_machine_without_attributes(spark, ratings):
    model = machine.fit(ratings, spark.createDataFrame([], "item long, feature_id long"), factors=2, sweeps=2)
    assert max(r.slope for r in machine.normal_equations(ratings, model, 1.0).collect()) < 1e-9


def test_best_step():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        c = np.r_[rnd.normal(size=4), abs(rnd.normal())]
        at = np.linspace(0, 2, 20_001)
        assert np.polyval(c[::-1], machine.best_step(c)) <= np.polyval(c[::-1], at).min() + 1e-6
