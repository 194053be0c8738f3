"""Pruned vector joins against all pairs: clustered, repeated, zero and masked vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.functions import nearest
from tastegrid.functions.vectors import block_pairs, cosine_block, dot_block


def cloud(rng, groups, each, dim, spread):
    centres = rng.normal(size=(groups, dim)) * rng.uniform(0.5, 3.0, size=(groups, 1))
    return np.concatenate([c + spread * rng.normal(size=(each, dim)) for c in centres])


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    x = cloud(rng, 12, 25, 8, 0.05)
    hot = np.repeat(x[:1], 120, axis=0)  # copies of one vector: nearly a third of the rows
    return [*x, *hot, np.zeros(8), np.zeros(8), None]


def as_set(rows, *names):
    got = [tuple(r[n] for n in names) for r in rows.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.0, -1.0])
def test_cosine_at_least_equals_all_pairs(spark, clustered, threshold):
    table = frame(spark, clustered)
    got = nearest.cosine_at_least(table, threshold, cell_rows=16, most_pivots=20)
    whole = block_pairs(table.where("vec IS NOT NULL"), table.where("vec IS NOT NULL"), cosine_block)
    near = whole.filter(F.col("score") >= threshold - 1e-8)
    mine = {(r.i, r.j): r.score for r in got.collect()}
    theirs = {(r.i, r.j): r.score for r in near.collect()}
    assert all(abs(mine[p] - s) < 2e-9 for p, s in theirs.items() if p in mine)
    assert all(abs(s - threshold) < 2e-9 for p, s in theirs.items() if p not in mine) and set(mine) <= set(theirs)


@pytest.mark.parametrize("cosine, exclude_self", [(True, False), (True, True), (False, False)])
def test_best_products_equal_all_pairs(spark, clustered, cosine, exclude_self):
    table = frame(spark, clustered)
    known = table.where("vec IS NOT NULL")
    got = nearest.best_products(table, table, 7, cosine=cosine, exclude_self=exclude_self, cell_rows=16, most_pivots=20)
    want = block_pairs(known, known, cosine_block if cosine else dot_block, 7, exclude_self=exclude_self, digits=9)
    mine = {(r.i, r["rank"]): r.score for r in got.collect()}
    theirs = {(r.i, r["rank"]): r.score for r in want.collect()}
    assert set(mine) == set(theirs) and all(abs(mine[p] - theirs[p]) < 2e-9 for p in theirs)


def test_masked_products_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    users, items = cloud(rng, 6, 20, 5, 0.2), cloud(rng, 9, 20, 5, 0.2)
    left, right = frame(spark, users), frame(spark, items, 1000)
    best = np.argsort(-(users @ items.T), axis=1)
    hidden = [(u, 1000 + int(j)) for u in range(0, 120, 2) for j in best[u, :30]] + [(3, 1000 + j) for j in range(178)]
    mask = spark.createDataFrame(hidden, "i long, j long")
    got = nearest.best_products(left, right, 5, mask=mask, cell_rows=16, most_pivots=12)
    want = block_pairs(left, right, dot_block, 5, mask=mask)
    assert as_set(got, "i", "rank", "j") == as_set(want, "i", "rank", "j")
    assert got.filter("i = 3").count() == 2  # the two items that the mask leaves


def test_only_cells_that_can_match_meet(spark, clustered, monkeypatch):
    """Twelve narrow groups: a row may go to the cells of its own group, not to those of the eleven others."""
    sent = []
    plain = nearest.copies_to
    monkeypatch.setattr(nearest, "copies_to", lambda *a: sent.append(plain(*a)) or sent[-1])
    table = frame(spark, clustered)
    rows = len(clustered) - 1
    nearest.cosine_at_least(table, 0.97, cell_rows=16, most_pivots=20).count()
    cells = sent[0].select("x").unionByName(sent[1].select("x")).distinct().count()
    assert sent[0].count() + sent[1].count() < 0.4 * rows * cells
    sent.clear()
    nearest.best_products(table, table, 5, cosine=True, cell_rows=16, most_pivots=20).count()
    assert sent[0].count() < 0.6 * rows * cells


def test_empty_and_all_zero_tables(spark):
    empty = frame(spark, [(1.0, 2.0)]).limit(0)
    zero = frame(spark, [np.zeros(2), np.zeros(2)])
    assert nearest.cosine_at_least(empty, 0.5).collect() == []
    assert nearest.best_products(empty, zero, 3).collect() == []
    assert nearest.best_products(zero, empty, 3).collect() == []
    assert nearest.cosine_at_least(zero, 0.5).collect() == []
    assert nearest.cosine_at_least(zero, 0.0).count() == 4
    assert nearest.best_products(zero, zero, 1).count() == 2
