"""Block products hold a bounded number of scores, whatever the sizes of the tables."""

import random

import numpy as np
import pytest

from tastegrid.functions import vectors as v

rnd = random.Random(11)


def _table(spark, ids):
    return spark.createDataFrame([(i, [float(rnd.randrange(-2, 3)) for _ in range(3)]) for i in ids], "id long, vec array<double>")


@pytest.fixture()
def short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 7)
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("block", [None, 9])
def test_k_best_over_many_batches(spark, short_batches, block):
    left, right = _table(spark, range(30)), _table(spark, range(5, 60))
    hidden = {(i, j) for i in range(30) for j in range(5, 60) if rnd.random() < 0.3} | {(3, j) for j in range(5, 60)}
    mask = spark.createDataFrame(sorted(hidden), "i long, j long")
    a, b = left.collect(), right.collect()
    for k, masked, alone in ((1, True, False), (6, True, True), (100, False, True)):
        want = set()
        for x in a:
            free = [(-float(np.dot(x.vec, y.vec)), y.id) for y in b if not (masked and (x.id, y.id) in hidden) and not (alone and x.id == y.id)]
            want |= {(x.id, j, -s, r) for r, (s, j) in enumerate(sorted(free)[:k], 1)}
        got = v.block_pairs(left, right, v.dot_block, k, mask=mask if masked else None, exclude_self=alone, block=block)
        assert {tuple(r) for r in got.collect()} == want


def test_kept_scores_only_and_string_and_null_ids(spark, short_batches):
    rows = [(f"n{n:02d}" if n else None, [float(n % 5 - 2), 1.0]) for n in range(20)]
    table = spark.createDataFrame(rows, "id string, vec array<double>")
    got = v.block_pairs(table, table, v.dot_block, 4, keep=lambda s: s <= 3, exclude_self=True).collect()
    for i, vec in rows:
        free = [(-s, j is not None, j or "") for j, w in rows if (s := float(np.dot(vec, w))) <= 3 and not (i == j and i is not None)]
        assert [(r.j or "", r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.i == i] == [(j, -s) for s, _, j in sorted(free)[:4]]


def test_few_scores_at_a_time(monkeypatch):
    """No block of scores is larger than the bound, and rows that cannot enter any more are not ranked again."""
    monkeypatch.setattr(v, "_CELLS", 64)
    shapes = []

    def score(a, b):
        shapes.append(len(a) * len(b))
        return a @ b.T

    best = v._Best(score, 2, None, False, 9)
    x, y = np.random.default_rng(1).normal(size=(2, 50, 4))
    best.batches = [v.pa.RecordBatch.from_pydict({"id": np.arange(50), "vec": list(x)})]
    best.close_left()
    for at in range(0, 50, 16):
        best.meet(v.pa.array(np.arange(50)[at : at + 16]), y[at : at + 16])
    assert max(shapes) <= 64
    i, j, s = (np.concatenate([np.asarray(c) for c in column]) for column in zip(*best.rows()))
    want = np.argsort(-np.round(x @ y.T, 9), axis=1, kind="stable")[:, :2]
    assert (j.reshape(50, 2) == want).all() and (i == np.repeat(np.arange(50), 2)).all()


def test_all_pairs_come_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(v, "_PAIRS_BLOCK", 10)
    table = _table(spark, range(40))
    got = v.block_pairs(table, table, v.dot_block)
    assert got.count() == 1600
    assert v._block_counts(table, table, v._PAIRS_BLOCK) == (4, 4)
