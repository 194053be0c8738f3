"""Building blocks against brute force, with the limits set so low that the skew paths run."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.functions import pairs as pairs_module
from tastegrid.functions.pairs import pair_stats
from tastegrid.functions.ranking import dense_index, exact_quantiles, first_free_places, position_in_group, running_total
from tastegrid.functions.vectors import block_pairs, cosine_block, dot_block


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_position_in_group(ratings, hot_rows):
    got = position_in_group(ratings, ["user"], [F.asc("ts"), F.asc("item")], "p", hot_rows, size="n")
    groups = defaultdict(list)
    for u, i, r, t in rows(ratings):
        groups[u].append((t, i))
    want = {(u, i): (p, len(g)) for u, g in groups.items() for p, (t, i) in enumerate(sorted(g), 1)}
    assert {(r["user"], r["item"]): (r["p"], r["n"]) for r in got.collect()} == want


def test_dense_index_and_running_total(ratings):
    ids = dense_index(ratings.select("item").distinct(), [F.desc("item")], start=5)
    items = sorted({r[1] for r in rows(ratings)}, reverse=True)
    assert dict(rows(ids)) == {i: n + 5 for n, i in enumerate(items)}
    counts = ratings.groupBy("item").count()
    got = running_total(counts, [F.asc("item")], "count", "total")
    seen, want = 0, {}
    for i, c in sorted(rows(counts)):
        want[i] = (seen, seen + c)
        seen += c
    assert {r["item"]: (r["total_before"], r["total"]) for r in got.collect()} == want


def test_first_free_places(spark):
    taken = {0: [0, 1, 2, 3, 4], 1: [], 2: [1, 3, 9], 3: list(range(9))}
    owners = spark.createDataFrame([(o,) for o in taken], "o long")
    held = spark.createDataFrame([(o, p) for o, ps in taken.items() for p in ps], "o long, place long")
    want = {(o, p) for o, ps in taken.items() for p in [q for q in range(10) if q not in ps][:3]}
    for hot in (2, 1000):
        assert set(rows(first_free_places(owners, "o", held, 3, 10, hot).select("o", "place"))) == want


def test_exact_quantiles(ratings):
    got = exact_quantiles(ratings, "ts", [0.1, 0.8, 0.95]).first()
    assert np.allclose(list(got), np.quantile([r[3] for r in rows(ratings)], [0.1, 0.8, 0.95]))


STATS = ["n", "dot", "low", "diff", "equal", "far", "canberra", "sum", "left", "right"]
FORMULAS = {
    "n": lambda a, b: 1.0, "dot": lambda a, b: a * b, "low": min, "diff": lambda a, b: a - b, "equal": lambda a, b: float(a == b),
    "far": lambda a, b: abs(a - b), "canberra": lambda a, b: abs(a - b) / (abs(a) + abs(b)), "sum": lambda a, b: a + b,
    "left": lambda a, b: a, "right": lambda a, b: b,
}


@pytest.mark.parametrize("stats", [STATS, ["n", "dot", "diff", "sum", "left", "right"]])
@pytest.mark.parametrize("hot_profile", [4, 10_000])
def test_pair_stats(ratings, monkeypatch, stats, hot_profile):
    monkeypatch.setattr(pairs_module, "_BLOCK_MEMBERS", 7)
    monkeypatch.setattr(pairs_module, "_PROFILE_PART", 3)
    monkeypatch.setattr(pairs_module, "_KEYS_PER_GROUP", 5)
    monkeypatch.setattr(pairs_module, "_KEYS_PER_STEP", 2)
    profiles = defaultdict(dict)
    for u, i, r, _ in rows(ratings):
        profiles[u][i] = r
    want = {}
    for p in profiles.values():
        for i, j in itertools.permutations(p, 2):
            cell = want.setdefault((i, j), {s: 0.0 for s in stats})
            for s in stats:
                v = FORMULAS[s](p[i], p[j])
                cell[s] = max(cell[s], v) if s == "far" else cell[s] + v
    got = {(r["i"], r["j"]): r for r in pair_stats(ratings, "user", "item", "rating", stats, hot_profile=hot_profile).collect()}
    assert set(got) == set(want)
    for key, cell in want.items():
        for s in stats:
            assert got[key][s] == pytest.approx(cell[s]), (key, s)


def test_block_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(13, 4)), rng.normal(size=(17, 4))
    left = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(a)], "id long, vec array<double>")
    right = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(b)], "id long, vec array<double>")
    hidden = [(0, 3), (0, 4), (5, 16)]
    mask = spark.createDataFrame(hidden, "i long, j long")
    got = block_pairs(left, right, dot_block, 4, mask=mask, block=5)
    scores = np.round(a @ b.T, 9)
    for i, j in hidden:
        scores[i, j] = -np.inf
    want = {(i, int(j)) for i in range(13) for j in np.argsort(-scores[i], kind="stable")[:4]}
    assert {(r["i"], r["j"]) for r in got.collect()} == want
    every = block_pairs(left, left, cosine_block, block=4, exclude_self=True)
    assert every.count() == 13 * 12
