"""Operators against brute force, hand-made values and invariants."""

import itertools
from collections import Counter, defaultdict
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import factor_models as fm
from tastegrid.operators import graph as gr
from tastegrid.operators import metrics as me
from tastegrid.operators import prefilter as pf
from tastegrid.operators import recommend as rc
from tastegrid.operators import results as rs
from tastegrid.operators import sampling as ns
from tastegrid.operators import similarity as si
from tastegrid.operators import split as sp
from tastegrid.operators import text as tx
from tastegrid.operators import unpersonalised as un


def rows(df):
    return [tuple(r) for r in df.collect()]


def profiles(df):
    out = defaultdict(set)
    for r in df.select("user", "item").collect():
        out[r["user"]].add(r["item"])
    return out


# --- prefilters and splits ----------------------------------------------------------------------------


def test_iterative_core_is_a_fixed_point(ratings):
    kept = pf.iterative_k_core(ratings, 4)
    users, items = Counter(r[0] for r in rows(kept)), Counter(r[1] for r in rows(kept))
    assert users and min(users.values()) >= 4 and min(items.values()) >= 4
    assert set(rows(kept)) == set(rows(pf.k_core_simultaneous(ratings, 4, 4)))


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_splits_are_whole_and_sized(ratings, hot_rows):
    whole = sorted(rows(ratings))
    split = sp.temporal_holdout(ratings, 0.25, hot_rows)
    assert sorted(rows(split.drop("part"))) == whole
    n = Counter(r[0] for r in whole)
    test = Counter(r["user"] for r in split.filter("part = 'test'").collect())
    assert all(test[u] == n[u] - int(n[u] * 0.75) for u in n)
    folds = sp.k_folds(ratings, 3, hot_rows)
    assert sorted(rows(folds.filter("part = 'test'").drop("part", "test_fold"))) == whole
    labels = sp.per_user_ratio_split(ratings, hot_rows=hot_rows)
    sizes = Counter((r["user"], r["x_label"]) for r in labels.collect())
    for u in n:
        held = 2 if n[u] < 10 else int(n[u] * 0.2)
        val = 1 if n[u] < 10 else held // 2
        assert (sizes[u, 1], sizes[u, 2]) == (val, held - val)


@pytest.mark.parametrize("below,over", [(1, 1), (2, 3), (0, 2), (2, 0)])
def test_best_timestamp(ratings, below, over):
    stamps = defaultdict(list)
    for u, _, _, t in rows(ratings):
        stamps[u].append(t)
    best = max(
        (sum(1 for s in stamps.values() if sum(x < t for x in s) >= below and sum(x >= t for x in s) >= over), t)
        for t in {t for s in stamps.values() for t in s}
    )
    got = sp.best_timestamp_value(ratings, below, over, hot_rows=4).first()
    assert (got["users"], got["ts"]) == best


# --- recommenders -------------------------------------------------------------------------------------


def test_most_popular(ratings):
    seen = profiles(ratings)
    pop = Counter(i for items in seen.values() for i in items)
    order = sorted(pop, key=lambda i: (-pop[i], i))
    want = {(u, i) for u, items in seen.items() if len(items) + 5 < len(pop) for i in [x for x in order if x not in items][:5]}
    for hot in (2, 1000):
        got = un.most_popular(ratings, 5, hot)
        assert {(r["user"], r["item"]) for r in got.collect()} == want


def test_short_head_crosses_the_ratio(ratings):
    head = un.short_head(ratings, 0.5).agg(F.sum("pop"), F.min("pop")).first()
    total = ratings.count()
    assert head[0] >= 0.5 * total > head[0] - head[1]
    assert un.long_tail(ratings, 0.5).count() + un.short_head(ratings, 0.5).count() == 30


def test_no_seen_item_is_recommended(ratings):
    near = si.similarity(ratings, "cosine", 5, hot_profile=4)
    recs = rc.top_k_unseen(rc.item_knn_scores(ratings, near), ratings, 5)
    assert recs.join(ratings, ["user", "item"]).count() == 0


@pytest.mark.parametrize("fn", ["euclidean", "cityblock", "canberra", "hamming", "correlation", "russellrao", "jaccard", "chebyshev", "yule", "kulsinski", "seuclidean", "minkowski"])
def test_distances_cover_items_without_common_users(spark, fn):
    """Few users, so that most item pairs share none."""
    rng = np.random.default_rng(1)
    m = np.zeros((9, 14))
    for u in range(9):
        for i in rng.choice(14, 3, replace=False):
            m[u, i] = rng.integers(1, 6)
    m[0, m.sum(0) == 0] = 2.0
    data = spark.createDataFrame([(int(u), int(i), float(m[u, i])) for u, i in zip(*np.nonzero(m))], "user long, item long, rating double")

    spread = m.std(axis=1, ddof=1)

    def distance(a, b):
        ta, tb = a > 0, b > 0
        both, one, other = int((ta & tb).sum()), int((ta & ~tb).sum()), int((~ta & tb).sum())
        differ = int((ta != tb).sum())
        return {
            "euclidean": lambda: sqrt(((a - b) ** 2).sum()),
            "cityblock": lambda: np.abs(a - b).sum(),
            "canberra": lambda: sum(abs(x - y) / (x + y) for x, y in zip(a, b) if x + y > 0),
            "hamming": lambda: (a != b).mean(),
            "correlation": lambda: 1 - np.corrcoef(a, b)[0, 1],
            "russellrao": lambda: (len(a) - int((ta & tb).sum())) / len(a),
            "jaccard": lambda: differ / (int((ta & tb).sum()) + differ),
            "chebyshev": lambda: np.abs(a - b).max(),
            "yule": lambda: 2 * one * other / (both * (len(a) - both - differ) + one * other) if one * other else 0.0,
            "kulsinski": lambda: (differ - both + len(a)) / (differ + len(a)),
            "seuclidean": lambda: sqrt((((a - b) / spread) ** 2).sum()),
            "minkowski": lambda: ((a - b) ** 2).sum() ** 0.5,
        }[fn]()

    want = {}
    for i in range(14):
        tie = {j: m[:, j].max() if fn == "chebyshev" else 0 for j in range(14)}
        sims = sorted(((-round(1 / (1 + distance(m[:, i], m[:, j])), 9), tie[j], j) for j in range(14) if j != i))
        want[i] = [j for *_, j in sims[:4]]
    got = defaultdict(dict)
    for r in si.distance_similarity(data, fn, 4).collect():
        got[r["i"]][r["rank"]] = r["j"]
    assert {i: [got[i][r] for r in range(1, 5)] for i in got} == want


@pytest.mark.parametrize("hot_pairs", [0, 10**6])
def test_chebyshev_levels_with_hot_keys(spark, hot_pairs):
    """Values of many levels, one key that every member has, and members that share a level whole, in part or not."""
    rng = np.random.default_rng(4)
    m = np.where(rng.random((30, 12)) < 0.4, rng.integers(1, 10, (30, 12)) / 2, 0.0)
    m[0] = 1.0
    m[:, 1] = m[:, 0]  # the same member twice: distance 0
    data = spark.createDataFrame([(int(u), int(i), float(m[u, i])) for u, i in zip(*np.nonzero(m))], "user long, item long, rating double")
    got = {(r.i, r.j): r.sim for r in si.chebyshev_similarity(data, 11, hot_pairs=hot_pairs).collect()}
    assert got == {(i, j): round(1 / (1 + np.abs(m[:, i] - m[:, j]).max()), 9) for i in range(12) for j in range(12) if i != j}
    assert si.chebyshev_similarity(data.limit(0), 3).count() == 0


def test_randomised_svd(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(25, 4)) @ rng.normal(size=(4, 18)) + 0.01 * rng.normal(size=(25, 18))
    data = spark.createDataFrame([(u, i, float(m[u, i])) for u in range(25) for i in range(18)], "user long, item long, rating double")
    users, items = fm.randomised_svd(data, 4, oversample=6, iterations=3)
    a = np.array([r["vec"] for r in sorted(users.collect(), key=lambda r: r["id"])])
    b = np.array([r["vec"] for r in sorted(items.collect(), key=lambda r: r["id"])])
    u, s, v = np.linalg.svd(m)
    assert np.allclose(a @ b.T, u[:, :4] * s[:4] @ v[:4], atol=1e-6)


def test_slim_solves_the_elastic_net(ratings):
    l1, l2 = 3.0, 1.0
    got = fm.slim_weights(ratings, l1, l2, k=1000, tolerance=1e-10)
    x = np.zeros((40, 30))
    for u, i, r, _ in rows(ratings):
        x[u, i] = r
    w = np.zeros((30, 30))
    for r in got.collect():
        w[r["j"], r["i"]] = r["sim"]
    slope = x.T @ (x @ w - x) + l2 * w + l1
    off = ~np.eye(30, dtype=bool)
    assert (w[~off] == 0).all() and (w >= 0).all() and (w > 0).any()
    assert np.abs(slope[(w > 1e-8) & off]).max() < 1e-4
    assert slope[(w <= 1e-8) & off].min() > -1e-4


# --- sampling -----------------------------------------------------------------------------------------


def test_draws_for_users_who_have_seen_nearly_all(ratings):
    """With so few draws many users need the exact way; user 0 has seen everything."""
    users = ratings.select("user").distinct()
    got = ns.draw_unseen(users, ratings, ratings.select("item").distinct(), 27, draws=20)
    seen, picks = profiles(ratings), profiles(got)
    for u in seen:
        assert not picks[u] & seen[u]
        assert len(picks[u]) == min(27, 30 - len(seen[u]))


def test_unseen_is_the_complement(ratings, monkeypatch):
    monkeypatch.setattr(ns, "_BLOCK_ITEMS", 7)
    got = ns.unseen(ratings.select("user").distinct(), ratings.select("item").distinct(), ratings)
    seen = profiles(ratings)
    assert sorted(rows(got)) == sorted((u, i) for u in seen for i in range(30) if i not in seen[u])


def test_negatives_are_unseen_and_complete(ratings):
    sampler = ns.Sampler(ratings)
    seen = profiles(ratings)
    triples = sampler.per_interaction().collect()
    assert len(triples) == sum(len(s) for u, s in seen.items() if u != 0)
    assert all(r["negative"] not in seen[r["user"]] and r["item"] in seen[r["user"]] for r in triples)
    assert sampler.pairwise(200).count() == 200
    labels = Counter(r["label"] for r in sampler.pointwise(300).collect())
    assert sum(labels.values()) == 300 and min(labels.values()) > 90


# --- metrics, by hand ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    """User 1 hits at ranks 1 and 3, user 2 hits nothing, user 3 has no relevant item and a short list."""
    recs = spark.createDataFrame(
        [(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3), (2, 10, 3.0, 1), (2, 11, 2.0, 2), (2, 13, 1.0, 3), (3, 10, 1.0, 1)],
        "user long, item long, score double, rank int",
    )
    test = spark.createDataFrame([(1, 10, 5.0), (1, 12, 4.0), (1, 14, 4.0), (2, 12, 4.0), (3, 10, 2.0)], "user long, item long, rating double")
    train = spark.createDataFrame([(1, 13, 3.0), (2, 14, 3.0), (3, 11, 3.0), (3, 13, 1.0), (2, 10, 1.0)], "user long, item long, rating double")
    return me.Evaluation(recs, test, train, 3, 4.0)


def test_accuracy_by_hand(small):
    names = ["Precision", "Recall", "HR", "F1", "nDCG", "nDCGRendle2020", "MRR", "MAP", "MAR", "NumRetrieved"]
    got = small.values(names).first()
    d = [log(2) / log(r + 1) for r in (1, 2, 3)]
    first = {
        "Precision": 2 / 3, "Recall": 2 / 3, "HR": 1, "F1": 2 / 3, "nDCG": (3 * d[0] + d[2]) / (3 * d[0] + d[1] + d[2]),
        "nDCGRendle2020": (d[0] + d[2]) / sum(d), "MRR": 1, "MAP": (1 + 1 / 2 + 2 / 3) / 3, "MAR": (1 / 3 + 1 / 3 + 2 / 3) / 3, "NumRetrieved": 6,
    }
    for n in names:
        rest = 0
        assert got[n] == pytest.approx((first[n] + rest) / 2), n


def test_full_list_and_list_metrics_by_hand(small):
    # Four training items. User 1: profile 1, three relevant, so one negative; hits at places 0 and 2.
    assert small.auc().first()[0] == pytest.approx(((1 - 0 + 0) / 1 + (1 - 2 + 1) / 1) / 2)
    assert small.gauc().first()[0] == pytest.approx(((1 + 0) / 3 + 0) / 2)
    errors = small.rating_errors().first()
    assert errors["MAE"] == pytest.approx((2 + 3) / 4) and errors["MSE"] == pytest.approx((4 + 9) / 4)
    assert small.item_coverage().first()[0] == 4 and small.user_coverage().first()[0] == 3 and small.user_coverage_at_n().first()[0] == 2
    # Counts: item 10 three times, 11 twice, 12 and 13 once; four training items.
    want = 1 - sum((2 * (j + 1) - 5) * c / 7 for j, c in enumerate([1, 1, 2, 3])) / 3
    assert small.gini().first()[0] == pytest.approx(want)
    pop = {10: 1, 11: 1, 13: 2, 14: 1}
    assert small.arp().first()[0] == pytest.approx(((1 + 1 + 0) / 3 + (1 + 1 + 2) / 3 + 1) / 3)
    d = [log(2) / log(r + 1) for r in (1, 2, 3)]
    assert small.epc().first()[0] == pytest.approx(((d[0] * (1 - pop[10] / 3) + d[2] * 1) / sum(d) + 0) / 2)


def test_curves_agree_with_single_cutoffs(small):
    last = small.curves().filter("n = 3").first()
    single = small.values(["Recall", "Precision", "HR", "nDCGRendle2020"]).first()
    assert last["recall"] == pytest.approx(single["Recall"]) and last["precision"] == pytest.approx(single["Precision"])
    assert last["hr"] == pytest.approx(single["HR"]) and last["ndcg"] == pytest.approx(single["nDCGRendle2020"])
    assert last["recall2"] == pytest.approx(2 / 4) and last["map"] == pytest.approx(((1 + 2 / 3) / 3 + 0) / 2)


def test_perfect_list_scores_one(spark):
    test = spark.createDataFrame([(1, i, 5.0 - i % 2) for i in range(4)], "user long, item long, rating double")
    recs = spark.createDataFrame([(1, i, 1.0, r) for r, i in enumerate([0, 2, 1, 3], 1)], "user long, item long, score double, rank int")
    got = me.Evaluation(recs, test, test, 4, 4.0).values(["nDCG", "Precision", "Recall", "MRR"]).first()
    assert [got[c] for c in ("nDCG", "Precision", "Recall", "MRR")] == pytest.approx([1.0] * 4)


def test_mean_difference(spark):
    values = [0.1, 0.7, 0.3, 0.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "cluster long, value double")
    want = np.mean([abs(a - b) for a, b in itertools.combinations(values, 2)])
    assert me.Evaluation.mean_difference(df).first()[0] == pytest.approx(want)


# --- significance -------------------------------------------------------------------------------------


def test_wilcoxon_and_ttest(spark):
    a = spark.createDataFrame([(u, float(v)) for u, v in enumerate([1, 3, 4, 7, 7, 2, 9])], "user long, value double")
    b = spark.createDataFrame([(u, float(v)) for u, v in enumerate([0, 1, 1, 3, 2, 8, 9])], "user long, value double")
    w = rs.wilcoxon(a, b).first()
    assert (w["w"], w["n"]) == (6.0, 6) and w["p"] == pytest.approx(28 / 64)
    d = np.array([1, 2, 3, 4, 5, -6, 0])
    assert rs.paired_ttest(a, b).first()["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / sqrt(7)))
    assert rs.wilcoxon(a, a).first()["n"] == 0


# --- graphs and text ----------------------------------------------------------------------------------


def test_norm_adjacency_is_symmetric(ratings):
    edges = {(r["src"], r["dst"]): r["weight"] for r in gr.norm_adjacency(ratings).collect()}
    assert all(edges[d, s] == w for (s, d), w in edges.items())


def test_propagation_against_matrices(ratings):
    edges = gr.norm_adjacency(ratings)
    nodes = sorted({r["src"] for r in edges.collect()})
    at = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for r in edges.collect():
        a[at[r["src"]], at[r["dst"]]] = r["weight"]
    x = np.random.default_rng(0).normal(size=(len(nodes), 3))
    spark = ratings.sparkSession
    table = spark.createDataFrame([(n, [float(v) for v in x[at[n]]]) for n in nodes], "id long, vec array<double>")
    got = gr.propagate(edges, table, 2, 3).collect()
    want = (x + a @ x + a @ a @ x) / 3
    assert all(np.allclose(r["vec"], want[at[r["id"]]]) for r in got)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Great!! I can't wait", "Great ! I ca n't wait"),
        ("I like it, e.g. this; it's 'good'", "I like it , e.g. this ; it 's good "),
        ("only 5 of us (or 3 )", "only five of us ( or three ) "),
        ("nothing here", "nothing here"),
        ("They've said: we'll see & I'm ok?", "They 've said we 'll see I 'm ok ? "),
    ],
)
def test_clean_review_text(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(tx.clean_review_text("t")).first()[0]
    assert got == want


def test_split_sentences_keeps_all(spark):
    for text in ("a. b.c", "a.", "", ".x..", "no end"):
        pieces = spark.createDataFrame([(text,)], "t string").select(tx.split_sentences("t")).first()[0]
        want = [p + "." for p in text.split(".")[:-1]] + [text.split(".")[-1]]
        assert pieces == want
