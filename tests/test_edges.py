"""Degenerate but ordinary data: zero denominators, lonely users, whole-file JSON, folder names, storage."""

import json
import math
import os

import pytest

from tastegrid import session
from tastegrid.operators import clean, features, metrics, prefilter, recommend, results, similarity
from tastegrid.sources import files


def rows(spark, data, schema="user long, item long, rating double"):
    return spark.createDataFrame(data, schema)


def test_equal_models_have_no_t_value(spark):
    a = rows(spark, [(u, 0.5) for u in range(5)], "user long, value double")
    row = results.paired_ttest(a, a).first()
    assert math.isnan(row.t) and row.df == 4


def test_spread_of_groups_without_hits_is_not_a_number(spark):
    groups = rows(spark, [(0, 0.0), (1, 0.0)], "cluster long, value double")
    assert math.isnan(metrics.Evaluation.spread(groups).first().value)


def test_members_with_only_zeros_have_no_neighbour(spark):
    data = rows(spark, [(1, 1, 0.0), (2, 1, 0.0), (1, 2, 3.0), (2, 2, 1.0), (1, 3, 2.0), (2, 3, 5.0)])
    for fn in ("cosine", "asymmetric"):
        found = {(r.i, r.j) for r in similarity.similarity(data, fn, 5).collect()}
        assert found == {(2, 3), (3, 2)}


def test_correlation_with_an_item_that_all_rated_alike(spark):
    data = rows(spark, [(u, 1, 4.0) for u in range(4)] + [(u, 2, float(u + 1)) for u in range(4)] + [(u, 3, float(5 - u)) for u in range(4)])
    found = {(r.i, r.j) for r in similarity.distance_similarity(data, "correlation", 5).collect()}
    assert found == {(2, 3), (3, 2)}


def test_a_feature_of_all_items_weighs_nothing(spark):
    weights = recommend.tfidf_items(rows(spark, [(1, 0), (2, 0), (2, 1)], "item long, feature_id long"))
    assert {(r.item, r.feature_id): r.weight for r in weights.collect()} == {(1, 0): 0.0, (2, 0): 0.0, (2, 1): 1.0}


def test_constant_vectors(spark):
    one = rows(spark, [(1, [2.0, 2.0, 2.0])], "id long, vec array<double>")
    assert one.select(features.minmax_normalise()).first()[0] == [0.0, 0.0, 0.0]
    assert one.select(features.zscore([2.0, 1.0, 2.0], [0.0, 1.0, 0.0])).first()[0] == [0.0, 1.0, 0.0]


def test_lists_are_full_and_zeros_stand_before_negative_scores(spark):
    train = rows(spark, [(1, 1, 5.0), (2, 1, 1.0), (2, 2, 2.0), (3, 9, 3.0)])
    scores = rows(spark, [(1, 2, -1.0), (1, 9, 0.5)], "user long, item long, score double")
    got = recommend.full_top_k_unseen(scores, train, 2).collect()
    assert sorted((r.user, r.rank, r.item, r.score) for r in got) == [(1, 1, 9, 0.5), (1, 2, 2, -1.0), (2, 1, 9, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]


def test_slope_one_gives_unrelated_items_the_users_mean(spark):
    # user 1 shares nobody with anyone: all unseen items have the mean of 3
    train = rows(spark, [(1, 1, 2.0), (1, 2, 4.0), (2, 3, 5.0), (2, 4, 1.0), (3, 3, 4.0), (3, 4, 4.0)])
    got = {(r.user, r.item): r.score for r in recommend.slope_one_recs(train, 3).collect()}
    assert got[1, 3] == got[1, 4] == 3.0 and got[2, 1] == 3.0 and got[3, 2] == 4.0


def test_profiles_in_both_layouts_agree(spark):
    profile = rows(spark, [(1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5), (3, 2, 1.0)], "user long, feature_id long, weight double")
    weights = rows(spark, [(10, 0, 1.0), (11, 1, 1.0), (12, 2, 1.0)], "item long, feature_id long, weight double")
    train = rows(spark, [(1, 10, 1.0), (2, 11, 1.0), (3, 12, 1.0)])
    for limit in (0, 4096):
        near = {(r.i, r.j) for r in recommend.profile_user_neighbours(profile, "cosine", 5, dense_features=limit).collect()}
        assert near == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    lists = [sorted((r.user, r["rank"], r.item, round(r.score, 6)) for r in recommend.vsm_recs(profile, weights, train, "cosine", 3, dense_features=d).collect()) for d in (0, 4096)]
    assert lists[0] == lists[1] and len(lists[0]) == 6


@pytest.mark.parametrize("indent", [None, 2])
def test_one_json_object_for_the_whole_file(spark, tmp_path, indent):
    lists = {str(k): [k + 1, k + 2] for k in range(300)} | {"999": []}
    (tmp_path / "near.json").write_text(json.dumps(lists, indent=indent))
    got = {(r.src, r.dst) for r in files.read_neighbour_json(spark, str(tmp_path / "near.json")).collect()}
    assert got == {(int(k), d) for k, v in lists.items() for d in v}
    pairs = {f"{k}_{k + 1}": [0.5, k / 3] for k in range(50)}
    (tmp_path / "pairs.json").write_text(json.dumps(pairs, indent=indent))
    vectors = {(r.src, r.dst): r.vec for r in files.read_pair_json(spark, str(tmp_path / "pairs.json")).collect()}
    assert vectors == {tuple(map(int, k.split("_"))): v for k, v in pairs.items()}


def test_broken_json_raises(spark, tmp_path):
    for k, text in enumerate(['{"1": [2, 3], oops "4": [5]}', '{"1": [2, x]}', '{"1": {"2": [3]}}']):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(Exception):
            files.read_neighbour_json(spark, str(tmp_path / f"{k}.json")).collect()


def test_folds_are_numbered_below_the_root(spark, tmp_path):
    root = tmp_path / "2024"
    for place in ("0/test.tsv", "0/train.tsv", "1/3/train.tsv", "1/3/val.tsv", "1/test.tsv"):
        (root / place).parent.mkdir(parents=True, exist_ok=True)
        (root / place).write_text("1\t2\t3.0\t4\n")
    got = {(r.test_fold, r.val_fold, r.part) for r in files.read_nested_folders(spark, str(root)).collect()}
    assert got == {(0, None, "test"), (0, None, "train"), (1, 3, "train"), (1, 3, "val"), (1, None, "test")}


def test_long_chains_of_side_tables_settle(spark):
    """Every round takes one more pair away; a fixed number of rounds would not do."""
    n = 12
    inter = rows(spark, [(k, k, 1.0) for k in range(n)])
    left = rows(spark, [(k, k) for k in range(n)], "user long, item long")
    right = rows(spark, [(k, k + 1) for k in range(n - 1)], "user long, item long")
    ids = clean.aligned_ids(inter, [right, left])
    assert ids["user"].count() == 0 and ids["item"].count() == 0


def test_rounds_leave_one_table_behind(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    # a path graph loses its two ends in each round
    edges = [(k, k, 1.0) for k in range(8)] + [(k, k + 1, 1.0) for k in range(7)]
    assert prefilter.iterative_k_core(rows(spark, edges), 2).count() == 0
    assert len([x for x in os.listdir(tmp_path / "tastegrid") if x.startswith("core-")]) == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            session.shared_folder(Session())
