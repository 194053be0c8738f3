import random

import pytest

from tastegrid.llm import mixing
from tests.llm.conftest import whole
from tools.check import compare


def rows(n, seed=3, sources="abcdefg"):
    rnd = random.Random(seed)
    return [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 400))), rnd.choice([*sources, sources[0], None])) for i in range(n)]


def test_equals_ranking_every_quotient(spark, documents, duck, odd):
    for data in (rows(300), odd, rows(1), [(1, "a b", "s"), (2, "a", "t")]):
        docs = documents(data)
        assert compare(whole(mixing.mix(docs).toPandas()), duck(mixing.SQL, documents=docs.toArrow())) == ""


def test_many_shards(spark, documents, duck, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    docs = documents(rows(200))
    sql = mixing.SQL.replace(f"greatest({1 << 14},", "greatest(500,")
    got = mixing.mix(docs).toPandas()
    assert got["shard"].max() > 5
    assert compare(whole(got), duck(sql, documents=docs.toArrow())) == ""


def test_near_the_targets_and_never_over_twice(spark, documents):
    got = mixing.mix(documents(rows(400))).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((per["taken"] - per["target"]).abs() <= 2 * mixing.BLOCK_WORDS).all()
    assert per["target"].sum() == pytest.approx(1.5 * per["size"].sum())
    assert (per["target"] <= 2 * per["size"] + 1e-9).all()


def test_reruns_agree_on_other_partitions(spark, documents):
    docs = documents(rows(120))
    a = mixing.mix(docs).toPandas()
    b = mixing.mix(docs.repartition(7, "text")).toPandas()
    assert compare(a, b) == ""


def test_empty(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    only_blank = mixing.mix(documents([(1, None, "a"), (2, "", None)])).toPandas()
    assert (only_blank["taken"] == 0).all() and (only_blank["target"] == 0).all()


def test_mixed_rows_keep_their_columns(spark, documents):
    docs = documents(rows(50) + [(7, "again and again", "a")] * 2)
    got = mixing.mixed(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "drop", "score", "fp", "size", "source_size", "target", "taken"]
    assert 0 < got.count() <= docs.count()
