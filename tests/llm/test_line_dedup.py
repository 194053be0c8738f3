import random

from tastegrid.llm import line_dedup
from tests.llm.conftest import whole
from tools.check import compare

COLUMNS = ["doc_id", "text", "n_lines", "n_dropped"]


def data(n=200):
    rnd = random.Random(1)
    return [
        (i, "\n".join([f"top of {i % 3}", *(f"line {rnd.randrange(60)}" for _ in range(rnd.randrange(6))), "", " all rights reserved "]), [None, "a", "b"][i % 3])
        for i in range(n)
    ]


def test_equals_sql(spark, documents, duck, odd):
    for rows in (data(), odd, data(5), []):
        docs = documents(rows)
        got = line_dedup.drop_boilerplate(docs).select(*COLUMNS).toPandas()
        assert compare(whole(got), duck(line_dedup.SQL.format(docs="documents"), documents=docs.toArrow())) == ""


def test_boilerplate_goes_and_the_rest_stays(spark, documents):
    rows = [(i, f"Home | About\nstory {i} a\nstory {i} b\nHome | About", "site") for i in range(40)] + [(100, "Home | About", "other")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(documents(rows)).collect()}
    assert got[3].text == "story 3 a\nstory 3 b" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[100].text == "Home | About"


def test_other_columns_stay(spark, documents):
    got = line_dedup.drop_boilerplate(documents(data(20)))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "drop", "score", "fp", "n_lines", "n_dropped"]
    assert got.first().drop == 7


def test_long_passages_go_from_a_smaller_part_on(spark, documents):
    rnd = random.Random(4)
    passage, rare, copied = (" ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(60)) for c in "prc")
    rows = [(i, f"story {i}", "big") for i in range(300)]
    rows += [(1000 + i, f"own {i}\n{passage}\nshort notice", "big") for i in range(6)]  # 2 % of the pages
    rows += [(2000 + i, f"own {i}\n{rare}", "big") for i in range(3)]  # fewer than MIN_PAGES
    rows += [(3000 + i, f"page\n{copied}", "big") for i in range(9)]  # one page, copied whole
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(documents(rows), long_ratio=line_dedup.LONG_RATIO).collect()}
    assert len(got) == len(rows)
    assert got[1002].text == "own 2\nshort notice" and got[1002].n_dropped == 1
    assert got[2001].text == f"own 1\n{rare}" and got[3004].text == f"page\n{copied}"
    none = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(documents(rows)).collect()}
    assert none == {i: t for i, t, _ in rows}


def test_pipeline_stage_drops_long_passages(spark, documents):
    import corpus_pipeline

    passage = " ".join(f"word{i}" for i in range(55))
    docs = documents([(i, f"story {i}", "big") for i in range(200)] + [(1000 + i, f"own {i}\n{passage}", "big") for i in range(5)])
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got[1003] == "own 3"
