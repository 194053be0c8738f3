"""Rounds of the k-core carry sizes, not edges."""

from tastegrid.operators import prefilter as pf


def chain(spark, n):
    """A ring of users and items around which every node has two rows, and a path that is peeled from its end, node by node."""
    ring = [(u, i) for u in range(100, 110) for i in (u + 900, 1000 + (u - 99) % 10 + 100)]
    path = [(u, i) for u in range(n) for i in (u + 200, u + 201)][1:]
    return spark.createDataFrame([(u, i, 1.0, 1) for u, i in ring + path], "user long, item long, rating double, ts long")


def plain(edges, keep_user, keep_item, at_once):
    while True:
        def sizes(side, rows):
            out = {}
            for e in rows:
                out[e[side]] = out.get(e[side], 0) + 1
            return out

        u, i = sizes(0, edges), sizes(1, edges)
        left = [e for e in edges if keep_user(u[e[0]])]
        i = i if at_once else sizes(1, left)
        left = [e for e in left if keep_item(i[e[1]])]
        if len(left) == len(edges):
            return set(left)
        edges = left


def test_rounds_do_not_write_the_edges(spark, monkeypatch):
    table = chain(spark, 4)
    rows = [(r.user, r.item) for r in table.collect()]
    real, sizes = pf.materialise, []

    def counted(df, name="stage"):
        out = real(df, name)
        sizes.append(name)
        return out

    monkeypatch.setattr(pf, "materialise", counted)
    got = {(r.user, r.item) for r in pf.iterative_k_core(table, 2).collect()}
    assert got == plain(rows, lambda n: n >= 2, lambda n: n >= 2, False)
    assert sizes.count("core") == 1  # one before for every round


def test_bounds_on_both_sides(spark, ratings):
    rows = [(r.user, r.item) for r in ratings.collect()]
    for bounds in ((3, 4, None, None), (2, 2, 8, None), (3, 2, 9, 20), (1, 1, None, 12)):
        lo_u, lo_i, hi_u, hi_i = bounds
        want = plain(rows, lambda n: lo_u <= n <= (hi_u or n), lambda n: lo_i <= n <= (hi_i or n), True)
        assert {(r.user, r.item) for r in pf.k_core_simultaneous(ratings, *bounds).collect()} == want
