"""Draws of unseen items: accepted rows are written once, neighbours are never written."""

from tastegrid.operators import sampling as ns


def _written(monkeypatch):
    real, sizes = ns.materialise, []

    def counted(df, name="stage"):
        out = real(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(ns, "materialise", counted)
    return sizes


def test_a_row_draws_again_only_if_rejected(spark, monkeypatch):
    seen = spark.createDataFrame([(u, i) for u in range(40) for i in range(30) if (u + i) % 3], "user long, item long")
    rows = seen.limit(300)
    n = rows.count()
    catalogue, size = ns.numbered(spark.createDataFrame([(i,) for i in range(30)], "item long"))
    sizes = _written(monkeypatch)
    got = ns.first_unseen(rows, ["user", "item"], "user", seen, catalogue, size, 42, "neg").collect()
    assert len(got) == n and not {(r.user, r.negative) for r in got} & {(r.user, r.item) for r in seen.collect()}
    redrawn = [s for name, s in sizes[1:] if name == "redraw"]
    assert sizes[0] == ("negatives", n) and sum(s for name, s in sizes if name == "negatives") <= n + sizes[1][1] + sum(redrawn)
    assert sizes[1][1] < n  # only rejected rows after the first draw


def test_neighbours_are_not_written(spark, ratings, monkeypatch):
    train = ratings.where("item <> 0 AND user <> 0")
    sizes = _written(monkeypatch)
    got = {r.id: (r.neighbour, r.stranger) for r in ns.neighbourhood_samples(train, "item").collect()}
    pairs = {(a.item, b.item) for a in train.collect() for b in train.collect() if a.user == b.user and a.item != b.item}
    items = {r.item for r in train.collect()}
    assert got.keys() == items and any(s for _, s in got.values())
    for i, (near, far) in got.items():
        if len([j for x, j in pairs if x == i]) <= 0.8 * len(items) and any(x == i for x, _ in pairs):
            assert (i, near) in pairs and (i, far) not in pairs
        else:
            assert (near, far) == (0, 0)
    assert sum(s for _, s in sizes) < len(pairs)
