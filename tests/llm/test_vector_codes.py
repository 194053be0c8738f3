import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tastegrid.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int, `a.b` int"


def plain(rows, parts, entries, rounds):
    """The same by loops: every distance of every part, Python's whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    size = len(kept[0][1]) // parts if kept else 0
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(p, c[p])[1], []).append(c[p])
            moved.append([tuple(sum(x) // len(held[k]) for x in zip(*held[k])) if k in held else e for k, e in enumerate(books[p])])
        books = moved
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    total = Counter()
    for (_, _, lab), f in zip(kept, found):
        total[lab] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[lab], digest) for (i, _, lab), f in zip(kept, found)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", 3, 4) for r in rows], SCHEMA)


def table(seed=4, n=220, width=8):
    """Coarse values, so that parts, distances and whole rows tie; null and broken vectors, null and repeated ids and labels."""
    rnd = random.Random(seed)
    rows = [(i, [rnd.randrange(-3, 4) / 64 for _ in range(width)], rnd.choice([0, 1, None])) for i in range(n)]
    rows += [(7, rows[7][1], 0), (7, rows[9][1], 0), (None, rows[3][1], None), (None, None, 1), (900, None, None)]
    rows += [(901, [0.0] * (width - 1) + [float("nan")], 1), (902, [None] + [0.0] * (width - 1), 1), (903, [float("inf")] * width, 1), (-5, [-0.001] * width, 2)]
    return rows


def got(out):
    return sorted(map(str, (tuple(r) for r in out.select("id", "code", "error", "label_error", "codebooks_sha256").collect())))


@pytest.mark.parametrize("parts, entries, rounds", [(4, 6, 2), (2, 64, 1), (8, 3, 0), (1, 5, 3)])
def test_equals_plain_version(spark, parts, entries, rounds):
    rows = table()
    out = vc.compress(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert got(out) == sorted(map(str, plain(rows, parts, entries, rounds)))


def test_walk_of_the_trie_equals_all_distances():
    rnd = np.random.default_rng(3)
    part = rnd.integers(-4, 5, (3000, 4))
    book = rnd.integers(-5, 6, (17, 4))
    leaves, inverse, weight = vc.distinct_parts(part)
    assert (leaves[inverse] == part).all() and weight.sum() == len(part) and (np.bincount(inverse) == weight).all()
    far = ((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    for subtree in (1, 2, 7, 100, 10_000):  # from node by node to level by level
        entry, error = vc.nearest(leaves, book, subtree)
        assert (entry[inverse] == far.argmin(axis=1)).all() and (error[inverse] == far.min(axis=1)).all()


def test_blocks_and_partitions_change_nothing(spark):
    rows = table(9)
    frames = frame(spark, rows)
    kept = vc.quantised(frames, "vec_id", "embedding", "label")
    books = vc.first_codebooks(kept, 4, 9)
    first = vc.refined(kept, books)
    assert (vc.refined(kept.repartition(7), books, block=5) == first).all()
    one, two = (sorted(map(str, vc.assigned(k, first, block=b).collect())) for k, b in ((kept, 10_000), (kept.repartition(3), 3)))
    assert one == two


def test_many_labels_are_salted(spark):
    coded = vc.compress(frame(spark, table()), parts=4, entries=6).drop("label_error")
    one, two = (sorted(map(str, vc.with_label_errors(coded, small=s, salt=5).collect())) for s in (100, 0))
    assert one == two


def test_edges(spark):
    assert vc.compress(frame(spark, [])).count() == 0
    assert vc.compress(frame(spark, [(1, None, 1), (2, [float("nan")] * 16, 1)])).count() == 0
    huge = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 15, 1)]  # held at the limit; another length than the first's goes
    rows = vc.compress(frame(spark, huge)).collect()
    assert sorted((r.id, r.code, r.error) for r in rows) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    assert vc.compress(frame(spark, [(1, [], 1), (2, [], None)])).count() == 2
    with pytest.raises(ValueError):
        vc.compress(frame(spark, [(1, [0.5] * 17, 1)]))
