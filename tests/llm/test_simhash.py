import random

import numpy as np
import xxhash

from tastegrid.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    ids = [i for i, _, _ in rows]
    return fps, [min((x for x, g in zip(ids, group) if g == own and x is not None), default=None) for own in group]


def rows(n=150):
    rnd = random.Random(2)
    base = [[f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(60, 200))] for _ in range(20)]
    out = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(9)}"
        out.append((i, " ".join(words), "s"))
    return out


def check(spark, documents, data, **options):
    fps, components = plain_components(data)
    got = simhash.near_duplicates(documents(data), **options).select("id", simhash.hex16(simhash.F.col("fp")).alias("fp"), "component_id").collect()
    want = [(i, f"{fp:016x}", c) for (i, _, _), fp, c in zip(data, fps, components)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_equals_brute_force(spark, documents, odd):
    check(spark, documents, rows())
    check(spark, documents, odd)


def test_hot_files_lose_no_link(spark, documents):
    check(spark, documents, rows(90), hot_file=2)


def test_other_radius(spark):
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(9):
        flip = rnd.random(3000) < 0.6
        b[flip] ^= np.uint64(1) << rnd.integers(0, 64, flip.sum(), dtype=np.uint64)
    far = np.bitwise_count(a ^ b)
    for radius in (1, 2, 3, 4, 7, 8):
        assert (simhash.linked_lanes(a, b, radius) == (far <= radius)).all()


def test_keep_first(spark, documents):
    data = rows(60)
    kept = sorted(r.doc_id for r in simhash.keep_first(documents(data)).collect())
    assert kept == sorted(set(plain_components(data)[1]))


def test_empty(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.keep_first(documents([(None, None, None), (3, None, None)])).count() == 1


def test_keep_first_by_row_not_by_id(spark, documents):
    rnd = random.Random(8)
    a, b, c = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    data = [(None, a, "s"), (7, b, "s"), (7, c, "s"), (9, b, "s"), (None, b, "s"), (7, c, "s")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(documents(data)).collect()), key=str)
    assert kept == sorted([(None, a), (7, b), (7, c)], key=str)
