import math
import random
import zlib

import numpy as np

from tastegrid.llm import toxicity as tx


def corpus(n=900):
    rnd = random.Random(11)
    syllables = ["ta", "re", "mo", "ni", "sel", "ka", "du"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(30, 150))]
        bad = i % 6 == 0
        if bad:  # an inflected expression: one stem, many endings
            for _ in range(3):
                words[rnd.randrange(len(words))] = "blurgo" + word()
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    got = tx.toxicity(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    bad = [r for r in held if r.doc_id % 6 == 0]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in held) - sum(r.predicted for r in bad) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = tx.drop_toxic(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == documents([]).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_never_read(spark, documents):
    rows, labels = corpus(200)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = ({r.doc_id: r.score for r in tx.toxicity(documents(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_sample_is_bounded(spark):
    table = spark.createDataFrame(corpus(300)[1], "doc_id long, toxic int")
    assert tx.labelled_sample(table, max_labelled=40).count() < 80


def test_model_equals_plain_kneser_ney(spark):
    """Every step and backoff of both classes by loops over the words."""
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 13))): [rnd.choice([0, 0, 1, 5]) for _ in range(4)] for _ in range(120)}
    steps, types = {}, {}
    for w, (o0, t0, o1, t1) in words.items():
        path = ["", *tx._path(w)]
        for parent, node in zip(path, path[1:]):
            o, t = steps.get((parent, node), (0, 0))
            steps[parent, node] = (o + o0 + o1, t + t0 + t1)
            types[node] = types.get(node, 0) + 1
    d = tx.DISCOUNT
    scale = sum(t for (p, _), (_, t) in steps.items() if p == "") / sum(o for (p, _), (o, _) in steps.items() if p == "")

    def spare(n, even):
        return d * ((1 - math.exp(-n)) if even else float(n > 0))

    below = {}
    for (parent, node), (o, t) in steps.items():
        b = below.setdefault(parent, dict(t=0, e=0, ts=0, es=0, both=0, kinds=0, types=0))
        e = o * scale
        for k, v in dict(t=t, e=e, ts=spare(t, False), es=spare(e, True), both=o + t, kinds=int(o + t > 0), types=types[node]).items():
            b[k] += v
    free = {p: (b["ts"] / b["t"] if b["t"] else 1.0, b["es"] / b["e"] if b["e"] else 1.0) for p, b in below.items()}
    want = {}
    for (parent, node), (o, t) in steps.items():
        if o + t < 2:
            continue
        b, e = below[parent], o * scale
        shared = (max(o + t - d, 0) + d * b["kinds"] * types[node] / b["types"]) / b["both"]
        toxic = (t - spare(t, False)) / b["t"] if b["t"] else 0.0
        other = (e - spare(e, True)) / b["e"] if b["e"] else 0.0
        step = math.log(toxic + free[parent][0] * shared) - math.log(other + free[parent][1] * shared)
        back, n = 0.0, t + e
        if node in below:
            m = below[node]["t"] + below[node]["e"]
            back = (math.log(free[node][0]) - math.log(free[node][1])) * m / (m + tx.CAUTION)
        want[node] = (step * n / (n + tx.CAUTION), back)
    counts = spark.createDataFrame([(w, *c) for w, c in words.items()], "word string, o0 long, t0 long, o1 long, t1 long")
    got = {r.node: (r.step, r.back) for r in tx.model(tx.nodes(counts), (0, 1)).collect()}
    assert got.keys() == want.keys() and max(abs(a - b) for n in want for a, b in zip(got[n], want[n])) < 1e-9


def test_reader_equals_loops():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("xyz") for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    nodes = sorted({n for w in vocabulary for n in tx._path(w)})
    known = {n: (rnd.uniform(-1, 3), rnd.uniform(-1, 1)) for n in nodes}
    digests = tx._hashes(nodes)
    order = np.argsort(digests)
    packed = (digests[order], *(np.array([known[n][k] for n in nodes])[order] for k in (0, 1)))
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(n)) for n in (0, 1, 99, 100, 101, 350)] + [None, "xyzzy qqq"]
    for text, got in zip(texts, tx.Reader(packed).read(texts)):
        words = (text or "").split()
        own = [tx.word_ratio(w, known) for k in range(0, len(words), tx.WINDOW) for w in set(words[k : k + tx.WINDOW])]
        strong, n = sum(max(r - tx.MARGIN, 0.0) for r in own), max(len(words), 1)
        want = (sum(own) / max(len(own), 1), (strong / n) ** 0.5, strong / (n + 25), n**-0.5)
        assert np.allclose(got, want, atol=1e-12)


def test_a_words_ratio_adds_up_along_its_prefixes():
    known = {"b": (0.5, 0.1), "bl": (1.0, -0.2), "bl$": (2.0, 0.0)}
    assert abs(tx.word_ratio("bl", known) - 3.5) < 1e-12
    assert abs(tx.word_ratio("blur", known) - (1.5 - 0.2)) < 1e-12
    assert tx.word_ratio("x", known) == 0.0


def test_odd_rows(spark, documents, odd):
    some = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (6, None), (7, 0), (8, 1)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (some, none):
        got = tx.toxicity(documents(odd), labels).collect()
        assert len(got) == len(odd) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        assert tx.toxicity(documents([]), labels).count() == 0
    blank = {round(r.score, 12) for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1


def test_fit_recovers_a_threshold():
    x = np.linspace(-1, 1, 400)[:, None]
    w = tx.fit(x, (x[:, 0] > 0.2).astype(float))
    assert abs(-w[0] / w[1] - 0.2) < 0.05


def test_a_rare_toxic_word_counts_beside_many_frequent_ones(spark):
    """More nodes than 262,144 that are more frequent than the rare word."""
    from pyspark.sql import functions as F

    words = spark.range(150_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("word"), *[F.lit(9).cast("long").alias(c) for c in tx.CELLS])
    words = words.union(spark.createDataFrame([("zzblurgo", 0, 2, 0, 1)], words.schema))
    known = tx.packed(tx.model(tx.nodes(words), (0, 1)))
    assert len(known[0]) > 1 << 18
    rare, other = tx.word_ratios(["zzblurgo", "zzother"], known)
    assert rare > 0.5 and rare > other


def test_ratios_at_once_equal_one_by_one(spark):
    data = [("b", 0.5, 0.1), ("bl", 1.0, -0.2), ("bl$", 2.0, 0.0), ("é", 9.0, 0.3), ("abcdefgh", 1.0, 1.0)]
    known = {n: (s, b) for n, s, b in data}
    words = ["bl", "blur", "x", "é", "b", "abcdefghi", "elephant"]
    got = tx.word_ratios(words, tx.packed(spark.createDataFrame(data, "node string, step double, back double")))
    assert max(abs(g - tx.word_ratio(w, known)) for g, w in zip(got, words)) < 1e-12
