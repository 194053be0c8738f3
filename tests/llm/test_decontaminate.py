import random

import numpy as np

from tastegrid.llm import decontaminate as dc

VOCABULARY = [f"term{k}" for k in range(800)]


def plain_score(item, passage):
    """Smith-Waterman, cell by cell."""
    best, rows = 0.0, [[0.0] * (len(passage) + 1)]
    for w in item:
        row = [0.0]
        for j, v in enumerate(passage, 1):
            same = dc.MATCH if v == w and w != 0 else dc.MISMATCH
            row.append(max(0.0, rows[-1][j - 1] + same, rows[-1][j] - dc.GAP, row[-1] - dc.GAP))
        rows.append(row)
        best = max(best, *row)
    return best


def test_alignment_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        item = np.array([rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 12))])
        passage = np.array([rnd.randrange(0, 6) for _ in range(rnd.randrange(0, 30))], dtype=int)
        assert abs(dc.align(item, passage)[0] - plain_score(item, passage)) < 1e-9


def edited(words, rnd, share):
    out = []
    for w in words:
        turn = rnd.random()
        out += [] if turn < share / 3 else [rnd.choice(VOCABULARY)] if turn < 2 * share / 3 else [w, "extra"] if turn < share else [w]
    return out


def test_edited_copies_are_found_and_clean_documents_are_not(spark, documents):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice(VOCABULARY) for _ in range(40))) for i in range(30)]
    rows, leaks = [], set()
    for d in range(200):
        words = [rnd.choice(VOCABULARY) for _ in range(300)]
        if d % 4 == 0:
            i = d // 4 % 30
            words[150:150] = edited(items[i][1].split(), rnd, 0.05 * (d % 5))
            leaks.add((d, i))
        rows.append((d, " ".join(words).upper() if d % 8 == 0 else ", ".join(words), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.contaminated(documents(rows), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == leaks
    spans = {r.doc_id: r for r in found.collect()}
    assert (spans[0].start_word, spans[0].end_word, spans[0].score) == (150, 190, 1.0)
    # every pair by brute force
    lists = {i: dc.words_of(t) for i, t in items}
    for d, text, _ in rows[:24]:
        words = dc.words_of(text)
        for i, own in lists.items():
            numbers = {w: k + 1 for k, w in enumerate(dict.fromkeys(own))}
            score = dc.align(np.array([numbers[w] for w in own]), np.array([numbers.get(w, 0) for w in words]))[0] / len(own)
            assert (score >= dc.MIN_SCORE) == ((d, i) in leaks)
    kept = {r.doc_id for r in dc.clean(documents(rows), bench).collect()}
    assert kept == set(range(200)) - {d for d, _ in leaks}


def test_slices_give_the_same(spark, documents):
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice(VOCABULARY) for _ in range(20))) for i in range(12)]
    docs = documents([(d, " ".join([*(rnd.choice(VOCABULARY) for _ in range(30)), items[d % 12][1]]), "s") for d in range(24)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench, slice_words=n).collect()) for n in (10**6, 50))
    assert one == many == sorted((d, d % 12) for d in range(24))


def test_odd_rows(spark, documents, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two"), (4, "one two three four five six"), (4, "one two three four five six"), (None, "one two three")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in dc.contaminated(documents(odd), bench).collect())
    assert ("6", 4) in got and ("4", 3) in got and ("None", 3) in got
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(documents(odd), none).count() == 0 and dc.clean(documents(odd), none).count() == len(odd)
    assert dc.contaminated(documents([]), bench).count() == 0


def test_clean_by_row_not_by_id(spark, documents):
    leak = " ".join(f"item{i}" for i in range(30))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(None, leak, "s"), (None, "an own text", "s"), (4, f"before {leak} after", "s"), (4, "another own text", "s"), (None, None, "s")]
    kept = sorted(((r.doc_id, r.text) for r in dc.clean(documents(rows), bench).collect()), key=str)
    assert kept == sorted([(None, "an own text"), (4, "another own text"), (None, None)], key=str)
