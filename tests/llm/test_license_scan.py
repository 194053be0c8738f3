import random

import numpy as np

from tastegrid.llm import license_scan as ls


def plain_band(notice, words, start):
    """Most notice words in order within the band, cell by cell."""
    best = {}
    for i in range(len(notice) + 1):
        for k in range(2 * ls.BAND + 1):
            if i == 0:
                best[i, k] = 0
                continue
            j = start + i - 1 + k - ls.BAND
            options = [best[i - 1, k] + (0 <= j < len(words) and words[j] == notice[i - 1])]
            if k < 2 * ls.BAND:
                options.append(best[i - 1, k + 1])
            if k:
                options.append(best[i, k - 1])
            best[i, k] = max(options)
    return max(best[len(notice), k] for k in range(2 * ls.BAND + 1))


def test_alignment_equals_brute_force():
    rnd = random.Random(7)
    for _ in range(80):
        notice = np.array([rnd.randrange(1, 8) for _ in range(rnd.randrange(1, 15))])
        words = np.array([rnd.randrange(0, 8) for _ in range(rnd.randrange(1, 40))])
        start = rnd.randrange(-3, len(words))
        count, first, end = ls.align(notice, words, start)
        assert count == plain_band(notice, words, start)
        if count:
            assert count <= end - first <= len(words) and 0 <= first < end <= len(words)


def test_exact_and_edited_notices(spark, documents):
    text = ls.NOTICES["MIT-text"]
    words = text.split()
    edited = words[:20] + ["really"] + words[20:45] + words[47:]
    rows = [(i, f"Some words {i}.\n{t}\nand more", "s") for i, t in enumerate(ls.NOTICES.values())]
    rows += [(50, " ".join(["intro"] * 30 + edited), "s"), (51, "licensed under nothing. Released under the BSD License", "s"), (52, " ".join([ls.NOTICES["MIT"]] * 3), "s")]
    found = ls.license_spans(documents(rows)).collect()
    whole = {r.doc_id: r for r in found if r.doc_id < 50}
    for i, (name, wording) in enumerate(ls.NOTICES.items()):
        assert (whole[i].license, whole[i].coverage) == (name, 1.0)
        assert wording.rstrip(".").startswith(rows[i][1][whole[i].start : whole[i].end])
    part = [r for r in found if r.doc_id == 50]
    assert len(part) == 1 and part[0].license == "MIT-text" and part[0].matched_words == len(ls.words_of(text)) - 2
    assert not [r for r in found if r.doc_id == 51]
    assert len([r for r in found if r.doc_id == 52]) == 3


def test_five_common_words_share_a_fingerprint():
    rnd = random.Random(8)
    for _ in range(200):
        common = [rnd.randrange(1, 50) for _ in range(5)]
        a, b = (np.array([rnd.randrange(50, 90) for _ in range(4)] + common + [rnd.randrange(90, 99) for _ in range(4)]) for _ in range(2))
        assert {h for h, _ in ls.winnow(a)} & {h for h, _ in ls.winnow(b)}


def test_odd_rows(spark, documents, odd):
    assert ls.license_spans(documents(odd)).count() == 0
    assert ls.license_spans(documents([])).count() == 0
    got = ls.license_spans(documents(odd), {"own": "one two three four five"}).collect()
    assert {r.doc_id for r in got} == {7}


def found_in(text):
    return [(r[0], r[1], text[r[3] : r[4]]) for r in ls.scan(text, ls.Index(ls.NOTICES))]


def test_notices_with_text_put_in_or_taken_out():
    words = ls.NOTICES["MIT-text"].split()
    size = len(ls.words_of(ls.NOTICES["MIT-text"]))
    for n in (1, 8, 9, 15, 40):
        text = " ".join(["Intro"] + words[:30] + [f"foreign{k}" for k in range(n)] + words[30:] + ["end"])
        (name, coverage, span), = found_in(text)
        assert (name, coverage) == ("MIT-text", 1.0) and span.startswith("Permission") and "foreign0" in span
    twice = " ".join(words[:20] + ["x"] * 12 + words[20:40] + ["y"] * 30 + words[40:])
    assert [r[:2] for r in found_in(twice)] == [("MIT-text", 1.0)]
    cut = " ".join(["Intro"] + words[:25] + words[45:] + ["end"])
    (name, coverage, _), = found_in(cut)
    assert name == "MIT-text" and abs(coverage - (size - 20) / size) < 0.05


def test_parts_of_long_notices():
    words = ls.NOTICES["MIT-text"].split()
    size = len(ls.words_of(ls.NOTICES["MIT-text"]))
    for part in (words[: len(words) // 2 + 1], words[len(words) // 2 - 1 :], words[: int(len(words) * 0.6)]):
        text = " ".join(["Of the many words to say"] * 20 + part + ["and for this they are in the end"] * 20)
        (name, coverage, span), = found_in(text)
        own = len(ls.words_of(" ".join(part)))
        assert name == "MIT-text" and abs(coverage * size - own) <= 3 and abs(len(ls.words_of(span)) - own) <= 6
    assert found_in(" ".join(words[:20])) == []


def test_other_notices_inside_a_notice_and_copies_in_a_row():
    words = ls.NOTICES["MIT-text"].split()
    inner = " ".join(words[:30]) + " " + ls.NOTICES["Unlicense"] + " " + " ".join(words[30:])
    assert sorted(r[:2] for r in found_in(inner)) == [("MIT-text", 1.0), ("Unlicense", 1.0)]
    assert [r[:2] for r in found_in(" ".join(words * 3))] == [("MIT-text", 1.0)] * 3


def test_densest_part_equals_brute_force():
    rnd = random.Random(9)
    for _ in range(200):
        pairs = [(p, 2 * p) for p in sorted(rnd.sample(range(30), rnd.randrange(1, 20)))]
        value = lambda a, b: 2 * (b - a) - (pairs[b - 1][0] - pairs[a][0] + 1)
        a, b = ls.densest(pairs)
        assert value(a, b) == max(value(x, y) for x in range(len(pairs)) for y in range(x + 1, len(pairs) + 1))
