import random
from itertools import product

import numpy as np
import pytest

from tastegrid.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string, held_out int, `a.b` int"
SOUNDS = {"aa": ["ta", "re", "mo", "ni", "sel"], "bb": ["og", "ust", "ka", "ein", "mo"], "cc": ["xi", "qua", "ze", "ni", "lho"]}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5, "x", 1, 2) for r in rows], SCHEMA)


def word(rnd, lang):
    return "".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randrange(1, 4)))


def corpus(n=240, seed=4):
    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rnd.choice(list(SOUNDS))
        rows.append((d, ", ".join(word(rnd, lang) for _ in range(rnd.randrange(1, 60))).capitalize() + ".", lang))
    return rows


@pytest.fixture(scope="module")
def field(spark):
    return li.learn(frame(spark, corpus()))


def by_paths(scores, moves):
    """Chances by adding up every sequence of labels."""
    n, k = scores.shape
    out, total = np.zeros((n, k)), 0.0
    pairs = np.zeros((k, k))
    for path in product(range(k), repeat=n):
        weight = np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += weight
        out[np.arange(n), path] += weight
        for a, b in zip(path, path[1:]):
            pairs[a, b] += weight
    return out / total, pairs / total, np.log(total)


@pytest.mark.parametrize("stride", [1, 2, 3, 32])
def test_forward_backward_equals_all_paths(stride):
    rnd = np.random.default_rng(2)
    lengths = np.array([1, 5, 0, 2, 6, 3])
    scores, moves = rnd.normal(size=(lengths.sum(), 3)) * 3, rnd.normal(size=(3, 3)) * 2
    got = li.marginals(scores, lengths, moves, stride)
    want, pairs, at = [], np.zeros((3, 3)), 0
    for n in lengths:
        if n:
            chances, joint, _ = by_paths(scores[at : at + n], moves)
            want.append(chances)
            pairs += joint
        at += n
    assert np.allclose(got, np.concatenate(want), atol=1e-12)
    assert np.allclose(li.pair_marginals(scores, got, lengths[lengths > 0], moves), pairs, atol=1e-9)


def test_long_chain_equals_position_by_position():
    rnd = np.random.default_rng(5)
    scores, moves = rnd.normal(size=(5000, 4)) * 20, np.eye(4) * 3 - 1
    got = li.marginals(scores, np.array([5000]), moves)
    assert np.allclose(got, li.marginals(scores, np.array([5000]), moves, 7), atol=1e-9) and np.allclose(got.sum(axis=1), 1)


def test_gradient_equals_differences():
    rnd = np.random.default_rng(1)
    words = ["ab", "ba", "abc", "é"]
    lexicon = li.Lexicon(["ab", "zz"], np.array([[5.0, 1.0, 0.0], [1.0, 1.0, 9.0]]), np.array([20.0, 20.0, 30.0]))
    field = li.Field(["x", "y", "z"], lexicon)
    field.grams = rnd.normal(size=field.grams.shape) * 0.3
    field.unknown, field.moves = rnd.normal(size=3), rnd.normal(size=(3, 3))
    chains, truth = [np.array([0, 1, 2, 0]), np.array([3])], [np.array([0, 0, 1, 2]), np.array([1])]

    def value():
        total = 0.0
        for c, t in zip(chains, truth):
            scores = field.scores(words)[c]
            total += sum(scores[k, y] for k, y in enumerate(t)) + sum(field.moves[a, b] for a, b in zip(t, t[1:])) - by_paths(scores, field.moves)[2]
        return total / 5

    got = li.gradient(field, li.Features(words, lexicon), chains, truth)
    _, bucket = li.features(words)
    places = [(field.grams, got[0], (int(bucket[3]), 1)), (field.known, got[1], (2,)), (field.unknown, got[2], (0,)), (field.moves, got[3], (0, 1)), (field.moves, got[3], (2, 2))]
    for weights, slope, at in places:
        weights[at] += 1e-5
        up = value()
        weights[at] -= 2e-5
        down = value()
        weights[at] += 1e-5
        assert abs((up - down) / 2e-5 - slope[at]) < 1e-6


def test_features_are_those_of_each_word_alone():
    words = ["a", "abcdefg", "日本語", "éa"]
    word, bucket = li.features(words)
    for k, w in enumerate(words):
        assert sorted(bucket[word == k]) == sorted(li.features([w])[1])
    assert len(li.features(["abc"])[1]) == 3 + 4 + 3 + 2 + 1  # inside the word; with its two borders
    assert set(li.features(["abcd"])[1]) & set(li.features(["abxy"])[1]) and not set(li.features(["abcd"])[1]) & set(li.features(["xyzw"])[1])


def test_held_out_accuracy(spark, field):
    rows = corpus()
    found = {r.doc_id: r for r in li.identify(frame(spark, rows), field).collect()}
    own = [found[d].lang_pred == lang for d, _, lang in rows if found[d].held_out]
    assert len(own) > 60 and np.mean(own) > 0.97 and all(0 <= r.score <= 1 for r in found.values())
    again = {r.doc_id: r for r in li.identify(frame(spark, rows).repartition(7)).collect()}
    assert {d: r.lang_pred for d, r in found.items()} == {d: r.lang_pred for d, r in again.items()}


def test_code_switched_words_have_labels_of_their_own(spark, field):
    rnd = random.Random(9)
    parts = [("aa", 14), ("cc", 11), ("bb", 17)]
    truth = [lang for lang, n in parts for _ in range(n)]
    rows = [(d, " ".join(word(rnd, lang) for lang in truth), None) for d in range(20)]
    labels = li.label_words(frame(spark, rows), field).collect()
    assert len(labels) == 20 * len(truth) and np.mean([r.lang == truth[r.position] for r in labels]) > 0.95
    assert {r.lang_pred for r in li.identify(frame(spark, rows), field).collect()} == {"bb"}  # most of the words


def test_labels_of_held_out_rows_are_not_read(spark, field):
    rows = corpus()
    held = {r.doc_id for r in frame(spark, rows).where(li.held_out()).collect()}
    other = li.learn(frame(spark, [(d, t, "aa" if d in held else lang) for d, t, lang in rows]))
    assert (other.grams == field.grams).all() and (other.moves == field.moves).all()


def test_odd_rows(spark, field, odd):
    rows = [(i, t, None) for i, t, _ in odd] + [(50, "123 ½ --", None), (51, "taremo " * 40_000, None), (52, "퟿\U0001f600", "aa")]
    found = li.identify(frame(spark, rows), field).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[2].lang_pred == by[50].lang_pred == "und" and by[50].score == 0 and by[51].lang_pred == "aa"
    assert li.identify(frame(spark, []), field).count() == 0


def test_nothing_to_learn_and_one_language(spark):
    assert {(r.lang_pred, r.score) for r in li.identify(frame(spark, [(1, "taremo", None), (2, None, "aa")])).collect()} == {("und", 0.0)}
    assert li.identify(frame(spark, [])).count() == 0
    one = [(d, "ta re mo", "aa") for d in range(9)]
    assert {(r.lang_pred, r.score) for r in li.identify(frame(spark, one)).collect()} == {("aa", 1.0)}
