import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tastegrid.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_statistics_equal_brute_force(spark, documents, odd):
    rnd = random.Random(9)
    rows = [(100 + i, rnd.choice([" ", "\n"]).join(rnd.choice(["a", "b", "cé", "#x", "y|z", "\x0b", "a\nb"]) for _ in range(rnd.randrange(120))), "s") for i in range(120)]
    rows += [(300, "a b c " * 9000, "s"), (301, "a b a b a b a", "s"), (302, "x y z x y z", "s"), *odd]
    got = qr.statistics(documents(rows)).withColumn("failed", qr.base_failed())
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain(t))) for i, t, _ in rows)


def corpus(n=600):
    rnd = random.Random(10)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(60, 120))]
        junk = i % 5 == 0
        if junk:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "s"))
        if i % 3:
            labels.append((i, 0 if junk else 1))
    return rows, labels


def test_learned_rules_hold_on_rows_without_labels(spark, documents):
    rows, labels = corpus()
    judged = qr.judge(documents(rows), spark.createDataFrame([*labels, (3, None), (10**6, 0), (None, 0)], "doc_id long, quality int"))
    got = {r.doc_id: r.kept for r in judged.collect()}
    known = {i for i, _ in labels}
    unseen = [i for i in range(600) if i not in known]
    assert len(got) == 600 and all(got[i] for i in unseen if i % 5)
    assert sum(got[i] for i in unseen if i % 5 == 0) <= 0.1 * len(unseen) / 5


def test_rules_are_ordered_conditions(spark, documents):
    rows, labels = corpus(300)
    stats = qr.statistics(documents(rows)).join(spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id").withColumn("low", F.col("quality") == 0)
    rules = qr.learn(stats)
    assert 1 <= len(rules) <= 8 and all(1 <= len(r) <= 3 and all(c.feature in qr.FEATURES for c in r) for r in rules)
    assert "CASE WHEN" in str(qr.verdict(rules))


def test_without_labels_only_the_base_filter_rejects(spark, documents, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for rows in (odd, []):
        assert all(r.kept == (not r.base_failed) for r in qr.judge(documents(rows), none).collect())
    one_class = spark.createDataFrame([(5, 0)], "doc_id long, quality int")
    assert qr.judge(documents(odd), one_class).count() == len(odd)
