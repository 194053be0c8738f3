"""Every stage of the pipeline next to a plain version of it, each on the rows that the stage before kept."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tastegrid.llm import decontaminate as dc
from tastegrid.llm import line_dedup, mixing, toxicity
from tests.llm.test_simhash import plain_components


def corpus():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice(["ta", "re", "mo", "ni", "sel", "ka", "du"]) for _ in range(rnd.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    rows, labels = [], []
    for d in range(150):
        words = [word() for _ in range(rnd.randrange(40, 90))]
        if d % 10 == 0:
            words[5:5] = ["blurgo" + word() for _ in range(4)]
        if d % 17 == 3:
            words[9:9] = items[d % 6][1].split()
        text = "top of the page\n" + " ".join(words)
        if d % 25 == 7:
            text = rows[d - 2][1]
        rows.append((d, text, "en", "ab"[d % 2], len(text)))
        labels.append((d, 1, int("blurgo" in text)))
    rows.append((500, None, None, None, None))
    return rows, labels, items


def test_stages_equal_plain_versions(spark, tmp_path, duck):
    rows, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]

    def step(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out = corpus_pipeline.materialise(out, name)
        return out, sorted(map(tuple, out.collect()), key=str)

    verdicts = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    docs, now = step("toxicity", docs)
    assert now == sorted((r for r in rows if not verdicts[r[0]]), key=str) and len(now) < len(rows)

    uses, pages = Counter(), Counter(r[3] for r in now)
    for r in now:
        uses.update((r[3], line) for line in {x.strip(" ") for x in (r[1] or "").split("\n")} if line)
    common = {k for k, n in uses.items() if n >= line_dedup.MIN_PAGES and n >= line_dedup.RATIO * pages[k[0]]}

    def cut(r):
        text = None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" ")) not in common)
        return (r[0], text, r[2], r[3], None if text is None else len(text))

    want = sorted(map(cut, now), key=str)
    docs, now = step("line_dedup", docs)
    assert now == want and common

    first = set(plain_components([(r[0], r[1], r[3]) for r in now])[1])
    want = [r for r in now if r[0] in first]
    docs, now = step("simhash_near_dedup", docs)
    assert now == want and len(want) < len(rows)

    def leaks(text):
        words = dc.words_of(text)
        for _, item in items:
            own = dc.words_of(item)
            numbers = {w: k + 1 for k, w in enumerate(dict.fromkeys(own))}
            score = dc.align(np.array([numbers[w] for w in own]), np.array([numbers.get(w, 0) for w in words], dtype=int))[0]
            if score >= dc.MIN_SCORE * len(own):
                return True
        return False

    want = [r for r in now if not leaks(r[1])]
    lost = len(now) - len(want)
    docs, now = step("benchmark_decontamination", docs)
    assert now == want and lost >= 3

    plan = duck(mixing.SQL, documents=docs.toArrow())
    taken = {int(r.doc_id): r.taken for r in plan[plan["doc_id"].notna()].itertuples() if r.taken > 0}
    out, _ = step("source_mixing", docs)
    assert {r.doc_id: r.taken for r in out.collect()} == taken
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.collect()) == sorted(taken)


def test_any_names_of_further_columns(spark, tmp_path):
    """Names with dots and back ticks and the names that the operators use inside pass through every stage."""
    names = ["a.b", "__key", "__host", "__id", "__hit", "row", "key", "host", "drop", "lines", "own", "of", "hit", "place", "taken", "sco`re"]
    rows, labels, items = corpus()
    rows = rows[:30] + rows[-1:]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.select("*", *[(corpus_pipeline.F.col("doc_id") * 3 + k).alias(n) for k, n in enumerate(names)])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns or name == "source_mixing"
        docs = corpus_pipeline.materialise(out, name)
    got = docs.collect()
    assert got and all(r["a.b"] == r.doc_id * 3 and r["sco`re"] == r.doc_id * 3 + len(names) - 1 for r in got if r.doc_id is not None)
