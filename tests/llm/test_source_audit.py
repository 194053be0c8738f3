import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from tastegrid.llm import source_audit as sa

SCHEMA = "doc_id long, text string, lang string, source string, value long, item string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def plain(rows, min_docs=10, top=10):
    """By loops over every kept term and every pair of sources."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words, word = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                words += [word] if word else []
                word = ""
            else:
                word += c.lower() if c.isascii() else c
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: counts[lang, s] for at, s in groups if at == lang}
        whole = sum(own.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in own.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < top]
    return out


def corpus(n=300, seed=6):
    """One source with a third of the rows, sources with few or no terms, ties, capitals, accents, nulls and copies."""
    rnd = random.Random(seed)
    words = ["the", "The", "of", "été", "É", "naïve", "x1y", "tail", "zo", "日本", "a_b", "don't"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for d in range(n):
        source = rnd.choice(["hot", "hot", "hot", "s1", "s2", "s3", "s4", None])
        own = words[: rnd.choice([6, 15, len(words)])]
        rows.append((d, " ".join(rnd.choice(own) for _ in range(rnd.randrange(0, 30))), rnd.choice(["en", "en", "fr", None]), source))
    rows += [(n, None, "en", "empty"), (n + 1, "123 --", "en", "digits"), (None, None, None, None), (5, rows[5][1], rows[5][2], rows[5][3]), (n + 2, "rare", "xx", "one"), (n + 3, "", "xx", "two")]
    return rows


def got(out):
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("block", [1, 50, 600_000])
def test_equals_plain_version(spark, block):
    rows = corpus()
    assert got(sa.audit(frame(spark, rows).repartition(5), block_postings=block)) == sorted(plain(rows))


def test_equals_sql(spark, odd):
    rows = corpus(200, 8) + [(i, t, "en", s) for i, t, s in odd]
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toArrow())
    want = sorted(con.execute(sa.SQL).fetchall())
    assert got(sa.audit(frame(spark, rows))) == want


def test_few_cells_and_no_matrix(spark, monkeypatch):
    rows = corpus(150, 3)
    monkeypatch.setattr(sa, "CELLS", 2)
    monkeypatch.setattr(sa, "DENSE", 0)
    assert got(sa.audit(frame(spark, rows), min_docs=3, top_terms=4)) == sorted(plain(rows, 3, 4))


def test_shares_of_huge_counts_are_exact(spark):
    n, total, v = 7 * 10**14 + 3, 9 * 10**14, 123_457
    row = spark.range(1).select(sa.share(sa.F.lit(n), sa.F.lit(total), sa.F.lit(v)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_run_is_sorted_and_merges(spark):
    block = sa.Block()
    for text, source in ((b"b a B", "s"), (b"a c", "t"), (b"", "u"), (b"a", "s")):
        block.add(text, "en", source)
    (run,) = block.run()
    assert run.column(1).to_pylist() == ["a", "b", "c"] and run.column(2).to_pylist() == [3, 1, 1]
    twice = pa.concat_batches([run.slice(0, 1), run])
    both = sa.merged(twice)
    assert both.column(2).to_pylist() == [6, 1, 1]
    assert [dict(zip(s, c)) for s, c in zip(both.column(3).to_pylist(), both.column(4).to_pylist())] == [{"s": 4, "t": 2}, {"s": 2}, {"t": 1}]


def test_empty(spark):
    assert got(sa.audit(frame(spark, []))) == []
    assert got(sa.audit(frame(spark, [(1, None, None, None)]))) == []
    assert got(sa.audit(frame(spark, [(1, "a", "en", "s"), (2, "b", "en", "t")]))) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
