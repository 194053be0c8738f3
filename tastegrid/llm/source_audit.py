"""Source divergence audit: how far the term frequencies of a language's sources lie apart, from one pass over the texts.

Single-pass in-memory indexing: a task builds postings (term -> occurrences per source) for the texts it reads until a
block is full, then lets the block go as a run sorted by term. Runs are dealt to shards by the hash of (language, term);
Spark's sorter merges a shard's runs, and one streaming pass over the merged rows adds up what belongs to a term and
keeps the frequent ones. Divergences of source pairs start from what two sources without a single kept term would have;
a pass over the kept postings streams the corrections for terms that one or both of them hold. Everything is in whole
numbers, so results do not depend on the order of additions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.session import materialise

MIN_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Postings (term and source) of a block before it is let go as a run.
BLOCK_POSTINGS = 600_000
#: Pair cells that a task adds up before it sends them on.
CELLS = 1_000_000
#: Largest square of local sources that is held as a matrix while a batch is added up.
DENSE = 1 << 22

_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_RUN_SQL = "lang string, term string, docs long, sources array<string>, counts array<long>"

#: Bytes of a term: A-Z become a-z, other ASCII ends a term, bytes of longer characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _lists(starts: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, n], pa.int32()), values)


class Block:
    """Postings of the texts read since the last run."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, Counter] = {}

    def add(self, text: bytes, lang: str, source: str) -> None:
        words = terms_of(text)
        if words:
            self.counts.setdefault((lang, source), Counter()).update(words)
            self.docs.setdefault(lang, Counter()).update(set(words))

    def __len__(self) -> int:
        return sum(map(len, self.counts.values()))

    def run(self) -> Iterator[pa.RecordBatch]:
        """The postings as one batch per language, sorted by term."""
        for lang in sorted(self.docs):
            docs = self.docs[lang]
            terms = pa.array(docs.keys(), pa.binary())
            order = pc.sort_indices(terms).to_numpy()
            place = dict(zip(terms.take(pa.array(order)).to_pylist(), range(len(order))))
            own = [(s, c) for (at, s), c in self.counts.items() if at == lang]
            n = sum(len(c) for _, c in own)
            at = np.fromiter((place[t] for t in chain.from_iterable(c for _, c in own)), np.int64, n)
            counts = np.fromiter(chain.from_iterable(c.values() for _, c in own), np.int64, n)
            source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])
            by_term = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[by_term], np.arange(len(order)))
            names = pa.array([s for s, _ in own], pa.string()).take(pa.array(source[by_term]))
            columns = [
                pa.repeat(lang, len(order)).cast(pa.string()), terms.take(pa.array(order)).cast(pa.string()),
                pa.array(np.fromiter(docs.values(), np.int64, len(docs))[order]),
                _lists(starts, n, names), _lists(starts, n, pa.array(counts[by_term])),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_RUN)


def runs(docs: DataFrame, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, term, docs, sources, counts``: the runs of all blocks; a row is a term's postings in one block."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, step = Block(), 0, min(1 << 20, 8 * block_postings)
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            for text, lang, source in zip(texts.to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                block.add(text, lang, source)
                seen += len(text)
                if seen >= step:  # the block is measured once per megabyte of text
                    seen = 0
                    if len(block) >= block_postings:
                        yield from block.run()
                        block = Block()
        yield from block.run()

    return docs.select("text", "lang", "source").mapInArrow(index, _RUN_SQL)


def merged(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows sorted by language and term, those of one term added up."""
    n = rows.num_rows
    lang, term = rows.column(0), rows.column(1)
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    lengths = pc.list_value_length(rows.column(3)).to_numpy()
    at = np.repeat(np.cumsum(new) - 1, lengths)
    names = rows.column(3).flatten().dictionary_encode()
    key = at * max(1, len(names.dictionary)) + names.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts = np.add.reduceat(rows.column(4).flatten().to_numpy()[order], starts) if len(key) else np.zeros(0, np.int64)
    kept = key[starts]
    edges = np.searchsorted(kept // max(1, len(names.dictionary)), np.arange(len(first)))
    sources = names.dictionary.take(pa.array(kept % max(1, len(names.dictionary))))
    pick = pa.array(first)
    docs = np.add.reduceat(rows.column(2).to_numpy(), first)
    columns = [lang.take(pick), term.take(pick), pa.array(docs), _lists(edges, len(kept), sources), _lists(edges, len(kept), pa.array(counts))]
    return pa.RecordBatch.from_arrays(columns, schema=_RUN)


def frequencies(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, docs, sources, counts``: one row for every term that ``min_docs`` documents of a language hold.

    A shard reads its runs in term order, so it holds one batch and the term that is still open at its end.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, _RUN)], schema=_RUN)
            if open_ is not None:
                rows = pa.concat_batches([open_, rows])
            rows = merged(rows)
            open_ = rows.slice(rows.num_rows - 1)
            yield enough(rows.slice(0, rows.num_rows - 1))
        if open_ is not None:
            yield enough(open_)

    def enough(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pc.greater_equal(rows.column(2), min_docs))

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, _RUN_SQL)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact for counts of any size."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", above, F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Cells:
    """Sums of whole numbers per (language, source, source)."""

    def __init__(self) -> None:
        self.sums: dict[tuple[str, str, str], int] = {}

    def add(self, names: list[tuple[str, str]], x: np.ndarray, y: np.ndarray, value: np.ndarray) -> None:
        n = len(names)
        key = x * n + y
        if n * n <= DENSE:
            sums = np.zeros(n * n, np.int64)
            np.add.at(sums, key, value)
            keys = np.unique(key)
            sums = sums[keys]
        else:
            keys, at = np.unique(key, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, value)
        for k, s in zip(keys.tolist(), sums.tolist()):
            (lang, a), (_, b) = names[k // n], names[k % n]
            self.sums[lang, a, b] = self.sums.get((lang, a, b), 0) + s

    def rows(self) -> pa.RecordBatch:
        columns = zip(*[(*k, v) for k, v in self.sums.items()]) if self.sums else ((),) * 4
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "source", "item", "value"])


def shared_corrections(postings: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for sources that share terms: over those terms, the gap of the two shares, less what
    counting the term once for either side alone has put in its place.

    ``postings(lang, term, source, p, p0)`` holds a source's share of a term and its share of a term it lacks. Rows of a
    term stand together; row i meets row i + s for every shift s, for all terms of a batch at once.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, open_ = Cells(), None
        for b in batches:
            if not b.num_rows:
                continue
            rows = b if open_ is None else pa.concat_batches([open_, b])
            new = np.ones(rows.num_rows, dtype=bool)
            lang, term = rows.column(0), rows.column(1)
            new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(new)[-1])
            add(rows.slice(0, cut), new[:cut], cells)
            open_ = rows.slice(cut)  # the last term may go on in the next batch: at most a row per source
            if len(cells.sums) > CELLS:
                yield cells.rows()
                cells = Cells()
        if open_ is not None:
            add(open_, np.arange(open_.num_rows) == 0, cells)
        yield cells.rows()

    def add(rows: pa.RecordBatch, new: np.ndarray, cells: Cells) -> None:
        if not rows.num_rows:
            return
        lang, source = rows.column(0).dictionary_encode(), rows.column(2).dictionary_encode()
        both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        found, own = np.unique(both, return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        names = [(langs[k // len(sources)], sources[k % len(sources)]) for k in found.tolist()]
        p, p0 = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        starts = np.flatnonzero(new)
        length = np.diff(np.r_[starts, len(new)])
        left = np.repeat(starts + length, length) - np.arange(len(new))  # rows from here to the end of the term
        at, shift = np.flatnonzero(left > 1), 1
        while len(at):
            x, y = at, at + shift
            value = gaps(p[x], p[y]) - gaps(p[x], p0[y]) - gaps(p0[x], p[y]) + gaps(p0[x], p0[y])
            cells.add(names, own[x], own[y], value)
            shift += 1
            at = at[left[at] > shift]

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = postings.select("lang", "term", "source", "p", "p0").repartition(n, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return placed.mapInArrow(stream, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source of a language its divergence from each other source
    (``part`` pair, all of them) and the terms it has most too much of against the language (``part`` term, ``top_terms``).

    Null texts, languages and sources are empty strings; repeated rows count each; a source without terms is compared like
    any other; a language without a kept term has divergence 0 throughout. Ties are ordered by the item's UTF-8 bytes.
    Other columns are ignored; an empty table gives an empty one.
    """
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = materialise(frequencies(runs(own, block_postings), min_docs), "kept")

    flat = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("all"), F.explode(F.arrays_zip("sources", "counts")).alias("z"))
    flat = flat.select("lang", "term", "all", F.col("z.sources").alias("source"), F.col("z.counts").alias("n"))
    langs = flat.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang")
    sizes = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    groups = materialise(groups.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))), "groups")

    shares = flat.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all"), F.col("lang_n"), F.col("v")).alias("q")
    )
    shares = materialise(shares, "shares")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))

    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    b = groups.select(F.col("lang").alias("of"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    other = (F.col("lang") == F.col("of")) & (F.col("source") != F.col("item"))
    empty = groups.select("lang", "source", "v", "p0").join(b, other).select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * gap(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    held = shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("terms"))
    alone = held.join(b, other).select("lang", "source", "item", (F.col("terms") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value"))
    corrections = alone.unionByName(shared_corrections(shares))
    corrections = corrections.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    corrections = corrections.select("lang", turned.alias("z"), "value").select("lang", "z.source", "z.item", "value")
    pairs = empty.unionByName(corrections).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))


#: DuckDB's SQL of the query over the table ``documents``: every source of a language against every kept term.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
uses AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM uses GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS lang_n FROM kept GROUP BY lang),
held AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM uses JOIN kept k USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n)::BIGINT AS total FROM held GROUP BY lang, source),
groups AS (SELECT g.lang, g.source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s ON g.lang = s.lang AND g.source = s.source),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(h.n, 0) + 2)) // (g.total + 2 * l.v) AS p, 1 + ({UNIT}::HUGEINT * (k.n + 2)) // (l.lang_n + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
