"""Benchmark decontamination: rare n-gram seeds find passages that may come from a test item, and Smith-Waterman
alignment scores them, so edited and paraphrased copies are found as well as exact ones.

The test items are the small side: they are cut into slices of a bounded number of words, and each slice goes to the tasks
as sorted arrays. A document never leaves its task; the whole text is searched, and all its seeds are aligned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm.registry import boxed, unboxed

NGRAM = 3
#: A seed is rare if words of its frequencies would meet by chance less than once in so many places.
RARE = 1e-6
#: An item has at least so many seeds: its rarest n-grams.
LEAST_SEEDS = 8
#: A passage is reported from this share of the item's highest possible score on.
MIN_SCORE = 0.4
MATCH, MISMATCH, GAP = 1.0, -0.5, 0.5
#: Words of test items that are sent to the tasks at once.
SLICE_WORDS = 1_000_000

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Letters and digits in lower case: case, marks and line ends do not matter."""
    return _WORDS.findall(text.lower()) if text else []


class Items:
    """Test items of one slice as word numbers (from 1; 0 is any word that no item has)."""

    def __init__(self, vocabulary: dict[str, int], ids: list[int], words: list[np.ndarray]):
        self.vocabulary, self.ids, self.words = vocabulary, ids, words

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> Items:
        out = cls({}, [], [])
        for item, text in items:
            own = words_of(text)
            if own:
                out.ids.append(item)
                out.words.append(np.array([out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in own], dtype=np.int64))
        return out

    def parts(self) -> tuple:
        """What goes to the tasks: plain values, so executors need no copy of this package."""
        return self.vocabulary, self.ids, self.words

    def numbers(self, text: str | None) -> np.ndarray:
        own = words_of(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in own), dtype=np.int64, count=len(own))

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """One number for each run of ``n`` words; -1 where a word is unknown."""
        if len(words) < n:
            return np.zeros(0, dtype=np.int64)
        runs = np.lib.stride_tricks.sliding_window_view(words, n)
        mixed = runs[:, 0].copy()
        for k in range(1, n):
            mixed = mixed * np.int64(len(self.vocabulary) + 1) + runs[:, k]
        mixed[(runs == 0).any(axis=1)] = -1
        return mixed

    def seeds(self, counts: np.ndarray, total: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Sorted tables from n-gram to item, one per length of n-gram. Items shorter than ``NGRAM`` words are their own seed."""
        chance = (counts + 1.0) / (total + len(counts) + 1.0)
        tables: dict[int, list[tuple[int, int]]] = {}
        for at, words in enumerate(self.words):
            n = min(NGRAM, len(words))
            grams = self.grams(words, n)
            odds = np.prod(np.lib.stride_tricks.sliding_window_view(chance[words], n), axis=1)
            rare = odds <= RARE
            rare[np.argsort(odds, kind="stable")[:LEAST_SEEDS]] = True
            tables.setdefault(n, []).extend((int(g), at) for g in set(grams[rare].tolist()))
        out = []
        for n, pairs in sorted(tables.items()):
            pairs.sort()
            out.append((n, np.array([g for g, _ in pairs]), np.array([a for _, a in pairs])))
        return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment: score and the place after its last word in ``passage``. Word number 0 matches nothing.

    A row of the Smith-Waterman table at a time; gaps along the row are a running maximum.
    """
    slope = GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for w in item:
        step = np.where(passage == w, MATCH, MISMATCH)
        new = np.maximum(row - GAP, 0.0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def _windows(places: np.ndarray, size: int, limit: int) -> list[tuple[int, int]]:
    """Stretches of the document around the seeds, wide enough for the item; overlapping ones are one."""
    lows, highs = np.maximum(places - size, 0), np.minimum(places + size, limit)
    cut = np.flatnonzero(lows[1:] > highs[:-1]) + 1
    return [(int(lows[a]), int(highs[b - 1])) for a, b in zip(np.r_[0, cut], np.r_[cut, len(places)])]


def matches(text: str | None, items: Items, tables: list[tuple[int, np.ndarray, np.ndarray]], min_score: float) -> list[tuple[int, float, int, int]]:
    """``item, score, first word, end word`` of each item that the text holds, its best place."""
    words = items.numbers(text)
    places: dict[int, list[int]] = {}
    for n, grams, owners in tables:
        own = items.grams(words, n)
        known = np.flatnonzero(own >= 0)
        if not len(known) or not len(grams):
            continue
        low, high = (np.searchsorted(grams, own[known], side) for side in ("left", "right"))
        for k in np.flatnonzero(high > low):
            for owner in owners[low[k] : high[k]].tolist():
                places.setdefault(owner, []).append(int(known[k]))
    out = []
    for owner, at in places.items():
        item = items.words[owner]
        best, where, need = 0.0, (0, 0), min_score * MATCH * len(item)
        for low, high in _windows(np.array(at), 2 * len(item), len(words)):
            score, end = align(item, words[low:high])
            if score > best:
                best, where = score, (low, low + end)
        if best >= need - 1e-9:
            low, end = where
            back, length = align(item[::-1], words[low:end][::-1])  # the same alignment from its end gives its start
            out.append((items.ids[owner], round(best / (MATCH * len(item)), 6), end - length, end))
    return sorted(out)


def _slices(benchmark: DataFrame, slice_words: int) -> list[list[tuple[int, str | None]]]:
    """The test items in slices of bounded size, each small enough for the tasks."""
    own = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = F.size(F.split("text", r"\s+"))
    total = own.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // slice_words))
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [[(r["item_id"], r["text"]) for r in own.where(part == k).sort("item_id", "text").collect()] for k in range(n)]


def word_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How often the corpus has each word of the items, and its words in all."""
    shared = docs.sparkSession.sparkContext.broadcast(items.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(*shared.value)
        counts = np.zeros(len(own.vocabulary) + 1, dtype=np.int64)
        held: list[np.ndarray] = []
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(own.numbers(text))
                if len(held[-1]) > 100_000 or len(held) > 1000:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held = []
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["word", "n"])

    sums = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row per word of the items
    counts = np.zeros(len(items.vocabulary) + 1, dtype=np.int64)
    counts[sums["word"].to_numpy()] = sums["n"].to_numpy()
    return counts, int(counts.sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word``: every document and test item that align from ``min_score`` on.

    ``score`` is the alignment's score over the item's highest possible one (1: the whole item word for word); the words
    are numbered as letters-and-digits runs of the document. Null and empty texts match nothing; repeated items are
    reported each; repeated documents and null ids are rows like any other. Extra columns are ignored; without items or
    documents the result is empty.
    """
    spark = docs.sparkSession
    parts = [_search(spark, docs, Items.of(own), min_score) for own in _slices(benchmark, slice_words)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(spark: SparkSession, docs: DataFrame, items: Items, min_score: float) -> DataFrame:
    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    counts, total = word_counts(docs, items)
    shared = spark.sparkContext.broadcast((items.parts(), items.seeds(counts, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = Items(*shared.value[0]), shared.value[1]
        for b in batches:
            rows = [(at, *m) for at, text in enumerate(b.column(1).to_pylist()) for m in matches(text, own, tables, min_score)]
            at, item, score, start, end = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "item_id", "score", "start_word", "end_word"],
            )

    return kept.mapInArrow(run, f"doc_id {kind}, item_id long, score double, start_word long, end_word long")


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; a row goes for its own text alone, whatever its id."""
    texts = docs.select(F.md5("text").alias("doc_id"), "text")
    hit = contaminated(texts, benchmark, min_score).select(F.col("doc_id").alias("hit")).distinct()
    rows = boxed(docs, hit=F.md5("text"))
    return rows.join(hit, "hit", "left_anti").select(*unboxed(rows, docs.columns))
