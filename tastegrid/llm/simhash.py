"""SimHash near-duplicates, found by comparing bit planes of whole blocks at once.

Fingerprints that differ in at most ``radius`` of 64 bits agree on two of six bit ranges (for a radius of four), so each
distinct fingerprint is filed under the fifteen pairs of ranges. Within a file the fingerprints are stored vertically: one
plane of packed bits for each of the 64 positions. The planes of two shifted copies are exclusive-ored and added by
carry-save counters, which update 64 distances with each machine word; a block is abandoned when all its distances have
passed the radius. Only a star of links per group of linked fingerprints leaves a task, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.llm.components import connected_components
from tastegrid.llm.registry import boxed, unboxed
from tastegrid.session import materialise

SEED = 42
#: Fingerprints of one file that a task compares at once; larger files are split by :func:`_split_hot`.
HOT_FILE = 4096


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles; 0 for a text without a word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D split
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    n = max(1, len(w) - words + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[words - 1 :] - 1).tolist() if n > 1 else [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for byte in range(8):
        counts = np.bincount(h[:, byte], minlength=256) @ _BITS
        out |= int(np.packbits(counts * 2 > n, bitorder="little")[0]) << (8 * byte)
    return out


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)`` for every row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(score, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def within(planes: np.ndarray, radius: int) -> np.ndarray:
    """Packed bits: which lanes of ``planes`` (64 rows of 64-lane words) have at most ``radius`` ones.

    Carry-save: two planes and the ones counter give a new ones counter and a carry of weight two, which ripples through
    one counter plane per power of two. A lane whose count runs over the top stays out. After every eight planes, words
    whose 64 lanes have all passed the radius are abandoned and the rest of their planes is not read.
    """
    top = max(2, int(radius).bit_length())
    active = np.arange(planes.shape[1])
    counters = [np.zeros(len(active), np.uint64) for _ in range(top)]
    over = np.zeros(len(active), np.uint64)
    for k in range(0, len(planes), 8):
        eight = planes[k : k + 8, active]
        for a, b in zip(eight[::2], eight[1::2]):
            differ = a ^ b
            carry = (a & b) | (counters[0] & differ)
            counters[0] = counters[0] ^ differ
            for level in range(1, top):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            over = over | carry
        left = _passed(counters, over, radius) != _FULL
        if not left.all():
            active, over, counters = active[left], over[left], [c[left] for c in counters]
        if not len(active):
            break
    out = np.zeros(planes.shape[1], np.uint64)
    out[active] = ~_passed(counters, over, radius)
    return out


_FULL = np.uint64(2**64 - 1)


def _passed(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius: bitwise comparison from the top bit."""
    above, equal = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _planes(x: np.ndarray) -> np.ndarray:
    """The fingerprints ``x`` as 64 rows of packed bits, padded with lanes that differ everywhere."""
    full = np.concatenate([x, np.full(-len(x) % 64, _FULL)])
    bits = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


#: Lanes that are turned into planes at once (64 bytes each while they are turned).
LANES = 1 << 18


def linked_lanes(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """For each position, whether ``a`` and ``b`` differ in at most ``radius`` bits."""
    out = np.zeros(len(a), dtype=bool)
    for k in range(0, len(a), LANES):
        hits = within(_planes(a[k : k + LANES] ^ b[k : k + LANES]), radius)
        out[k : k + LANES] = np.unpackbits(hits.view(np.uint8), bitorder="little")[: len(out[k : k + LANES])]
    return out


def links_of_files(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of links within runs of equal ``keys`` (sorted): each linked row and the first row of its group.

    Row i is held against row i + s for every shift s up to the longest run, over all files of the batch at once.
    """
    n = len(keys)
    root = np.arange(n)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, int)
    length = np.diff(np.r_[starts, n])
    left = np.repeat(starts + length, length) - np.arange(n)  # rows from here to the end of the run
    at = np.flatnonzero(left > 1)
    shift = 1
    while len(at):
        other = at + shift
        todo = root[at] != root[other]  # already in one group: nothing to learn
        x, y = at[todo], other[todo]
        hit = linked_lanes(fps[x], fps[y], radius)
        root = _merge(root, x[hit], y[hit])
        shift += 1
        at = at[left[at] > shift]
    child = np.flatnonzero(root != np.arange(n))
    return fps[child], fps[root[child]]


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the groups of the rows ``x`` and ``y``; the smallest row stays root."""
    while len(x):
        a, b = root[x], root[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        differ = low != high
        if not differ.any():
            break
        np.minimum.at(root, high[differ], low[differ])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _ranges(bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [round(k * bits / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _take(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` in the ranges, side by side."""
    out, at = F.lit(0).cast("long"), 0
    for start, width in ranges:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def _files(fps: DataFrame, radius: int) -> DataFrame:
    """``(file, key, fp)``: every fingerprint under each choice of ranges that a linked pair must share one of."""
    parts = radius + 2
    choices = list(combinations(_ranges(64, parts), 2))
    filed = [F.struct(F.lit(k).alias("file"), _take(F.col("fp"), list(c)).alias("key")) for k, c in enumerate(choices)]
    return fps.select(F.explode(F.array(*filed)).alias("f"), "fp").select("f.file", "f.key", "fp")


def _split_hot(filed: DataFrame, radius: int, limit: int) -> DataFrame:
    """Deal out files of more than ``limit`` fingerprints once more, by ranges of all bits, so that no link is lost.

    A pair in a hot file differs in at most ``radius`` bits, so it agrees on three of ``radius`` + 3 ranges as well; the
    sizes come from an aggregate with map-side combine, and hot keys are few (at most rows / limit). What then still
    meets in one file are different fingerprints that agree on some 40 bits; a task holds them as two numbers each.
    """
    hot = filed.groupBy("file", "key").count().where(F.col("count") > limit).select("file", "key", F.lit(True).alias("hot"))
    marked = filed.join(hot, ["file", "key"], "left")
    finer = list(combinations(_ranges(64, radius + 3), 3))
    more = F.array(*[F.xxhash64(F.lit(k), _take(F.col("fp"), list(c))) for k, c in enumerate(finer)])
    again = marked.select("file", "key", "fp", F.explode(F.when(F.col("hot"), more).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"))
    return again


def _links(filed: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: stars of linked fingerprints within each file; tasks read sorted files in bounded batches."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.zeros(0, dtype=np.int64)
        for b in batches:
            keys = np.r_[keys, b.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, b.column(1).to_numpy(zero_copy_only=False)]
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last file may go on in the next batch
            if cut:
                yield star(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield star(keys, fps)

    def star(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = links_of_files(keys, fps.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = filed.select(F.xxhash64("file", "key", "sub").alias("at"), "fp")
    n = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "at").sortWithinPartitions("at").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, hot_file: int = HOT_FILE) -> DataFrame:
    """``(id, fp, component_id)`` for every row: ``component_id`` is the smallest id reachable over links.

    Rows link if their fingerprints differ in at most ``radius`` bits. Null and empty texts have fingerprint 0 and link
    like any other; repeated rows share a component; a null id never becomes a component id unless it stands alone. Extra
    columns are ignored; an empty table gives an empty one. Copies are merged first, so links are between distinct
    fingerprints only.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    filed = _split_hot(_files(distinct.select("fp"), radius), radius, hot_file)
    roots = connected_components(_links(filed, radius))
    roots = materialise(roots, "roots")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    place = member.join(lowest, "root").select("fp", "component_id")
    return prints.join(place, "fp").select("id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the row with the smallest id, one with a null id only if no
    other is in the group, the smallest digest of all columns among equal ids. Rows are told apart by all their columns, so
    null and repeated ids lose no group; columns may have any names."""
    key = F.md5(F.to_json("row"))
    rows = boxed(docs).select("row", key.alias("key"))
    place = F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), F.col("key").alias("key"))
    placed = rows.select(place.alias("place"), F.col("row")[text_col].alias("text"))
    first = near_duplicates(placed, "place", "text", words, radius).select("component_id.key").distinct()
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select(*unboxed(rows, docs.columns))
