"""Product-quantised vector codes: exact integer k-means by part, assigned over tries of the distinct parts.

A vector is cut into equal parts and every part is coded by the nearest entry of its position's codebook. A task holds the
distinct parts of a few thousand vectors as a lexicographic trie, one level per dimension, and walks it depth first. A
node carries the squared distances of its prefix to all entries; its children add one dimension to them, so parts with a
common prefix share that work. A leaf takes the nearest entry, weighted by the number of vectors that hold the part.
Only sums and counts per entry leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.session import materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors whose distinct parts a task holds as one trie per position.
BLOCK = 16_384
#: A subtree of at most so many leaves is finished level by level at once; a larger one child by child.
SUBTREE = 4_096
#: Components beyond this are held at it: with it the squared distance of any vector of up to 256 dimensions fits a long.
MOST = 1 << 26
#: Sums of up to so many labels are sent to the tasks; above it they meet their rows in a salted join.
SMALL_LABELS = 100_000
SALT = 32

Codebooks = np.ndarray  # parts x entries x dimensions of a part, int64


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``id, label, v``: the kept rows with integer components ``floor(scale * x)``."""
    x = F.col(vec_col)
    clean = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), e.cast("double") * scale))).cast("int"))
    return vectors.where(clean).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v"))


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the rows with the ``entries`` smallest ids; null ids come last, equal ids by their components."""
    rows = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()  # as many rows as a codebook has entries
    table = np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), -1)
    return table.reshape(len(rows), parts, -1).transpose(1, 0, 2) if len(rows) else np.zeros((parts, 0, 0), np.int64)


def distinct_parts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of ``part`` in lexicographic order, which of them each row is, and how many rows each has."""
    order = np.lexsort(part.T[::-1])
    ranked = part[order]
    new = np.ones(len(part), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    inverse = np.empty(len(part), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ranked[starts], inverse, np.diff(np.r_[starts, len(part)])


def nearest(leaves: np.ndarray, book: np.ndarray, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """For every one of the sorted distinct ``leaves`` the index of the nearest entry of ``book`` (the lowest of equal
    ones) and its squared distance, by a depth-first walk over the trie that the leaves form."""
    n, width = leaves.shape
    entry, error = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    # depth at which a leaf leaves the path of the leaf before it: it opens a new node on every level from there on
    fork = np.zeros(n, dtype=np.int64)
    if n > 1:
        same = leaves[1:] == leaves[:-1]
        fork[1:] = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    stack = [(0, n, 0, np.zeros(len(book), dtype=np.int64))]
    while stack:
        start, stop, depth, far = stack.pop()
        if stop - start > subtree and depth < width:
            opens = np.flatnonzero(fork[start + 1 : stop] <= depth) + start + 1
            edges = np.r_[start, opens, stop]
            for a, b in zip(edges[-2::-1], edges[:0:-1]):  # pushed from the last, so the first child is walked first
                step = leaves[a, depth] - book[:, depth]
                stack.append((a, b, depth + 1, far + step * step))
            continue
        distances, row = far[None, :], np.zeros(stop - start, dtype=np.int64)
        for level in range(depth, width):
            opens = fork[start:stop] <= level
            opens[0] = True
            at = np.flatnonzero(opens)
            step = leaves[start + at, level][:, None] - book[None, :, level]
            distances, row = distances[row[at]] + step * step, np.cumsum(opens) - 1
        best = distances.argmin(axis=1)
        entry[start:stop], error[start:stop] = best[row], distances[np.arange(len(best)), best][row]
    return entry, error


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int, block: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, block):
            own = b.slice(k, block)
            yield own, own.column(column).flatten().to_numpy().astype(np.int64).reshape(own.num_rows, width)


def refined(kept: DataFrame, books: Codebooks, block: int = BLOCK) -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the floor of the mean of its parts."""
    parts, entries, size = books.shape
    width = parts * size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, size), dtype=np.int64)
        for _, v in _blocks(batches, 0, width, block):
            for p in range(parts):
                leaves, _, weight = distinct_parts(v[:, p * size : (p + 1) * size])
                entry, _ = nearest(leaves, books[p])
                np.add.at(count[p], entry, weight)
                np.add.at(total[p], entry, leaves * weight[:, None])
        at = np.flatnonzero(count)
        rows = total.reshape(-1, size)[at]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(rows.ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count.ravel()[at], pa.int64()), lists], names=["at", "n", "total"])

    found = kept.select("v").mapInArrow(add, "at int, n long, total array<long>").select("at", "n", F.posexplode("total").alias("dim", "x"))
    sums = found.groupBy("at", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = books.reshape(-1, size).copy()
    for r in sums.collect():  # at most one row per entry and dimension of a part
        out[r["at"], r["dim"]] = int(r["x"]) // r["n"]
    return out.reshape(books.shape)


def assigned(kept: DataFrame, books: Codebooks, block: int = BLOCK) -> DataFrame:
    """``id, label, code, error``: the entry of every part as two hex digits, and the squared distances summed."""
    parts, entries, size = books.shape
    digits = np.array([f"{k:02x}" for k in range(max(entries, 1))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, v in _blocks(batches, 2, parts * size, block):
            codes, error = np.zeros((len(v), parts), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
            for p in range(parts):
                leaves, inverse, _ = distinct_parts(v[:, p * size : (p + 1) * size])
                entry, far = nearest(leaves, books[p])
                codes[:, p] = entry[inverse]
                error += far[inverse]
            texts = ["".join(row) for row in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    kinds = [f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    return kept.mapInArrow(assign, ", ".join([*kinds, "code string", "error long"]))


def codebooks_text(books: Codebooks) -> str:
    """All components by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256`` for every kept row of ``vectors``.

    Rows whose vector is null or holds null, NaN or infinite components are dropped, as are vectors of another length than
    the first kept one's (by id); a length that ``parts`` does not divide is a ValueError. All arithmetic is in whole
    numbers; components beyond 2^26 in size after scaling are held at that. Fewer than ``entries`` rows give smaller
    codebooks. Repeated rows count each; null ids are kept and come last among the first entries; null labels are one
    label; a label's total beyond a long is null. Extra columns are ignored; an empty table gives an empty one.

    The quantised vectors are written once (they are read once per round). A round is one pass without a shuffle of
    vectors: tasks send a row per entry and dimension, and the codebooks, at most parts x entries x dimensions numbers,
    are all that reaches the driver.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = materialise(quantised(vectors, id_col, vec_col, label_col), "quantised")
    first = kept.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("n")).first()
    length = first["n"] if first else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    if length == 0:
        coded = kept.select("id", "label", F.repeat(F.lit("00"), parts).alias("code"), F.lit(0).cast("bigint").alias("error"))
        books = np.zeros((parts, 0, 0), np.int64)
        coded = coded.where(F.lit(first is not None)) if first else coded.limit(0)
    else:
        kept = kept.where(F.size("v") == length)
        books = first_codebooks(kept, parts, entries)
        for _ in range(rounds):
            books = refined(kept, books)
        coded = assigned(kept, books)
    coded = materialise(coded, "codes")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest))


def with_label_errors(coded: DataFrame, small: int = SMALL_LABELS, salt: int = SALT) -> DataFrame:
    """``coded`` plus ``label_error``. The sums are made with map-side combine, so a hot label costs one row per task; up
    to ``small`` sums go to the tasks, more are copied ``salt`` times and meet salted rows."""
    total = F.try_sum(F.col("error"))
    sums = materialise(coded.groupBy("label").agg(total.alias("label_error")), "label_errors")
    columns = [*[F.col(f"c.{c}") for c in coded.columns], F.col("s.label_error")]
    if sums.count() <= small:
        return coded.alias("c").join(F.broadcast(sums.alias("s")), F.expr("c.label <=> s.label")).select(*columns)
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(salt)))
    copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
    return dealt.alias("c").join(copies.alias("s"), F.expr("c.label <=> s.label AND c.salt = s.salt")).select(*columns)


def _nearest_sql(books: str, out: str) -> str:
    """SQL of one assignment of the table ``parts`` to the codebooks ``books``: every distance, the least one kept."""
    return f"""
{out} AS (
  SELECT row, part, p, struct_extract(best, 'e') AS e, struct_extract(best, 'far') AS far FROM (
    SELECT a.row, a.part, any_value(a.p) AS p, arg_min({{'e': b.e, 'far': far}}, far * {ENTRIES} + b.e) AS best
    FROM parts a JOIN {books} b ON a.part = b.part,
      LATERAL (SELECT list_sum(list_transform(list_zip(a.p, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far)
    GROUP BY a.row, a.part))"""


def _moved_sql(before: str, near: str, out: str) -> str:
    return f"""
{out}_sums AS (
  SELECT part, e, list(CAST(floor(s::HUGEINT / n) AS BIGINT) ORDER BY d) AS c FROM (
    SELECT part, e, d, sum(p[d])::BIGINT AS s, count(*) AS n FROM {near}, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS d) GROUP BY part, e, d)
  GROUP BY part, e),
{out} AS (SELECT b.part, b.e, coalesce(s.c, b.c) AS c FROM {before} b LEFT JOIN {out}_sums s ON b.part = s.part AND b.e = s.e)"""


#: DuckDB's SQL of the query over the table ``embeddings``: all distances of all parts in every round.
SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS p FROM kept, LATERAL (SELECT unnest(range({PARTS})) AS part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS e, p AS c FROM parts WHERE row <= {ENTRIES}),
{_nearest_sql("book0", "near0")},
{_moved_sql("book0", "near0", "book1")},
{_nearest_sql("book1", "near1")},
{_moved_sql("book1", "near1", "book2")},
{_nearest_sql("book2", "near2")},
coded AS (
  SELECT row, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""
