"""Dense vectors held as array<double>: sums, norms and blocked all-pairs products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.ranking import top_k
from tastegrid.session import materialise, stored

# Rows of a block: enough blocks to keep the cluster busy, but as few copies of every vector as memory allows.
_LEAST_BLOCK, _MOST_BLOCK = 256, 16_384
# Rows of a block whose every pair is a row of the result.
_PAIRS_BLOCK = 1_024
# Scores that a task holds at a time.
_CELLS = 2_000_000
# Bytes of the vectors and best scores of the left rows that a task keeps, and their number, where the k best are wanted.
_LEFT_BYTES, _LEFT_ROWS = 32 << 20, 65_536


def _slice_rows(width: int) -> int:
    """Rows of a block scored at a time against ``width`` others."""
    return max(1, _CELLS // max(1, width))


def as_double(vec: str | Column) -> Column:
    return (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: str | Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def normalised(vec: str, eps: float = 0.0) -> Column:
    """Vector over its length; a zero vector stays zero."""
    length = norm(vec) + F.lit(eps)
    return F.transform(vec, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def sum_vectors(df: DataFrame, keys: list[str], vec: str, dim: int, weight: str | None = None, out: str = "vec") -> DataFrame:
    """Weighted element-wise sum per key: one aggregate over whole vectors, whatever their length ``dim``. Rows without a
    vector count as zeros."""
    values = F.coalesce(as_double(vec), F.array_repeat(F.lit(0.0), dim))
    if weight:
        values = F.zip_with(values, F.array_repeat(F.col(weight).cast("double"), dim), lambda x, w: x * w)  # weights may be negative
    rows = df.select(*keys, array_to_vector(values).alias("_v"))
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias(out))


def mean_vector(df: DataFrame, vec: str, dim: int, out: str = "mean_vec") -> DataFrame:
    """One row: the element-wise mean of the vectors there are; null without any."""
    rows = df.where(F.col(vec).isNotNull()).select(array_to_vector(as_double(vec)).alias("_v"))
    return rows.agg(F.when(F.count("_v") > 0, vector_to_array(Summarizer.mean(F.col("_v")))).alias(out))


def explode_vector(df: DataFrame, keys: list[str], vec: str = "vec", digits: int | None = None) -> DataFrame:
    """Long form (keys, dim, value)."""
    long = df.select(*keys, F.posexplode(vec).alias("dim", "value")).withColumn("dim", F.col("dim").cast("bigint"))
    return long if digits is None else long.withColumn("value", F.round("value", digits) + F.lit(0.0))


def _block_counts(left: DataFrame, right: DataFrame, block: int | None) -> tuple[int, int]:
    """How many blocks each side is cut into. A vector is copied once per block of the other side."""
    n, m = left.count(), right.count()
    if block is None:
        tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
        block = int(min(_MOST_BLOCK, max(_LEAST_BLOCK, ceil(sqrt(n * m / tasks)))))
    return max(1, ceil(n / block)), max(1, ceil(m / block))


def _vector_blocks(df: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    """Each row placed in its own block and copied to every block of the other side."""
    return df.select(
        "id", as_double("vec").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own)
    ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def k_best(scores: np.ndarray, ok: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest allowed scores of every row, of equal ones at the cut the first columns."""
    if k is None or k >= scores.shape[1]:
        return np.nonzero(ok)
    lost = np.where(ok, -scores, np.inf)
    cut = np.partition(lost, k - 1, axis=1)[:, k - 1 : k]
    inside, tied = lost < cut, lost == cut
    tied &= np.cumsum(tied, axis=1) <= k - inside.sum(axis=1, keepdims=True)
    return np.nonzero((inside | tied) & ok)


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    k: int | None = None,
    keep: Callable[[np.ndarray], np.ndarray] | None = None,
    mask: DataFrame | None = None,
    exclude_self: bool = False,
    digits: int = 9,
    block: int | None = None,
) -> DataFrame:
    """``(i, j, score)`` of two vector tables ``(id, vec)`` by blocks of rows on both sides.

    ``score`` maps two matrices to the block of scores; ``mask`` holds pairs ``(i, j)`` to leave out. With
    ``k`` a task keeps its left rows and their k best so far while the right rows stream by, so only k rows per i and
    part of the right side leave it (ties by j). Scores are rounded to ``digits`` so that block shapes cannot reorder
    equal ones.
    """
    left, right = stored(left, "left"), stored(right, "right")  # counted now, read twice
    if k is not None:
        return _best_pairs(left, right, score, k, keep, mask, exclude_self, digits, block)
    nx, ny = _block_counts(left, right, block or _PAIRS_BLOCK)
    x = _vector_blocks(left, "x", "y", nx, ny)
    y = _vector_blocks(right.toDF(*right.columns), "y", "x", ny, nx)
    if mask is not None:
        x = x.join(_hidden(mask, ny), ["id", "y"], "left")
    kind_i = left.schema["id"].dataType.simpleString()
    kind_j = right.schema["id"].dataType.simpleString()
    masked = mask is not None

    def wanted(ids_i: np.ndarray, vecs: np.ndarray, unseen: list | None, ids_j: np.ndarray, others: np.ndarray) -> pd.DataFrame:
        got = np.round(score(vecs, others), digits)
        ok = np.ones(got.shape, dtype=bool) if keep is None else keep(got)
        if exclude_self:
            ok &= ids_i[:, None] != ids_j[None, :]
        for row, out in enumerate(unseen or []):
            if out is not None:
                at = np.searchsorted(ids_j, out).clip(max=len(ids_j) - 1)
                ok[row, at[ids_j[at] == out]] = False
        r, c = np.nonzero(ok)
        return pd.DataFrame({"i": ids_i[r], "j": ids_j[c], "score": got[r, c]})

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"i": a["id"].iloc[:0], "j": b["id"].iloc[:0], "score": np.zeros(0)})
        b = b.sort_values("id")
        ids_j, others = b["id"].to_numpy(), np.stack(b["vec"].to_list())
        found, rows = [], _slice_rows(len(b))
        for at in range(0, len(a), rows):
            part = a.iloc[at : at + rows]
            unseen = part["hidden"].to_list() if masked else None
            found.append(wanted(part["id"].to_numpy(), np.stack(part["vec"].to_list()), unseen, ids_j, others))
        return pd.concat(found)

    return x.groupBy("x", "y").cogroup(y.groupBy("x", "y")).applyInPandas(kernel, f"i {kind_i}, j {kind_j}, score double")


def _hidden(mask: DataFrame, ny: int) -> DataFrame:
    """``id, y, hidden``: what each left row must not see of block ``y`` of the right rows."""
    rows = mask.select(F.col("i").alias("id"), F.pmod(F.xxhash64("j"), F.lit(ny)).cast("int").alias("y"), "j")
    return rows.groupBy("id", "y").agg(F.collect_set("j").alias("hidden"))


def _best_parts(left: DataFrame, right: DataFrame, k: int, block: int | None, vectors: DataFrame | None = None) -> tuple[int, int]:
    """Parts of both sides: no more left rows in a task than fit, enough tasks, and the fewest bytes sent. The left rows' vectors
    may be in a table of their own."""
    n, m = left.count(), right.count()
    if block is not None:
        return max(1, ceil(n / block)), max(1, ceil(m / block))
    width = 8 * ((left if vectors is None else vectors).agg(F.max(F.size("vec"))).first()[0] or 1)
    tasks = 2 * left.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(tasks, ceil(n * m / _LEAST_BLOCK**2)))
    least = ceil(n / max(1, min(_LEFT_ROWS, _LEFT_BYTES // (width + 16 * k))))
    choices = [(nx, ceil(tasks / nx)) for nx in range(max(1, least), max(1, least, tasks) + 1)]
    return min(choices, key=lambda c: c[0] * m * width + c[1] * n * (width + 24 * k))


def left_out(out_rows: np.ndarray, out_ids: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells (left row, place among ``ids``) of the pairs ``out_rows, out_ids``, held by id, in order of the rows."""
    if not len(out_rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = ids.drop_null().to_numpy(zero_copy_only=False)
    first, last = np.searchsorted(out_ids, known, "left"), np.searchsorted(out_ids, known, "right")
    n = last - first
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row, col = out_rows[at], np.repeat(np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False)), n)
    order = np.argsort(row, kind="stable")
    return row[order], col[order]


def _count_rows(cells: np.ndarray) -> np.ndarray:
    """True cells of every row."""
    return np.bitwise_count(np.packbits(cells, axis=1)).sum(axis=1, dtype=np.int64)


class _Best:
    """Left rows of one part, the k best right rows of each so far, and all right rows seen. Right rows come by id."""

    def __init__(self, score: Callable, k: int, keep: Callable | None, exclude_self: bool, digits: int):
        self.score, self.k, self.keep, self.exclude_self, self.digits = score, k, keep, exclude_self, digits
        self.batches: list[pa.RecordBatch] = []
        self.seen: list[pa.Array] = []
        self.n_seen = 0
        self.vecs: np.ndarray | None = None

    def close_left(self) -> None:
        """Stack the left rows; hidden ids (and own ones) become (row, id) by id."""
        table = pa.Table.from_batches(self.batches).combine_chunks()
        self.batches = []
        self.ids = table["id"].combine_chunks()
        self.vecs = matrix(table["vec"].combine_chunks())
        rows, ids = [], []
        if "hidden" in table.column_names:
            hidden = table["hidden"].combine_chunks()
            rows.append(np.repeat(np.arange(len(hidden)), np.diff(hidden.offsets.to_numpy())))
            ids.append(hidden.flatten().to_numpy(zero_copy_only=False))
        if self.exclude_self:
            known = self.ids.is_valid().to_numpy(zero_copy_only=False)
            rows.append(np.flatnonzero(known))
            ids.append(self.ids.drop_null().to_numpy(zero_copy_only=False))
        self.out_rows, self.out_ids = (np.concatenate(rows), np.concatenate(ids)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(self.out_ids, kind="stable")
        self.out_rows, self.out_ids = self.out_rows[order], self.out_ids[order]
        self.best = np.full((len(self.ids), self.k), -np.inf)
        self.place = np.full((len(self.ids), self.k), -1)

    def meet(self, ids: pa.Array, others: np.ndarray) -> None:
        """Score a run of right rows against all left rows."""
        row, col = left_out(self.out_rows, self.out_ids, ids)
        step = _slice_rows(len(ids))
        for at in range(0, len(self.vecs), step):
            got = self.score(self.vecs[at : at + step], others)
            a, b = np.searchsorted(row, (at, at + step))
            got[row[a:b] - at, col[a:b]] = -np.inf
            self._merge(at, got)
        self.seen.append(ids.take(pa.array(np.arange(len(ids)))))  # a copy: a slice would keep its whole batch
        self.n_seen += len(ids)

    def _merge(self, at: int, got: np.ndarray) -> None:
        """Put the scores of left rows from ``at`` on among their best; equal ones stay behind those met before."""
        best, place = self.best[at : at + len(got)], self.place[at : at + len(got)]
        least = best[:, -1]
        with np.errstate(invalid="ignore"):
            near = got > (least - 10.0**-self.digits - 1e-12 * np.abs(least))[:, None] if np.isfinite(least).all() else got > -np.inf
            if np.count_nonzero(near) > 4 * self.k * len(got):
                got = np.round(got, self.digits)
                near &= got > least[:, None]
                if self.keep is not None:
                    near &= self.keep(got)
                r, c = k_best(got, near, self.k)
                new = got[r, c]
            else:
                r, c = np.nonzero(near)
                new = np.round(got[r, c], self.digits)
                ok = new > least[r]
                if self.keep is not None:
                    ok &= self.keep(new)
                r, c, new = r[ok], c[ok], new[ok]
        if not len(r):
            return
        rows = np.unique(r)
        r = np.concatenate([np.repeat(rows, self.k), r])
        new = np.concatenate([best[rows].ravel(), new])
        spot = np.concatenate([place[rows].ravel(), c + self.n_seen])
        order = np.lexsort((spot, -new, r))
        start = np.searchsorted(r[order], rows)
        first = order[(start[:, None] + np.arange(self.k)[None, :]).ravel()]
        best[rows], place[rows] = new[first].reshape(-1, self.k), spot[first].reshape(-1, self.k)

    def rows(self) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        if self.vecs is None or not self.seen:
            return
        seen = pa.concat_arrays(self.seen)
        for at in range(0, len(self.place), _slice_rows(self.k)):
            place = self.place[at : at + _slice_rows(self.k)]
            r, c = np.nonzero(place >= 0)
            yield self.ids.take(pa.array(at + r)), seen.take(pa.array(place[r, c])), self.best[at + r, c]


def matrix(vecs: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix; null components are NaN."""
    widths = np.diff(vecs.offsets.to_numpy())
    if vecs.null_count or (len(widths) and (widths != widths[0]).any()):
        raise ValueError("vectors must not be null and must have the same length")
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def _best_pairs(left: DataFrame, right: DataFrame, score: Callable, k: int, keep: Callable | None, mask: DataFrame | None, exclude_self: bool, digits: int, block: int | None) -> DataFrame:
    nx, ny = _best_parts(left, right, k, block)
    x = _vector_blocks(left, "x", "y", nx, ny)
    if mask is not None:
        x = x.join(_hidden(mask, ny), ["id", "y"], "left")
    found = _streamed(x, right, nx, ny, ["hidden"] if mask is not None else [], lambda: _Best(score, k, keep, exclude_self, digits), [("score", "double")])
    return top_k(found, ["i"], [F.desc("score"), F.asc("j")], k)


def _streamed(x: DataFrame, right: DataFrame, nx: int, ny: int, held: list[str], make: Callable, out: list[tuple[str, str]]) -> DataFrame:
    """``(i, j, <out>)``: every part ``(x, y)`` of left rows ``(x, y, id, vec, <held>)`` is kept by a task in what ``make`` returns,
    which the right rows of the part then meet, by id, as they stream by."""
    x = x.withColumn("side", F.lit(0))
    y = _vector_blocks(right.toDF(*right.columns), "y", "x", ny, nx).withColumn("side", F.lit(1))
    types = {"i": x.schema["id"].dataType, "j": right.schema["id"].dataType}
    columns = ["x", "y", "side", "vec", *held]
    x = x.select(*columns, F.col("id").alias("i"), F.lit(None).cast(types["j"]).alias("j"))
    y = y.select(*columns[:4], *[F.lit(None).cast(x.schema[c].dataType).alias(c) for c in held], F.lit(None).cast(types["i"]).alias("i"), F.col("id").alias("j"))
    rows = x.unionByName(y).repartitionById(nx * ny, (F.col("x") * ny + F.col("y")).cast("int")).sortWithinPartitions("x", "y", "side", "i", "j")
    sent = ["i", "j", *[c for c, _ in out]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = None, None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("x", "y", "side")])
            starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(axis=0)]) if len(batch) else []
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                if part != tuple(at[:2, a]):
                    if now is not None:
                        yield from (pa.RecordBatch.from_arrays([i, j, *map(pa.array, values)], sent) for i, j, *values in now.rows())
                    part, now = tuple(at[:2, a]), make()
                run = batch.slice(a, b - a)
                if at[2, a] == 0:
                    own = ["i", "vec", *held]
                    now.batches.append(pa.RecordBatch.from_arrays([run.column(c) for c in own], ["id", *own[1:]]))
                elif now.batches or now.vecs is not None:
                    if now.vecs is None:
                        now.close_left()
                    now.meet(run.column("j"), matrix(run.column("vec")))
        if now is not None:
            yield from (pa.RecordBatch.from_arrays([i, j, *map(pa.array, values)], sent) for i, j, *values in now.rows())

    return rows.mapInArrow(kernel, ", ".join(f"{c} {t}" for c, t in [("i", types["i"].simpleString()), ("j", types["j"].simpleString()), *out]))


class _Places:
    """Left rows of one part with their wanted pairs, and how many right rows came before each so far. A left row with
    more than ``sorted_from`` wanted pairs has its scores sorted; others are compared pair by pair."""

    sorted_from = 48

    def __init__(self, digits: int):
        self.digits = digits
        self.batches: list[pa.RecordBatch] = []
        self.vecs: np.ndarray | None = None

    def close_left(self) -> None:
        """Stack the left rows, those with most wanted pairs first; pair ``w`` of row ``r`` is entry ``first[r] + w``."""
        table = pa.Table.from_batches(self.batches).combine_chunks()
        self.batches = []
        order = np.argsort(-np.diff(table["asked"].combine_chunks().offsets.to_numpy()), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.ids = table["id"].combine_chunks()
        self.vecs = matrix(table["vec"].combine_chunks())
        asked = table["asked"].combine_chunks()
        offsets = asked.offsets.to_numpy()
        self.first, self.count = offsets[:-1] - offsets[0], np.diff(offsets)
        self.asked = asked.flatten()
        self.score = table["score"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # a score beyond these bounds is on its side of the wanted one also when rounded
        edge = 10.0**-self.digits + 1e-12 * np.abs(self.score)
        self.low, self.high = self.score - edge, self.score + edge
        self.n = np.zeros(len(self.score), np.int64)
        hidden = table["hidden"].combine_chunks()
        rows = np.repeat(np.arange(len(hidden)), np.diff(hidden.offsets.to_numpy()))
        ids = hidden.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.out_rows, self.out_ids = rows[order], ids[order]

    def meet(self, ids: pa.Array, others: np.ndarray) -> None:
        """Count a run of right rows for all wanted pairs."""
        row, col = left_out(self.out_rows, self.out_ids, ids)
        step = _slice_rows(len(ids))
        for at in range(0, len(self.vecs), step):
            got = self.vecs[at : at + step] @ others.T
            a, b = np.searchsorted(row, (at, at + step))
            got[row[a:b] - at, col[a:b]] = -np.inf
            many = int(np.count_nonzero(self.count[at : at + step] > self.sorted_from))
            for r in range(many):
                self._by_order(at + r, got[r], ids)
            most = self.count[at + many] if at + many < len(self.count) else 0
            for w in range(most):
                upto = int(np.count_nonzero(self.count[at + many : at + step] > w))
                self._by_comparison(self.first[at + many : at + many + upto] + w, got[many : many + upto], ids)

    def _by_comparison(self, entry: np.ndarray, got: np.ndarray, ids: pa.Array) -> None:
        """One wanted pair of every row of ``got``."""
        before, near = got > self.high[entry, None], got < self.low[entry, None]
        self.n[entry] += _count_rows(before)
        if np.count_nonzero(before) + np.count_nonzero(near) < got.size:
            r, c = np.nonzero(~(before | near))
            np.add.at(self.n, entry[r], self._close(entry[r], got[r, c], c, ids))

    def _by_order(self, row: int, got: np.ndarray, ids: pa.Array) -> None:
        """All wanted pairs of one row, by its scores in order."""
        entry = self.first[row] + np.arange(self.count[row])
        order = np.argsort(-got, kind="stable")  # NaN last
        lost = -got[order]
        start, stop = np.searchsorted(lost, -self.high[entry], "left"), np.searchsorted(lost, -self.low[entry], "right")
        unknown = np.isnan(self.score[entry])
        start, stop = np.where(unknown, 0, start), np.where(unknown, len(got), stop)
        self.n[entry] += start
        n = stop - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        e, c = np.repeat(entry, n), order[at]
        np.add.at(self.n, e, self._close(e, got[c], c, ids))

    def _close(self, entry: np.ndarray, got: np.ndarray, col: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Whether right rows ``col`` with scores at the edge come before the wanted pairs: by rounded score, then by id; the
        wanted row itself does not, as its product may differ in the last digit."""
        got, score = np.round(got, self.digits), self.score[entry]
        mine, other = self.asked.take(pa.array(entry)), ids.take(pa.array(col))
        smaller = pc.fill_null(pc.less(other, mine), False).to_numpy(zero_copy_only=False)
        itself = pc.fill_null(pc.equal(other, mine), False).to_numpy(zero_copy_only=False)
        none, unknown = np.isnan(score), np.isnan(got)  # NaN is behind all numbers
        first = (got > score) | (none & ~unknown) | (((got == score) | (none & unknown)) & smaller)
        return first & ~itself & (got != -np.inf)

    def rows(self) -> Iterator[tuple]:
        if self.vecs is None:
            return
        owner = np.repeat(np.arange(len(self.ids)), self.count)
        for at in range(0, len(owner), _CELLS):
            part = slice(at, at + _CELLS)
            yield self.ids.take(pa.array(owner[part])), self.asked.slice(at, _CELLS), self.score[part], self.n[part]


def product_ranks(
    left: DataFrame, right: DataFrame, wanted: DataFrame, hidden: DataFrame, digits: int = 9, block: int | None = None, most_wanted: int = 1_000
) -> DataFrame:
    """``(i, j, score, rank)``: the place, from 1, of every wanted pair ``(i, j)`` among the dot products of ``i`` with all rows of
    ``right`` that ``hidden(i, j)`` does not take out; of equal ones the smaller ``j`` is first.

    No list is made: a task keeps left rows with their wanted pairs, counts how many of the right rows that stream by come before
    each, and the counts of the parts add up. Wanted pairs that are hidden or lack a vector have no row; repeated ones
    count once. An ``i`` with more than ``most_wanted`` of them is several rows in several parts.
    """
    left, right = stored(left, "left"), stored(right, "right")
    kinds = {"i": left.schema["id"].dataType, "j": right.schema["id"].dataType}
    asked = wanted.select("i", "j").distinct().join(hidden.select("i", "j"), ["i", "j"], "left_anti")
    asked = asked.join(right.select(F.col("id").alias("j"), as_double("vec").alias("b")), "j").join(left.select(F.col("id").alias("i"), as_double("vec").alias("a")), "i")
    asked = materialise(asked.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], (F.round(dot("a", "b"), digits) + F.lit(0.0)).alias("score")), "wanted")
    parts = asked.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / most_wanted).alias("parts"))
    packed = asked.join(parts, "i").groupBy("i", F.pmod(F.xxhash64("j"), F.col("parts")).alias("part"))
    packed = packed.agg(F.array_sort(F.collect_list(F.struct("j", "score"))).alias("w"))
    packed = materialise(packed.select(F.col("i").alias("id"), "part", F.col("w.j").alias("asked"), F.col("w.score").alias("score")), "packed")
    each = packed.agg(F.ceil(F.avg(F.size("asked")))).first()[0] or 1
    nx, ny = _best_parts(packed, right, int(each), block, left)
    x = packed.join(left.select("id", as_double("vec").alias("vec")), "id")
    x = x.withColumn("x", F.pmod(F.xxhash64("id", "part"), F.lit(nx)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    x = x.join(_hidden(hidden.select("i", "j"), ny), ["id", "y"], "left").withColumn("hidden", F.coalesce("hidden", F.array().cast(hidden.select(F.array("j")).schema[0].dataType)))
    counts = _streamed(x, right, nx, ny, ["asked", "score", "hidden"], lambda: _Places(digits), [("score", "double"), ("n", "long")])
    return counts.groupBy("i", "j", "score").agg((F.sum("n") + 1).alias("rank"))


def dense_rows(long: DataFrame, owner: str, index: str, value: str, width: int) -> DataFrame:
    """``(id, vec)`` from long form, for a checked, bounded number of columns ``width``."""
    held = long.groupBy(F.col(owner).alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(index).cast("int"), F.col(value).cast("double")))).alias("m")
    )
    cells = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    return held.select("id", cells.alias("vec"))


def block_totals(table: DataFrame, total: Callable[[np.ndarray, np.ndarray], float], block: int | None = None) -> DataFrame:
    """(total): one number per pair of blocks of a vector table, all ordered pairs and self pairs in it."""
    table = stored(table, "table")
    n, _ = _block_counts(table, table, block)
    x = _vector_blocks(table, "x", "y", n, n)
    y = _vector_blocks(table.toDF(*table.columns), "y", "x", n, n)

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"total": []})
        x, y, step = np.stack(a["vec"].to_list()), np.stack(b["vec"].to_list()), _slice_rows(len(b))
        return pd.DataFrame({"total": [float(sum(total(x[at : at + step], y) for at in range(0, len(x), step)))]})

    return x.groupBy("x", "y").cogroup(y.groupBy("x", "y")).applyInPandas(kernel, "total double")


def cosine_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def unit(m: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    return unit(a) @ unit(b).T


def dot_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def shrunk_cosine_block(shrink: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :] + shrink)

    return score
