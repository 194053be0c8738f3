"""Sums over shared keys of every left row with every right row, made in tasks from tables that are read, never shuffled by pair.

Both sides are written once, one row per id with its keys and values as arrays. A task keeps a block of left rows, ordered by
key, and reads the whole right table past it; what a right row gives with the block is whole when the row has passed. So
pairs are never sent or written, a task's memory does not follow the number of pairs, and one key or row may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.ranking import number_rows
from tastegrid.session import materialise

#: Pair rows (a left and a right entry of one key) and left entries of a block, and pair rows that a task of a small job has.
BLOCK_ROWS, BLOCK_ENTRIES, SMALL_BLOCK_ROWS = 50_000_000, 4_000_000, 1_000_000
#: Pair rows that are expanded at a time, cells that they may be added up in, and how many cells there may be per pair row.
_STEP_ROWS, _STEP_CELLS, _CELLS_PER_ROW = 1_000_000, 8_000_000, 8
#: Pair rows of a block that keeps all its pairs as lists.
LIST_ROWS = 5_000_000
#: Best of all its left rows that a block has at most, and candidates that wait before the best are chosen again.
_BLOCK_BEST, _WAITING = 4_000_000, 2_000_000

_BEST = ["i", "j", "sim", "nonzero", "place"]
_NO_NAME = "\1"

# name -> of the two values
STATS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "n": lambda a, b: np.ones(len(a)),
    "dot": lambda a, b: a * b,
    "low": np.fmin,
    "sum": lambda a, b: a + b,
    "diff": lambda a, b: a - b,
    "equal": lambda a, b: np.where(np.isnan(a) | np.isnan(b), np.nan, a == b),
    "far": lambda a, b: np.abs(a - b),
    "canberra": lambda a, b: np.abs(a - b) / np.where((a == 0) & (b == 0), 1.0, np.abs(a) + np.abs(b)),
    "left": lambda a, b: a,
    "right": lambda a, b: b,
}
MAXED = {"far"}


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: half away from 0, and values too large for digits stay."""
    scaled = np.abs(x) * 10.0**digits
    return np.where(scaled < 2.0**52, np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x), x)


class Sides:
    """What a score may read of pairs: columns by name, on arrays in a task and on columns in a plan."""

    def __init__(self, get: Callable[[str], np.ndarray | Column], on_columns: bool):
        self.get, self.on_columns = get, on_columns

    def sqrt(self, x):
        return F.sqrt(x) if self.on_columns else np.sqrt(x)

    def power(self, x, y: float):
        return F.pow(x, F.lit(y)) if self.on_columns else np.power(x, y)

    def at_least(self, x, least: float):
        return F.greatest(x, F.lit(least)) if self.on_columns else np.maximum(x, least)

    def round(self, x, digits: int):
        return F.round(x, digits) if self.on_columns else rounded(x, digits)

    def ratio(self, a, b, empty: float | None = None):
        """``a / b``; ``empty`` (nothing by default) where b is 0 or a side is not there."""
        if self.on_columns:
            return F.coalesce(F.try_divide(a, b), F.lit(empty).cast("double"))
        out = np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=np.asarray(b) != 0)
        return out if empty is None else np.where(np.isnan(out), empty, out)


def on_columns(**other: Column) -> Sides:
    return Sides(lambda name: other.get(name, F.col(name)), True)


def members(base: DataFrame, sides: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The members ``(id, k, v)`` as a table of :func:`entries`, for pairs of them, and how many keys they share."""
    base = base.where("k IS NOT NULL AND id IS NOT NULL")
    keys = number_rows(base.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key")
    return entries(base, keys, sides), keys.count()


def entries(base: DataFrame, keys: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """One written row per id of ``base(id, k, v)``: ``id, keys, values``, the ``work`` of its keys and the columns of ``sides(id, ...)``.
    ``keys`` is ``(k, key, size)``, numbered from 0; rows of other keys are left out."""
    placed = base.join(keys.select("k", F.col("key").cast("int").alias("key"), "size"), "k").select("id", "key", "v", "size")
    held = placed.repartition("id").groupBy("id").agg(F.collect_list(F.struct("key", "v")).alias("p"), F.sum("size").alias("work"))
    held = held.select("id", F.col("p.key").alias("keys"), F.col("p.v").alias("values"), "work")
    held = held if sides is None else held.join(sides, "id", "left")
    return materialise(held.withColumn("no", F.monotonically_increasing_id()), "entries")


def blocks_of(work: int, entries: int, best: int, cores: int) -> int:
    small = min(2 * cores, ceil(work / SMALL_BLOCK_ROWS))
    return max(1, small, ceil(work / BLOCK_ROWS), ceil(entries / BLOCK_ENTRIES), ceil(best / _BLOCK_BEST))


def partners(
    left: DataFrame,
    right: DataFrame,
    n_keys: int,
    stats: Sequence[str],
    score: Callable[[Sides], np.ndarray] | None = None,
    k: int = 0,
    digits: int = 9,
    own: bool = False,
    keep_zero: bool = False,
    hidden: str | None = None,
    about: Sequence[str] = (),
    about_left: Sequence[str] | None = None,
    reach: str | None = None,
    lists: bool = False,
) -> DataFrame:
    """Pairs of the rows of two tables of :func:`entries` (or the same one twice) that share a key.

    Without ``score`` every pair is a row ``(i, j, <stats>, <about>_i, <about>_j)``. With it, ``score`` maps their :class:`Sides` to scores and
    the ``k`` best of every i, of equal ones the smaller j, are rows ``(i, j, sim, nonzero, place)``, where ``nonzero`` is how many pairs of i have a
    score other than 0. Scores are rounded; undefined ones are no pairs, nor are zeros unless ``keep_zero``. ``about`` are columns of both sides
    (``about_left`` of the left one if others) that the score reads.

    ``own``: both tables are one and a row meets all but itself. ``hidden``: a left column with right ids that are no partners.
    ``reach``: a left column, no less than the places that i meets, is hidden from and needs. Places (a right column ``place``, from 0) that
    i meets are rows ``(i, place)`` too, as far as they may bar one of the first k that it neither meets nor is hidden from.
    ``lists``: the result is a table as of :func:`entries`, whose keys are the ``place`` (of both sides) of all partners and whose values are the
    scores, not rounded, beside the row's own ``place``.
    """
    of_left = list(about if about_left is None else about_left)
    total = left.agg(F.sum("work"), F.sum(F.size("keys")), F.count(F.lit(1))).first()
    n = blocks_of(total[0] or 0, total[1] or 0, total[2] * max(1, k), left.sparkSession.sparkContext.defaultParallelism)
    kinds = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    if lists:
        n = max(n, ceil((total[0] or 0) / LIST_ROWS))
    placed = ["place"] if reach or lists else []
    only_left = [c for c in (hidden, reach, "place" if lists else None) if c]

    def side(table: DataFrame, at: int, other: DataFrame, columns: list[str], missing: list[str]) -> DataFrame:
        rows = table.toDF(*table.columns)
        ids = [F.col("id").alias("i"), F.lit(None).cast(kinds[1]).alias("j")] if at == 0 else [F.lit(None).cast(kinds[0]).alias("i"), F.col("id").alias("j")]
        block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") if at == 0 else F.lit(0)
        absent = [F.lit(None).cast(other.schema[c].dataType).alias(c) for c in missing]
        return rows.select(F.lit(at).alias("side"), block.alias("block"), *ids, "keys", "values", "no", *columns, *absent)

    only_right = [c for c in (*about, *placed) if c not in (*of_left, *only_left)]
    for_left, for_right = [*of_left, *only_left], [c for c in of_left if c not in about]
    a = side(left, 0, right, for_left, only_right)
    b = side(right, 1, left, [*about, *placed], [c for c in (*for_right, *only_left) if c not in placed]).select(a.columns)
    # the left rows of the block come first: partitions of a union stay in order, and the kernel makes sure
    stream = a.unionByName(b).coalesce(1)
    parts = left.sparkSession.range(0, n, 1, n).select(F.col("id").cast("int").alias("part"))
    met = stream.join(parts.hint("shuffle_replicate_nl"), (F.col("side") == 1) | (F.col("block") == F.col("part")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Block(n_keys, list(stats), score, k, digits, own, keep_zero, hidden, list(about), of_left, reach, lists)
        for batch in batches:
            first = batch.column("side").to_numpy() == 0
            cut = int(first.sum())
            if cut:
                if now.closed or not first[:cut].all():
                    raise RuntimeError("right rows came before the left rows of the block")
                now.waiting.append(batch.slice(0, cut))
            if cut < len(batch):
                yield from now.meet(batch.slice(cut))
        yield from now.rows()

    if score is None:
        out = [("i", kinds[0]), ("j", kinds[1]), *[(s, "double") for s in stats]]
        out += [(f"{c}_i", left.schema[c].dataType.simpleString()) for c in of_left] + [(f"{c}_j", right.schema[c].dataType.simpleString()) for c in about]
    elif lists:
        out = [("id", kinds[0]), ("keys", "array<int>"), ("values", "array<double>"), ("place", "bigint")]
    else:
        out = [("i", kinds[0]), ("j", kinds[1]), ("sim", "double"), ("nonzero", "bigint"), ("place", "bigint")]
    return met.drop("block", "part").mapInArrow(kernel, ", ".join(f"{c} {t}" for c, t in out))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all lists and the length of each; null elements are NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _plain(ids: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as Spark does, nulls first."""
    if pa.types.is_string(ids.type):
        return ids.fill_null(_NO_NAME).to_numpy(zero_copy_only=False).astype(str)
    if not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return ids.fill_null(pa.scalar(_no_id(ids.type.to_pandas_dtype()), ids.type)).to_numpy(zero_copy_only=False)


def _no_id(kind: np.dtype):
    return np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf


def _ids(found: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The other way round."""
    return pa.array(found, kind, mask=found == (_NO_NAME if found.dtype.kind == "U" else _no_id(found.dtype)))


class _Block:
    """Left rows of one block by key, and what the right rows give with them."""

    def __init__(self, n_keys, stats, score, k, digits, own, keep_zero, hidden, about, of_left, reach, lists):
        self.n_keys, self.stats, self.score, self.k, self.digits, self.own, self.keep_zero = n_keys, stats, score, k, digits, own, keep_zero
        self.hidden, self.about, self.of_left, self.reach, self.lists = hidden, about, of_left, reach, lists
        self.waiting: list[pa.RecordBatch] = []
        self.closed = False

    def close(self) -> None:
        self.closed = True
        table = pa.Table.from_batches(self.waiting).combine_chunks()
        self.waiting = []
        column = lambda c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0)
        self.ids = column("i")
        keys, widths = _flat(column("keys"))
        values, _ = _flat(column("values"))
        order = np.argsort(keys, kind="stable")
        self.row = np.repeat(np.arange(len(widths), dtype=np.int32), widths)[order]
        self.value = values[order]
        self.gaps = bool(np.isnan(self.value).any())
        self.count = np.bincount(keys, minlength=self.n_keys).astype(np.int32)
        self.start = (np.cumsum(self.count, dtype=np.int64) - self.count).astype(np.int32)
        self.no = column("no").to_numpy()
        self.left = {c: column(c).to_numpy(zero_copy_only=False).astype(float) for c in self.of_left} if self.score else {c: column(c) for c in self.of_left}
        self.limit = column(self.reach).to_numpy() if self.reach else None
        if self.reach:
            self.from_bit = np.cumsum(self.limit + 1) - (self.limit + 1)
            self.taken = np.zeros(int((self.limit + 1).sum()), bool)
            self.spare = self.k + (np.diff(column(self.hidden).offsets.to_numpy()) if self.hidden else np.ones(len(self.ids), np.int64))
        self.own_place = column("place") if self.lists else None
        if self.hidden:
            out = column(self.hidden)
            rows = np.repeat(np.arange(len(out)), np.diff(out.offsets.to_numpy()))
            self.out_ids, at = np.unique(_plain(out.flatten()), return_inverse=True)
            self.out = np.unique(at * np.int64(len(out)) + rows)
        self.nonzero = np.zeros(len(self.ids), np.int64)
        self.least = np.full(len(self.ids), -np.inf)
        self.last: np.ndarray | None = None
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Add up what the right rows have in common with the left ones, some rows at a time."""
        if not self.closed:
            if not self.waiting:
                return
            self.close()
        self.kind = batch.column("j").type
        keys, widths = _flat(batch.column("keys"))
        values, _ = _flat(batch.column("values"))
        number = self.count[keys]
        there = number > 0
        col = np.repeat(np.arange(len(widths)), widths)[there]
        keys, values, number = keys[there], values[there], number[there].astype(np.int64)
        upto = np.cumsum(np.bincount(col, number, len(widths)).astype(np.int64))
        ends = np.cumsum(np.bincount(col, minlength=len(widths)))
        at, done, entry = 0, 0, 0
        while at < len(widths):
            to = max(at + 1, int(np.searchsorted(upto, done + _STEP_ROWS, "right")))
            e = slice(entry, ends[to - 1])
            work = int(upto[to - 1]) - done
            if work:
                yield from self._found(batch, at, self._sums(keys[e], values[e], number[e], col[e] - at, to - at, work))
            at, done, entry = to, int(upto[to - 1]), int(ends[to - 1])

    def _expanded(self, keys: np.ndarray, values: np.ndarray, number: np.ndarray, col: np.ndarray):
        """Left row, right row and both values of every pair row."""
        at = np.arange(number.sum()) + np.repeat(self.start[keys] - (np.cumsum(number) - number), number)
        return self.row[at], np.repeat(col, number), self.value[at], np.repeat(values, number)

    def _sums(self, keys, values, number, col, width: int, work: int):
        """Left row, right row and statistics of the pairs of ``width`` right rows."""
        cells = len(self.ids) * width
        gaps = self.gaps or bool(np.isnan(values).any())
        if width > 1 and (cells > _STEP_CELLS or cells > _CELLS_PER_ROW * work or MAXED & set(self.stats)):
            return self._sorted(keys, values, number, col, width, gaps)
        total = {s: np.zeros(cells) for s in self.stats}
        seen = {s: np.zeros(cells) for s in self.stats if gaps and s != "n"}
        met = np.zeros(cells, bool)
        upto = np.cumsum(number)
        entry = 0
        while entry < len(keys):  # a right row may have any number of pair rows
            to = max(entry + 1, int(np.searchsorted(upto, (upto[entry - 1] if entry else 0) + 2 * _STEP_ROWS, "right")))
            r, c, a, b = self._expanded(keys[entry:to], values[entry:to], number[entry:to], col[entry:to])
            code = r.astype(np.int64) * width + c
            met[code] = True
            for s in self.stats:
                v = STATS[s](a, b)
                if s in seen:
                    real = ~np.isnan(v)
                    seen[s] += np.bincount(code, real, cells)
                    v = np.where(real, v, 0.0)
                if s in MAXED:
                    np.maximum.at(total[s], code, v)
                else:
                    total[s] += np.bincount(code, None if s == "n" else v, cells)
            entry = to
        at = np.flatnonzero(met)
        got = {s: np.where(seen[s][at] > 0, total[s][at], np.nan) if s in seen else total[s][at] for s in self.stats}
        return at // width, at % width, got

    def _sorted(self, keys, values, number, col, width: int, gaps: bool):
        r, c, a, b = self._expanded(keys, values, number, col)
        code = r.astype(np.int64) * width + c
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        a, b = a[order], b[order]
        got = {}
        for s in self.stats:
            if s == "n":
                got[s] = np.diff(np.r_[first, len(code)]).astype(float)
                continue
            v = STATS[s](a, b)
            add = (np.maximum if s in MAXED else np.add).reduceat
            if gaps:
                real = ~np.isnan(v)
                got[s] = np.where(np.add.reduceat(real.astype(np.int64), first) > 0, add(np.where(real, v, 0.0), first), np.nan)
            else:
                got[s] = add(v, first)
        at = code[first]
        return at // width, at % width, got

    def _found(self, batch: pa.RecordBatch, at: int, sums) -> Iterator[pa.RecordBatch]:
        r, c, got = sums
        c = c + at
        if self.own:
            other = self.no[r] != batch.column("no").to_numpy()[c]
            if not other.all():
                r, c, got = r[other], c[other], {s: v[other] for s, v in got.items()}
        if self.score is None:
            sent = {s: pa.array(v, from_pandas=True) for s, v in got.items()}
            sent |= {f"{x}_i": self.left[x].take(pa.array(r)) for x in self.of_left}
            sent |= {f"{x}_j": batch.column(x).take(pa.array(c)) for x in self.about}
            yield pa.RecordBatch.from_pydict({"i": self.ids.take(pa.array(r)), "j": batch.column("j").take(pa.array(c))} | sent)
            return
        if self.limit is not None:
            place = batch.column("place").to_numpy(zero_copy_only=False)[c]
            near = place <= self.limit[r]  # not where there is none
            self.taken[self.from_bit[r[near]] + place[near].astype(np.int64)] = True
        sides = got | {f"{x}_i": v[r] for x, v in self.left.items()}
        sides |= {f"{x}_j": batch.column(x).to_numpy(zero_copy_only=False).astype(float)[c] for x in self.about}
        with np.errstate(all="ignore"):
            sim = self.score(Sides(sides.__getitem__, False))
            sim = sim if self.lists else rounded(sim, self.digits)
        real = ~np.isnan(sim)
        if self.lists:
            self.best.append((r[real].astype(np.int32), batch.column("place").to_numpy(zero_copy_only=False)[c[real]].astype(np.int32), sim[real]))
            return
        if not self.keep_zero:
            real &= sim != 0
            self.nonzero += np.bincount(r[real], minlength=len(self.nonzero))
        ids = _plain(batch.column("j"))
        near = real & (sim >= self.least[r])
        r, c, sim = r[near], c[near], sim[near]
        j = ids[c]
        if self.last is not None:
            ahead = (sim > self.least[r]) | (j < self.last[r])
            r, j, sim = r[ahead], j[ahead], sim[ahead]
        if self.hidden and len(r):
            seen = self._is_hidden(r, j)
            r, j, sim = r[~seen], j[~seen], sim[~seen]
        if len(r):
            self.best.append((r, j, sim))
            self.held += len(r)
            if self.held > _WAITING + self.k * len(self.ids):
                self._choose()

    def _is_hidden(self, r: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not len(self.out):
            return np.zeros(len(r), bool)
        at = np.searchsorted(self.out_ids, j).clip(max=len(self.out_ids) - 1)
        code = at * np.int64(len(self.ids)) + r
        return (self.out_ids[at] == j) & (self.out[np.searchsorted(self.out, code).clip(max=len(self.out) - 1)] == code)

    def _choose(self) -> None:
        """Keep the best of every left row; worse ones need not wait from now on."""
        r, j, sim = map(np.concatenate, zip(*self.best))
        order = np.lexsort((j, -sim, r))
        r, j, sim = r[order], j[order], sim[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        size = np.diff(np.r_[first, len(r)])
        place = np.arange(len(r)) - np.repeat(first, size)
        full, cut = r[first[size >= self.k]], first[size >= self.k] + self.k - 1
        if self.last is None:
            self.last = np.zeros(len(self.ids), j.dtype)
        elif self.last.dtype.itemsize < j.dtype.itemsize:
            self.last = self.last.astype(j.dtype)  # longer names
        self.least[full], self.last[full] = sim[cut], j[cut]
        kept = place < self.k
        self.best, self.held = [(r[kept], j[kept], sim[kept])], int(kept.sum())

    def _barred(self) -> Iterator[pa.RecordBatch]:
        """Met places of each left row up to as many free ones as it may need."""
        found, rows, held = [], [], 0
        for at, (first, limit, spare) in enumerate(zip(self.from_bit, self.limit, self.spare)):
            met = self.taken[first : first + limit + 1]
            free = np.flatnonzero(~met)
            found.append(np.flatnonzero(met if len(free) < spare else met[: free[spare - 1]]))
            rows.append(at)
            held += len(found[-1])
            if held > _STEP_ROWS or at + 1 == len(self.ids):
                i = self.ids.take(pa.array(np.repeat(rows, [len(x) for x in found])))
                none = [pa.nulls(len(i), kind) for kind in (self.kind, pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([i, *none, pa.array(np.concatenate(found))], _BEST)
                found, rows, held = [], [], 0

    def _lists(self) -> pa.RecordBatch:
        r, key, value = map(np.concatenate, zip(*self.best))
        self.best = []
        order = np.argsort(r, kind="stable")
        r = r[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
        at, ends = pa.array(r[first]), pa.array(np.r_[first, len(r)].astype(np.int32))
        keys, values = (pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (key, value))
        return pa.RecordBatch.from_arrays([self.ids.take(at), keys, values, self.own_place.take(at)], ["id", "keys", "values", "place"])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.score is None or not self.closed:
            return
        if self.limit is not None:
            yield from self._barred()
        if not self.best:
            return
        if self.lists:
            yield self._lists()
            return
        self._choose()
        r, j, sim = self.best[0]
        for at in range(0, len(r), _STEP_ROWS):
            part = slice(at, at + _STEP_ROWS)
            i = self.ids.take(pa.array(r[part]))
            yield pa.RecordBatch.from_arrays([i, _ids(j[part], self.kind), pa.array(sim[part]), pa.array(self.nonzero[r[part]]), pa.nulls(len(i), pa.int64())], _BEST)


