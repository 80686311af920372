"""Scores of all pairs of two tables of vectors, multiplied tile by tile in NumPy.

A left side of at most ``HELD`` bytes is broadcast, and the right side is scanned where it lies: neither is shuffled, and a right
row meets every left tile in turn.  A larger left side is cut into parts of that size, which meet parts of the right side in
cells; a cell is read as a stream, so that both sides may grow and only one left part is held.  What is returned of a tile's
products is up to its reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import settled

#: rows of a left tile, of a right one, and of the right rows that are multiplied at once
TILE, RIGHT_TILE, SLICE = 1024, 16_384, 2048
#: bytes of left rows that a task holds; rows that ``cut`` keeps in a task before they are passed on
HELD, KEPT = 32 << 20, 500_000
#: meetings of equal entries that are counted at once
MEETINGS = 2_000_000

#: of a left tile, a function of right rows that returns what is kept of their products
Prepare = Callable[[pa.Table], Callable[[pa.Table], pa.Table]]


def tiled(left: DataFrame, right: DataFrame, prepare: Prepare, out: str, tile: int | None = None, right_tile: int | None = None, cut: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """``prepare(left tile)(right rows)`` for every left tile and all right rows, as rows of ``out`` (a DDL string).

    At most ``right_tile`` right rows are given at once.  ``cut`` keeps, of the rows found so far by a task, those that are still wanted.
    """
    tile, step = tile or TILE, min(right_tile or SLICE, SLICE)
    spark = left.sparkSession
    names = spark.createDataFrame([], out).toArrow().schema
    held = left.limit(tile + 1).toArrow()
    most = max(tile, HELD * held.num_rows // max(held.nbytes, 1))
    if held.num_rows > tile:
        # written once, so that a row is dealt to the same cells however often a task is run again
        left = settled(left.withColumn("_n", F.monotonically_increasing_id()))
        held = left.drop("_n").limit(most + 1).toArrow()
    if held.num_rows <= most:
        shared = spark.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            meeting = _Meeting(shared.value, tile, step, prepare, names, cut)
            for batch in batches:
                yield from meeting.rows(pa.Table.from_batches([batch]))
            yield from meeting.rest()

        return right.mapInArrow(scan, out)

    n_rows = -(-left.count() // most)
    n_columns = -(-4 * spark.sparkContext.defaultParallelism // n_rows)
    right = settled(right.withColumn("_n", F.monotonically_increasing_id()))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod("_n", F.lit(n)).cast("int")
    rows = left.withColumn("_row", own(n_rows)).withColumn("_column", every(n_columns))
    columns = right.withColumn("_column", own(n_columns)).withColumn("_row", every(n_rows))
    packed = lambda df: F.struct(*[c for c in df.columns if c != "_n"])
    kind = lambda df: df.select(packed(df).alias("x")).schema["x"].dataType
    cell = (F.col("_row") * n_columns + F.col("_column")).alias("_cell")
    both = rows.select(cell, F.lit(0).alias("_side"), packed(left).alias("_left"), F.lit(None).cast(kind(right)).alias("_right"))
    both = both.unionAll(columns.select(cell, F.lit(1), F.lit(None).cast(kind(left)), packed(right)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, meeting = None, [], None
        for batch in batches:
            cells, sides = (batch.column(c).to_numpy() for c in ("_cell", "_side"))
            heads = np.flatnonzero(np.diff(cells, prepend=-1) | np.diff(sides, prepend=-1))
            for begin, end in zip(heads.tolist(), [*heads.tolist()[1:], len(cells)]):
                if cells[begin] != at:
                    yield from meeting.rest() if meeting else ()
                    at, waiting, meeting = cells[begin], [], None
                part = batch.slice(begin, end - begin)
                if not sides[begin]:
                    waiting.append(pa.RecordBatch.from_struct_array(part.column("_left")))
                elif waiting:
                    meeting = meeting or _Meeting(pa.Table.from_batches(waiting), tile, step, prepare, names, cut)
                    yield from meeting.rows(pa.Table.from_batches([pa.RecordBatch.from_struct_array(part.column("_right"))]))
        yield from meeting.rest() if meeting else ()

    return both.repartitionById(n_rows * n_columns, "_cell").sortWithinPartitions("_cell", "_side").mapInArrow(meet, out)


class _Meeting:
    """A part of the left side, tile by tile, and what is kept of the right rows that it meets."""

    def __init__(self, held: pa.Table, tile: int, step: int, prepare: Prepare, names: pa.Schema, cut: Callable[[pa.Table], pa.Table] | None):
        self.step, self.names, self.cut = step, names, cut
        self.tiles = [prepare(held.slice(at, tile)) for at in range(0, held.num_rows, tile)]
        self.found = [names.empty_table()] * len(self.tiles)
        self.wanted = [0] * len(self.tiles)

    def rows(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, self.step):
            part = rows.slice(at, self.step)
            for i, keep in enumerate(self.tiles):
                new = keep(part).cast(self.names)
                if self.cut is None:
                    yield from new.to_batches()
                else:
                    self.found[i] = pa.concat_tables([self.found[i], new])
                    if self.found[i].num_rows > 2 * self.wanted[i] + TILE:
                        self.found[i] = self.cut(self.found[i])
                        self.wanted[i] = self.found[i].num_rows
            if sum(x.num_rows for x in self.found) > KEPT:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for i, found in enumerate(self.found):
            if found.num_rows:
                self.found[i], self.wanted[i] = self.names.empty_table(), 0
                yield from self.cut(found).to_batches()


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: rows, their vectors in double precision, and norms.  Null vectors and those that hold nulls are left out."""
    lists = pa.concat_arrays([c.cast(pa.large_list(pa.float64())) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values
    size = np.diff(offsets)
    whole = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    if values.null_count:
        gone = np.concatenate([[0], np.cumsum(pc.is_null(values).to_numpy(zero_copy_only=False))])
        whole = whole & (gone[offsets[1:]] == gone[offsets[:-1]])
    flat = values.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == n))
        held = flat[offsets[rows][:, None] + np.arange(n)]
        out[n] = rows, held, np.sqrt(np.einsum("ij,ij->i", held, held))
    return out


def cosines(a: dict, n_a: int, b: dict, n_b: int) -> np.ndarray:
    """Cosines rounded to nine digits, as ``functions.cosine`` has them: 0 for zero, null and unequally long vectors."""
    out = np.zeros((n_a, n_b))
    for n in a.keys() & b.keys():
        (i, x, size_x), (j, y, size_y) = a[n], b[n]
        size = np.outer(size_x, size_y)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(size <= 0, 0.0, (x @ y.T) / size)
        out[np.ix_(i, j)] = found
    return np.round(out, 9)


def indexed(of: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that hold each of the whole numbers from 0 on: all of them in the numbers' order, and where each begins and how many it has."""
    times = np.bincount(left)
    return of[np.argsort(left, kind="stable")], np.cumsum(times) - times, times


def shared(index: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, at: np.ndarray, right: np.ndarray, m: int) -> np.ndarray:
    """(n, m) counts of equal entries of indexed left and right rows; left row ``of[i]`` holds ``left[i]``, once, and row ``at[j]`` ``right[j]``."""
    rows, first, times = index
    known = right < len(times)
    at, right = (at, right) if known.all() else (at[known], right[known])
    first, times = first[right], times[right]
    out, sums = None, np.cumsum(times)
    begin = 0
    while begin < len(right):
        # every right entry meets the left rows that have it, so many meetings at once
        end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + MEETINGS, side="right")))
        k = times[begin:end]
        met = rows[np.repeat(first[begin:end] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        counts = np.bincount(met * m + np.repeat(at[begin:end], k), minlength=n * m)
        out = counts if out is None else out + counts
        begin = end
    return (np.zeros(n * m, np.int64) if out is None else out).reshape(n, m)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the column's values, equal values alike; nulls first."""
    whole = column.combine_chunks()
    return pc.rank(whole, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def taken(rows: pa.Table, at: np.ndarray, **names: str) -> dict[str, pa.ChunkedArray]:
    """Columns of the rows at the given places, renamed."""
    return {new: rows.column(old).take(pa.array(at)) for new, old in names.items()}


def largest(scores: np.ndarray, k: int, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest entries of each row; not a number is above all, ties go to the smaller of ``ties``."""
    ranked = np.where(np.isnan(scores), np.inf, scores)
    n = ranked.shape[1]
    if n > k:
        i, j = np.nonzero(ranked >= np.partition(ranked, n - k, axis=1)[:, n - k, None])
    else:
        i, j = (x.ravel() for x in np.indices(ranked.shape))
    order = np.lexsort((ties[j], -ranked[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def best(rows: pa.Table, k: int) -> pa.Table:
    """Of ``(query_id, id, score)`` the ``k`` rows of largest score of each query; not a number is above all, ties go to the smaller id."""
    query, score = numbers(rows.column("query_id")), rows.column("score").to_numpy()
    order = np.lexsort((numbers(rows.column("id")), -np.where(np.isnan(score), np.inf, score), query))
    query = query[order]
    return rows.take(pa.array(order[np.arange(len(order)) - np.searchsorted(query, query) < k]))
