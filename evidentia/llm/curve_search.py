"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted and put on a Hilbert curve; several curves, each with its own
directions and shift.  Spark range-partitions every curve's keys, which gives each vector its rank on the curve; a curve
is cut by rank into blocks of about ``block`` rows, a query looks through its own and the two neighbouring blocks of every
curve, and the blocks' best candidates are merged and ranked by the exact inner product of the original vectors.

A round of curves compares a query with at most ``3 * curves * block`` rows, however large the table is.  What that finds
depends on the data: the fewer directions they really vary in, the better a curve keeps neighbours together.  So the recall
is measured: ``measured`` queries, drawn by a hash, are also compared with all vectors, and as long as fewer than ``recall`` of
their neighbours are found, another round runs on fresh curves with blocks twice as long (up to ``LONGEST`` rows), whose
finds join those before.  Blocks that reach the table's length find everything.  ``recall=0`` is one round.

Candidates are chosen in single precision, four more than are needed.  Equal vectors are searched once, as one row with
its ``k + 1`` smallest ids, which is all that a result can name.

Largest inner product is made nearest by the usual added component ``sqrt(M^2 - |x|^2)`` (M: the largest norm).

Defined cases: vectors null, zero, of another than the most frequent dimension (of equally frequent ones the largest), with
null or non-finite components or a squared length beyond double precision take no part, nor do rows without id; rows that
repeat an id are not candidates for one another; ties go to the smaller id; with fewer candidates than ``k`` all of them
return; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read_table, staged, table

CURVES, BLOCK, DIRECTIONS, BITS = 32, 448, 12, 5
#: candidates taken beyond those needed, as they are chosen in single precision
MARGIN = 4
#: share of neighbours that the measured queries must find, and how many of them are drawn; rows of the longest block
RECALL, MEASURED, LONGEST = 0.93, 200, 1 << 16


def hilbert_key(point: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (rows x axes) of integers below 2^bits, by Skilling's transposition."""
    x = point.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for axis in x:
            up = (axis & bit) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(up, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | ((axis >> np.uint64(level)) & one)
    return key.view(np.int64)


def _matrix(batch: pa.RecordBatch, name: str, dim: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column(batch, name).flatten(), dtype=kind).reshape(-1, dim)


class Curves:
    """Directions, shifts and scales of all curves."""

    def __init__(self, dim: int, largest: float, curves: int, directions: int, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.largest, self.curves, self.d = largest, curves, directions
        self.axes = np.hstack([np.linalg.qr(draw.normal(size=(dim + 1, dim + 1)))[0][:, :directions] for _ in range(curves)])
        self.shift = draw.random(curves * directions)
        self.low, self.span = np.zeros(curves * directions), np.ones(curves * directions)

    def project(self, x: np.ndarray, is_query: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))
        scaled = np.where(is_query[:, None], x * (self.largest / norm)[:, None], x)
        extra = np.where(is_query, 0.0, np.sqrt(np.maximum(self.largest**2 - norm**2, 0)))
        return np.hstack([scaled, extra[:, None]]) @ self.axes

    def keys(self, projected: np.ndarray, bits: int) -> np.ndarray:
        """Hilbert keys (rows x curves) of coordinates scaled to half the cube and shifted within it."""
        unit = np.clip((projected - self.low) / self.span, 0, 1) / 2 + self.shift / 2
        cell = np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)
        return np.stack([hilbert_key(cell[:, c * self.d : (c + 1) * self.d], bits) for c in range(self.curves)], axis=1)


def _fit(points: DataFrame, dim: int, largest: float, curves: int, directions: int, seed: int) -> Curves:
    """Scales from the mean and deviation of every direction over all vectors."""
    model = Curves(dim, largest, curves, directions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, curves * directions)), 0
        for batch in batches:
            y = model.project(_matrix(batch, "x", dim), np.zeros(batch.num_rows, dtype=bool))
            total, n = total + np.stack([y.sum(axis=0), (y * y).sum(axis=0)]), n + len(y)
        yield table({"i": (np.arange(curves * directions), pa.int32()), "n": (np.full(curves * directions, n), pa.int64()), "s": (total[0], pa.float64()), "q": (total[1], pa.float64())})

    sums = points.select("x").mapInArrow(run, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    for r in sums.collect():  # curves x directions rows
        mean = r["s"] / max(r["n"], 1)
        spread = max(r["q"] / max(r["n"], 1) - mean * mean, 1e-18) ** 0.5
        model.low[r["i"]], model.span[r["i"]] = mean - 3 * spread, 6 * spread
    return model


def _largest(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of largest score of every query of ``scores(query, found, score)``."""
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return scores.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= k).drop("turn")


def _round(points: DataFrame, both: DataFrame, model: Curves, dim: int, k: int, block: int, bits: int) -> DataFrame:
    """(query, found, score): the best of every query's own and neighbouring blocks of all curves of ``model``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = model.keys(model.project(_matrix(batch, "x", dim), column(batch, "is_query").to_numpy(zero_copy_only=False)), bits)
            for c in range(model.curves):
                yield table({"curve": (np.full(batch.num_rows, c, dtype=np.int32), pa.int32()), "key": (key[:, c].copy(), pa.int64()), "point": (column(batch, "point"), None), "is_query": (column(batch, "is_query"), None)})

    keyed = both.mapInArrow(place, "curve int, key long, point long, is_query boolean")
    order = ["curve", "key", "point", "is_query"]
    line = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "curves")
    # rank on the curve: rows of the curve in earlier partitions, and the place within the partition
    part = F.shiftright("at", 33)
    sizes = line.groupBy("curve", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("head"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("curve")))
    starts = starts.select(F.col("curve").alias("c"), F.col("part").alias("p"), "head", "start", "total")  # a row per partition and curve
    ranked = line.withColumn("part", part).join(starts.hint("shuffle_hash"), (F.col("curve") == F.col("c")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("start") + F.col("at") - F.col("head"))
    # as many blocks as make them about equal; 1 at least
    ranked = ranked.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("total") / block)).cast("int"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") * F.col("blocks") / F.col("total")).cast("int"))
    near = F.filter(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1), lambda b: (b >= 0) & (b < F.col("blocks")))
    visits = F.when(F.col("is_query"), near).otherwise(F.array("block"))
    single = points.select("point", F.col("x").cast("array<float>").alias("x"))
    group = ["curve", "block"]
    dealt = ranked.select("point", "curve", "is_query", F.explode(visits).alias("block")).join(single.hint("merge"), "point")
    dealt = dealt.select(*group, "is_query", "point", "x").repartition(*group).sortWithinPartitions(*group, "is_query")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, rows = None, [], []  # the block's vectors come first, then its queries stream by
        for batch in batches:
            where = np.stack([column(batch, g).to_numpy() for g in group])
            query = column(batch, "is_query").to_numpy(zero_copy_only=False)
            point, vector = column(batch, "point").to_numpy(), _matrix(batch, "x", dim, np.float32)
            edges = np.flatnonzero(np.any(np.diff(where, axis=1), axis=0) | np.diff(query)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                key = tuple(where[:, a].tolist())
                if key != here:
                    here, ids, rows = key, [], []
                if not query[a]:
                    ids.append(point[a:b])
                    rows.append(vector[a:b])
                    continue
                if not ids:
                    continue
                names, matrix = np.concatenate(ids), np.concatenate(rows)
                ids, rows = [names], [matrix]
                for s in range(a, b, 256):
                    score = vector[s : min(s + 256, b)] @ matrix.T
                    take = min(k + 1 + MARGIN, len(names))
                    # the take largest, ties by id
                    least = np.partition(score, len(names) - take, axis=1)[:, len(names) - take]
                    q, n = np.nonzero(score >= least[:, None])
                    top = np.lexsort((names[n], -score[q, n], q))
                    q, n = q[top], n[top]
                    turn = np.arange(len(q)) - np.searchsorted(q, q)
                    q, n = q[turn < take], n[turn < take]
                    yield table({"query": (point[s + q], pa.int64()), "found": (names[n], pa.int64()), "score": (score[q, n].astype(np.float64), pa.float64())})

    found = dealt.mapInArrow(best, "query long, found long, score double").groupBy("query", "found").agg(F.max("score").alias("score"))
    return _largest(found, k + 1 + MARGIN)


def _neighbours(points: DataFrame, asking: DataFrame, dim: int, k: int, measured: int) -> DataFrame:
    """(query, found): the ``k`` nearest other points of at most ``measured`` queries, by comparison with all points."""
    drawn = asking.orderBy(F.xxhash64("point"), "point").limit(measured).collect()  # a bounded number of vectors
    names = np.array([r["point"] for r in drawn], dtype=np.int64)
    vectors = np.array([r["x"] for r in drawn], dtype=np.float64).reshape(len(drawn), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, found = np.full((len(names), k), -np.inf), np.full((len(names), k), -1, dtype=np.int64)
        for batch in batches:
            point = column(batch, "point").to_numpy()
            product = vectors @ _matrix(batch, "x", dim).T
            product[names[:, None] == point] = -np.inf  # not itself
            score, found = np.hstack([score, product]), np.hstack([found, np.broadcast_to(point, product.shape)])
            keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, found = np.take_along_axis(score, keep, axis=1), np.take_along_axis(found, keep, axis=1)
        q, n = np.nonzero(score > -np.inf)
        yield table({"query": (names[q], pa.int64()), "found": (found[q, n], pa.int64()), "score": (score[q, n], pa.float64())})

    return _largest(points.select("point", "x").mapInArrow(run, "query long, found long, score double"), k).select("query", "found")


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, curves: int = CURVES, block: int = BLOCK, directions: int = DIRECTIONS, bits: int = BITS, seed: int = 11, recall: float = RECALL, measured: int = MEASURED) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors(vec_id, embedding)``; queries: ids divisible by ``query_every``."""
    x = F.col("x")
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    )
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    valid = valid.where(norm < float("inf"))
    facts = valid.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, largest = (facts["dim"], facts["largest"]) if facts else (1, 1.0)
    valid = valid.where(F.size("x") == dim)
    directions = min(directions, dim + 1)
    # equal vectors: the k + 1 smallest ids stand for all; the partial limit runs before the shuffle
    members = valid.distinct().withColumn("turn", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("turn") <= k + 1)
    members = staged(members.withColumn("point", F.min("vec_id").over(Window.partitionBy("x"))), "members")
    points = members.where("turn = 1").select("point", "x")
    asked = staged(valid.where(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), "x").distinct().join(points.hint("merge"), "x").select("query_id", "point"), "queries")
    asking = staged(points.join(asked.select("point").distinct().hint("merge"), "point"), "asking")
    both = points.withColumn("is_query", F.lit(False)).union(asking.withColumn("is_query", F.lit(True)))
    found, truth, rounds = None, None, 0
    while True:
        longer = min(block << rounds, max(block, LONGEST))
        model = _fit(points, dim, largest, curves, directions, seed + rounds)
        now = staged(_round(points, both, model, dim, k, longer, bits), "round")
        found = now if found is None else staged(_largest(found.union(now).groupBy("query", "found").agg(F.max("score").alias("score")), k + 1 + MARGIN), "merged")
        rounds += 1
        if recall <= 0 or not facts or facts["n"] <= longer:  # then all are in two blocks at most
            break
        if truth is None:
            truth = staged(_neighbours(points, asking, dim, k, measured), "measured")
        # at most k rows of each measured query
        if found.join(F.broadcast(truth), ["query", "found"]).count() >= recall * truth.count():
            break
    exact = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pair = found.select("query", "found").join(points.select(F.col("point").alias("query"), "x").hint("merge"), "query").join(points.select(F.col("point").alias("found"), F.col("x").alias("y")).hint("merge"), "found")
    found = staged(pair.select("query", "found", exact.alias("score")), "found")
    named = found.join(members.select(F.col("point").alias("found"), "vec_id").hint("merge"), "found")
    answer = asked.join(named.withColumnRenamed("query", "point").hint("merge"), "point").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answer.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))
