"""Greedy choices whose state decides every row: ordered folds of each key, and forms that never read a whole key in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_reason, settled

#: tasks over which the rows of one key and size are dealt
SALTS = 64


def fold(df: DataFrame, key: str, order: list[Column | str], fresh: Callable[[], object], step: Callable[[object, dict], tuple], out: str) -> DataFrame:
    """``step(state, row)`` on every row of a key in order; ``out`` names and types what it returns, as a DDL string.

    A key's rows pass through one task in sorted order and only the state is held; ``df`` should have no more columns than
    the step reads, and no key of more rows than a task should see.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at, state = none, None
        for batch in batches:
            decided = []
            for row in batch.to_pylist():
                if at is none or row[key] != at:
                    at, state = row[key], fresh()
                decided.append(step(state, row))
            values = zip(*decided) if decided else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(v, t) for v, t in zip(values, types)]], names=[key, *names])

    spark = df.sparkSession
    wanted = spark.createDataFrame([], out)
    names, types = wanted.columns, [c.type for c in wanted.toArrow().schema]
    ordered = df.repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {out}")


def skip_ahead(rows: DataFrame, key: str, order: list[str], room: str = "room", limit: int | None = None, unsized: str = "admitted") -> DataFrame:
    """``rows (key, *order, size, room)`` with a ``reason``: in ``order``, a row that fits what is left of its key's room is
    ``admitted``; one that does not is passed over (``budget``) and later ones may enter; behind ``limit`` admitted rows all
    are ``limit``.  One of unknown size takes and counts nothing, and is ``unsized`` (but for the limit).

    Of rows of one key and one size, those admitted are the first so many: what is left only shrinks.  There can be at most
    ``room / size`` of them, so only so many first rows of each size are folded; all others are decided wholesale.  Their
    numbers are taken over ``SALTS`` parts first, so no task reads all rows of a key, nor of a key and a size; the fold sees
    at most the sum of ``room / size`` over a key's sizes, whatever the key's rows.  ``order`` are ascending columns; rows equal
    in all of them and in size are interchangeable.  Sizes are lengths, never below zero.
    """
    full = F.lit(limit if limit is not None else 0)
    most = F.when(F.col("size").isNull() | (F.col(room) < 0), 0).when(F.col("size") == 0, full).otherwise(F.floor(F.col(room) / F.col("size")))
    most = F.least(most, F.lit(limit)) if limit is not None else most
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= most
    first = settled(dealt.withColumn("_open", nth(key, "size", "_salt"))).drop("_salt")
    second = settled(first.where("_open").withColumn("_open", nth(key, "size")))
    kept = [key, *dict.fromkeys([*order, "size", *rows.columns])]
    rest = first.where("not _open").unionByName(second.where("not _open")).select(*dict.fromkeys(kept))

    columns = list(dict.fromkeys([c for c in kept if c != key]))
    schema = rows.select(*columns).schema

    def step(state: list, r: dict) -> tuple:
        used, n = state
        if limit is not None and n >= limit:
            reason = "limit"
        elif used + r["size"] > r[room]:
            reason = "budget"
        else:
            reason, state[:] = "admitted", [used + r["size"], n + 1]
        return *(r[c] for c in columns), reason

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", reason string"
    decided = settled(fold(second.where("_open").select(*dict.fromkeys(kept)), key, order, lambda: [0, 0], step, out))
    sized = F.when(F.col("size").isNull(), unsized).when((F.col("size") == 0) & (F.col(room) >= 0), "admitted").otherwise("budget")
    if limit is None:
        return decided.unionByName(rest.withColumn("reason", sized))
    place = F.struct(*order)
    ends = decided.where("reason = 'admitted'").groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(place).alias("_last")).where(F.col("_n") >= limit)
    ends = ends.select(F.col(key).alias("_key"), "_last")
    ended = rest.join(ends.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return decided.unionByName(ended.withColumn("reason", first_reason((F.lit(limit == 0) | (place >= F.col("_last")), "limit"), otherwise=None)).withColumn("reason", F.coalesce("reason", sized)).drop("_last"))


def first_free(pairs: DataFrame, key: str, sides: tuple[str, str], order: list[str], block: int = 100_000, rate: float = 0.1) -> DataFrame:
    """The ``pairs`` of a key kept one by one in ``order`` if neither of their ``sides`` stands in an earlier kept pair.

    Keys of at most ``block`` pairs are folded.  In larger ones, all pairs that come first at both their sides are kept in one
    round, and pairs that share a side with them go; both are what the fold would do, in any order of the rounds.  Rounds go on
    while each settles at least ``rate`` of what is open.  If fewer do (each pair waiting for the one before), the open pairs
    are folded ``block`` at a time, behind joins that take away those whose sides are taken.  So no task holds a larger key's
    pairs or sides.  ``pairs`` has exactly key, sides and order columns; equal rows count once.
    """
    left, right = sides
    columns = [key, left, right, *[c for c in order if c not in sides]]
    pairs = settled(pairs.select(*columns).distinct())
    sizes = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > block).select(F.col(key).alias("_key"))
    is_large = F.col(key).eqNullSafe(F.col("_key"))

    def step(taken: tuple, r: dict) -> tuple:
        lefts, rights = taken
        free = r[left] not in lefts and r[right] not in rights
        if free:
            lefts.add(r[left])
            rights.add(r[right])
        return *(r[c] for c in columns[1:]), free

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name != key) + ", free boolean"
    folded = lambda df: fold(df, key, order, lambda: (set(), set()), step, out).where("free").drop("free")
    if not large.limit(1).count():
        return folded(pairs)
    kept = folded(pairs.join(large.hint("merge"), is_large, "left_anti"))
    open_ = settled(pairs.join(large.hint("merge"), is_large, "left_semi"))

    place = F.struct(*order)

    def without(df: DataFrame, taken: DataFrame) -> DataFrame:
        for side in sides:
            gone = taken.select(F.col(key).alias("_key"), F.col(side).alias("_side"))
            df = df.join(gone.hint("merge"), is_large & F.col(side).eqNullSafe(F.col("_side")), "left_anti")
        return df

    n = open_.count()
    while n:
        first = open_.select(*columns, place.alias("_place"))
        for side in sides:  # minima are combined before they are dealt by side
            least = settled(open_.groupBy(F.col(key).alias("_key"), F.col(side).alias("_side")).agg(F.min(place).alias("_least")))
            first = first.join(least.hint("merge"), is_large & F.col(side).eqNullSafe(F.col("_side")) & (F.col("_place") == F.col("_least"))).drop("_key", "_side", "_least")
        first = settled(first.select(*columns))
        kept = kept.unionByName(first)
        open_ = settled(without(open_, first))
        before, n = n, open_.count()
        if n > (1 - rate) * before:
            break
    if not n:
        return kept
    # what is left waits in long chains: blocks of consecutive pairs, one after the other
    ranged = settled(open_.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), start.alias("_start"))
    nth = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_nth", nth).join(starts.hint("merge"), is_large & (F.col("_part") == F.col("_p")))
    numbered = settled(numbered.withColumn("_block", F.floor((F.col("_start") + F.col("_nth")) / block)).select(*columns, "_block"))
    taken = None
    for i in range(numbered.agg(F.max("_block")).first()[0] + 1):
        rows = numbered.where(F.col("_block") == i).select(*columns)
        new = settled(folded(rows if taken is None else without(rows, taken)))
        taken = new if taken is None else taken.unionByName(new)
    return kept.unionByName(taken)
