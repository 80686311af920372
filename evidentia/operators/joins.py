"""Join shapes that Spark has no operator for, and thin forms of those that it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import if_small, settled, top
from .fold import first_free


def full_by_id(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join that says which side a row came from."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), on, "full")
    return j.withColumn("side", F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")).drop("_a", "_b")


def missing(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` without a partner in ``b``."""
    return a.join(b, on, "left_anti")


def interval_join(a: DataFrame, b: DataFrame, on: list[str], bucket: int = 512) -> DataFrame:
    """Pairs of overlapping half-open intervals ``(start, end)``; ``b``'s columns come as ``b_start``, ``b_end`` and so on.

    Both sides are dealt over the buckets that they touch and joined on them, so a long document is many small joins;
    of the buckets that a pair shares, the first keeps it.  Both sides come from explode, whose size Spark cannot tell: sort-merge.
    """
    touch = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bucket)))
    right = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on]).withColumn("_bucket", touch("b_start", "b_end"))
    left = a.withColumn("_bucket", touch("start", "end"))
    overlap = (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start"))
    first = F.col("_bucket") == F.floor(F.greatest(F.col("start"), F.col("b_start")) / bucket)
    return left.join(right.hint("merge"), [*on, "_bucket"]).where(overlap & first).drop("_bucket")


def innermost(points: DataFrame, spans: DataFrame, on: list[str], point: str = "at", bucket: int = 512) -> DataFrame:
    """For each point (``id``, ``at``) the smallest span around it: shortest, then first, then smallest id."""
    as_spans = points.withColumns({"start": F.col(point), "end": F.col(point) + 1})
    inside = interval_join(as_spans, spans, on, bucket)
    return top(inside.withColumn("size", F.col("b_end") - F.col("b_start")), [*on, "id"], ["size", "b_start", "b_id"], 1, "_r").drop("_r", "start", "end", "size")


def asof(facts: DataFrame, instants: DataFrame, on: list[str], at: str, as_of: str, id_: str) -> DataFrame:
    """Latest fact at or before each instant, by union and a running last value: one shuffle on the key."""
    both = facts.select(*on, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.col(id_).alias("_fact"), F.lit(None).cast("long").alias("instant_id")).unionByName(
        instants.select(*on, F.col(as_of).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_fact"), F.col("instant_id").cast("long"))
    )
    order = Window.partitionBy(*on).orderBy("_t", "_kind", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("fact", F.last("_fact", ignorenulls=True).over(order)).where("_kind = 1").select(*on, "instant_id", F.col("_t").alias(as_of), "fact")


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return top(df, key, [F.desc(c) for c in order], 1, "_r").drop("_r")


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs with a small, counted side."""
    return a.crossJoin(if_small(b))


def greedy_match(pairs: DataFrame, case: str = "case_id", **sizes) -> DataFrame:
    """One-to-one matches in order: a pair of ``(case_id, left, right, turn)`` is kept if both sides are known and still free."""
    known = pairs.where("left is not null and right is not null").select(case, *[F.col(c).cast("long").alias(c) for c in ("left", "right", "turn")])
    late = known.withColumn("late", F.col("turn").isNull())
    return first_free(late, case, ("left", "right"), ["late", "turn", "left", "right"], **sizes).select(case, "left", "right", "turn")


def fixpoint(start: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, last, depth, cycle): where each origin's chain of ``edges(a, b)`` ends; one successor a node.

    Pointers are doubled (a node's pointer becomes its pointer's pointer), so rounds grow with the logarithm of the
    longest chain, until no more nodes reach an end.  What then has none runs into a cycle: ``last`` and ``depth`` are null.
    With a ``max_depth``, chains are walked so many steps at most, ``last`` is the node reached and a cycle's last new one.
    """
    if max_depth is not None:
        return _walked(start, edges, max_depth)
    step = edges.groupBy("a").agg(F.min("b").alias("b")).where("b is not null")
    ends = step.select(F.col("a").alias("b"), F.lit(True).alias("goes_on"))
    at = settled(step.join(ends.hint("merge"), "b", "left").select("a", "b", F.lit(1).cast("long").alias("n"), F.coalesce("goes_on", F.lit(False)).alias("open")))
    left = at.where("open").count()
    while left:
        further = at.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"), F.col("open").alias("goes_on"))
        moved = at.where("open").join(further, "b").select("a", F.col("c").alias("b"), (F.col("n") + F.col("m")).alias("n"), F.col("goes_on").alias("open"))
        at = settled(at.where("not open").unionByName(moved))
        before, left = left, at.where("open").count()
        if left == before:  # a longer chain would have nodes that end in this round
            break
    found = start.join(at.withColumnRenamed("a", "origin"), "origin", "left")
    cycle = F.coalesce("open", F.lit(False))
    return found.select("origin", F.when(~cycle, F.coalesce("b", "origin")).alias("last"), F.when(~cycle, F.coalesce("n", F.lit(0).cast("long"))).alias("depth"), cycle.alias("cycle"))


def _walked(start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Each step is a join; rows leave as their chain ends, so the frontier shrinks.  A visited node ends a chain as a cycle."""
    frontier = start.select("origin", F.col("origin").alias("last"), F.array("origin").alias("path"))
    done = None
    step = edges.groupBy("a").agg(F.min("b").alias("b"))
    for depth in range(max_depth + 1):
        joined = frontier.join(step, frontier["last"] == step["a"], "left")
        again = F.array_contains("path", F.col("b"))
        stop = joined.where(F.col("b").isNull() | again).select("origin", "last", F.lit(depth).alias("depth"), F.coalesce(again, F.lit(False)).alias("cycle"))
        done = stop if done is None else done.unionByName(stop)
        if depth == max_depth:
            open_ = joined.where(F.col("b").isNotNull() & ~again).select("origin", "last", F.lit(depth).alias("depth"), F.lit(False).alias("cycle"))
            return done.unionByName(open_)
        frontier = joined.where(F.col("b").isNotNull() & ~again).select("origin", F.col("b").alias("last"), F.concat("path", F.array("b")).alias("path"))
    return done
