"""Similar sets by prefix filtering: sets meet at their rarest elements only, so common elements join nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import settled


def similar_sets(a: DataFrame, b: DataFrame, least: float, ordered: bool = False) -> DataFrame:
    """(left_id, right_id, shared, left_size, right_size): pairs of sets ``(id, element)`` whose Jaccard is at least ``least`` (above 0).

    ``ordered``: a and b are one table, and each pair comes once, the smaller id left.  Elements are ordered by how many sets have
    them.  Two sets of n and m elements with that similarity share one of the rarest ``n - ceil(least n) + 1`` of the first and
    ``m - ceil(least m) + 1`` of the second; a pair that meets there is kept only if sizes, and what is left behind the places where
    it meets, allow the similarity.  Candidates, each once, are counted on their whole sets.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    a = settled(a.select("id", "element").where("element is not null").distinct())
    b = a if ordered else settled(b.select("id", "element").where("element is not null").distinct())
    both = a if ordered else a.unionByName(b)
    rarity = settled(both.groupBy("element").agg(F.count(F.lit(1)).alias("sets")))
    slack = 1e-9  # a product just above a whole number is that number

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy("id").orderBy("sets", "element")
        placed = df.join(rarity.hint("merge"), "element").withColumn("at", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
        kept = placed.where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - slack) + 1)
        return kept.select(F.col("id").alias(f"{side}_id"), "element", F.col("at").alias(f"{side}_at"), F.col("n").alias(f"{side}_size"))

    left = settled(prefixes(a, "left"))
    right = left.toDF("right_id", "element", "right_at", "right_size") if ordered else settled(prefixes(b, "right"))
    n, m = F.col("left_size"), F.col("right_size")
    need = F.ceil(least / (1 + least) * (n + m) - slack)
    rest = 1 + F.least(n - F.col("left_at"), m - F.col("right_at"))
    met = left.join(right.hint("merge"), "element").where((m + slack >= least * n) & (n + slack >= least * m))
    if ordered:
        met = met.where("left_id < right_id")
    # a pair first meets at its rarest shared element, which bounds what it shares
    pairs = settled(met.groupBy("left_id", "right_id", "left_size", "right_size").agg(F.max_by(rest, -F.col("left_at")).alias("rest")).where(F.col("rest") >= need).drop("rest"))
    own = pairs.join(a.select(F.col("id").alias("left_id"), "element").hint("merge"), "left_id")
    shared = own.join(b.select(F.col("id").alias("right_id"), "element").hint("merge"), ["right_id", "element"])
    counted = shared.groupBy("left_id", "right_id", "left_size", "right_size").agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(F.col("shared") + slack >= least * (n + m - F.col("shared"))).select("left_id", "right_id", "shared", "left_size", "right_size")
