"""Sharding by a hierarchical weighted hash tree (free style; built-in functions only).

A row descends region -> rack -> shard.  At each level every child draws ``-ln(u) / weight`` from a hash of the row's
key and the child's name, and the smallest draw wins, so a child gets rows in proportion to its weight and a change of
weight moves rows only into (growth) or out of (shrinkage) the subtree whose weight changed.

A shard added later opens a region of its own with its own weight.  Its siblings' draws stay as they were at every
level, so it takes rows and no row moves between old shards: the ``key`` law.

Defined cases: null text has 0 bytes; null ids draw as the word ``null``; repeated rows get a slot each; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged, with_group_rank

#: shards of a rack, racks of a region
FANOUT = (5, 4)


def layout(shards: int, planned: int = 40) -> dict[str, dict[str, list[int]]]:
    """Tree of shard numbers: the planned ones fill regions and racks, each later one is a region of its own."""
    tree: dict[str, dict[str, list[int]]] = {}
    per_region = FANOUT[0] * FANOUT[1]
    for s in range(shards):
        region, rack = (f"r{s // per_region}", f"k{s // FANOUT[0]}") if s < planned else (f"g{s}", f"k{s}")
        tree.setdefault(region, {}).setdefault(rack, []).append(s)
    return tree


def draw(key: Column, name: Column, weight: Column) -> Column:
    """Exponential draw of a child: smaller for heavier children; 48 bits of an MD5 make the uniform number."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, name).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / weight


def descend(key: Column, tree: dict[str, dict[str, list[int]]], weights: dict[int, float] | None = None) -> Column:
    """Shard number of each row.  ``weights``: of shards, 1 where missing; a subtree weighs the sum of its shards."""
    levels: list[dict[str, list[tuple[str, float]]]] = [{}, {}, {}]
    numbers: dict[str, int] = {}
    for region, racks in tree.items():
        for rack, members in racks.items():
            own = [(f"{region}/{rack}/s{s}", (weights or {}).get(s, 1.0)) for s in members]
            numbers.update(zip((path for path, _ in own), members))
            levels[2][f"{region}/{rack}"] = own
            levels[1].setdefault(region, []).append((f"{region}/{rack}", sum(w for _, w in own)))
        levels[0].setdefault("", []).append((region, sum(w for _, w in levels[1][region])))
    at = F.lit("")
    for level in levels:
        entries = [x for parent, kids in level.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(float(w)).alias("w")) for p, w in kids]))]
        children = F.element_at(F.create_map(*entries), at)
        at = F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["p"], c["w"]).alias("d"), c["p"].alias("p"))))["p"]
    return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), at)


def shard(docs: DataFrame, shards: int = 40, grown: int | None = 41, planned: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs(doc_id, text)``."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, layout(shards, planned)).cast("int").alias("shard"),
        (descend(key, layout(grown, planned)) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    ranked = with_group_rank(staged(placed, "shards"), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"), shards=40, grown=41)
