"""Conversation prefix trie: ROLLUP over positional turn-id columns, in blocks of ``WIDTH`` positions.

A conversation's turns are numbered from 0 and named by a 64-bit hash of role and text.  ``WIDTH`` consecutive names make
the columns ``t0, t1, ...`` of a block; one ``GROUP BY block, key, ROLLUP (t0, t1, ...)`` aggregates all prefixes that end
in a block together, and ``grouping_id`` tells how long a prefix is.  A long conversation goes on in further blocks, keyed
by the node at which the block before ends, so one statement serves conversations of any length.  That node's name is the
exclusive-or of two 64-bit hashes of every block so far with its number, a running value that needs no loop over blocks.

What a node needs from its whole subtree comes from members, not from descendants, so that no row is made per pair of
node and ancestor.  Every node is *owned* by its smallest member; a conversation owns a suffix of its own path.  With the
conversation's bytes, the bytes of the nodes that it owns and whether it owns a leaf, a second ROLLUP sums over members:

    members' bytes below a node  = sum of their bytes - members x bytes in front of the node
    bytes of a subtree's nodes   = sum of what members own, with the owner's part counted from the node on

Digests of members that end at a node are made by one pass over sorted ids, joined into strings of bounded length first,
so that a node at which very many conversations end is streamed, never held.

Defined cases: rows without ``conv_id`` belong to no conversation; a null turn comes first; turns of equal number are
ordered by role and by the SHA-256 of their text; repeated rows are turns each; a null role or text is empty; texts of any
length enter as hash and size only; a conversation of any length is numbered over many tasks; an empty table gives no
rows; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read_table, staged, table

WIDTH = 8
#: blocks of a conversation that one task runs over; ids joined into one string
SEGMENT, JOINED = 1024, 4096

TURNS = [f"t{j}" for j in range(WIDTH)]
BYTES = [f"b{j}" for j in range(WIDTH)]
NODE = ["i1", "i2", "depth"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_id, n_bytes) for every row of ``conversations(conv_id, turn, role, text)``; place from 0, gapless.

    Rows are range-partitioned in their order; a row's place is its number within conversation and partition behind the
    conversation's rows of earlier partitions, so a conversation may be longer than a task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("by_text"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64(role, text).alias("turn_id"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "by_text", "row"]
    ranged = staged(slim.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    placed = ranged.withColumn("within", within).join(starts.hint("merge"), ["conv_id", "part"])
    return placed.select("conv_id", (F.col("start") + F.col("within")).cast("long").alias("place"), "turn_id", "n_bytes")


def branched(turns: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, place, turn_id, n_bytes), with a row of null place for every conversation: ``turns`` with shared beginnings.

    A conversation takes its first h turns from conversation ``conv_id - conv_id % step`` (all if it has fewer, none if
    there is no such), and goes on with its own from the h-th; h is crc32 of its decimal id, modulo ``most``.
    """
    h, base = F.crc32(F.col("conv_id").cast("string")) % most, F.col("conv_id") - F.col("conv_id") % step
    sizes = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    wants = sizes.select("conv_id", base.alias("base"), h.alias("h"))
    heads = turns.where(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "place", "turn_id", "n_bytes")
    taken = wants.join(heads.hint("merge"), "base").where("place < h").select("conv_id", "place", "turn_id", "n_bytes")
    given = wants.join(sizes.select(F.col("conv_id").alias("base"), "n").hint("merge"), "base", "left").select("conv_id", (F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.where(F.col("place") >= h).join(staged(given, "shifts").hint("merge"), "conv_id").select("conv_id", (F.col("place") + F.col("shift")).cast("long").alias("place"), "turn_id", "n_bytes")
    none = F.lit(None).cast("long")
    return taken.union(own).union(sizes.select("conv_id", none, none, none))


def _names(level: Column, held: list[Column]) -> list[Column]:
    """What a node's name adds to its block's key: two hashes of the block's number and the first ``level`` turns."""
    turns = [F.when(level > j, t) for j, t in enumerate(held)]
    return [F.xxhash64(F.lit(seed), F.col("block"), level, *turns) for seed in (1, 2)]


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, k1, k2, t0.., b0.., before, n, total): a row per conversation and block of ``WIDTH`` places.

    ``turns`` has a row of null place for every conversation, so that those without turns have a block too.  ``before``:
    bytes of the blocks in front; n and total: turns and bytes of the whole conversation.
    """
    j = F.col("place") % WIDTH
    cells = [F.max(F.when(j == i, F.col(c))).alias(f"{k}{i}") for k, c in (("t", "turn_id"), ("b", "n_bytes")) for i in range(WIDTH)]
    held = turns.groupBy("conv_id", F.coalesce(F.floor(F.col("place") / WIDTH), F.lit(0)).alias("block")).agg(*cells)
    sizes = turns.groupBy("conv_id").agg(F.count("place").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("total"))
    n_bytes = sum((F.coalesce(b, F.lit(0)) for b in BYTES), F.lit(0))
    h1, h2 = _names(F.lit(WIDTH), [F.col(t) for t in TURNS])
    held = held.withColumns({"segment": F.floor(F.col("block") / SEGMENT), "h1": h1, "h2": h2, "n_bytes": n_bytes})
    front = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda a, b, c, w: [F.coalesce(F.bit_xor(a).over(w), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor(b).over(w), F.lit(0)).alias("x2"), F.coalesce(F.sum(c).over(w), F.lit(0)).alias("x3")]
    within = held.select("*", *running("h1", "h2", "n_bytes", front(Window.partitionBy("conv_id", "segment").orderBy("block"))))
    segments = held.groupBy("conv_id", "segment").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"), F.sum("n_bytes").alias("s3"))
    across = segments.select("conv_id", "segment", *[c.alias(f"y{i + 1}") for i, c in enumerate(running("s1", "s2", "s3", front(Window.partitionBy("conv_id").orderBy("segment"))))])
    whole = within.join(across.hint("merge"), ["conv_id", "segment"]).join(sizes.hint("merge"), "conv_id")
    return whole.select("conv_id", "block", F.col("x1").bitwiseXOR(F.col("y1")).alias("k1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("k2"), *TURNS, *BYTES, (F.col("x3") + F.col("y3")).alias("before"), "n", "total")


def rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """Every prefix of ``rows`` (blocks) once, with its name, its parent's name, level, depth and ``aggregates``."""
    all_turns = ", ".join(TURNS)
    prefixes = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {all_turns}, cast({WIDTH} - bit_count(grouping_id()) AS int) AS level, {aggregates} FROM {{rows}} GROUP BY block, k1, k2, ROLLUP ({all_turns})",
        rows=rows,
    )
    # a prefix longer than its conversation has a gap; a block's empty prefix is the block before's last node
    filled = sum((F.col(t).isNotNull().cast("int") for t in TURNS), F.lit(0))
    real = prefixes.where((F.col("level") == filled) & ((F.col("level") > 0) | (F.col("block") == 0)))
    return real.select("*", *_keys(F.col("level"), ("i1", "i2")), *_keys(F.col("level") - 1, ("p1", "p2")), (F.col("block") * WIDTH + F.col("level")).cast("long").alias("depth"))


def _keys(level: Column, names: tuple[str, str]) -> list[Column]:
    added = _names(level, [F.col(t) for t in TURNS])
    return [F.when(level > 0, F.col(k).bitwiseXOR(h)).when(level == 0, F.col(k)).alias(name) for k, h, name in zip(("k1", "k2"), added, names)]


def end_digests(held: DataFrame) -> DataFrame:
    """(i1, i2, depth, ends_sha256): SHA-256 of the ascending ids of the conversations that end at a node, comma-joined."""
    last = held.where(F.col("block") == F.greatest(F.lit(0), F.floor((F.col("n") - 1) / WIDTH)))
    level = F.when(F.col("n") > 0, (F.col("n") - 1) % WIDTH + 1).otherwise(0).cast("int")
    ends = last.select(*_keys(level, ("i1", "i2")), F.col("n").alias("depth"), "conv_id")
    shape = "i1 long, i2 long, depth long"

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        keys = np.stack([column(batch, c).to_numpy() for c in NODE])
        return np.append(np.flatnonzero(np.any(np.diff(keys, prepend=keys[:, :1] - 1), axis=0)), batch.num_rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = runs(batch)
            bounds = np.unique(np.concatenate([bounds, *(np.arange(a, b, JOINED) for a, b in zip(bounds[:-1], bounds[1:]))]))
            ids = column(batch, "conv_id").to_pylist()
            head = batch.take(pa.array(bounds[:-1]))
            joined = [",".join(map(str, ids[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
            yield table({**{c: (column(head, c), None) for c in NODE}, "first": (column(head, "conv_id"), None), "ids": (joined, pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        done = lambda: table({**{c: ([v], pa.int64()) for c, v in zip(NODE, node)}, "ends_sha256": ([sha.hexdigest()], pa.string())})
        for batch in batches:
            for *key, ids in zip(*(column(batch, c).to_pylist() for c in (*NODE, "ids"))):
                if key != node:
                    if node:
                        yield done()
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if node:
            yield done()

    parts = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, shape + ", first long, ids string")
    return staged(parts, "joined-ends").repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, shape + ", ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every prefix of
    ``turns(conv_id, place, turn_id, n_bytes)``, which has a row of null place for every conversation."""
    held = staged(blocks(turns), "blocks")
    nodes = rolled(held, "min(conv_id) AS conv_id, count(*) AS n_convs").select(*NODE, "p1", "p2", "block", "level", "conv_id", "n_convs")
    front = sum((F.when(F.col("level") > j + 1, F.coalesce(b, F.lit(0))).otherwise(0) for j, b in enumerate(BYTES)), F.col("before"))
    owners = held.select("conv_id", "block", "before", *BYTES, "total")
    nodes = staged(nodes.join(owners.hint("merge"), ["conv_id", "block"]).withColumn("front", front).drop("block", "before", *BYTES), "nodes")

    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("i1"), F.col("p2").alias("i2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(kids.hint("merge"), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-with-children")
    parents = nodes.where("n_children > 0").select(F.col("i1").alias("p1"), F.col("i2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    placed = staged(nodes.join(parents.hint("merge"), ["p1", "p2", "depth"], "left").drop("p1", "p2"), "placed")

    owns = nodes.groupBy("conv_id").agg((F.first("total") - F.min_by("front", "depth")).alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    members = held.select("conv_id", "block", "k1", "k2", *TURNS, "total").join(staged(owns, "owned").hint("merge"), "conv_id", "left")
    sums = rolled(members, "sum(total) AS totals, coalesce(sum(owned), 0) AS owned, coalesce(sum(leaf), 0) AS n_leaves, min_by(coalesce(owned, 0), conv_id) AS by_owner").select(*NODE, "totals", "owned", "n_leaves", "by_owner")
    whole = placed.join(sums.hint("merge"), NODE).join(end_digests(held).hint("merge"), NODE, "left")
    of_members = F.col("totals") - F.col("n_convs") * F.col("front")
    of_nodes = F.col("owned") - F.col("by_owner") + F.col("total") - F.col("front")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"),
        (of_members - of_nodes).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are."""
    turns = staged(numbered(conversations), "numbered")
    none = F.lit(None).cast("long")
    return trie(turns.union(turns.select("conv_id").distinct().select("conv_id", none, none, none)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(numbered(read_table(spark, sf_dir, "conversations")), "numbered")
    return trie(staged(branched(turns), "branched"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"

SQL = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS place
               FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM turns GROUP BY conv_id),
wants AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor({_CRC}, 4294967295) % 9 AS h FROM sizes),
convs AS (SELECT w.conv_id, w.base, w.h, least(w.h, coalesce(b.n, 0)) AS given FROM wants w LEFT JOIN sizes b ON b.conv_id = w.base),
rebuilt AS (SELECT c.conv_id, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
            UNION ALL SELECT c.conv_id, place - h + given, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
prefixes AS (SELECT conv_id, place + 1 AS depth, strlen(text) AS n_bytes,
                    string_agg(md5(role) || md5(text), '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt
             UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ends AS (SELECT conv_id, max(depth) AS last FROM prefixes GROUP BY conv_id),
nodes AS (SELECT depth, path, min(conv_id) AS owner, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
          FROM prefixes JOIN ends USING (conv_id) GROUP BY depth, path),
children AS (SELECT p.depth, p.path, count(c.path) AS n_children, any_value(p.owner) AS owner, any_value(p.n_convs) AS n_convs, any_value(p.n_bytes) AS n_bytes, any_value(p.ends_sha256) AS ends_sha256
             FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND left(c.path, 64 * p.depth) = p.path GROUP BY p.depth, p.path),
below AS (SELECT a.depth, a.path, sum((d.n_convs - 1) * d.n_bytes) AS saved_tokens, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves
          FROM children a JOIN children d ON d.depth >= a.depth AND left(d.path, 64 * a.depth) = a.path GROUP BY a.depth, a.path)
SELECT n.owner AS conv_id, n.depth, p.owner AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM children n JOIN below USING (depth, path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))
"""
