"""The prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("evidentia.llm")

from evidentia.llm import prefix_trie as p  # noqa: E402
from evidentia.llm.common import staged  # noqa: E402

RNG = random.Random(13)
TURN = "conv_id long, turn long, role string, text string, place string, block int, n string"


@pytest.fixture(scope="module")
def talks():
    """Shared beginnings, ties, nulls, repeated rows, a long conversation twice, copies, ids below zero."""
    rows = []
    opening = [("user", f"opening {i}") for i in range(3)] + [(None, None), ("user", "")]
    for c in [*range(-7, 60), 77, 100]:
        turns = [RNG.choice(opening) for _ in range(RNG.randrange(1, 4))] + [(RNG.choice(["user", "assistant"]), RNG.choice(["x", "yé", "日本" * 3])) for _ in range(RNG.randrange(0, 20))]
        rows += [(c, i if i or c % 2 else None, *t) for i, t in enumerate(turns)]
    long = [("user", f"t{i % 7}") for i in range(2500)]
    rows += [(c, i, *t) for c in (200, 201) for i, t in enumerate(long + [("user", f"end {c}")] * (c % 2))]
    rows += [(c, i, "user", f"same {i}") for c in range(300, 340) for i in range(9)]
    rows += [(50, 3, "a", "tie"), (50, 3, "b", "tie"), (50, 3, "a", "tie two"), (50, 3, "a", "tie"), (None, 1, "user", "no conversation")]
    return [r + ("s", 1, "n") for r in rows]


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in by.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = talks.get(base, [])[:h] + own[h:]
    return out


def brute(talks):
    # node names are numbers, so that a long conversation takes no square of its length
    child, members, ends, parent, size = {}, defaultdict(list), defaultdict(list), {0: None}, {0: 0}
    depth = {0: 0}
    for c in sorted(talks):
        node = 0
        members[0].append(c)
        for t in talks[c]:
            if (node, t) not in child:
                new = child[node, t] = len(parent)
                parent[new], size[new], depth[new] = node, len(t[1].encode()), depth[node] + 1
            node = child[node, t]
            members[node].append(c)
        ends[node].append(c)
    n_children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(parent, reverse=True):  # children have larger numbers
        leaves[node] += n_children[node] == 0
        saved[node] += (len(members[node]) - 1) * size[node]
        if node:
            n_children[parent[node]] += 1
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    if not talks:
        return []
    return sorted((members[n][0], depth[n], members[parent[n]][0] if n else -1, len(members[n]), n_children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in parent)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_trie_equals_brute_force(spark, talks, monkeypatch):
    monkeypatch.setattr(p, "SEGMENT", 16)
    monkeypatch.setattr(p, "JOINED", 7)
    frame = spark.createDataFrame(talks, TURN).repartition(3)
    assert result(p.prefix_trie(frame)) == brute(ordered(talks))


def test_rebuilt_conversations_equal_brute_force(spark, talks):
    frame = spark.createDataFrame(talks, TURN).repartition(3)
    turns = staged(p.branched(staged(p.numbered(frame), "numbered")), "branched")
    assert result(p.trie(turns)) == brute(rebuilt(ordered(talks)))


def test_a_conversation_longer_than_a_partition_is_numbered_in_order(spark):
    rows = [(1, i // 3, "u", f"{i % 3}") + ("s", 1, "n") for i in range(3000)] + [(1, None, "u", "first")] * 5 * 0 + [(2, 0, "u", "x", "s", 1, "n")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = p.numbered(spark.createDataFrame(rows, TURN).repartition(5)).where("conv_id = 1").orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.place for r in got] == list(range(3000))
    want = ordered(rows)[1]
    names = dict(spark.createDataFrame([(t,) for t in "012"], "t string").selectExpr("xxhash64('u', t)", "t").collect())
    assert [names[r.turn_id] for r in got] == [t for _, t in want]


def test_empty_table_and_conversations_without_turns(spark):
    assert p.prefix_trie(spark.createDataFrame([], TURN)).count() == 0
    none = spark.createDataFrame([(5, None, None, None), (9, None, None, None)], "conv_id long, place long, turn_id long, n_bytes long")
    assert result(p.trie(none)) == [(5, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"5,9").hexdigest())]


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(p.SQL)
    got = p.op13_prefix_trie(spark, "/root/testdata/sf0.01").select(want.columns)
    assert result(got) == sorted(tuple(-1 if v is None else v for v in r) for r in want.fetchall())
