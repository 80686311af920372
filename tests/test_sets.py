"""Similar sets against all pairs."""

import random

import pytest

from evidentia.operators import sets

DDL = "id long, element string"


def collection(seed, n, ids):
    draw = random.Random(seed)
    out = {}
    for i in range(n):
        base = {f"e{int(draw.paretovariate(0.6)) % 60}" for _ in range(draw.randrange(1, 25))}
        out[ids + i] = base if i % 5 else {"common", *list(base)[:2]}
        if i % 7 == 1:
            out[ids + i] = set(out[ids + i - 1]) ^ {f"x{i}"}
        if i % 11 == 2:
            out[ids + i] = set(out[ids + i - 1])
    return out


def rows(c):
    return [(i, e) for i, s in c.items() for e in s] * 2 + [(i, None) for i in list(c)[:3]]


@pytest.mark.parametrize("least", [0.1, 0.5, 0.8, 1.0])
def test_pairs_equal_brute_force(spark, least):
    a, b = collection(1, 60, 0), collection(2, 80, 40)
    jac = lambda x, y: len(x & y) >= least * len(x | y) - 1e-12
    frame = lambda c: spark.createDataFrame(rows(c), DDL).repartition(3)
    got = sets.similar_sets(frame(a), frame(b), least)
    assert sorted(map(tuple, got.collect())) == sorted((i, j, len(x & y), len(x), len(y)) for i, x in a.items() for j, y in b.items() if x & y and jac(x, y))
    own = sets.similar_sets(frame(b), frame(b), least, ordered=True)
    assert sorted(map(tuple, own.collect())) == sorted((i, j, len(x & y), len(x), len(y)) for i, x in b.items() for j, y in b.items() if i < j and x & y and jac(x, y))


def test_a_common_element_joins_nothing(spark, monkeypatch):
    """Sets that share one very common element alone never meet."""
    df = spark.range(4000).selectExpr("id", "explode(array('all', concat('a', id), concat('b', id))) element")
    assert sets.similar_sets(df, df, 0.5, ordered=True).count() == 0
    plan = sets.similar_sets(df.where("id < 0"), df, 0.5)
    assert plan.count() == 0
    with pytest.raises(ValueError):
        sets.similar_sets(df, df, 0)


@pytest.mark.parametrize("tile", [None, 3])
def test_graph_similarity_of_all_pairs(spark, monkeypatch, tile):
    """Every pair that shares an edge, however unlike; nothing but graphs is shuffled."""
    from evidentia.operators import graphs, tiles

    if tile:
        monkeypatch.setattr(tiles, "TILE", tile)
        monkeypatch.setattr(tiles, "RIGHT_TILE", 7)
    monkeypatch.setattr(tiles, "SLICE", 5)
    rng = random.Random(3)
    sets = {i: {f"e{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 25]))} for i in range(40)}
    rows = [(i, e) for i, s in sets.items() for e in sorted(s)]
    b = spark.createDataFrame(rows + rows[:5] + [(3, None)], "graph long, edge string")
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in graphs.graph_similarity(b.where("graph % 5 = 0"), b).collect()}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i % 5 == 0 and sets[i] & sets[j]}
    assert got == want and min(want.values()) < 0.1
