"""Tiled products against the column expression of the same cosine, in one tile and in a grid."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import clamp, cosine, numbered, top
from evidentia.operators import rank, tiles

RNG = random.Random(4)


def vector(i):
    if i % 29 == 0:
        return [None, [], [0.0] * 6, [1.0, None, 2.0, 0.0, 0.0, 1.0], [1.0, 2.0]][i // 29 % 5]
    return [float(RNG.randrange(-3, 4)) for _ in range(6)]


@pytest.fixture(scope="module", params=[False, True], ids=["one tile", "grid"])
def small(request):
    with pytest.MonkeyPatch.context() as m:
        if request.param:
            m.setattr(tiles, "TILE", 7)
            m.setattr(tiles, "RIGHT_TILE", 33)
        m.setattr(tiles, "SLICE", 20)
        yield request.param


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, vector(i)) for i in range(260)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3).cache()


def same(got, want):
    got = got.select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def pairs(queries, vectors):
    return vectors.crossJoin(queries.withColumnRenamed("embedding", "asked")).withColumn("score", cosine("asked", "embedding"))


def test_top_k(small, vectors):
    queries = vectors.where("id % 7 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = top(pairs(queries, vectors).select("query_id", "id", "score"), ["query_id"], [F.desc("score"), "id"], 9)
    same(rank.cosine_topk(queries, vectors, 9), want)
    same(rank.cosine_scores(queries, vectors), pairs(queries, vectors).select("query_id", "id", "score"))
    assert rank.cosine_topk(queries.limit(0), vectors, 3).count() == rank.cosine_topk(queries, vectors.limit(0), 3).count() == 0


def test_profiles(small, vectors):
    profiles = vectors.selectExpr("id div 9 owner", "id % 9 idx", "embedding")
    left = profiles.where("owner % 3 = 0")
    p = profiles.selectExpr("owner right_id", "idx j", "embedding b").crossJoin(left.selectExpr("owner left_id", "idx i", "embedding a")).withColumn("s", clamp(cosine("a", "b")))
    rows, cols = p.groupBy("left_id", "right_id", "i").agg(F.max("s").alias("m")), p.groupBy("left_id", "right_id", "j").agg(F.max("s").alias("m"))
    key = ["left_id", "right_id"]
    joined = rows.groupBy(key).agg(F.avg("m").alias("l"), F.max("m").alias("best")).join(cols.groupBy(key).agg(F.avg("m").alias("r")), key)
    want = joined.select(*key, "best", F.col("l").alias("left_coverage"), F.col("r").alias("right_coverage"), (0.5 * F.col("best") + 0.25 * F.col("l") + 0.25 * F.col("r")).alias("similarity"), (0.7 * F.col("l") + 0.3 * F.col("best")).alias("relevance"))
    got = rank.profile_similarity(left, profiles)
    for x, y in zip(got.orderBy(key).collect(), want.orderBy(key).collect(), strict=True):
        assert tuple(x) == pytest.approx(tuple(y), abs=1e-9)


@pytest.mark.parametrize("k", [None, 5])
def test_cohorts(small, vectors, k):
    cohort = vectors.where("id % 5 = 1").selectExpr("id % 4 query_id", "id member", "1.0D / (1 + id % 3) weight", "embedding")
    p = vectors.crossJoin(cohort.withColumnRenamed("embedding", "asked")).select("query_id", "id", "member", (cosine("asked", "embedding") * F.col("weight")).alias("score"))
    want = numbered(top(p, ["query_id", "id"], [F.desc("score"), "member"], 1).drop("rank"), ["query_id"], [F.desc("score"), "id"])
    same(rank.best_cohort_match(vectors, cohort, k), want if k is None else want.where(F.col("rank") <= k))


def test_partners(small, spark, vectors):
    some = vectors.where("id % 29 <> 0")
    chosen = spark.createDataFrame([(i, i, i + 1) for i in range(1, 250, 6) if i % 29 and (i + 1) % 29], "pair_id long, a long, b long")
    held = {r["id"]: r["embedding"] for r in some.collect()}
    want = []
    scores = {(r["query_id"], r["id"]): r["score"] for r in pairs(some.select(F.col("id").alias("query_id"), "embedding"), some).select("query_id", "id", "score").collect()}
    for p in chosen.collect():
        ranks = []
        for q, partner in ((p["a"], p["b"]), (p["b"], p["a"])):
            order = sorted((i for i in held if i != q), key=lambda i: (-scores[q, i], i))
            ranks.append(order.index(partner) + 1)
        want.append((p["pair_id"], *ranks))
    assert sorted(map(tuple, rank.partner_rank(chosen, some).collect())) == sorted(want)


def test_not_a_number_is_above_all(small, spark):
    rows = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 0.0]), (3, [0.5, 0.1])], "id long, embedding array<double>")
    got = rank.cosine_topk(rows.where("id = 2").withColumnRenamed("id", "query_id"), rows, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]
