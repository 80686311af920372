"""Pairs are decided where both sides lie: no shuffle, and no written copy, that grows with the pairs."""

import pytest
from pyspark.sql import functions as F

from evidentia import plans
from evidentia.operators import lists, rank, tiles


def exchanges(df) -> list[str]:
    """The operators above the first Python one that returns pairs, down to which nothing may be shuffled."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return plan[: next(i for i, line in enumerate(plan) if "MapInArrow" in line)]


@pytest.mark.parametrize("name", ["v4_rank_channel", "v5_dense_with_tail", "v6_rrf", "v8_hybrid_rank", "v11_page", "v17_discover", "v2_profile_similarity", "v7_lexical_coverage", "g2_graph_similarity"])
def test_pairs_are_not_shuffled(spark, name):
    """Before, a query's blocks, or parts of pairs of profiles, were grouped after they had been multiplied."""
    plan = exchanges(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not any(word in line for line in plan for word in ("Join", "Aggregate", "Window", "Repartition", "FlatMapGroups", "FlatMapCoGroups"))


def numbers(df, *key):
    return sorted((tuple(r[k] for k in key), [x if x is None else round(x, 9) for x in r if not isinstance(x, str)]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(i * 7 % 11 - 5), float(i * 5 % 13 - 6), float(i % 3)]) for i in range(240)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3).cache()


def test_a_left_side_of_many_bytes_is_met_in_cells(spark, monkeypatch, vectors):
    """Cells are read as streams: batches that begin and end within a cell, several left parts, more cells than rows."""
    asked = vectors.where("id % 2 = 0").withColumnRenamed("id", "query_id")
    want = [numbers(rank.cosine_topk(asked, vectors, k), "query_id", "id") for k in (1, 5)], numbers(rank.cosine_scores(asked, vectors), "query_id", "id")
    monkeypatch.setattr(tiles, "TILE", 8)
    monkeypatch.setattr(tiles, "HELD", 700)
    monkeypatch.setattr(tiles, "KEPT", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = [numbers(rank.cosine_topk(asked, vectors, k), "query_id", "id") for k in (1, 5)], numbers(rank.cosine_scores(asked, vectors), "query_id", "id")
        assert "RepartitionBy" in rank.cosine_scores(asked, vectors)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_large_profiles_beside_small_ones(spark, monkeypatch, vectors):
    """Profiles of 1 to 40 chunks, some of equal place, whole and in parts."""
    profiles = vectors.selectExpr("cast(sqrt(id) as long) owner", "id % 9 idx", "embedding").unionAll(vectors.where("id < 30").selectExpr("99L", "id % 20", "embedding"))
    left = profiles.where("owner % 3 = 0")
    key = ["left_id", "right_id"]
    whole = numbers(rank.profile_similarity(left, profiles), *key)
    monkeypatch.setattr(rank, "CHUNKS", 12)
    mixed = numbers(rank.profile_similarity(left, profiles), *key)
    monkeypatch.setattr(rank, "CHUNKS", 0)
    parts = numbers(rank.profile_similarity(left, profiles), *key)
    assert whole == mixed == parts and len(whole) == 7 * 17


def test_tasks_hold_few_queries(spark, monkeypatch, vectors):
    """Rows of one query in one task, however few fit; a list of no rows beside dense rows is still fused."""
    asked = vectors.where("id % 12 = 0").withColumnRenamed("id", "query_id")
    asked = asked.unionAll(asked.where("query_id = 24"))
    want = numbers(rank.ranked_lists(lists.cosine_lists(asked, vectors)), "query_id", "rank")
    monkeypatch.setattr(lists, "HELD", 240 * 4 * 2)
    assert numbers(rank.ranked_lists(lists.cosine_lists(asked, vectors)), "query_id", "rank") == want and len(want) == 21 * 240
    few = rank.cosine_topk(asked.dropDuplicates(["query_id"]), vectors, 2)
    empty = lists.cosine_lists(asked, vectors.limit(0))
    assert rank.ranked_lists(empty).count() == 0
    assert rank.rrf_lists(few, empty).select(F.max("rank"), F.count("id")).first() == (2, 40)
