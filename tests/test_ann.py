"""Searches in tiles: cells against brute force, and what the metrics of rankings look up."""

import numpy as np

from evidentia.operators import ann, rank
from evidentia.operators import tiles as T


def frames(spark, n=300, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype("float32").astype(float)
    x[5] = x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows[::5], "query_id long, embedding array<float>"), spark.createDataFrame(rows, "id long, embedding array<float>"), x


def exact(x, queries, allowed, k):
    out = {}
    for q in queries:
        s = np.round(x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])), 9)
        ids = [i for i in range(len(x)) if allowed(q, i)]
        out[q] = sorted(ids, key=lambda i: (-s[i], i))[:k]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_small_tiles_of_cells_return_k_rows_a_query_and_lose_none(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 8)
    monkeypatch.setattr(T, "RIGHT_TILE", 32)
    monkeypatch.setattr(T, "SLICE", 7)
    queries, vectors, x = frames(spark)
    assert listed(ann.ann_topk(queries, vectors, cells=4, beam=4, k=6)) == exact(x, range(0, 300, 5), lambda q, i: True, 6)
    probes = queries.selectExpr("query_id", "embedding", "int(query_id % 2) cell")
    placed = vectors.selectExpr("id", "embedding", "int(id % 2) cell")
    found = ann.within_cells(probes, placed, 6)
    assert found.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 6 * -(-150 // 32)
    from evidentia.functions import top

    assert listed(top(found, ["query_id"], [found["score"].desc(), "id"], 6)) == exact(x, range(0, 300, 5), lambda q, i: q % 2 == i % 2, 6)


def test_a_cell_of_the_grid_returns_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 16)
    monkeypatch.setattr(T, "RIGHT_TILE", 100)
    monkeypatch.setattr(T, "SLICE", 10)
    queries, vectors, x = frames(spark)
    assert rank.cosine_scores(queries, vectors, 4).count() <= 60 * 3 * 4
    assert listed(rank.cosine_topk(queries, vectors, 4)) == exact(x, range(0, 300, 5), lambda q, i: True, 4)


def test_metrics_look_up_ranked_pairs_only(spark):
    from evidentia.plans.evaluation import arms
    from evidentia.plans.registry import Tables

    current, _, labels = arms(Tables(spark, "/root/testdata/sf0.001"))
    assert labels.join(current, ["query_id", "id"], "left_anti").count() == 0 < labels.count() <= current.count()
