"""Approximate neighbours by coarse cells with a beam."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cosine, top
from . import tiles as T


def ann_topk(queries: DataFrame, vectors: DataFrame, cells: int = 64, beam: int = 8, k: int = 16, seed: int = 1) -> DataFrame:
    """(query_id, id, score, rank): exact cosine within the ``beam`` cells whose centres are nearest to a query.

    The centres are a table of ``cells`` rows; queries and vectors meet in tiles of a cell, which return ``k`` rows a query.
    """
    with_features = vectors.select("id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("_features"))
    model = KMeans(k=cells, seed=seed, maxIter=8, featuresCol="_features", predictionCol="cell").fit(with_features)
    placed = model.transform(with_features).select("id", "embedding", "cell")
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    near = queries.select("query_id", F.col("embedding").alias("asked")).crossJoin(F.broadcast(centres)).withColumn("s", cosine("asked", "centre"))
    probes = top(near, ["query_id"], [F.desc("s"), "cell"], beam).select("query_id", F.col("asked").alias("embedding"), "cell")
    return top(within_cells(probes, placed, k), ["query_id"], [F.desc("score"), "id"], k)


def within_cells(probes: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each query and tile of a cell, the ``k`` nearest; a large cell is cut into tiles on both sides."""
    rows = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / T.TILE).cast("int").alias("n_rows"))
    columns = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / T.RIGHT_TILE).cast("int").alias("n_columns"))
    sizes = F.broadcast(rows.join(columns, "cell"))
    own = lambda *of: F.pmod(F.xxhash64(*of), F.col(of[0])).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(sizes, "cell").select("cell", "query_id", "embedding", own("n_rows", "query_id", "embedding").alias("_row"), every("n_columns").alias("_column"))
    right = placed.join(sizes, "cell").select("cell", "id", "embedding", every("n_rows").alias("_row"), own("n_columns", "id", "embedding").alias("_column"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = f"query_id {kind(probes, 'query_id')}, id {kind(placed, 'id')}, score double"
    names = probes.sparkSession.createDataFrame([], out).toArrow().schema

    def tile(asked: pa.Table, held: pa.Table) -> pa.Table:
        found, a = names.empty_table(), T.matrices(asked.column("embedding"))
        for at in range(0, held.num_rows if asked.num_rows else 0, T.SLICE):
            part = held.slice(at, T.SLICE)
            s = T.cosines(a, asked.num_rows, T.matrices(part.column("embedding")), part.num_rows)
            i, j = T.largest(s, k, T.numbers(part.column("id")))
            more = pa.table({**T.taken(asked, i, query_id="query_id"), **T.taken(part, j, id="id"), "score": s[i, j]})
            found = T.best(pa.concat_tables([found, more.cast(names)]), k)
        return found

    key = ["cell", "_row", "_column"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, out)
