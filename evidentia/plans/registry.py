"""Names of queries, their functions and their SQL, and the views of the tables that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(t)``, where ``t(table)`` reads a table, under a name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The driver's tables, and the shapes that operators take them in."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def vectors(self) -> DataFrame:
        return self("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    def asked(self) -> DataFrame:
        """Queries: every fiftieth vector."""
        return self("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")

    def profiles(self) -> DataFrame:
        """Five vectors are the chunks of one owner; chunk i spans [80 i, 80 i + 100)."""
        idx = F.col("vec_id") % 5
        return self("embeddings").select(F.floor(F.col("vec_id") / 5).cast("long").alias("owner"), idx.alias("idx"), (idx * 80).alias("start"), (idx * 80 + 100).alias("end"), "embedding")

    def docs(self) -> DataFrame:
        return self("documents").select(F.col("doc_id").alias("id"), "text")

    def log(self) -> DataFrame:
        """The events as a ledger: project, version, object key, value."""
        return self("events").select(
            F.col("user_id").alias("project_id"), "event_id", "ts", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("object_id"), "value"
        )


#: the same shapes in SQL
COS = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 9)"
ASKED = "asked AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0)"
PROFILES = "profiles AS (SELECT vec_id // 5 AS owner, vec_id % 5 AS idx, (vec_id % 5) * 80 AS start, (vec_id % 5) * 80 + 100 AS \"end\", embedding FROM embeddings)"
LOG = "log AS (SELECT user_id AS project_id, event_id, ts, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS object_id, value FROM events)"
DENSE = f"dense AS (SELECT query_id, v.vec_id AS id, {COS.format(a='q.embedding', b='v.embedding')} AS score FROM asked q, embeddings v)"
