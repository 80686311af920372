"""Column expressions that the operators share; all of them stay in the JVM."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: constant of reciprocal-rank fusion, and the weight of the structural channel in it
RRF_K, W_LEAF = 60, 0.6


def dot(a, b) -> Column:
    """Inner product of two arrays, in double precision."""
    products = F.zip_with(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine of two arrays rounded to nine digits, so that order does not hang on the order of additions.

    0 for a zero vector, one that holds nulls, and vectors of unequal length.
    """
    size = norm(a) * norm(b)
    return F.round(F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0)), 9)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def saturate(weight: Column, scale: float) -> Column:
    """``1 - exp(-w / scale)`` within [0, 1]."""
    return clamp(1 - F.exp(-weight / scale))


def noisy_or(a: Column, b: Column) -> Column:
    """``1 - (1 - a)(1 - b)``; an absent side counts as no evidence."""
    return 1 - (1 - F.coalesce(a, F.lit(0.0))) * (1 - F.coalesce(b, F.lit(0.0)))


def rrf_term(rank: Column, weight: float | Column = 1.0, k: int = RRF_K) -> Column:
    """A channel's share in reciprocal-rank fusion; an absent rank adds nothing."""
    return F.when(rank.isNotNull(), F.lit(weight) / (k + rank) if not isinstance(weight, Column) else weight / (k + rank)).otherwise(0.0)


def squash(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def digest(*cols: str) -> Column:
    """SHA-256 of the columns' text form in the order given, separated by bars; null is a marker of its own."""
    return sha(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]))


def uuid_from(hexadecimal: Column) -> Column:
    """UUID-shaped id from the first 32 digits of a digest."""
    return F.concat_ws("-", *[F.substring(hexadecimal, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def slice_text(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """``text[start:end]`` by code points, 0-based and end-exclusive."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.substring(as_col(text), as_col(start) + 1, as_col(end) - as_col(start))


def first_reason(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The reason of the first rule that holds."""
    return F.coalesce(*[F.when(test, F.lit(reason)) for test, reason in rules], F.lit(otherwise).cast("string"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a rate; null where nothing was counted."""
    p = successes / n
    middle, width, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    some = n > 0
    return F.when(some, clamp((middle - width) / scale)), F.when(some, clamp((middle + width) / scale))


def numbered(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """Number rows from 1 within ``by``; ``order`` must end in an id, so that the order is total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int"))


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits groups before it shuffles."""
    return numbered(df, by, order, name).where(F.col(name) <= k)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the folder that ``spark.checkpoint.dir`` names, without their lineage; lost executors cost no rows.

    Where the setting is absent on one machine (tests), the folder is a local one; on a cluster, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def dealt(df: DataFrame, *by: str, rows: int = 250_000) -> DataFrame:
    """Rows dealt by key to as many partitions as make about ``rows`` each (counted now), so that tasks do not grow with the input."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows (counted now); else leave the strategy to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tokens(text: Column, pattern: str = r"[A-Za-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
