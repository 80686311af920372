"""Shared helpers of the training-data operators: tables, staging, ranking, components and vectorised hashing.

Conventions used by every operator of the subpackage:

* a null text counts as the empty text, a null id is an ordinary value (it never matches another row by accident),
* rows that repeat an id are separate rows and get a result row each,
* only the named columns are read, so extra or clashing column names do no harm,
* intermediate tables go to the folder named by ``spark.checkpoint.dir`` so that a lost executor loses nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; it bounds a Python worker's memory whatever the batch size.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; where it is missing, one machine gets a local one (tests), a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: lets Spark drop a job's shuffle files when the job ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes.

    The job's shuffle files go when it ends, as whatever follows reads the written table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a staged table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_group_rank(df: DataFrame, group: str, tie: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Add a gapless 0-based rank within ``group`` without putting a whole group into one task.

    Rows of a group are dealt over ``buckets`` hash buckets; a rank is the number of rows in earlier buckets of the
    group plus the row number within the bucket.  The per-bucket counts form a table of at most groups x buckets rows.
    ``df`` must be deterministic (a staged table), because it is read twice.
    """
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_bucket").orderBy(*tie)
    ranked = keyed.withColumn("_row", F.row_number().over(within) - 1)
    joined = ranked.join(starts.hint("shuffle_hash"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_g", "_b", "_start", "_row")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates the large-star and small-star steps, each one grouping and one join.  Minima are combined before the
    shuffle; those of the large-star step, where a hub has its rows, are written before they are joined, so that Spark can
    split the hub.  Stops when the edge set no longer changes.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    signature = None
    while True:
        # large star: every neighbour larger than a node points to the node's smallest neighbour
        near = both(current)
        least = staged(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = near.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours point to the smallest of them
        large = staged(large.where("a <> b").distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        following = staged(small.where("a <> b").distinct(), name)
        now = following.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        current = following
        if signature == (now["n"], now["s"]):
            break
        signature = (now["n"], now["s"])
    low = current.groupBy("a").agg(F.min("b").alias("component"))
    return low.select(F.col("a").alias("node"), "component").union(low.select(F.col("component").alias("node"), "component").distinct())


# ---------------------------------------------------------------- vectorised text work inside tasks

def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, a null one as the empty text."""
    return ["" if t is None else t for t in column(batch, name).to_pylist()]


def byte_chunks(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about ``limit`` bytes of text (one row at least).

    Yields the rows, their UTF-8 bytes laid end to end, and the rows' bounds in them (rows + 1 values).
    """
    for batch in batches:
        whole = pc.fill_null(column(batch, name), "").cast(pa.large_binary())
        bounds = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(whole):
            upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
            upto = min(upto, len(whole))
            yield batch.slice(at, upto - at), data[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at]
            at = upto


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE_CODES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[key] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), so that every bit of the result depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one value more than bytes; ``span_hash`` reads any span's hash from it."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power(_ODD, len(data), "odd"), out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((running[end] - running[start]) * _power(_INVERSE, len(running), "inverse")[start])


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes, and each row's first word (rows + 1 values)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(bounds), dtype=np.int64)
    inside = is_word[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    edges = bounds[:-1]
    before[edges[edges < n]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def gram_hash(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (the caller drops runs that cross a row's end)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = mix(word_hash[:n])
    for i in range(1, k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word_hash[i : i + n])
    return out


def table(cols: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in cols.values()], names=list(cols))
