"""Structured Streaming forms of the ledger's batch operators.

The watermark only bounds state: rows later than it go to a late table in the ``foreachBatch`` forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_turns(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One capture per ``(conversation, ordinal, content_hash)`` of a stream with event time ``captured_at``."""
    return turns.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["conversation", "ordinal", "content_hash"])


def append_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event of each ``(project_id, key)`` of a stream with event time ``ts``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["project_id", "key"])


def replay(events: DataFrame) -> DataFrame:
    """State of every object, for update or complete mode: a running maximum per object."""
    last = events.groupBy("project_id", "object_id").agg(F.max(F.struct("ts", "event_id", "kind")).alias("s"))
    return last.select("project_id", "object_id", F.col("s.event_id").alias("event_id"), F.col("s.kind").alias("kind"))


def latest_turns(turns: DataFrame) -> DataFrame:
    """Latest complete capture of every turn, else the latest, for update or complete mode."""
    best = turns.groupBy("conversation", "ordinal").agg(F.max(F.struct("complete", "captured_at", "capture_id")).alias("s"))
    return best.select("conversation", "ordinal", F.col("s.complete").alias("complete"), F.col("s.capture_id").alias("capture_id"))


def into_ledger(path: str, late_path: str, delay_seconds: int, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: appends events whose ``(project_id, key)`` the ledger lacks, and late ones to their own table.

    A batch is an epoch.  Its rows go to ``path/epoch=N``, by bucket of their key, and late ones to ``late_path/epoch=N``; a marker
    in ``path/_commits`` is written last.  Both folders are overwritten whole, so an epoch that failed midway leaves nothing
    behind when it is run again, and one that has its marker is not run again.  New rows are compared with committed epochs
    in their own buckets only.  ``read_ledger`` reads what is committed.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = committed(spark, path)
        if epoch in done:
            return
        newest = batch.agg(F.max("ts")).first()[0]
        late = F.coalesce(F.col("ts") < F.lit(newest) - F.expr(f"interval {delay_seconds} seconds"), F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/epoch={epoch}")
        keyed = batch.where(~late).withColumn("bucket", F.pmod(F.xxhash64("project_id", "key"), F.lit(buckets)).cast("int"))
        new = keyed.dropDuplicates(["project_id", "key"])
        if done:
            held = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets``
            known = read_ledger(spark, path).where(F.col("bucket").isin(held)).select("bucket", "project_id", "key")
            new = new.join(known.hint("merge"), ["bucket", "project_id", "key"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")
        fs, at = _file_system(spark, f"{path}/_commits/{epoch}")
        fs.create(at, True).close()

    return write


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> list[int]:
    """Epochs of a ledger whose marker is written."""
    fs, at = _file_system(spark, f"{path}/_commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def read_ledger(spark: SparkSession, path: str, late_path: str | None = None) -> DataFrame:
    """Committed rows of a ledger with their bucket, or its committed late rows."""
    epochs = committed(spark, path)
    if not epochs:
        raise ValueError(f"{path} has no committed epoch")
    base = late_path or path
    return spark.read.option("basePath", base).option("mergeSchema", "false").parquet(*[f"{base}/epoch={e}" for e in epochs]).drop("epoch")


def reassemble(frames: DataFrame, timeout_ms: int = 60_000, max_frames: int = 1024) -> DataFrame:
    """Messages of a stream ``frames(message, seq, total, body)``: emitted once all numbers came; incomplete ones expire.

    State per message: the bodies by number, at most ``max_frames``.  The last write of a number wins; numbers out of
    bounds are rejected.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (message,) = key
        if state.hasTimedOut:
            numbers, _, total = state.get
            state.remove()
            yield pd.DataFrame({"message": [message], "outcome": ["expired"], "frames": [len(numbers)], "body": [None]})
            return
        numbers, bodies, total = state.get if state.exists else ([], [], 0)
        have = dict(zip(numbers, bodies))
        for batch in batches:
            for seq, of, body in zip(batch["seq"], batch["total"], batch["body"]):
                if 0 < of <= max_frames and 0 <= seq < of:
                    total = int(of)
                    have[int(seq)] = body
        if total and len(have) == total:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"message": [message], "outcome": ["complete"], "frames": [total], "body": ["".join(have[i] for i in range(total))]})
        else:
            state.update((list(have), list(have.values()), total))
            state.setTimeoutDuration(timeout_ms)

    return frames.groupBy("message").applyInPandasWithState(step, "message long, outcome string, frames int, body string", "numbers array<int>, bodies array<string>, total int", "append", GroupStateTimeout.ProcessingTimeTimeout)
