"""Channel scores of chunks and features of their rolling history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, saturate

#: how near two rows of the history must be, and how many rows it has
NEAR, HISTORY = 0.70, 12


def static_channels(rows: DataFrame, routes: DataFrame, scale: float = 1.0) -> DataFrame:
    """(id, channel, value): confidences of ``(id, kind, confidence)`` summed by route ``(kind, channel, factor)`` and saturated.  Routes: a fixed table."""
    j = rows.join(F.broadcast(routes), "kind").groupBy("id", "channel").agg(F.sum(F.col("confidence") * F.col("factor")).alias("w"))
    return j.select("id", "channel", saturate(F.col("w"), scale).alias("value"))


def channel_support(rows: DataFrame) -> DataFrame:
    """Contributions of ``(id, path, start, end, quote, confidence)`` summed by their support, with the largest."""
    return rows.groupBy("id", "path", "start", "end", "quote").agg(F.sum("confidence").alias("total"), F.max("confidence").alias("largest"), F.count(F.lit(1)).alias("n"))


def channel_max(df: DataFrame) -> DataFrame:
    """Per (record, channel) of chunks: largest value, its first chunk, chunks within 1e-9 of it, and its distance to the median."""
    w = Window.partitionBy("record", "channel")
    near = df.withColumn("top", F.max("value").over(w)).withColumn("tied", F.col("value") >= F.col("top") - 1e-9)
    return near.groupBy("record", "channel").agg(F.max("value").alias("high"), F.min(F.when(F.col("tied"), F.col("chunk"))).alias("first_chunk"), F.sum(F.col("tied").cast("long")).alias("saturated"), (F.max("value") - F.expr("percentile(value, 0.5)")).alias("above_median"))


def history_channels(sims: DataFrame) -> DataFrame:
    """Features of each target ``t`` from ``(project, t, s, sim)``, the similarities to its last twelve rows ``s < t``.

    frequency: share near; persistence: length of the trailing near run over min(6, n); burstiness: rate of the last four
    less the earlier rate, clamped; recurrence: the largest (0 without history); novelty: 1 - it (1 without); decay: rows
    since the last near one over twelve (1 without).
    """
    own = sims.where((F.col("s") >= F.col("t") - HISTORY) & (F.col("s") < F.col("t"))).withColumns({"near": F.col("sim") >= NEAR, "ago": F.col("t") - F.col("s")})
    g = own.groupBy("project", "t").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("near").cast("double")).alias("frequency"), F.min(F.when(~F.col("near"), F.col("ago"))).alias("break"), F.max("sim").alias("most"), F.min(F.when(F.col("near"), F.col("ago"))).alias("since"),
        F.avg(F.when(F.col("ago") <= 4, F.col("near").cast("double"))).alias("late"), F.avg(F.when(F.col("ago") > 4, F.col("near").cast("double"))).alias("early"),
    )
    run = F.least(F.coalesce(F.col("break") - 1, F.col("n")), F.lit(6))
    return g.select("project", "t", "frequency", clamp(run / F.least(F.lit(6), "n")).alias("persistence"), clamp(F.coalesce("late", F.lit(0.0)) - F.coalesce("early", F.lit(0.0))).alias("burstiness"), clamp(F.col("most")).alias("recurrence"), (1 - clamp(F.col("most"))).alias("novelty"), F.coalesce(F.col("since") / HISTORY, F.lit(1.0)).alias("decay"))


def volatility(df: DataFrame) -> DataFrame:
    """``.65`` distance from the row before (long form ``(project, t, channel, value)``) and ``.35`` the saturated change; 0 for the first."""
    before = F.lag("value").over(Window.partitionBy("project", "channel").orderBy("t"))
    step = df.withColumn("d", F.col("value") - before).groupBy("project", "t").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("distance"), F.sum(F.abs("d")).alias("change"))
    return step.select("project", "t", (0.65 * clamp(F.coalesce("distance", F.lit(0.0))) + 0.35 * saturate(F.coalesce("change", F.lit(0.0)), 1.0)).alias("volatility"))


def memory_channel(df: DataFrame) -> DataFrame:
    """``1 - (1 - m)(1 - .65 r)`` of memory and recurrence."""
    return df.withColumn("memory", 1 - (1 - F.col("memory")) * (1 - 0.65 * F.col("recurrence")))


def soft_history(sims: DataFrame) -> DataFrame:
    """Soft features of the last twelve similarities: mean, product of the last six, largest, and the halves' difference."""
    own = sims.where((F.col("s") >= F.col("t") - HISTORY) & (F.col("s") < F.col("t"))).withColumn("ago", F.col("t") - F.col("s"))
    late, early = F.avg(F.when(F.col("ago") <= 6, F.col("sim"))), F.avg(F.when(F.col("ago") > 6, F.col("sim")))
    run = F.exp(F.sum(F.when(F.col("ago") <= 6, F.log(F.greatest("sim", F.lit(1e-9))))))
    signed = F.coalesce(late, F.lit(0.0)) - F.coalesce(early, F.lit(0.0))
    return own.groupBy("project", "t").agg(F.avg("sim").alias("mean"), run.alias("run"), F.max("sim").alias("most"), signed.alias("burst"), F.abs(signed).alias("burst_size"))


def classify_zero(df: DataFrame) -> DataFrame:
    """Kind of zero of ``(id, value, raw, applicable, history)``: positive, not applicable, no history, clamped negative, absent."""
    return df.select("id", F.when(F.col("value") > 0, "positive").when(~F.col("applicable"), "not_applicable").when(F.col("history") == 0, "no_history").when(F.col("raw") < 0, "clamped_negative").otherwise("absent").alias("kind"))
