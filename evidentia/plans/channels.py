"""Queries of channel scores."""

from pyspark.sql import functions as F

from ..functions import numbered
from ..operators import channels as C
from .registry import Tables, query

_ROUTES = [("click", "change", 1.0), ("error", "threat", 0.6), ("error", "change", 0.7), ("purchase", "commitment", 1.0), ("signup", "commitment", 0.5)]
_RT = "rt AS (SELECT * FROM (VALUES ('click', 'change', 1.0::DOUBLE), ('error', 'threat', 0.6::DOUBLE), ('error', 'change', 0.7::DOUBLE), ('purchase', 'commitment', 1.0::DOUBLE), ('signup', 'commitment', 0.5::DOUBLE)) v(kind, channel, factor))"


@query("c1_static_channels", f"WITH {_RT} SELECT user_id AS id, channel, round(greatest(0, least(1, 1 - exp(-sum(value / 100 * factor) / 2))), 6) AS value FROM events JOIN rt ON kind = event_type GROUP BY ALL")
def c1(t: Tables):
    routes = t.spark.createDataFrame(_ROUTES, "kind string, channel string, factor double")
    return C.static_channels(t("events").selectExpr("user_id id", "event_type kind", "value / 100 confidence"), routes, 2.0).withColumn("value", F.round("value", 6))


@query("c2_channel_support", "SELECT user_id AS id, event_type AS path, props AS quote, round(sum(value), 6) AS total, max(value) AS largest, count(*) AS n FROM events GROUP BY ALL")
def c2(t: Tables):
    rows = t("events").selectExpr("user_id id", "event_type path", "0 start", "0 end", "props quote", "value confidence")
    return C.channel_support(rows).select("id", "path", "quote", F.round("total", 6).alias("total"), "largest", "n")


@query("c3_channel_max", "WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id, event_type) AS top FROM events) SELECT user_id AS record, event_type AS channel, max(value) AS high, min(event_id) FILTER (value >= top - 1e-9) AS first_chunk, CAST(sum((value >= top - 1e-9)::INT) AS BIGINT) AS saturated, round(max(value) - quantile_cont(value, 0.5), 6) AS above_median FROM m GROUP BY ALL")
def c3(t: Tables):
    return C.channel_max(t("events").selectExpr("user_id record", "event_type channel", "event_id chunk", "value")).withColumn("above_median", F.round("above_median", 6))


@query("c4_threat_change", "SELECT user_id AS id, channel, round(greatest(0, least(1, 1 - exp(-sum(value / 100 * factor)))), 6) AS value FROM events JOIN (VALUES ('error', 'threat', 0.6::DOUBLE), ('view', 'change', 0.7::DOUBLE)) v(kind, channel, factor) ON kind = event_type GROUP BY ALL")
def c4(t: Tables):
    routes = t.spark.createDataFrame([("error", "threat", 0.6), ("view", "change", 0.7)], "kind string, channel string, factor double")
    return C.static_channels(t("events").selectExpr("user_id id", "event_type kind", "value / 100 confidence"), routes).withColumn("value", F.round("value", 6))


_SIM = """ev AS (SELECT user_id AS project, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value, event_id FROM events), sm AS (SELECT a.project, a.t, b.t AS s, ((a.event_id * 7 + b.event_id * 3) % 101) / 100 AS sim FROM ev a JOIN ev b ON a.project = b.project AND b.t BETWEEN a.t - 12 AND a.t - 1)"""


def sims(t: Tables):
    """A similarity of each event with each of the twelve before it, made from ids; a lag per distance, no self-join."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").withColumn("t", F.row_number().over(w))
    back = F.array(*[F.struct(F.lit(k).alias("ago"), F.lag("event_id", k).over(w).alias("other")) for k in range(1, 13)])
    x = e.withColumn("back", back).select(F.col("user_id").alias("project"), "t", "event_id", F.explode("back").alias("b")).where("b.other is not null")
    return x.selectExpr("project", "t", "t - b.ago s", "((event_id * 7 + b.other * 3) % 101) / 100 sim")


@query("c5_history_channels", f"""WITH {_SIM}, g AS (SELECT project, t, count(*) AS n, avg((sim >= 0.7)::INT) AS frequency, min(t - s) FILTER (NOT sim >= 0.7) AS brk, max(sim) AS most, min(t - s) FILTER (sim >= 0.7) AS since, avg((sim >= 0.7)::INT) FILTER (t - s <= 4) AS late, avg((sim >= 0.7)::INT) FILTER (t - s > 4) AS early FROM sm GROUP BY ALL)
 SELECT project, CAST(t AS INTEGER) AS t, round(frequency, 6) AS frequency, round(greatest(0, least(1, least(coalesce(brk - 1, n), 6) / least(6, n))), 6) AS persistence, round(greatest(0, least(1, coalesce(late, 0) - coalesce(early, 0))), 6) AS burstiness, round(greatest(0, least(1, most)), 6) AS recurrence, round(1 - greatest(0, least(1, most)), 6) AS novelty, round(coalesce(since / 12, 1), 6) AS decay FROM g""")
def c5(t: Tables):
    out = C.history_channels(sims(t))
    return out.withColumns({c: F.round(c, 6) for c in out.columns[2:]})


@query("c6_volatility", """WITH l AS (SELECT user_id AS project, t, channel, v, v - lag(v) OVER (PARTITION BY user_id, channel ORDER BY t) AS d FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 100 AS a, (event_id % 10) / 10 AS b FROM events) UNPIVOT (v FOR channel IN (a, b)))
 SELECT project, CAST(t AS INTEGER) AS t, round(0.65 * greatest(0, least(1, coalesce(sqrt(sum(d * d)), 0))) + 0.35 * greatest(0, least(1, 1 - exp(-coalesce(sum(abs(d)), 0)))), 6) AS volatility FROM l GROUP BY ALL""")
def c6(t: Tables):
    e = numbered(t("events"), ["user_id"], ["ts", "event_id"], "t")
    return C.volatility(e.selectExpr("user_id project", "t", "stack(2, 'a', value / 100, 'b', (event_id % 10) / 10) as (channel, value)")).withColumn("volatility", F.round("volatility", 6))


@query("c7_memory_channel", "SELECT l_orderkey, l_linenumber, l_partkey, round(1 - (1 - l_discount) * (1 - 0.65 * l_tax), 9) AS memory FROM lineitem")
def c7(t: Tables):
    return C.memory_channel(t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_discount memory", "l_tax recurrence")).select("l_orderkey", "l_linenumber", "l_partkey", F.round("memory", 9).alias("memory"))


@query("c8_soft_history", f"WITH {_SIM} SELECT project, CAST(t AS INTEGER) AS t, round(avg(sim), 6) AS mean, round(exp(sum(ln(greatest(sim, 1e-9))) FILTER (t - s <= 6)), 6) AS run, max(sim) AS most, round(coalesce(avg(sim) FILTER (t - s <= 6), 0) - coalesce(avg(sim) FILTER (t - s > 6), 0), 6) AS burst, round(abs(coalesce(avg(sim) FILTER (t - s <= 6), 0) - coalesce(avg(sim) FILTER (t - s > 6), 0)), 6) AS burst_size FROM sm GROUP BY ALL")
def c8(t: Tables):
    return C.soft_history(sims(t)).withColumns({c: F.round(c, 6) for c in ("mean", "run", "burst", "burst_size")})


@query("c9_classify_zero", "SELECT event_id AS id, CASE WHEN greatest(value - 20, 0) > 0 THEN 'positive' WHEN event_type = 'view' THEN 'not_applicable' WHEN user_id % 4 = 0 THEN 'no_history' WHEN value - 20 < 0 THEN 'clamped_negative' ELSE 'absent' END AS kind FROM events")
def c9(t: Tables):
    return C.classify_zero(t("events").selectExpr("event_id id", "greatest(value - 20, 0) value", "value - 20 raw", "event_type <> 'view' applicable", "user_id % 4 history"))
