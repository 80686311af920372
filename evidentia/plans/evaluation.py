"""Queries of evaluation."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import numbered, settled, union
from ..operators import evaluate as E
from ..operators import lists as L
from ..operators import rank as R
from .registry import ASKED, DENSE, Tables, query

_ARMS = f"""{ASKED}, {DENSE}, lab AS (SELECT a.query_id, e.vec_id AS id FROM asked a JOIN embeddings e USING (label) WHERE e.vec_id <> a.query_id),
 ca AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM dense WHERE id <> query_id QUALIFY rank <= 16),
 cb AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (id * 7 + query_id) % 101, id) AS INTEGER) AS rank FROM ca),
 arms AS (SELECT *, 'current' AS arm FROM ca UNION ALL SELECT query_id, id, rank, 'proposed' FROM cb)"""


def arms(t: Tables):
    """Two rankings of the same cohort: by cosine, and shuffled in a fixed way; relevant are those of its vectors that have the query's label."""
    base = settled(R.cosine_topk(t.asked(), t.vectors(), 17).where("id <> query_id"))
    current = numbered(base.drop("rank"), ["query_id"], [F.desc("score"), "id"]).where("rank <= 16").select("query_id", "id", "rank")
    proposed = numbered(current.drop("rank"), ["query_id"], [(F.col("id") * 7 + F.col("query_id")) % 101, "id"]).select("query_id", "id", "rank")
    asked, held = t.asked().select("query_id", "label"), t.vectors().select("id", F.col("label").alias("own"))
    # only ranked pairs are looked up, on ids: a label may be that of a tenth of all vectors
    labels = current.select("query_id", "id").join(asked.hint("merge"), "query_id").join(held.hint("merge"), "id").where("own = label and id <> query_id").select("query_id", "id")
    return current, proposed, labels


def same_label(asked: pa.Table):
    """Relevant pairs: equal labels, but not the query itself."""
    def marks(rows: pa.Table) -> np.ndarray:
        both = pa.chunked_array([*asked.column("label").chunks, *rows.column("label").chunks]).combine_chunks().dictionary_encode()
        label = both.indices.fill_null(-1).to_numpy()
        a, b = label[: asked.num_rows, None], label[None, asked.num_rows :]
        query, ids = asked.column("query_id").to_numpy(), rows.column("id").fill_null(L.NO_ID).to_numpy()
        return (a == b) & (a >= 0) & (ids[None, :] != query[:, None]) & (ids[None, :] != L.NO_ID)

    return marks


_METRICS = "m AS (SELECT query_id, arm, count(l.id) FILTER (rank <= 5) / 5 AS p_at_5, count(l.id) FILTER (rank <= 10) / 10 AS p_at_10, coalesce(1 / min(rank) FILTER (l.id IS NOT NULL), 0) AS rr FROM arms LEFT JOIN lab l USING (query_id, id) GROUP BY ALL)"


@query("e1_ir_metrics", f"WITH {_ARMS}, {_METRICS} SELECT query_id, arm, round(p_at_5, 9) AS p_at_5, round(p_at_10, 9) AS p_at_10, round(rr, 9) AS rr FROM m")
def e1(t: Tables):
    current, proposed, labels = arms(t)
    m = E.ir_metrics(union(current.withColumn("arm", F.lit("current")), proposed.withColumn("arm", F.lit("proposed"))), labels, [5, 10])
    return m.withColumns({c: F.round(c, 9) for c in ("p_at_5", "p_at_10", "rr")})


@query("e1_mean_metrics", f"""WITH {_ARMS}, {_METRICS} SELECT round(avg(rr) FILTER (arm = 'current'), 9) AS rr_current, round(avg(rr) FILTER (arm = 'proposed'), 9) AS rr_proposed, round(avg(rr) FILTER (arm = 'proposed') - avg(rr) FILTER (arm = 'current'), 9) AS rr_delta FROM m""")
def e1m(t: Tables):
    current, proposed, labels = arms(t)
    m = E.ir_metrics(union(current.withColumn("arm", F.lit("current")), proposed.withColumn("arm", F.lit("proposed"))), labels, [5])
    out = E.mean_metrics(m, ["rr"], "current", "proposed")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("e2_recall_metrics", f"""WITH {_ARMS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense)
 SELECT k.query_id, round(count(l.id) FILTER (rank <= 10) / nullif(count(l.id), 0), 9) AS recall_10, round(count(l.id) FILTER (rank <= 100) / nullif(count(l.id), 0), 9) AS recall_100, CAST(min(rank) FILTER (l.id IS NOT NULL) AS INTEGER) AS first_hit, min(score) AS low, max(score) AS high, round(max(score) - min(score), 9) AS spread,
 string_agg(CASE WHEN rank <= 5 THEN CAST(k.id AS VARCHAR) END, ',' ORDER BY rank) AS top_five FROM k LEFT JOIN lab l USING (query_id, id) GROUP BY k.query_id""")
def e2(t: Tables):
    lists = L.cosine_lists(t.asked(), t.vectors(), same_label, ["label"])
    return E.recall_lists(lists, [10, 100]).withColumns({c: F.round(c, 9) for c in ("recall_10", "recall_100", "spread")})


_TWO = f"{_ARMS}, a AS (SELECT * FROM ca WHERE rank <= 12), b AS (SELECT * FROM cb WHERE rank <= 12), j AS (SELECT query_id, id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b USING (query_id, id))"


def two(t: Tables):
    current, proposed, _ = arms(t)
    return current.where("rank <= 12"), proposed.where("rank <= 12")


@query("e3_rank_divergence", f"WITH {_TWO} SELECT query_id, id, CAST(abs(coalesce(ra, 13) - coalesce(rb, 13)) AS BIGINT) AS delta, ra IS NULL AS only_b, rb IS NULL AS only_a FROM j")
def e3(t: Tables):
    return E.rank_divergence(*two(t))


@query("e4_cohort_divergence", f"WITH {_TWO} SELECT query_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS overlap, count(*) FILTER (ra IS NULL OR rb IS NULL) AS apart, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*), 9) AS jaccard, bool_or(ra IS DISTINCT FROM rb) AS differs FROM j GROUP BY query_id")
def e4(t: Tables):
    return E.cohort_divergence(*two(t)).withColumn("jaccard", F.round("jaccard", 9))


@query("e5_rank_correlation", f"WITH {_TWO} SELECT query_id, count(*) AS common, round(CASE WHEN count(*) >= 2 AND min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END, 6) AS correlation FROM j WHERE ra IS NOT NULL AND rb IS NOT NULL GROUP BY query_id")
def e5(t: Tables):
    return E.rank_correlation(*two(t)).withColumn("correlation", F.round("correlation", 6))


@query("e6_distribution", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS nth, count(*) OVER (PARTITION BY event_type) AS c FROM events)
 SELECT event_type, count(*) AS n, min(value) AS low, round(quantile_cont(value, 0.5), 9) AS median, max(value) FILTER (nth = ceil(c * 0.9::DOUBLE)) AS p90, max(value) AS high, round(avg(value), 6) AS mean FROM k GROUP BY event_type""")
def e6(t: Tables):
    return E.distribution(t("events"), ["event_type"], "value").withColumns({"median": F.round("median", 9), "mean": F.round("mean", 6)})


@query("e7_collisions", "SELECT min(vec_id) AS first_id, count(*) AS members FROM (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE vec_id % 9 = 0) GROUP BY embedding HAVING count(*) > 1")
def e7(t: Tables):
    v = t.vectors()
    return E.collisions(v.unionByName(v.where("id % 9 = 0")))


@query("e8_latency_summary", "SELECT l_shipdate::DATE - DATE '1990-01-01' >= 0 AS late, l_returnflag, count(*) AS n, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS high FROM lineitem GROUP BY ALL")
def e8(t: Tables):
    li = t("lineitem").withColumn("late", F.col("l_shipdate") >= F.to_timestamp(F.lit("1990-01-01")))
    return E.latency_summary(li, ["late", "l_returnflag"], "l_extendedprice").withColumns({"median": F.round("median", 6), "p95": F.round("p95", 6)})


_Z = "1.959963984540054::DOUBLE"


@query("e9_rates", f"""WITH c AS (SELECT l_returnflag, l_linestatus, CAST(sum((l_discount > 0.05::DOUBLE)::INT) AS BIGINT) AS successes, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, successes / n AS p FROM c)
 SELECT l_returnflag, l_linestatus, successes, n, round(p, 9) AS rate, round(greatest(0, least(1, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n))), 9) AS low,
 round(greatest(0, least(1, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n))), 9) AS high FROM p""")
def e9(t: Tables):
    out = E.rates(t("lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05)
    return out.withColumns({c: F.round(c, 9) for c in ("rate", "low", "high")})


_SRC = "src AS (SELECT n_name AS domain, o_orderpriority AS family, l_returnflag AS arm, l_quantity > 25 AS success FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def observations(t: Tables):
    """Lines by arm (return flag), family (order priority) and domain (nation)."""
    c = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("domain"))), "c_nationkey")
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("family")).join(c, "c_custkey")
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("arm"), (F.col("l_quantity") > 25).alias("success"))
    return li.join(o, "o_orderkey").select("domain", "family", "arm", "success")


_MACRO = "m AS (SELECT arm, count(*) AS families, avg(rate) AS macro FROM (SELECT arm, family, avg(success::INT) AS rate FROM src GROUP BY ALL) GROUP BY arm)"


@query("e10_macro_rates", f"WITH {_SRC}, {_MACRO} SELECT arm, families, round(macro, 9) AS macro FROM m")
def e10(t: Tables):
    return E.macro_rates(observations(t), "arm", "family", F.col("success")).withColumn("macro", F.round("macro", 9))


@query("e10_hypotheses", f"WITH {_SRC}, {_MACRO} SELECT arm, round(macro - (SELECT macro FROM m WHERE arm = 'A'), 9) AS difference, CASE arm WHEN 'N' THEN -0.01::DOUBLE ELSE 0.2::DOUBLE END AS threshold, round(macro - (SELECT macro FROM m WHERE arm = 'A'), 9) >= CASE arm WHEN 'N' THEN -0.01::DOUBLE ELSE 0.2::DOUBLE END AS supported FROM m WHERE arm <> 'A'")
def e10h(t: Tables):
    return E.hypotheses(E.macro_rates(observations(t), "arm", "family", F.col("success")), "arm", "A", {"N": -0.01, "R": 0.2})


@query("e11_cluster_bootstrap", f"""WITH {_SRC}, dom AS (SELECT domain, row_number() OVER (ORDER BY domain) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT domain FROM src)),
 dr AS (SELECT r AS replicate, CAST('0x' || substring(md5(r || ':' || nth), 1, 8) AS BIGINT) % n + 1 AS pick FROM dom, (SELECT unnest(range(10000)) AS r)),
 tm AS (SELECT replicate, d.domain, count(*) AS times FROM dr JOIN dom d ON d.nth = pick GROUP BY ALL),
 cell AS (SELECT domain, family, arm, sum(success::INT) AS s, count(*) AS n FROM src GROUP BY ALL),
 per AS (SELECT replicate, family, arm, sum(s * times) / sum(n * times) AS rate FROM tm JOIN cell USING (domain) GROUP BY ALL),
 pr AS (SELECT replicate, family, max(rate) FILTER (arm = 'R') - max(rate) FILTER (arm = 'A') AS d FROM per GROUP BY ALL),
 rp AS (SELECT replicate, count(d) AS f, avg(d) AS d FROM pr GROUP BY ALL), ok AS (SELECT *, (SELECT count(DISTINCT family) FROM src) AS nf FROM rp)
 SELECT count(*) FILTER (f = nf) AS valid, count(*) FILTER (f <> nf) AS invalid, round(quantile_cont(d, 0.025) FILTER (f = nf), 9) AS low, round(quantile_cont(d, 0.975) FILTER (f = nf), 9) AS high, round(avg(d) FILTER (f = nf), 9) AS mean FROM ok""")
def e11(t: Tables):
    rows = observations(t)
    out = E.bootstrap(rows, 10_000, "A", "R")
    return out.withColumns({c: F.round(c, 9) for c in ("low", "high", "mean")})


_REL = "SELECT l_orderkey AS case_id, CAST(l_partkey % 5 AS INTEGER) AS source, l_returnflag AS kind, CAST(l_suppkey % 5 AS INTEGER) AS target, l_linenumber AS n FROM lineitem"


@query("e12_score_extraction", f"""WITH r AS ({_REL}), e AS (SELECT DISTINCT case_id, source, kind, target FROM r WHERE n <> 2), a AS (SELECT DISTINCT case_id, CASE WHEN n = 3 THEN target ELSE source END AS source, kind, CASE WHEN n = 3 THEN source ELSE target END AS target FROM r WHERE n <> 1),
 x AS (SELECT e.case_id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE (a.case_id, a.source, a.kind, a.target) = (e.case_id, e.source, e.kind, e.target)) THEN 'matched' WHEN EXISTS (SELECT 1 FROM a WHERE (a.case_id, a.target, a.kind, a.source) = (e.case_id, e.source, e.kind, e.target)) THEN 'reversed' ELSE 'missing' END AS what FROM e
   UNION ALL SELECT case_id, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e))
 SELECT case_id, count(*) FILTER (what = 'matched') AS matched, count(*) FILTER (what = 'missing') AS missing, count(*) FILTER (what = 'reversed') AS reversed, count(*) FILTER (what = 'unexpected') AS unexpected, count(*) FILTER (what <> 'matched') = 0 AS exact FROM x GROUP BY case_id""")
def e12(t: Tables):
    r = t("lineitem").selectExpr("l_orderkey case_id", "cast(l_partkey % 5 as int) source", "l_returnflag kind", "cast(l_suppkey % 5 as int) target", "l_linenumber n")
    actual = r.where("n <> 1").selectExpr("case_id", "if(n = 3, target, source) source", "kind", "if(n = 3, source, target) target")
    return E.score_extraction(r.where("n <> 2"), actual)


@query("e13_gate_report", """WITH d AS (SELECT o_orderpriority AS family, o_orderstatus <> 'P' AS valid, o_orderkey % 20 <> 0 AS exact FROM orders), g AS (SELECT family, count(*) AS n, round(avg(valid::INT), 9) AS valid, round(avg(exact::INT), 9) AS exact, bool_and(exact) AS all_exact FROM d GROUP BY family)
 SELECT *, valid >= 0.6::DOUBLE AND exact >= 0.95::DOUBLE AS passed FROM g""")
def e13(t: Tables):
    d = t("orders").select(F.col("o_orderpriority").alias("family"), (F.col("o_orderstatus") != "P").alias("valid"), (F.col("o_orderkey") % 20 != 0).alias("exact"))
    return E.gate_report(d, {"valid": 0.6, "exact": 0.95})


@query("e14_pair_diff", """WITH a AS (SELECT l_orderkey AS k, l_returnflag AS atom, count(*) AS x FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY ALL), b AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 4 THEN 'Z' ELSE l_returnflag END AS atom, count(*) AS y FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY ALL),
 g AS (SELECT k, CAST(sum(abs(coalesce(x, 0) - coalesce(y, 0))) AS BIGINT) AS d, count(x) > 0 AND count(y) > 0 AS there FROM a FULL JOIN b USING (k, atom) GROUP BY k)
 SELECT k AS case_id, CASE WHEN there THEN d END AS difference, CASE WHEN there THEN d = 0 END AS agree FROM g""")
def e14(t: Tables):
    li = t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("atom"), "l_linenumber")
    other = li.where("case_id % 11 <> 0").withColumn("atom", F.when(F.col("l_linenumber") == 4, "Z").otherwise(F.col("atom")))
    return E.pair_diff(li.where("case_id % 10 <> 0"), other, "case_id", "atom")


@query("e15_arm_summary", "SELECT l_returnflag AS arm, count(*) AS n, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 9) AS mean_span, round(avg((l_linestatus = 'F')::INT), 9) AS failed, round(avg((l_tax > 0.04::DOUBLE)::INT), 9) AS unknown FROM lineitem GROUP BY ALL")
def e15(t: Tables):
    rows = t("lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_quantity").alias("span"), F.col("l_linenumber").alias("entities"), (F.col("l_linestatus") == "F").alias("failed"), (F.col("l_tax") > 0.04).alias("unknown"))
    return E.arm_summary(rows).withColumns({c: F.round(c, 9) for c in ("mean_span", "failed", "unknown")})


_LISTS = """e AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CAST(l_partkey % 7 AS INTEGER) AS item FROM lineitem),
 a AS (SELECT key, CASE WHEN key % 3 = 0 THEN n + 1 - pos ELSE pos END AS pos, CASE WHEN key % 5 = 0 AND pos = 1 THEN 9 ELSE item END AS item FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM e))"""


@query("e16_list_delta", f"""WITH {_LISTS}, s AS (SELECT key, sum(greatest(coalesce(x, 0) - coalesce(y, 0), 0))::BIGINT AS missing, sum(greatest(coalesce(y, 0) - coalesce(x, 0), 0))::BIGINT AS extra FROM (SELECT key, item, count(*) AS x FROM e GROUP BY ALL) FULL JOIN (SELECT key, item, count(*) AS y FROM a GROUP BY ALL) USING (key, item) GROUP BY key),
 p AS (SELECT e.key, bool_and(coalesce(e.item = a.item, false)) AS exact FROM e FULL JOIN a USING (key, pos) GROUP BY e.key)
 SELECT key, exact, missing = 0 AND extra = 0 AS multiset_equal, missing = 0 AND extra = 0 AND NOT exact AS order_only, missing, extra FROM s JOIN p USING (key)""")
def e16(t: Tables):
    from pyspark.sql import Window

    e = numbered(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "pos").selectExpr("l_orderkey key", "pos", "cast(l_partkey % 7 as int) item")
    n = F.count(F.lit(1)).over(Window.partitionBy("key")).cast("int")
    a = e.withColumn("n", n).selectExpr("key", "if(key % 3 = 0, n + 1 - pos, pos) pos", "if(key % 5 = 0 and pos = 1, 9, item) item")
    return E.list_delta(e, a)


@query("e17_score_answers", """SELECT o_orderkey AS case_id, CAST(CASE WHEN o_orderkey % 10 = 0 THEN (o_orderstatus IS NULL)::INT + (o_orderpriority IS NULL)::INT ELSE (o_orderkey % 4 <> 0)::INT + (o_orderkey % 6 <> 0)::INT END AS INTEGER) AS matching,
 CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0 THEN 'consistent' ELSE 'mismatch' END AS verdict FROM orders""")
def e17(t: Tables):
    expected = t("orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("authority"))
    answers = expected.where("case_id % 10 <> 0").withColumns({"action": F.when(F.col("case_id") % 4 != 0, F.col("action")), "authority": F.when(F.col("case_id") % 6 == 0, "none").otherwise(F.col("authority"))})
    return E.score_answers(answers, expected, ["action", "authority"])


@query("e18_score_terms", """SELECT doc_id AS id, (NOT contains(lower(text), 'the'))::INT + (NOT contains(lower(text), 'of'))::INT AS absent, contains(lower(text), 'license')::INT + contains(lower(text), 'password')::INT AS present,
 contains(lower(text), 'the') AND contains(lower(text), 'of') AND NOT contains(lower(text), 'license') AND NOT contains(lower(text), 'password') AS passed FROM documents""")
def e18(t: Tables):
    terms = lambda *w: F.array(*[F.lit(x) for x in w])
    return E.score_terms(t.docs().withColumns({"required": terms("The", "of"), "forbidden": terms("License", "password")}))


@query("e19_classify_failures", """SELECT event_id AS id, event_type AS stage, CASE WHEN event_type = 'error' AND regexp_matches(props, '"k": [0-9]\\}') THEN 'single_digit' WHEN event_type = 'error' AND regexp_matches(props, '"k"') THEN 'other_key' WHEN event_type = 'click' AND regexp_matches(props, '[05]\\}$') THEN 'round_click' ELSE 'unclassified' END AS class FROM events""")
def e19(t: Tables):
    errors = t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("props").alias("message"))
    return E.classify_failures(errors, [("error", r'"k": [0-9]\}', "single_digit"), ("error", '"k"', "other_key"), ("click", r"[05]\}$", "round_click")])


@query("e20_packet_summary", """WITH f AS (SELECT o_custkey AS packet, CASE WHEN o_orderkey % 3 = 0 THEN 'admitted' WHEN o_orderkey % 5 = 0 THEN 'excluded:budget' ELSE 'unseen' END AS fate FROM orders) SELECT packet, count(*) AS expected, count(*) FILTER (fate = 'admitted') AS admitted, bool_and(fate = 'admitted') AS covered FROM f GROUP BY packet""")
def e20(t: Tables):
    o = t("orders").select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("id"))
    return E.packet_summary(E.packet_audit(o, o.where("id % 3 = 0"), o.where("id % 5 = 0").withColumn("reason", F.lit("budget"))), ["packet"])


@query("e21_id_space", "SELECT l_returnflag AS arm, CAST(sum((l_partkey % 4 <> 0)::INT) AS BIGINT) AS known, CAST(sum((l_partkey % 4 = 0 AND l_partkey % 3 = 0)::INT) AS BIGINT) AS \"foreign\", CAST(sum((l_partkey % 4 = 0 AND l_partkey % 3 <> 0)::INT) AS BIGINT) AS unknown FROM lineitem GROUP BY ALL")
def e21(t: Tables):
    p = t("part").select(F.col("p_partkey").alias("id"))
    return E.id_space(t("lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_partkey").alias("id")), p.where("id % 4 <> 0"), p.where("id % 3 = 0"))


@query("e22_telemetry", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS sent, CAST(sum(l_linenumber + (l_partkey % 1000 = 0)::INT) AS BIGINT) AS seen, bool_and(l_partkey % 1000 <> 0) AS complete FROM lineitem GROUP BY ALL")
def e22(t: Tables):
    rows = t("lineitem").selectExpr("l_returnflag", "l_linenumber sent", "l_linenumber + if(l_partkey % 1000 = 0, 1, 0) seen")
    return E.telemetry(rows, ["sent", "seen"], ["l_returnflag"])


@query("e23_json_diff", """WITH p AS (SELECT event_id AS id, unnest(['type', 'k', 'value']) AS path, unnest([event_type, json_extract_string(props, '$.k'), CAST(CAST(value AS BIGINT) AS VARCHAR)]) AS v FROM events), b AS (SELECT id, path, CASE WHEN id % 4 = 0 AND path = 'k' THEN 'x' ELSE v END AS v FROM p WHERE NOT (id % 6 = 0 AND path = 'type'))
 SELECT id, path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM p WHERE NOT (id % 7 = 0 AND path = 'k')) a FULL JOIN b USING (id, path) WHERE a.v IS DISTINCT FROM b.v""")
def e23(t: Tables):
    flat = t("events").select(F.col("event_id").alias("id"), F.explode(F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"), F.round("value").cast("long").cast("string"))).alias("path", "value"))
    b = flat.where("not (id % 6 = 0 and path = 'type')").withColumn("value", F.when((F.col("id") % 4 == 0) & (F.col("path") == "k"), "x").otherwise(F.col("value")))
    return E.json_diff(flat.where("not (id % 7 = 0 and path = 'k')"), b)


@query("e24_split_leakage", "SELECT sha256(text) AS sha, count(DISTINCT doc_id % 3) AS splits, count(*) AS rows, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 3) > 1")
def e24(t: Tables):
    return E.split_leakage(t.docs().withColumn("split", F.col("id") % 3))


@query("e24_contrast_violations", "WITH b AS (SELECT o_custkey AS g, min(o_orderstatus) AS base FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL) SELECT g AS \"group\", count(*) AS rows FROM orders JOIN b ON o_custkey = g WHERE o_orderkey % 3 = 0 AND o_orderstatus = base GROUP BY g")
def e24c(t: Tables):
    return E.contrast_violations(t("orders").selectExpr("o_custkey group", "o_orderkey % 3 = 0 contrast", "o_orderstatus label"))


@query("e25_stratified_groups", "SELECT c_mktsegment AS stratum, c_nationkey AS \"group\", count(*) AS rows, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('v1|7|' || c_mktsegment || '|' || c_nationkey), c_nationkey) AS INTEGER) AS rank FROM customer GROUP BY c_mktsegment, c_nationkey QUALIFY rank <= 5")
def e25(t: Tables):
    return E.stratified_groups(t("customer").selectExpr("c_mktsegment stratum", "c_nationkey group"), "v1", 7, 5)


@query("e26_pilot_selection", "SELECT family, mode, case_id FROM (SELECT o_orderpriority AS family, CASE WHEN o_orderstatus = 'F' THEN 'long' ELSE 'control' END AS mode, o_orderkey AS case_id, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus = 'F' ORDER BY o_orderkey) AS r FROM orders) WHERE r <= CASE mode WHEN 'long' THEN 2 ELSE 1 END")
def e26(t: Tables):
    return E.pilot_selection(t("orders").selectExpr("o_orderpriority family", "if(o_orderstatus = 'F', 'long', 'control') mode", "o_orderkey case_id"))


@query("e26_rotate_arms", "WITH c AS (SELECT o_orderpriority AS family, o_orderkey AS case_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth FROM orders) SELECT family, case_id, arm, CAST((i - (nth - 1) % 3 + 3) % 3 + 1 AS INTEGER) AS turn FROM c, (SELECT unnest(['A', 'B', 'C']) AS arm, unnest([0, 1, 2]) AS i)")
def e26r(t: Tables):
    return E.rotate_arms(t("orders").selectExpr("o_orderpriority family", "o_orderkey case_id"), ["A", "B", "C"]).withColumn("turn", F.col("turn").cast("int"))


@query("e27_audit_cases", "SELECT o_orderpriority AS family, o_orderstatus AS mode, count(*) AS rows, count(DISTINCT o_custkey) AS groups, count(*) - count(DISTINCT o_orderkey // 2) AS repeated_ids FROM orders GROUP BY ALL")
def e27(t: Tables):
    return E.audit_cases(t("orders").selectExpr("o_orderpriority family", "o_orderstatus mode", "o_custkey group", "o_orderkey div 2 case_id"))


@query("e28_region_comparison", f"""WITH {_ARMS}, s AS (SELECT query_id, query_id % 3 AS family, id FROM ca), n AS (SELECT query_id, count(*) AS n, min(family) AS f FROM s GROUP BY ALL), p AS (SELECT x.query_id AS a, y.query_id AS b, count(*) AS k FROM s x JOIN s y USING (id) WHERE x.query_id < y.query_id GROUP BY ALL)
 SELECT a, b, round(k / (u.n + v.n - k), 9) AS jaccard, k = u.n AND u.n = v.n AS identical, u.f = v.f AS same_family FROM p JOIN n u ON u.query_id = a JOIN n v ON v.query_id = b WHERE k >= 0.02 * (u.n + v.n - k)""")
def e28(t: Tables):
    return E.region_comparison(arms(t)[0].select("query_id", (F.col("query_id") % 3).alias("family"), "id")).withColumn("jaccard", F.round("jaccard", 9))


@query("e28_stage_summary", "SELECT l_returnflag AS stage, count(*) AS queries, round(avg(l_linenumber), 9) AS mean_rank, quantile_cont(l_linenumber, 0.5) AS median_rank, CAST(sum((l_linenumber = 1)::INT) AS BIGINT) AS top_one FROM lineitem GROUP BY ALL")
def e28s(t: Tables):
    return E.stage_summary(t("lineitem").selectExpr("l_returnflag stage", "l_orderkey query_id", "l_linenumber first_rank")).withColumn("mean_rank", F.round("mean_rank", 9))


@query("e29_complete_cases", "SELECT l_orderkey AS case_id, count(DISTINCT l_returnflag) AS captured, count(DISTINCT l_returnflag) = 3 AS complete FROM lineitem GROUP BY ALL")
def e29(t: Tables):
    return E.complete_cases(t("lineitem").selectExpr("l_orderkey case_id", "l_returnflag arm"), 3)


@query("e30_source_fidelity", "SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN 'missing' WHEN doc_id % 9 = 0 THEN 'extra' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'equal' END AS status FROM documents WHERE NOT (doc_id % 8 = 0 AND doc_id % 9 = 0)")
def e30(t: Tables):
    d = t.docs()
    stored = d.where("id % 8 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return E.source_fidelity(d.where("id % 9 <> 0"), stored)


@query("e31_range_checks", "SELECT event_type AS channel, count(*) AS rows, CAST(sum((value NOT BETWEEN 1 AND 40 + length(event_type))::INT) AS BIGINT) AS outside, bool_and(value BETWEEN 1 AND 40 + length(event_type)) AS within FROM events GROUP BY ALL")
def e31(t: Tables):
    e = t("events").selectExpr("event_id id", "event_type channel", "value")
    return E.range_checks(e, e.select("channel").distinct().selectExpr("channel", "1.0D low", "cast(40 + length(channel) as double) high"))


@query("e32_duplicate_relations", "SELECT case_id, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT l_suppkey AS case_id, l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY case_id")
def e32(t: Tables):
    return E.duplicate_relations(t("lineitem").selectExpr("l_suppkey case_id", "l_returnflag", "l_linenumber"), ["l_returnflag", "l_linenumber"])


@query("e33_label_audit", "SELECT sha256(text) AS sha, count(*) AS rows, count(DISTINCT source) AS labels, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def e33(t: Tables):
    return E.label_audit(t("documents").selectExpr("doc_id id", "text", "source label"))


@query("e34_hash_audit", "SELECT doc_id AS id, CASE WHEN r = sha256(text) THEN 'raw' WHEN r = sha256(trim(text)) THEN 'trimmed' WHEN r = sha256(lower(text)) THEN 'lower' ELSE 'none' END AS rule FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(lower(text)) ELSE 'x' END AS r FROM documents)")
def e34(t: Tables):
    r = F.when(F.col("id") % 3 == 0, F.sha2("text", 256)).when(F.col("id") % 3 == 1, F.sha2(F.lower("text"), 256)).otherwise("x")
    return E.hash_audit(t.docs().withColumn("recorded", r))
