"""Queries of projections, filters and integrity checks."""

from pyspark.sql import functions as F

from ..operators import integrity as I
from .registry import Tables, query

_DOCS = "d AS (SELECT doc_id, text, doc_id * 7 % 1009 AS ingested_tick, CASE WHEN doc_id % 6 = 0 THEN doc_id END AS tombstoned_at FROM documents)"


def library(t: Tables):
    return t("documents").selectExpr("doc_id", "text", "doc_id * 7 % 1009 ingested_tick", "if(doc_id % 6 = 0, doc_id, null) tombstoned_at")


@query("f1_active_chunks", f'WITH {_DOCS} SELECT doc_id, i AS idx, i * 500 AS start, least((i + 1) * 500, length(text)) AS "end", ingested_tick, sha256(substring(text, i * 500 + 1, least((i + 1) * 500, length(text)) - i * 500)) AS sha FROM (SELECT *, unnest(range(0, length(text) // 500 + 1)) AS i FROM d WHERE tombstoned_at IS NULL)')
def f1(t: Tables):
    chunks = t("documents").selectExpr("doc_id", "length(text) n", "explode(sequence(0L, length(text) div 500)) idx").selectExpr("doc_id", "idx", "idx * 500 start", "least((idx + 1) * 500, n) end")
    return I.active_chunks(library(t), chunks).select("doc_id", "idx", "start", "end", "ingested_tick", F.sha2("text", 256).alias("sha"))


@query("f2_withdraw", f"WITH {_DOCS} SELECT doc_id, coalesce(tombstoned_at, CASE WHEN doc_id % 4 = 0 THEN doc_id + 5 END) AS tombstoned_at, tombstoned_at IS NULL AND doc_id % 4 = 0 AS withdrawn_now FROM d")
def f2(t: Tables):
    requests = t("documents").where("doc_id % 4 = 0").selectExpr("doc_id", "explode(array(doc_id + 9, doc_id + 5)) at")
    return I.withdraw(library(t).drop("text"), requests)


@query("f3_with_prefix", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000')")
def f3(t: Tables):
    return I.with_prefix(t("customer"), "c_name", "Customer#00000").select("c_custkey", "c_name")


@query("f4_gate_candidates", """SELECT o_orderkey % 7 AS request_id, l_orderkey * 10 + l_linenumber AS candidate_id, CASE WHEN l_partkey % 9 = 0 THEN 'cross_project' WHEN l_suppkey % 8 = 0 THEN 'cross_workstream' WHEN l_returnflag = 'R' AND o_orderkey % 7 < 3 THEN 'privacy' WHEN l_discount * 10 < 0.05::DOUBLE THEN 'low_integrity' WHEN l_linestatus = 'F' THEN 'superseded' WHEN l_quantity > 45 THEN 'archived' ELSE 'pass' END AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def f4(t: Tables):
    li = t("lineitem").selectExpr("l_orderkey % 7 request_id", "l_orderkey * 10 + l_linenumber candidate_id", "if(l_partkey % 9 = 0, 'q', 'p') project", "if(l_suppkey % 8 = 0, 'x', 'w') workstream", "l_returnflag = 'R' private", "l_discount * 10 integrity", "case when l_linestatus = 'F' then 'superseded' when l_quantity > 45 then 'archived' else 'active' end status", "l_orderkey")
    li = li.join(t("orders").selectExpr("o_orderkey l_orderkey"), "l_orderkey", "left_semi")
    requests = t.spark.range(7).selectExpr("id request_id", "'p' want_project", "'w' want_workstream", "id >= 3 may_see_private")
    return I.gate_candidates(li, F.broadcast(requests), 0.05)


@query("f5_assign_section", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 11 = 0 THEN 'authority' WHEN o_orderpriority LIKE '1%' THEN 'constraints' WHEN o_orderpriority LIKE '2%' AND o_orderstatus = 'O' THEN 'decisions' WHEN o_orderstatus = 'F' THEN 'history' ELSE 'evidence' END AS section, o_custkey % 11 = 0 OR (o_orderpriority LIKE '1%' AND o_orderstatus = 'O') AS mandatory FROM orders""")
def f5(t: Tables):
    rows = t("orders").selectExpr("o_orderkey id", "if(o_custkey % 11 = 0, 'pinned', 'pool') pool", "case substring(o_orderpriority, 1, 1) when '1' then 'constraint' when '2' then 'decision' else 'note' end type", "case o_orderstatus when 'O' then 'active' when 'F' then 'superseded' else 'open' end status")
    return I.assign_section(rows).select("id", "section", "mandatory")


@query("f6_redact", "SELECT doc_id, lang, source, n_chars FROM documents")
def f6(t: Tables):
    return I.redact(t("documents"), ["doc_id", "lang", "source", "n_chars", "not_there"])


@query("f7_check_spans", """SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'no_text' WHEN doc_id % 5 = 0 THEN 'bounds' WHEN length(text) < 30 THEN 'bounds' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS reason FROM documents""")
def f7(t: Tables):
    spans = t("documents").selectExpr("doc_id id", "doc_id", "if(doc_id % 5 = 0, 9, 10) start", "if(doc_id % 5 = 0, 9, 30) end", "if(doc_id % 7 = 0, '#', substring(text, 11, 20)) quote")
    return I.check_spans(spans, t("documents").where("doc_id % 13 <> 0"))


_QUOTES = "q AS (SELECT doc_id AS id, doc_id, CASE WHEN doc_id % 10 = 0 OR length(text) < 60 THEN '#@!' ELSE substring(text, CAST(doc_id % 40 + 1 AS BIGINT), 5) END AS quote, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 300 END AS hint, text FROM documents)"


#: the only place within the anchor, a document's first 150 characters, where the hint decides nothing
@query("f8_bind_quotes", f"""WITH {_QUOTES}, o AS (SELECT id, hint, length(quote) AS size, unnest(list_filter(range(0, length(text) - length(quote) + 1), lambda i: substring(text, i + 1, length(quote)) = quote)) AS place FROM q),
 n AS (SELECT *, abs(place - hint) = min(abs(place - hint)) OVER (PARTITION BY id) AS near, place + size <= 150 AS inside FROM o), g AS (SELECT id, count(*) AS n, count(*) FILTER (near) AS k, count(*) FILTER (inside) AS a, min(place) AS sole, min(place) FILTER (near) AS hinted, min(place) FILTER (inside) AS anchored FROM n GROUP BY id)
 SELECT q.id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' WHEN k = 1 THEN 'hinted' WHEN a = 1 THEN 'anchored' ELSE 'ambiguous' END AS status, CAST(CASE WHEN n = 1 THEN sole WHEN k = 1 THEN hinted WHEN a = 1 THEN anchored END AS INTEGER) AS start FROM q LEFT JOIN g ON g.id = q.id""")
def f8(t: Tables):
    d = t("documents")
    quotes = d.selectExpr("doc_id id", "doc_id", "if(doc_id % 10 = 0 or length(text) < 60, '#@!', substring(text, cast(doc_id % 40 + 1 as int), 5)) quote", "if(doc_id % 3 = 0, null, doc_id % 300) hint")
    return I.bind_quotes(quotes, d, d.selectExpr("doc_id id", "0 start", "150 end"))


@query("f9_validate_candidates", """WITH e AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey % 10 AS id FROM lineitem WHERE l_linenumber <> 3), e2 AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE chunk % 50 = 0 AND id = 1),
 r AS (SELECT l_orderkey AS chunk, l_linenumber AS id, l_partkey % 10 AS source, l_suppkey % 10 AS target, l_returnflag AS kind, l_discount * 11 AS confidence FROM lineitem)
 SELECT chunk, CAST(id AS VARCHAR) AS id, 'duplicate_entity' AS violation FROM e2 GROUP BY chunk, id HAVING count(*) > 1
 UNION ALL SELECT DISTINCT chunk, CAST(id AS VARCHAR), 'unknown_endpoint' FROM (SELECT chunk, id, source AS x FROM r UNION ALL SELECT chunk, id, target FROM r) z WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE e2.chunk = z.chunk AND e2.id = z.x)
 UNION ALL SELECT chunk, CAST(id AS VARCHAR), 'equal_endpoints' FROM r WHERE source = target UNION ALL SELECT chunk, CAST(id AS VARCHAR), 'unknown_kind' FROM r WHERE kind = 'N' UNION ALL SELECT chunk, CAST(id AS VARCHAR), 'confidence' FROM r WHERE confidence > 1
 UNION ALL SELECT chunk, '-1', 'too_many' FROM r GROUP BY chunk HAVING count(*) > 6""")
def f9(t: Tables):
    li = t("lineitem")
    e = li.where("l_linenumber <> 3").selectExpr("l_orderkey chunk", "l_partkey % 10 id").distinct()
    r = li.selectExpr("l_orderkey chunk", "l_linenumber id", "l_partkey % 10 source", "l_suppkey % 10 target", "l_returnflag kind", "l_discount * 11 confidence")
    return I.validate_candidates(e.unionByName(e.where("chunk % 50 = 0 and id = 1")), r, ["A", "R"], 6)


@query("f10_validate_vectors", "SELECT vec_id AS id, CASE vec_id % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'dimension' WHEN 2 THEN 'norm' ELSE 'ok' END AS reason FROM embeddings")
def f10(t: Tables):
    v = t.vectors().withColumn("embedding", F.when(F.col("id") % 9 == 1, F.slice("embedding", 1, 60)).when(F.col("id") % 9 == 2, F.transform("embedding", lambda x: x * 2)).when(F.col("id") % 9 != 0, F.col("embedding")))
    return I.validate_vectors(v, 64, 1e-3)


@query("f11_policy_violations", """WITH r AS (SELECT user_id AS record_id, event_type AS channel, min(value - 1) AS value, count(*) % 3 AS support, CASE WHEN count(*) % 5 = 0 THEN 'absent' END AS zero_kind FROM events GROUP BY ALL), e AS (SELECT * FROM (SELECT DISTINCT record_id FROM r), (SELECT unnest(['click', 'view', 'error', 'refund']) AS channel)),
 p AS (SELECT record_id, channel, CASE WHEN value IS NULL THEN 'missing' WHEN value < 0 THEN 'negative' WHEN value > 0 AND support = 0 THEN 'unsupported' WHEN value > 0 AND zero_kind IS NOT NULL THEN 'zero_kind_on_positive' WHEN value = 0 AND zero_kind IS NULL THEN 'zero_kind_refused' END AS problem FROM e LEFT JOIN r USING (record_id, channel)) SELECT * FROM p WHERE problem IS NOT NULL""")
def f11(t: Tables):
    r = t("events").groupBy(F.col("user_id").alias("record_id"), F.col("event_type").alias("channel")).agg(F.min(F.col("value") - 1).alias("value"), (F.count(F.lit(1)) % 3).alias("support"), F.when(F.count(F.lit(1)) % 5 == 0, "absent").alias("zero_kind"))
    return I.policy_violations(r, t.spark.createDataFrame([("click",), ("view",), ("error",), ("refund",)], "channel string"))


@query("f12_inflight_violations", "SELECT o_custkey AS project_id, count(*) AS in_flight FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL HAVING count(*) > 1")
def f12(t: Tables):
    return I.inflight_violations(t("orders").selectExpr("o_custkey project_id", "if(o_orderstatus = 'P', 'sending', 'done') status"))


@query("f13_digest_and_uuid", "WITH d AS (SELECT doc_id, sha256(doc_id || '|' || lang || '|' || source) AS digest FROM documents) SELECT doc_id, digest, substring(digest, 1, 8) || '-' || substring(digest, 9, 4) || '-' || substring(digest, 13, 4) || '-' || substring(digest, 17, 4) || '-' || substring(digest, 21, 12) AS uuid FROM d")
def f13(t: Tables):
    cols = ["doc_id", "lang", "source"]
    return I.with_uuid(I.with_digest(t("documents"), cols), cols).select("doc_id", "digest", "uuid")


@query("f14_check_twins", "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'hash' ELSE 'content' END AS violation FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0")
def f14(t: Tables):
    lib = t.docs().where("id % 10 <> 0").withColumn("content_hash", F.when(F.col("id") % 7 == 0, "x").otherwise(F.sha2("text", 256)))
    return I.check_twins(t.docs().withColumn("text", F.when(F.col("id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), lib)
