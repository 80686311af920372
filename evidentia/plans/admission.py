"""Queries of admission."""

from pyspark.sql import functions as F

from ..operators import admission as A
from .registry import Tables, query

_C = """c AS (SELECT o_orderkey % 40 AS request_id, l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS semantic, l_discount * 10 AS structural, l_tax * 12 AS sequence, CASE WHEN l_returnflag = 'R' THEN 1.5 ELSE 0.5 END::DOUBLE AS authority, l_linenumber / 7 AS recency, CASE WHEN l_linestatus = 'F' THEN 0.3 ELSE 0 END::DOUBLE AS stale, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 0.1 END::DOUBLE AS conflict, (l_suppkey % 5) / 5 AS redundant, CASE WHEN l_partkey % 4 = 0 THEN 1.0::DOUBLE / (60 + l_linenumber) END AS rrf, l_partkey % 400 + 20 AS size, l_partkey % 50 = 0 AS mandatory, CASE l_suppkey % 5 WHEN 0 THEN 'authority' WHEN 1 THEN 'constraints' WHEN 2 THEN 'decisions' WHEN 3 THEN 'evidence' ELSE 'history' END AS section, l_suppkey % 5 AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_CL = lambda c: f"greatest(0, least(1, coalesce({c}, 0)))"
_S = f"""s AS (SELECT *, round(CASE WHEN rrf IS NOT NULL THEN greatest(0, least(1, 61 * rrf)) * 0.55::DOUBLE ELSE {_CL('semantic')} * 0.25::DOUBLE + {_CL('structural')} * 0.30::DOUBLE END + {_CL('sequence')} * 0.15::DOUBLE + {_CL('authority')} * 0.20::DOUBLE + {_CL('recency')} * 0.10::DOUBLE + {_CL('stale')} * -0.45::DOUBLE + {_CL('conflict')} * -0.40::DOUBLE + {_CL('redundant')} * -0.20::DOUBLE, 9) AS score FROM c)"""


def candidates(t: Tables):
    li = t("lineitem").join(t("orders").selectExpr("o_orderkey l_orderkey"), "l_orderkey", "left_semi")
    return li.selectExpr(
        "l_orderkey % 40 request_id", "l_orderkey * 10 + l_linenumber id", "l_quantity / 50 semantic", "l_discount * 10 structural", "l_tax * 12 sequence", "if(l_returnflag = 'R', 1.5D, 0.5D) authority", "l_linenumber / 7 recency",
        "if(l_linestatus = 'F', 0.3D, 0D) stale", "if(l_partkey % 9 = 0, null, 0.1D) conflict", "(l_suppkey % 5) / 5 redundant", "if(l_partkey % 4 = 0, 1D / (60 + l_linenumber), null) rrf", "l_partkey % 400 + 20 size", "l_partkey % 50 = 0 mandatory",
        "case l_suppkey % 5 when 0 then 'authority' when 1 then 'constraints' when 2 then 'decisions' when 3 then 'evidence' else 'history' end section",
    )


@query("a1_score_candidates", f"WITH {_C}, {_S} SELECT request_id, id, score FROM s")
def a1(t: Tables):
    return A.score_candidates(candidates(t)).select("request_id", "id", "score")


@query("a2_collapse_duplicates", "WITH d AS (SELECT doc_id % 5 AS request_id, doc_id AS id, trim(regexp_replace(CASE WHEN doc_id % 50 = 0 THEN ' ' ELSE text END, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS body FROM documents) SELECT request_id, id, CASE WHEN body = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY request_id, body ORDER BY id) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM d")
def a2(t: Tables):
    return A.collapse_duplicates(t("documents").selectExpr("doc_id % 5 request_id", "doc_id id", "doc_id seq", "if(doc_id % 50 = 0, ' ', text) text"))


_P = "p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY mandatory DESC, place, score DESC, id) AS nth FROM s)"
_ADMIT = f"""{_C}, {_S}, {_P}, f AS (SELECT request_id, 0::BIGINT AS id, 0::BIGINT AS nth, 0::BIGINT AS used, '' AS decision FROM (SELECT DISTINCT request_id FROM p)
 UNION ALL SELECT f.request_id, p.id, p.nth, f.used + CASE WHEN p.mandatory OR f.used + p.size <= 2000 THEN p.size ELSE 0 END, CASE WHEN p.mandatory THEN 'mandatory' WHEN f.used + p.size <= 2000 THEN 'admitted' ELSE 'budget' END FROM f JOIN p ON p.request_id = f.request_id AND p.nth = f.nth + 1)"""


@query("a3_admit", f"WITH RECURSIVE {_ADMIT} SELECT request_id, id, decision FROM f WHERE nth > 0")
def a3(t: Tables):
    return A.admit(A.score_candidates(candidates(t)))


_HEADER = "list_extract([16, 21, 19, 14, 71, 41, 23, 17, 24, 18, 17], CAST(doc_id % 11 AS INT) + 1)"


@query("a3_admit_rendered", f"""WITH RECURSIVE c AS (SELECT doc_id % 200 AS request_id, 'doc-' || doc_id AS id, (doc_id * 37 % 101) / 100 AS score, doc_id % 11 AS place, doc_id % 40 = 0 OR doc_id % 11 IN (0, 2, 4) AS mandatory,
  length(coalesce(text, '')) + length('doc-' || doc_id) + {_HEADER} + 14 + CASE WHEN doc_id % 3 = 0 THEN length(coalesce(source, 'not supplied')) + 18 ELSE 0 END AS cost, doc_id % 3 = 0 AS document FROM documents),
 r AS (SELECT request_id, 4 * CASE WHEN request_id % 25 = 0 THEN 500 ELSE least(request_id % 25 * 400, CASE WHEN request_id % 2 = 0 THEN 9000 ELSE 1200 END) END - 650 - length('project ' || request_id) - 4 - CASE WHEN bool_or(document) THEN 400 ELSE 0 END AS room FROM c GROUP BY request_id),
 p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY mandatory DESC, place, score DESC, id) AS nth FROM c JOIN r USING (request_id)),
 f AS (SELECT request_id, '' AS id, 0::BIGINT AS nth, 0::BIGINT AS used, '' AS decision, 0::BIGINT AS cost FROM r
  UNION ALL SELECT f.request_id, p.id, p.nth, f.used + CASE WHEN p.mandatory OR f.used + p.cost <= room THEN p.cost ELSE 0 END, CASE WHEN p.mandatory THEN 'mandatory' WHEN f.used + p.cost <= room THEN 'admitted' ELSE 'budget' END, p.cost FROM f JOIN p ON p.request_id = f.request_id AND p.nth = f.nth + 1)
 SELECT request_id, id, decision, cost FROM f WHERE nth > 0""")
def a3_rendered(t: Tables):
    names = ", ".join(f"'{s}'" for s in A.HEADERS)
    c = t("documents").selectExpr("doc_id % 200 request_id", "concat('doc-', doc_id) id", "text", f"array({names})[cast(doc_id % 11 as int)] section", "(doc_id * 37 % 101) / 100 score", "if(doc_id % 3 = 0, 'evidence', 'authoritative_state') pool", "'user' authority", "source provenance", "doc_id % 40 = 0 binding")
    r = c.select("request_id").distinct().selectExpr("request_id", "request_id % 25 * 400 budget_tokens", "if(request_id % 2 = 0, 'research', 'standard') profile", "concat('project ', request_id) project", "'main' workstream")
    return A.admit_rendered(c, r)


_DEPS = "ed AS (SELECT DISTINCT p_partkey AS a, (p_partkey * 7 + 3) % 2000 + 1 AS b FROM part WHERE p_partkey % 3 <> 0 UNION SELECT p_partkey, (p_partkey * 5 + 1) % 2000 + 1 FROM part WHERE p_partkey % 4 = 0 UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 40 = 0)"


@query("a4_close_dependencies", f"""WITH {_DEPS}, av AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 11 <> 0), l1 AS (SELECT p_partkey AS origin, a, b, 1 AS level, [p_partkey] AS path FROM part JOIN ed ON a = p_partkey),
 l2 AS (SELECT origin, ed.a, ed.b, 2 AS level, list_append(path, l1.b) AS path FROM l1 JOIN ed ON ed.a = l1.b WHERE NOT list_contains(path, l1.b) AND l1.b IN (SELECT id FROM av)), l3 AS (SELECT origin, ed.a, ed.b, 3 AS level, list_append(path, l2.b) AS path FROM l2 JOIN ed ON ed.a = l2.b WHERE NOT list_contains(path, l2.b) AND l2.b IN (SELECT id FROM av)),
 u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) SELECT origin, b AS id, CASE WHEN list_contains(path, b) THEN 'dependency-cycle' WHEN level > 2 THEN 'depth-cap' WHEN b NOT IN (SELECT id FROM av) THEN 'unavailable' ELSE 'added' END AS outcome, min(level) AS level FROM u GROUP BY ALL""")
def a4(t: Tables):
    p = t("part")
    return A.close_dependencies(p.selectExpr("p_partkey id"), dependencies(t), p.where("p_partkey % 11 <> 0").selectExpr("p_partkey id"))


def dependencies(t: Tables):
    p = t("part")
    return p.where("p_partkey % 3 <> 0").selectExpr("p_partkey a", "(p_partkey * 7 + 3) % 2000 + 1 b").union(p.where("p_partkey % 4 = 0").selectExpr("p_partkey", "(p_partkey * 5 + 1) % 2000 + 1")).union(p.where("p_partkey % 40 = 0").selectExpr("p_partkey", "p_partkey")).distinct()


@query("a4_fit_dependencies")
def a4b(t: Tables):
    p = t("part")
    selected = p.where("p_partkey % 3 = 0").selectExpr("p_partkey div 60 request_id", "p_partkey id")
    return A.fit_dependencies(selected, dependencies(t), p.where("p_partkey % 11 <> 0").selectExpr("p_partkey id", "p_size size", "p_partkey % 17 = 0 mandatory"), 700)


@query("a5_coverage_rows", "SELECT DISTINCT o_custkey AS request_id, 'not covered: ' || o_orderpriority AS text, true AS mandatory FROM orders WHERE o_orderstatus <> 'F'")
def a5(t: Tables):
    return A.coverage_rows(t("orders").selectExpr("o_custkey request_id", "o_orderpriority identifier", "if(o_orderstatus = 'F', 'resolved', 'unresolved') status"))


@query("a6_packet_digest", "SELECT o_custkey AS request_id, count(DISTINCT o_orderkey || '@' || o_orderstatus) AS entries, sha256(array_to_string(list_sort(list_distinct(list(o_orderkey || '@' || o_orderstatus))), ',')) AS digest FROM orders GROUP BY ALL")
def a6(t: Tables):
    return A.packet_digest(t("orders").selectExpr("o_custkey request_id", "o_orderkey id", "o_orderstatus version"))


@query("a7_packet_stats", "SELECT conv_id AS request_id, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(ceil(sum(length(text)) / 4) AS BIGINT) AS tokens, ceil(sum(length(text)) / 4) > 300 AS over_budget FROM conversations GROUP BY ALL")
def a7(t: Tables):
    return A.packet_stats(t("conversations").selectExpr("conv_id request_id", "length(text) size"), 300)


@query("a8_mark_admitted", f"WITH RECURSIVE {_ADMIT} SELECT c.request_id, c.id, f.decision, coalesce(f.decision IN ('mandatory', 'admitted'), false) AS admitted FROM (SELECT DISTINCT request_id, id FROM c) c LEFT JOIN (SELECT DISTINCT request_id, id, decision FROM f WHERE nth > 0) f USING (request_id, id)")
def a8(t: Tables):
    return A.mark_admitted(candidates(t).select("request_id", "id").distinct(), a3(t).distinct())


@query("a9_match_roles", """WITH q AS (SELECT o_orderkey AS query_id, unnest(['actor', 'status']) AS role, unnest([o_orderpriority, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END]) AS value FROM orders), s AS (SELECT o_custkey AS source_id, unnest(['actor', 'status']) AS role, unnest([min(o_orderpriority), max(o_orderstatus)]) AS value FROM orders GROUP BY o_custkey),
 n AS (SELECT query_id, count(*) AS need FROM q WHERE value IS NOT NULL GROUP BY ALL), g AS (SELECT query_id, source_id, count(*) AS got FROM q JOIN s USING (role, value) GROUP BY ALL), f AS (SELECT query_id, count(*) AS n, min(source_id) AS source_id FROM g JOIN n USING (query_id) WHERE got = need GROUP BY ALL)
 SELECT query_id, CASE WHEN n IS NULL THEN 'not_supported' WHEN n = 1 THEN 'supported' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN source_id END AS source_id FROM (SELECT DISTINCT query_id FROM q) LEFT JOIN f USING (query_id)""")
def a9(t: Tables):
    q = t("orders").selectExpr("o_orderkey query_id", "stack(2, 'actor', o_orderpriority, 'status', if(o_orderkey % 6 = 0, null, o_orderstatus)) as (role, value)")
    s = t("orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"), F.max("o_orderstatus").alias("s")).selectExpr("o_custkey source_id", "stack(2, 'actor', p, 'status', s) as (role, value)")
    return A.match_roles(q, s)


@query("a10_bind_sources", "WITH w AS (SELECT DISTINCT l_orderkey AS packet, l_suppkey AS source FROM lineitem) SELECT packet, count(*) AS wanted, CAST(sum((source % 10 <> 0)::INT) AS BIGINT) AS bound, bool_and(source % 10 <> 0) AS accepted FROM w GROUP BY packet")
def a10(t: Tables):
    w = t("lineitem").selectExpr("l_orderkey packet", "l_suppkey source").distinct()
    return A.bind_sources(w.where("source % 10 <> 0"), w)


@query("a11_resolve_sources", """WITH s AS (SELECT doc_id % 7 AS query_id, doc_id AS ref FROM documents UNION ALL SELECT doc_id % 7, doc_id FROM documents WHERE doc_id % 20 = 0) SELECT s.query_id, s.ref, CASE WHEN ref % 20 = 0 THEN 'repeated' WHEN ref % 9 = 0 THEN 'unregistered' WHEN ref % 8 = 0 THEN 'no_document' WHEN length(text) < 15 THEN 'bounds' WHEN ref % 5 = 0 THEN 'hash' END AS reason, CASE WHEN ref % 20 = 0 OR ref % 9 = 0 OR ref % 8 = 0 OR length(text) < 15 OR ref % 5 = 0 THEN NULL ELSE substring(text, 6, 10) END AS text FROM s JOIN documents ON doc_id = ref""")
def a11(t: Tables):
    d = t("documents")
    s = d.selectExpr("doc_id % 7 query_id", "doc_id ref")
    refs = d.where("doc_id % 9 <> 0").selectExpr("doc_id ref", "doc_id", "5 start", "15 end", "if(doc_id % 5 = 0, 'x', sha2(substring(text, 6, 10), 256)) sha")
    return A.resolve_sources(s.union(s.where("ref % 20 = 0")), refs, d.where("doc_id % 8 <> 0"))
