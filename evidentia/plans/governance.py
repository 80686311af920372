"""Queries of response governance."""

from pyspark.sql import functions as F

from ..operators import governance as G
from .registry import COS, Tables, query

_RULES = "ru AS (SELECT 'code' || (n_nationkey % 4) AS code, n_nationkey AS state_id, ['the', 'that', 'ation', 'ther', 'of the', 'erea', 'und '][n_nationkey % 7 + 1] AS phrase FROM nation)"


def rules(t: Tables):
    return t("nation").selectExpr("concat('code', cast(n_nationkey % 4 as string)) code", "n_nationkey state_id", "element_at(array('the', 'that', 'ation', 'ther', 'of the', 'erea', 'und '), n_nationkey % 7 + 1) phrase")


def responses(t: Tables):
    return t("conversations").where("role = 'assistant'").selectExpr("conv_id * 1000 + turn response_id", "text")


_HITS = f"{_RULES}, h AS (SELECT DISTINCT conv_id * 1000 + turn AS response_id, code, state_id FROM conversations, ru WHERE role = 'assistant' AND length(phrase) >= 4 AND contains(lower(text), phrase))"


@query("r1_rule_hits", f"WITH {_HITS} SELECT * FROM h")
def r1(t: Tables):
    return G.rule_hits(responses(t), rules(t))


@query("r2_ledger_hits", """SELECT l_orderkey AS response_id, code, l_partkey AS state_id FROM lineitem, (SELECT unnest(['scope_mismatch', 'asserted_candidate', 'stale_evidence', 'supersession_without_reason', 'ignored_dependency']) AS code)
 WHERE (code = 'scope_mismatch' AND l_suppkey % 10 = 0) OR (code = 'asserted_candidate' AND l_returnflag = 'N' AND l_quantity > 40) OR (code = 'stale_evidence' AND l_linenumber % 3 < l_linenumber % 2) OR (code = 'supersession_without_reason' AND l_linestatus = 'F' AND l_partkey % 6 = 0) OR (code = 'ignored_dependency' AND l_partkey % 8 = 0 AND l_suppkey % 2 = 0)""")
def r2(t: Tables):
    m = t("lineitem").selectExpr("l_orderkey response_id", "l_partkey state_id", "if(l_suppkey % 10 = 0, 'a', 'b') scope", "'b' asked_scope", "if(l_returnflag = 'N', 'candidate', 'active') status", "l_quantity > 40 asserted", "l_linenumber % 3 evidence_version", "l_linenumber % 2 version", "if(l_linestatus = 'F', 1, null) superseded_by", "if(l_partkey % 6 = 0, ' ', 'why') reason", "l_partkey % 8 = 0 has_dependency", "l_suppkey % 2 <> 0 dependency_mentioned")
    return G.ledger_hits(m)


@query("r3_interventions", f"WITH {_HITS} SELECT response_id, count(*) AS findings, CASE WHEN bool_or(code = 'code1') THEN 'conflict' ELSE 'review' END AS state FROM h GROUP BY response_id")
def r3(t: Tables):
    policy = t.spark.createDataFrame([(f"code{i}", "blocking" if i == 1 else "review", 0.9) for i in range(4)], "code string, severity string, confidence double")
    return G.interventions(G.rule_hits(responses(t), rules(t)), policy)[1]


@query("r4_guardrail_hits", f"WITH p AS (SELECT a.vec_id AS anchor_id, v.vec_id AS span_id, {COS.format(a='a.embedding', b='v.embedding')} AS score FROM embeddings a, embeddings v WHERE a.vec_id % 50 = 0 AND a.vec_id % 100 <> 0 AND v.vec_id <> a.vec_id) SELECT anchor_id, span_id, score, 'review' AS state FROM p WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, span_id) = 1")
def r4(t: Tables):
    v = t.vectors()
    anchors = v.where("id % 50 = 0").selectExpr("id anchor_id", "embedding")
    return G.guardrail_hits(v.selectExpr("id span_id", "embedding"), anchors, anchors.where("anchor_id % 100 = 0").select("anchor_id"), 0.2, own_rows=True)


@query("r5_guardrail_anchors", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority[1] IN ('1', '2') AND o_orderstatus = 'O' AND o_custkey % 3 <> 0 AND o_custkey % 5 <> 0")
def r5(t: Tables):
    o = t("orders").selectExpr("o_orderkey id", "case substring(o_orderpriority, 1, 1) when '1' then 'constraint' when '2' then 'decision' else 'note' end type", "if(o_orderstatus = 'O', 'active', 'closed') status", "if(o_custkey % 3 = 0, 'model', 'user') authority", "o_custkey % 5 <> 0 in_scope")
    return G.guardrail_anchors(o).select("id")


@query("r6_resolve_findings", "WITH a AS (SELECT l_orderkey AS f, arg_max(l_returnflag, (l_linenumber, l_partkey * 1000 + l_suppkey)) AS s FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL) SELECT o_custkey AS project_id, count(*) AS findings, CAST(sum((coalesce(CASE s WHEN 'R' THEN 'open' WHEN 'A' THEN 'dismissed' WHEN 'N' THEN 'fixed' END, 'open') = 'open')::INT) AS BIGINT) AS open FROM orders LEFT JOIN a ON f = o_orderkey GROUP BY o_custkey")
def r6(t: Tables):
    actions = t("lineitem").where("l_linenumber > 3").selectExpr("l_orderkey finding_id", "case l_returnflag when 'R' then 'open' when 'A' then 'dismissed' else 'fixed' end status", "l_linenumber at", "l_partkey * 1000 + l_suppkey action_id")
    return G.resolve_findings(t("orders").selectExpr("o_orderkey finding_id", "o_custkey project_id"), actions)


@query("r7_review_precision", "SELECT l_returnflag AS code, count(*) AS n, CAST(sum((l_partkey % 3 <> 0)::INT) AS BIGINT) AS reviewed, round(sum((l_partkey % 3 <> 0)::INT) / count(*), 9) AS coverage, round(sum((l_partkey % 3 = 1)::INT) / nullif(sum((l_partkey % 3 <> 0)::INT), 0), 9) AS precision FROM lineitem GROUP BY ALL")
def r7(t: Tables):
    labels = t("lineitem").selectExpr("l_returnflag code", "case l_partkey % 3 when 0 then null when 1 then 'right' else 'wrong' end verdict")
    return G.review_precision(labels).withColumns({"coverage": F.round("coverage", 9), "precision": F.round("precision", 9)})


@query("r8_rules_from_packets", "SELECT CASE role WHEN 'user' THEN 'R1' ELSE 'R2' END AS code, conv_id * 1000 + turn AS state_id, lower(trim(regexp_replace(substring(text, 1, 40), '^[A-Za-z]+:', ''), ' ')) AS phrase FROM conversations WHERE role IN ('user', 'assistant')")
def r8(t: Tables):
    items = t("conversations").selectExpr("conv_id * 1000 + turn state_id", "role section", "substring(text, 1, 40) text")
    return G.rules_from_packets(items, {"user": "R1", "assistant": "R2"})
