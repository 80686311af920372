"""Queries of the join shapes."""

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import Tables, query


@query("j1_equi", "SELECT l_orderkey, l_linenumber, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j1(t: Tables):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "l_quantity")


@query("j2_full_by_id", "SELECT coalesce(a.c_custkey, b.o_custkey) AS id, acct, n, CASE WHEN b.o_custkey IS NULL THEN 'left' WHEN a.c_custkey IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT c_custkey, c_acctbal AS acct FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) b ON a.c_custkey = b.o_custkey")
def j2(t: Tables):
    a = t("customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey id", "c_acctbal acct")
    return J.full_by_id(a, t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n")), ["id"])


@query("j3_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def j3(t: Tables):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j4_missing", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j4(t: Tables):
    return J.missing(t("customer").selectExpr("c_custkey id"), t("orders").where("o_orderstatus = 'P'").selectExpr("o_custkey id"), ["id"])


_SPANS = """a AS (SELECT doc_id, i AS id, i * 300 AS start, least(i * 300 + 350, length(text)) AS "end" FROM (SELECT *, unnest(range(0, length(text) // 300 + 1)) AS i FROM documents)),
 b AS (SELECT doc_id, i AS id, i * 470 AS start, i * 470 + 40 + (doc_id + i) % 900 AS "end" FROM (SELECT *, unnest(range(0, length(text) // 470 + 1)) AS i FROM documents))"""


def spans(t: Tables):
    d = t("documents")
    a = d.select("doc_id", F.length("text").alias("n"), F.explode(F.expr("sequence(0L, length(text) div 300)")).alias("id")).selectExpr("doc_id", "id", "id * 300 start", "least(id * 300 + 350, n) end")
    b = d.select("doc_id", F.explode(F.expr("sequence(0L, length(text) div 470)")).alias("id")).selectExpr("doc_id", "id", "id * 470 start", "id * 470 + 40 + (doc_id + id) % 900 end")
    return a, b


@query("j5_interval_overlap", f'WITH {_SPANS} SELECT a.doc_id, a.id, b.id AS b_id FROM a JOIN b ON a.doc_id = b.doc_id AND a.start < b."end" AND a."end" > b.start AND a."end" > a.start')
def j5(t: Tables):
    a, b = spans(t)
    return J.interval_join(a.where("end > start"), b, ["doc_id"]).select("doc_id", "id", "b_id")


@query("j6_innermost", f'WITH {_SPANS}, p AS (SELECT a.doc_id, a.id, b.id AS b_id, row_number() OVER (PARTITION BY a.doc_id, a.id ORDER BY b."end" - b.start, b.start, b.id) AS r FROM a JOIN b ON a.doc_id = b.doc_id AND a.start >= b.start AND a.start < b."end") SELECT doc_id, id, b_id FROM p WHERE r = 1')
def j6(t: Tables):
    a, b = spans(t)
    return J.innermost(a.selectExpr("doc_id", "id", "start at"), b, ["doc_id"]).select("doc_id", "id", "b_id")


@query("j7_asof", "SELECT o_custkey AS key, i AS instant_id, (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders f WHERE f.o_custkey = c.o_custkey AND f.o_orderdate <= TIMESTAMP '1993-01-01' + INTERVAL (i * 400) DAY) AS fact FROM (SELECT DISTINCT o_custkey FROM orders) c, (SELECT unnest(range(5)) AS i)")
def j7(t: Tables):
    o = t("orders").selectExpr("o_custkey key", "o_orderkey id", "o_orderdate at")
    instants = o.select("key").distinct().withColumn("instant_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("as_of", F.expr("timestamp '1993-01-01' + make_dt_interval(cast(instant_id * 400 as int))"))
    return J.asof(o, instants.withColumn("as_of", F.col("as_of").cast(dict(o.dtypes)["at"])), ["key"], "at", "as_of", "id").select("key", "instant_id", "fact")


@query("j8_latest_by", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def j8(t: Tables):
    return J.latest_by(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("j9_cross", "SELECT n_name, c_custkey FROM nation, customer")
def j9(t: Tables):
    return J.cross(t("customer").select("c_custkey"), t("nation").select("n_name"))


@query("j10_greedy_match", """WITH RECURSIVE p AS (SELECT l_orderkey AS case_id, l_partkey % 4 AS a, l_suppkey % 4 AS b, CAST(l_linenumber AS BIGINT) AS turn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 4, l_suppkey % 4) AS n FROM lineitem),
 w AS (SELECT case_id, n, a, b, turn, true AS free, [a] AS las, [b] AS rbs FROM p WHERE n = 1
  UNION ALL SELECT p.case_id, p.n, p.a, p.b, p.turn, f, CASE WHEN f THEN list_append(las, p.a) ELSE las END, CASE WHEN f THEN list_append(rbs, p.b) ELSE rbs END
   FROM (SELECT p.*, las, rbs, NOT list_contains(las, p.a) AND NOT list_contains(rbs, p.b) AS f FROM w JOIN p ON p.case_id = w.case_id AND p.n = w.n + 1) p)
 SELECT case_id, a AS "left", b AS "right", turn FROM w WHERE free""")
def j10(t: Tables):
    pairs = t("lineitem").selectExpr("l_orderkey case_id", "l_partkey % 4 left", "l_suppkey % 4 right", "cast(l_linenumber as bigint) turn")
    return J.greedy_match(pairs)


@query("j11_fixpoint", """WITH RECURSIVE n AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), e AS (SELECT * FROM n WHERE b IS NOT NULL),
 w AS (SELECT a AS origin, a AS last, 0 AS depth FROM n UNION ALL SELECT origin, e.b, depth + 1 FROM w JOIN e ON e.a = w.last)
 SELECT origin, arg_max(last, depth) AS last, CAST(max(depth) AS BIGINT) AS depth, false AS cycle FROM w GROUP BY origin""")
def j11(t: Tables):
    from pyspark.sql import Window

    o = t("orders").withColumn("b", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return J.fixpoint(o.selectExpr("o_orderkey origin"), o.where("b is not null").selectExpr("o_orderkey a", "b"))
