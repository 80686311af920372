"""Queries of sources and sinks, on tables in place of files."""

from pyspark.sql import functions as F

from .. import sources as S
from .registry import Tables, query


@query("s1_repeated_ids", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def s1(t: Tables):
    return S.repeats(t("orders"), "o_custkey")


@query("s2_registry", "WITH r AS (SELECT CAST(p_partkey // 2 AS VARCHAR) AS id, CASE WHEN p_partkey % 12 = 1 THEN 'other' ELSE 'part' END AS kind, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS label FROM part), k AS (SELECT id, count(DISTINCT kind) AS kinds FROM r GROUP BY ALL) SELECT id, kind, label, CASE WHEN label = '' THEN 'missing_field' WHEN kinds > 1 THEN 'two_kinds' END AS reason FROM r JOIN k USING (id)")
def s2(t: Tables):
    ok, bad = S.split_registry(t("part").selectExpr("cast(p_partkey div 2 as string) id", "if(p_partkey % 12 = 1, 'other', 'part') kind", "if(p_partkey % 9 = 0, '', p_name) label"))
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query("s3_ingest_documents", """WITH x AS (SELECT DISTINCT substring(sha256(text), 1, 16) AS document_id, CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE sha256(text) END AS known FROM documents WHERE doc_id % 5 = 0 AND doc_id = (SELECT min(d.doc_id) FROM documents d WHERE d.text = documents.text)),
 n AS (SELECT doc_id AS seq, substring(sha256(text), 1, 16) AS document_id, sha256(text) AS sha, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents)
 SELECT seq, document_id, CASE WHEN known = sha THEN 'duplicate' WHEN known IS NOT NULL THEN 'conflict' WHEN nth > 1 THEN 'duplicate' ELSE 'insert' END AS decision FROM n LEFT JOIN x USING (document_id)""")
def s3(t: Tables):
    d = t("documents").select(F.col("doc_id").alias("seq"), "text")
    first = d.groupBy("text").agg(F.min("seq").alias("seq")).where("seq % 5 = 0")
    existing = first.select(F.substring(F.sha2("text", 256), 1, 16).alias("document_id"), F.when(F.col("seq") % 10 == 0, "other").otherwise(F.sha2("text", 256)).alias("content_sha256"))
    return S.ingest_documents(d, existing)


@query("s4_gate_documents", "SELECT page_id AS id, CASE WHEN page_id % 9 = 0 THEN 'name' WHEN page_id % 7 = 0 THEN 'media_type' WHEN trim(html) = '' THEN 'empty' WHEN length(html) > 1500 THEN 'too_long' ELSE 'accepted' END AS reason FROM pages")
def s4(t: Tables):
    return S.gate_documents(t("pages").selectExpr("page_id id", "if(page_id % 9 = 0, ' ', url) name", "html text", "if(page_id % 7 = 0, 'image/png', 'text/html') media_type"), ["text/html", "text/plain"], 1500)


@query("s5_slice_passages", """WITH pg AS (SELECT doc_id, unnest(string_split(replace(text, 'and', chr(12)), chr(12))) AS body, unnest(range(len(string_split(replace(text, 'and', chr(12)), chr(12))))) AS page FROM documents),
 o AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_offset FROM pg)
 SELECT doc_id, page * 10 AS passage, CAST(page AS INTEGER) AS page, CAST(page_offset AS BIGINT) AS page_offset, sha256(array_to_string(string_split(body, chr(10))[1:2], chr(10))) AS sha FROM o WHERE page < 3""")
def s5(t: Tables):
    texts = t("documents").select("doc_id", F.replace("text", F.lit("and"), F.lit("\f")).alias("text"))
    plan = texts.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page")).selectExpr("doc_id", "cast(page * 10 as bigint) passage", "page", "0 line_start", "2 line_end")
    return S.slice_passages(texts, plan).select("doc_id", "passage", "page", "page_offset", "sha")


@query("s6_through_parent", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 0)")
def s6(t: Tables):
    projects = t("customer").where("c_custkey % 50 = 0").selectExpr("c_custkey project_id")
    return S.through_parent(t("lineitem").selectExpr("l_orderkey key", "l_linenumber"), t("orders").selectExpr("o_orderkey key", "o_custkey project_id"), "key", projects).selectExpr("key l_orderkey", "l_linenumber")


@query("s7_write_manifest")
def s7(t: Tables):
    """Digests of the files that hold the documents."""
    files = S.write_manifest(t.spark, f"{t.sf_dir}/documents.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "sha256")


@query("s10_messages", """SELECT CASE WHEN conv_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split, conv_id, turn, question, answer FROM (SELECT *, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE answer IS NOT NULL""")
def s10(t: Tables):
    from pyspark.sql import Window

    asked = t("conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("answer is not null")
    split = F.when(F.col("conv_id") % 10 == 0, "eval").otherwise("train")
    key = F.concat_ws(":", split, "conv_id", "turn")
    made = S.messages(asked.select(key.alias("split"), F.col("text").alias("question"), "answer"))
    part = F.split("split", ":")
    return made.select(part[0].alias("split"), part[1].cast("long").alias("conv_id"), part[2].cast("int").alias("turn"), F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@query("s8_verify_manifest", "SELECT p_name || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'unexpected' WHEN p_partkey % 3 = 0 THEN 'checksum_mismatch' ELSE 'ok' END AS status FROM part WHERE p_partkey % 35 <> 0")
def s8(t: Tables):
    p = t("part").selectExpr("concat(p_name, cast(p_partkey as string)) path", "sha2(p_name, 256) sha256", "p_partkey k")
    return S.verify_manifest(p.where("k % 7 <> 0"), p.where("k % 5 <> 0").withColumn("sha256", F.when(F.col("k") % 3 == 0, "x").otherwise(F.col("sha256"))))


@query("s9_import_project", "SELECT o_custkey AS project_id, o_orderkey AS old_id, (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 2 = 1) + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS audit_id FROM orders WHERE o_custkey % 2 = 0")
def s9(t: Tables):
    o = t("orders").selectExpr("o_custkey project_id", "o_orderkey audit_id", "o_orderkey old_id")
    return S.import_project(o.where("project_id % 2 = 0"), o.where("project_id % 2 = 1"))[0]


@query("s11_events_after", "SELECT event_id, user_id FROM events WHERE event_id > 1234 ORDER BY event_id LIMIT 500")
def s11(t: Tables):
    return S.events_after(t("events"), 1234, 500).select("event_id", "user_id")


@query("s12_validate_labels", """SELECT doc_id // 2 * 2 AS passage_id, CASE WHEN doc_id % 20 < 2 THEN 'repeated_id' WHEN doc_id % 7 = 0 THEN 'hash' WHEN doc_id % 6 = 0 THEN 'provenance' END AS violation FROM documents WHERE doc_id % 2 = 0 OR doc_id % 20 = 1""")
def s12(t: Tables):
    d = t("documents").where("doc_id % 2 = 0 or doc_id % 20 = 1")
    return S.validate_labels(d.selectExpr("doc_id div 2 * 2 passage_id", "text source_text", "if(doc_id % 7 = 0, 'x', sha2(text, 256)) source_sha256", "source note", "if(doc_id % 6 = 0, ' ', 'p') provenance"))
