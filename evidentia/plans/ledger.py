"""Queries of the ledger."""

from pyspark.sql import functions as F

from ..functions import digest, sha
from ..operators import ledger as L
from .registry import LOG, Tables, query

_IN = "inc AS (SELECT user_id AS project_id, event_type || CAST(event_id % 40 AS VARCHAR) AS key, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS payload, event_id AS seq FROM events)"


@query("l1_append_events", f"""WITH {_IN}, k AS (SELECT project_id, key, arg_min(payload, seq) AS known FROM inc WHERE seq % 5 = 0 GROUP BY ALL),
 b AS (SELECT *, row_number() OVER w AS nth, first_value(payload) OVER w AS f FROM inc WHERE seq % 5 <> 0 WINDOW w AS (PARTITION BY project_id, key ORDER BY seq))
 SELECT project_id, key, seq, CASE WHEN known IS NULL AND nth = 1 THEN 'new' WHEN coalesce(known, f) IS NOT DISTINCT FROM payload THEN 'duplicate' ELSE 'conflict' END AS decision FROM b LEFT JOIN k USING (project_id, key)""")
def l1(t: Tables):
    rows = t("events").select(F.col("user_id").alias("project_id"), F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("key"), (F.floor("value") % 3).cast("string").alias("payload"), F.col("event_id").alias("seq"))
    return L.append_events(rows.where("seq % 5 = 0"), rows.where("seq % 5 <> 0"))


_VERSIONED = f"{LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, event_id) AS version FROM log)"


@query("l2_version_gaps", f"WITH {_VERSIONED}, b AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN version ELSE version - 1 END AS base_version, version - 1 AS expected FROM v) SELECT project_id, event_id, CAST(base_version AS INTEGER) AS base_version, CAST(expected AS INTEGER) AS expected FROM b WHERE base_version <> expected")
def l2(t: Tables):
    v = L.with_version(t.log())
    return L.version_gaps(v.withColumn("base_version", F.when(F.col("event_id") % 17 == 0, F.col("version")).otherwise(F.col("version") - 1)))


@query("l3_chain_breaks", f"""WITH {_VERSIONED}, d AS (SELECT *, sha256(project_id || '|' || event_id) AS r FROM v), p AS (SELECT *, lag(r) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS e FROM d)
 SELECT project_id, event_id FROM p WHERE (CASE WHEN event_id % 23 = 0 THEN 'x' ELSE e END) IS DISTINCT FROM e""")
def l3(t: Tables):
    from pyspark.sql import Window

    d = t.log().withColumn("resulting_digest", digest("project_id", "event_id"))
    prior = F.lag("resulting_digest").over(Window.partitionBy("project_id").orderBy("ts", "event_id"))
    return L.chain_breaks(d.withColumn("prior_digest", F.when(F.col("event_id") % 23 == 0, "x").otherwise(prior)))


_STATE = "SELECT project_id, object_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(kind, (ts, event_id)) AS kind"


@query("l4_replay", f"WITH {LOG} {_STATE}, arg_max(value, (ts, event_id)) AS value FROM log GROUP BY project_id, object_id")
def l4(t: Tables):
    return L.replay(t.log()).select("project_id", "object_id", "event_id", "kind", "value")


@query("l5_state_at", f"WITH {_VERSIONED} {_STATE} FROM v WHERE version <= 20 GROUP BY project_id, object_id")
def l5(t: Tables):
    return L.state_at(t.log(), 20).select("project_id", "object_id", "event_id", "kind")


@query("l5_state_diff", f"""WITH {_VERSIONED}, a AS ({_STATE} FROM v WHERE version <= 10 GROUP BY project_id, object_id), b AS ({_STATE} FROM v WHERE version <= 30 GROUP BY project_id, object_id)
 SELECT project_id, object_id, a.event_id AS old_event, b.event_id AS new_event, CASE WHEN a.event_id IS NULL THEN 'added' WHEN b.event_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (project_id, object_id) WHERE a.event_id IS DISTINCT FROM b.event_id""")
def l5d(t: Tables):
    return L.state_diff(t.log(), 10, 30)


_BUCKETS = f"s3 AS (SELECT project_id, substring(sha256(CAST(object_id AS VARCHAR)), 1, 3) AS bucket, count(*) AS objects, sha256(array_to_string(list_sort(list(sha256(object_id || '|' || event_id || '|' || kind))), ',')) AS digest FROM ({_STATE} FROM log GROUP BY project_id, object_id) GROUP BY ALL)"
_UP = ", ".join(f"s{i} AS (SELECT project_id, substring(bucket, 1, {i}) AS bucket, CAST(sum(objects) AS BIGINT) AS objects, sha256(array_to_string(list_sort(list(substring(bucket, {i + 1}, 1) || ':' || digest)), ',')) AS digest FROM s{i + 1} GROUP BY project_id, substring(bucket, 1, {i}))" for i in (2, 1, 0))
_SNAP = f"{_BUCKETS}, {_UP}, s AS (SELECT project_id, objects, digest FROM s0)"


@query("l6_snapshot", f"WITH {LOG}, {_SNAP} SELECT * FROM s")
def l6(t: Tables):
    return L.snapshot(L.replay(t.log()))


@query("l6_verify_snapshot", f"WITH {LOG}, {_SNAP} SELECT project_id, CASE WHEN project_id % 7 = 0 THEN 'missing' WHEN project_id % 7 = 1 THEN 'changed' ELSE 'ok' END AS status FROM s")
def l6v(t: Tables):
    objects = L.replay(t.log())
    stored = L.snapshot(objects).where("project_id % 7 <> 0").withColumn("digest", F.when(F.col("project_id") % 7 == 1, "other").otherwise(F.col("digest")))
    return L.verify_snapshot(objects, stored)


@query("l6_differing_buckets", f"WITH {LOG}, {_BUCKETS} SELECT project_id, bucket, CASE WHEN project_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS status FROM s3 WHERE project_id % 7 = 0 OR (project_id % 7 = 1 AND bucket < '8')")
def l6d(t: Tables):
    """Stored are the buckets of six of seven projects, half of them spoilt in one of these."""
    objects = L.replay(t.log())
    stored = L.snapshot_buckets(objects).where("project_id % 7 <> 0").withColumn("digest", F.when((F.col("project_id") % 7 == 1) & (F.col("bucket") < "8"), "other").otherwise(F.col("digest")))
    return L.differing_buckets(objects, stored)


@query("l7_history", """SELECT o_custkey AS key, o_orderkey AS id, o_orderdate AS at, lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by, lag(o_orderkey) OVER w AS supersedes, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def l7(t: Tables):
    return L.history(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")), "key", "at", "id")


@query("l7_supersede", """SELECT o_orderkey AS old_id, o_orderkey + 1 AS new_id, CASE WHEN trim(CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END) = '' THEN 'blank_reason' WHEN o_custkey % 2 = 1 THEN 'absent' ELSE 'applied' END AS outcome,
 CASE WHEN o_orderkey % 5 <> 0 AND o_custkey % 2 = 0 THEN (o_orderkey + 1) || '>' || o_orderkey END AS edge FROM orders""")
def l7s(t: Tables):
    o = t("orders")
    requests = o.select(F.col("o_orderkey").alias("old_id"), (F.col("o_orderkey") + 1).alias("new_id"), F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("reason"))
    return L.supersede(o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id")), requests)


@query("l8_commit_gate", """SELECT l_orderkey * 10 + l_linenumber AS candidate_id, CASE WHEN o_orderkey IS NULL OR l_linenumber <> 1 + l_orderkey % 3 THEN 'version' WHEN l_returnflag = 'R' THEN 'confirmation' WHEN l_linestatus = 'F' AND l_quantity > 40 THEN 'authority' WHEN l_orderkey * 10 + l_linenumber IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_discount > 0.08) THEN 'open_finding' ELSE 'commit' END AS outcome
 FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 4 <> 0""")
def l8(t: Tables):
    li = t("lineitem").withColumn("candidate_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    cands = li.select("candidate_id", F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("base_version"), (F.col("l_returnflag") != "R").alias("confirmed"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40), "model").otherwise("user").alias("authority"))
    projects = t("orders").where("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("project_id"), (1 + F.col("o_orderkey") % 3).alias("current_version"))
    return L.commit_gate(cands, projects, li.select("candidate_id", (F.col("l_discount") > 0.08).alias("blocking"), F.lit(True).alias("open")))


@query("l9_check_import", """SELECT c_custkey AS batch_id, count(o_orderkey) AS rows, CAST(coalesce(sum(CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END) FILTER (o_orderkey IS NOT NULL), 0) AS BIGINT) AS foreign_rows,
 CASE WHEN count(o_orderkey) = 0 THEN 'empty' WHEN sum(CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END) > 0 THEN 'foreign_project' ELSE 'ok' END AS outcome FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def l9(t: Tables):
    batch = t("orders").select(F.col("o_custkey").alias("batch_id"), F.when(F.col("o_orderkey") % 29 == 0, -1).otherwise(F.col("o_custkey")).alias("project_id"))
    return L.check_import(batch, t("customer").select(F.col("c_custkey").alias("batch_id"), F.col("c_custkey").alias("project_id")))


def captures(t: Tables):
    """Every turn captured up to three times, of which some are incomplete."""
    c = t("conversations").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("n <= (conv_id + turn) % 3")
    cut = F.when(F.col("n") < (F.col("turn") % 2), F.expr("substring(text, 1, 20)")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("conversation"), F.col("turn").alias("ordinal"), sha(cut).alias("content_hash"), (F.col("n") >= F.col("turn") % 2).alias("complete"), F.col("n").alias("captured_at"), (F.col("conv_id") * 1000 + F.col("turn") * 10 + F.col("n")).alias("capture_id"))


_CAPTURES = """cap AS (SELECT conv_id AS conversation, turn AS ordinal, sha256(CASE WHEN n < turn % 2 THEN substring(text, 1, 20) ELSE text END) AS content_hash, n >= turn % 2 AS complete, n AS captured_at, conv_id * 1000 + turn * 10 + n AS capture_id FROM conversations, (SELECT unnest([0, 1, 2]) AS n) WHERE n <= (conv_id + turn) % 3)"""


@query("l10_dedup_turns", f"WITH {_CAPTURES} SELECT conversation, ordinal, content_hash, capture_id FROM cap QUALIFY row_number() OVER (PARTITION BY conversation, ordinal, content_hash ORDER BY captured_at, capture_id) = 1")
def l10(t: Tables):
    return L.dedup_turns(captures(t)).select("conversation", "ordinal", "content_hash", "capture_id")


@query("l11_latest_turns", f"WITH {_CAPTURES} SELECT conversation, ordinal, count(*) AS captures, bool_or(complete) AS complete, arg_max(capture_id, (complete, captured_at, capture_id)) AS capture_id FROM cap GROUP BY ALL")
def l11(t: Tables):
    return L.latest_turns(captures(t))


_FRAMES = """fr AS (SELECT doc_id AS message, CAST(i - 1 AS INTEGER) AS seq, CAST((length(text) + 199) // 200 AS INTEGER) AS total, substring(text, (i - 1) * 200 + 1, 200) AS body, r AS seen FROM (SELECT *, unnest(generate_series(1, (length(text) + 199) // 200 + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END)) AS i FROM documents WHERE length(text) > 0), (SELECT unnest([0, 1]) AS r) WHERE NOT (doc_id % 5 = 0 AND i = 2) AND r <= i % 2)"""


def frames(t: Tables):
    n = F.floor((F.length("text") + 199) / 200)
    d = t("documents").where(F.length("text") > 0).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), n + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)))).withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.where("not (doc_id % 5 = 0 and i = 2) and r <= i % 2")
    return d.select(F.col("doc_id").alias("message"), (F.col("i") - 1).cast("int").alias("seq"), n.cast("int").alias("total"), F.expr("substring(text, cast((i - 1) * 200 + 1 as int), 200)").alias("body"), F.col("r").alias("at"))


@query("l12_reassemble", f"""WITH {_FRAMES}, v AS (SELECT message, total, seq, arg_max(body, seen) AS body FROM fr WHERE seq < total AND total <= 1024 GROUP BY ALL), x AS (SELECT message, count(*) AS rejected FROM fr WHERE seq >= total OR total > 1024 GROUP BY ALL)
 SELECT message, total, count(*) AS frames, count(*) = total AS complete, CASE WHEN count(*) = total THEN sha256(string_agg(body, '' ORDER BY seq)) END AS sha, coalesce(max(rejected), 0) AS rejected FROM v LEFT JOIN x USING (message) GROUP BY message, total""")
def l12(t: Tables):
    return L.reassemble(frames(t)).withColumn("sha", F.sha2("body", 256)).drop("body")


@query("l13_commit_eligible", """SELECT o_orderkey AS sent_id, CASE WHEN o_orderkey % 13 = 0 THEN 'already_committed' WHEN o_orderstatus = 'P' OR o_orderkey % 11 = 0 THEN 'incomplete' WHEN o_orderkey % 7 = 0 THEN 'hash_mismatch' WHEN o_orderkey % 5 = 0 THEN 'not_evaluated' WHEN o_custkey % 4 > 2 THEN 'open_findings' WHEN o_custkey % 3 = 0 THEN 'not_accepted' ELSE 'eligible' END AS outcome FROM orders""")
def l13(t: Tables):
    o = t("orders").withColumn("sent_id", F.col("o_orderkey"))
    return L.commit_eligible(
        o.select("sent_id", F.lit("h").alias("sent_hash")), o.where("sent_id % 11 <> 0").select("sent_id", (F.col("o_orderstatus") != "P").alias("complete"), F.when(F.col("sent_id") % 7 == 0, "g").otherwise("h").alias("seen_hash")),
        o.where("sent_id % 5 <> 0").select("sent_id", F.when(F.col("o_custkey") % 4 > 2, 1).otherwise(0).alias("open_findings")), o.where("o_custkey % 3 <> 0").select("sent_id"), o.where("sent_id % 13 = 0").select("sent_id"),
    )


@query("l14_stale_contexts", f"WITH {_VERSIONED}, c AS (SELECT project_id, max(version) AS current_version FROM v GROUP BY ALL) SELECT event_id AS context_id, project_id, CAST(version AS INTEGER) AS version, CAST(current_version AS INTEGER) AS current_version FROM v JOIN c USING (project_id) WHERE kind = 'click' AND version <> current_version")
def l14(t: Tables):
    v = L.with_version(t.log())
    return L.stale_contexts(v.where("kind = 'click'").withColumnRenamed("event_id", "context_id"), v.groupBy("project_id").agg(F.max("version").alias("current_version")))


@query("l15_conversation_view", "SELECT conv_id, count(*) AS turns, string_agg(turn || ':' || role || ':' || CASE WHEN turn % 3 = 1 THEN 'f' || turn ELSE '-' END, ';' ORDER BY turn) AS view FROM conversations GROUP BY conv_id")
def l15(t: Tables):
    c = t("conversations").select("conv_id", "turn", "role")
    return L.conversation_view(c, c.where("turn % 3 = 1").select("conv_id", "turn", F.concat(F.lit("f"), F.col("turn").cast("string")).alias("mark")))


@query("l16_latest_run", f"WITH {LOG} SELECT project_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(kind, (ts, event_id)) AS kind FROM log GROUP BY ALL")
def l16(t: Tables):
    return L.latest_run(t.log()).select("project_id", "event_id", "kind")


@query("l16_continuity", "SELECT conv_id, count(*) AS committed, least(3, count(*)) AS \"window\", count(*) >= 3 AS triggered FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def l16c(t: Tables):
    return L.continuity(t("conversations").where("role <> 'system'"))


@query("l17_visible_turns", "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS sha FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id")
def l17(t: Tables):
    return L.visible_turns(t("conversations"), 4).select("conv_id", "turns", F.sha2("history", 256).alias("sha"))


_FRONT = "f AS (SELECT user_id AS project_id, event_id AS id, value - 20 AS strength, event_id % 9 AS access_count FROM events)"


def front(t: Tables):
    return t("events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("id"), (F.col("value") - 20).alias("strength"), (F.col("event_id") % 9).alias("access_count"))


@query("l18_evict", f"""WITH {_FRONT}, a AS (SELECT *, id % 6 = 0 AS serving, row_number() OVER (PARTITION BY project_id ORDER BY id % 6 = 0, strength, access_count, id) AS nth, count(*) OVER (PARTITION BY project_id) AS n FROM f WHERE strength > 0)
 SELECT project_id, id, CASE WHEN nth <= n - 25 AND NOT serving THEN 'capacity' ELSE 'kept' END AS outcome FROM a UNION ALL SELECT project_id, id, 'decayed' FROM f WHERE NOT strength > 0""")
def l18(t: Tables):
    f = front(t)
    return L.evict(f, f.where("id % 6 = 0").select("id"), 25)


@query("l19_readmit", f"""WITH {_FRONT}, s AS (SELECT id, access_count, false AS restored FROM f WHERE id % 3 = 0 UNION ALL SELECT id, 0, true FROM f WHERE id % 3 <> 0 AND id % 4 = 0 AND id % 5 <> 0)
 SELECT id, restored, access_count + (id % 4 = 0)::INT AS access_count, CASE WHEN id % 4 = 0 THEN id * 2 END AS last_access FROM s""")
def l19(t: Tables):
    f = front(t)
    return L.readmit(f.where("id % 3 = 0"), f.where("id % 5 <> 0"), f.where("id % 4 = 0").select("id", (F.col("id") * 2).alias("tick")))


@query("l20_retrieval_outcomes", """WITH a AS (SELECT l_orderkey AS "commit", l_partkey AS id, l_linenumber AS rank FROM lineitem), d AS (SELECT *, count(*) OVER (PARTITION BY "commit", id) AS times FROM a)
 SELECT "commit", id, rank, CASE WHEN ("commit" + id) % 2 = 0 THEN CAST(id % 16 + 1 AS INTEGER) END AS lexical_rank, CASE WHEN times > 1 THEN 'duplicate' WHEN id % 10 = 0 THEN 'missing_twin' ELSE 'recorded' END AS outcome FROM d""")
def l20(t: Tables):
    a = t("lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"))
    trace = a.where("(commit + id) % 2 = 0").select("commit", "id", (F.col("id") % 16 + 1).cast("int").alias("lexical_rank")).distinct()
    return L.retrieval_outcomes(a, trace, t("part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id")))


@query("l21_reconcile", """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 11 <> 0)
 SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.status IS DISTINCT FROM b.status OR a.priority IS DISTINCT FROM b.priority THEN 'differs' ELSE 'exact' END AS status,
 CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END) END AS mismatched FROM a FULL JOIN b ON a.id = b.id""")
def l21(t: Tables):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    stored = o.where("id % 11 <> 0").withColumns({"status": F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status")), "priority": F.when(F.col("id") % 9 != 0, F.col("priority"))})
    return L.reconcile(o.where("id % 10 <> 0"), stored, ["status", "priority"])


@query("l22_structural_history", "SELECT user_id AS project_id, event_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id // 100, event_id) AS INTEGER) AS position FROM events WHERE event_type IN ('click', 'purchase')")
def l22(t: Tables):
    e = t("events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 100).alias("tick"), F.col("event_type").alias("key"))
    active = t("events").where("event_type in ('click', 'purchase')").select(F.col("event_type").alias("key")).distinct()
    return L.structural_history(e, active).select("project_id", "seq", "position")
