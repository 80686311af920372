"""The event-sourced ledger: append, audits, replay, time travel, capture, lineage and seats.

A log has ``project_id, event_id, ts, ...``; its order within a project is ``(ts, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_reason, numbered, settled, sha, top, union


def append_events(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows ``(project_id, key, payload, seq)`` with decision new, duplicate or conflict.

    The first of a ``(project_id, key)`` wins, the log before the batch; a repeat with another payload is a conflict.
    """
    known = log.groupBy("project_id", "key").agg(F.min_by("payload", "seq").alias("known"))
    order = Window.partitionBy("project_id", "key").orderBy("seq")
    batch = incoming.withColumns({"nth": F.row_number().over(order), "first": F.first("payload").over(order)})
    joined = batch.join(known, ["project_id", "key"], "left").withColumn("kept", F.coalesce("known", "first"))
    decision = F.when(F.col("known").isNull() & (F.col("nth") == 1), "new").when(F.col("kept").eqNullSafe(F.col("payload")), "duplicate").otherwise("conflict")
    return joined.select("project_id", "key", "seq", decision.alias("decision"))


def _by_project(*order) -> Window:
    return Window.partitionBy("project_id").orderBy(*order)


def version_gaps(log: DataFrame) -> DataFrame:
    """Rows whose ``base_version`` is not the version before them."""
    before = F.coalesce(F.lag("version").over(_by_project("ts", "event_id")), F.lit(0))
    return log.withColumn("expected", before).where(F.col("base_version") != F.col("expected")).select("project_id", "event_id", "base_version", "expected")


def chain_breaks(log: DataFrame) -> DataFrame:
    """Rows whose ``prior_digest`` is not the ``resulting_digest`` before them."""
    before = F.lag("resulting_digest").over(_by_project("ts", "event_id"))
    return log.withColumn("expected", before).where(~F.col("prior_digest").eqNullSafe(F.col("expected"))).select("project_id", "event_id")


def replay(log: DataFrame, key: str = "object_id") -> DataFrame:
    """State of every object: its last write.  A struct maximum per object, so no object's history is gathered."""
    rest = [c for c in log.columns if c not in ("project_id", key)]
    last = log.groupBy("project_id", key).agg(F.max(F.struct("ts", "event_id", *[c for c in rest if c not in ("ts", "event_id")])).alias("s"))
    return last.select("project_id", key, *[F.col(f"s.{c}").alias(c) for c in rest])


def with_version(log: DataFrame) -> DataFrame:
    return numbered(log, ["project_id"], ["ts", "event_id"], "version")


def state_at(log: DataFrame, version: int) -> DataFrame:
    """State after the first ``version`` events of each project."""
    return replay(with_version(log).where(F.col("version") <= version))


def state_diff(log: DataFrame, a: int, b: int) -> DataFrame:
    """Objects that are added or changed between two versions (a log without removals has no third case)."""
    old = state_at(log, a).select("project_id", "object_id", F.col("event_id").alias("old_event"))
    new = state_at(log, b).select("project_id", "object_id", F.col("event_id").alias("new_event"))
    both = old.join(new, ["project_id", "object_id"], "full").where(~F.col("old_event").eqNullSafe(F.col("new_event")))
    return both.withColumn("change", F.when(F.col("old_event").isNull(), "added").when(F.col("new_event").isNull(), "removed").otherwise("changed"))


#: digits of an object id's digest that name its bucket: 16 ** DIGITS buckets a project
DIGITS = 3


def snapshot_buckets(objects: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(project_id, bucket, objects, digest): digests of a project's objects by bucket, in no order of the objects.

    An object's bucket follows from its id alone, so a changed object changes one bucket.  Only a bucket's rows are gathered.
    """
    row = sha(F.concat_ws("|", F.col("object_id").cast("string"), F.col("event_id").cast("string"), "kind"))
    bucket = F.substring(sha(F.col("object_id").cast("string")), 1, digits)
    return objects.select("project_id", bucket.alias("bucket"), row.alias("row")).groupBy("project_id", "bucket").agg(F.count(F.lit(1)).alias("objects"), sha(F.concat_ws(",", F.array_sort(F.collect_list("row")))).alias("digest"))


def snapshot_root(buckets: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(project_id, objects, digest) of bucket digests: a tree of sixteen branches, digit by digit, up to one root a project."""
    for _ in range(digits):
        branch = F.concat_ws(":", F.right("bucket", F.lit(1)), "digest")
        parent = F.substring("bucket", F.lit(1), F.length("bucket") - 1)
        buckets = buckets.select("project_id", parent.alias("bucket"), "objects", branch.alias("branch")).groupBy("project_id", "bucket").agg(F.sum("objects").alias("objects"), sha(F.concat_ws(",", F.array_sort(F.collect_list("branch")))).alias("digest"))
    return buckets.select("project_id", "objects", "digest")


def snapshot(objects: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(project_id, objects, digest): order-independent digest of a project's objects, from those of its buckets."""
    return snapshot_root(snapshot_buckets(objects, digits), digits)


def verify_snapshot(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """(project_id, status): ok, changed, missing (not stored) or unexpected (stored without objects)."""
    now = snapshot(objects).select("project_id", F.col("digest").alias("now"))
    return _compared(now, stored.select("project_id", "digest"), ["project_id"])


def differing_buckets(objects: DataFrame, stored: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(project_id, bucket, status) of the buckets that differ from those stored by ``snapshot_buckets``.

    Roots are compared first; only projects whose roots differ are looked into.
    """
    now = settled(snapshot_buckets(objects, digits))
    roots = lambda df, name: snapshot_root(df, digits).select("project_id", F.col("digest").alias(name))
    differ = settled(_compared(roots(now, "now"), roots(stored, "digest"), ["project_id"]).where("status <> 'ok'").select("project_id"))
    own = lambda df, name: df.join(differ.hint("merge"), "project_id", "left_semi").select("project_id", "bucket", F.col("digest").alias(name))
    return _compared(own(now, "now"), own(stored, "digest"), ["project_id", "bucket"]).where("status <> 'ok'")


def _compared(now: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    both = now.join(stored.hint("merge"), key, "full")
    return both.select(*key, F.when(F.col("now").isNull(), "unexpected").when(F.col("digest").isNull(), "missing").when(F.col("now") == F.col("digest"), "ok").otherwise("changed").alias("status"))


def history(objects: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """Validity ranges of successive versions: each ends where its successor begins."""
    order = Window.partitionBy(key).orderBy(at, id_)
    return objects.withColumns({"valid_to": F.lead(at).over(order), "superseded_by": F.lead(id_).over(order), "supersedes": F.lag(id_).over(order)}).withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))


def supersede(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of requests ``(old_id, new_id, reason)``: refused for a blank reason or an absent object, else applied with its edge."""
    known = objects.select(F.col("id").alias("old_id"), F.lit(True).alias("known"))
    joined = requests.join(known, "old_id", "left")
    why = first_reason((F.trim("reason") == "", "blank_reason"), (F.col("known").isNull(), "absent"), otherwise="applied")
    return joined.select("old_id", "new_id", why.alias("outcome")).withColumn("edge", F.when(F.col("outcome") == "applied", F.concat_ws(">", F.col("new_id").cast("string"), F.col("old_id").cast("string"))))


def commit_gate(candidates: DataFrame, projects: DataFrame, findings: DataFrame) -> DataFrame:
    """First failing reason of candidates: stale version, unconfirmed, authority, open blocking finding."""
    blocked = findings.where("blocking and open").select("candidate_id").distinct().withColumn("blocked", F.lit(True))
    joined = candidates.join(projects.select("project_id", "current_version"), "project_id", "left").join(blocked, "candidate_id", "left")
    return joined.select("candidate_id", first_reason(
        (F.col("current_version").isNull() | (F.col("base_version") != F.col("current_version")), "version"), (~F.col("confirmed"), "confirmation"),
        (~F.col("authority").isin("user", "owner"), "authority"), (F.col("blocked").isNotNull(), "open_finding"), otherwise="commit").alias("outcome"))


def check_import(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(batch_id, rows, foreign_rows, outcome): no empty batch, no foreign project."""
    own = known.select(F.col("batch_id"), F.col("project_id").alias("own"))
    joined = own.join(batch, "batch_id", "left")
    counted = joined.groupBy("batch_id").agg(F.count("project_id").alias("rows"), F.sum((F.col("project_id") != F.col("own")).cast("long")).alias("foreign_rows"))
    return counted.select("batch_id", "rows", F.coalesce("foreign_rows", F.lit(0)).cast("long").alias("foreign_rows"), F.when(F.col("rows") == 0, "empty").when(F.col("foreign_rows") > 0, "foreign_project").otherwise("ok").alias("outcome"))


def dedup_turns(turns: DataFrame) -> DataFrame:
    """One capture per ``(conversation, ordinal, content hash)``, the earliest."""
    return top(turns, ["conversation", "ordinal", "content_hash"], ["captured_at", "capture_id"], 1).drop("rank")


def latest_turns(turns: DataFrame) -> DataFrame:
    """Per ``(conversation, ordinal)`` the latest complete capture, else the latest."""
    best = turns.groupBy("conversation", "ordinal").agg(F.max(F.struct("complete", "captured_at", "capture_id")).alias("s"), F.count(F.lit(1)).alias("captures"))
    return best.select("conversation", "ordinal", "captures", F.col("s.complete").alias("complete"), F.col("s.capture_id").alias("capture_id"))


def reassemble(frames: DataFrame, max_frames: int = 1024) -> DataFrame:
    """Messages of ``frames(message, seq, total, body, at)``: complete when ``total`` distinct valid numbers came.

    The last write of a number wins; numbers out of bounds are rejected and counted.  A message has at most
    ``max_frames`` frames, which bounds what is gathered for it.
    """
    valid = (F.col("total") > 0) & (F.col("total") <= max_frames) & (F.col("seq") >= 0) & (F.col("seq") < F.col("total"))
    rejected = frames.where(~valid).groupBy("message").agg(F.count(F.lit(1)).alias("rejected"))
    last = frames.where(valid).groupBy("message", "total", "seq").agg(F.max(F.struct("at", "body")).alias("s"))
    whole = last.groupBy("message", "total").agg(F.count(F.lit(1)).alias("frames"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("s.body").alias("body")))), lambda x: x["body"]), "").alias("body"))
    return whole.join(rejected, "message", "left").select("message", "total", "frames", (F.col("frames") == F.col("total")).alias("complete"), F.when(F.col("frames") == F.col("total"), F.col("body")).alias("body"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


def commit_eligible(sent: DataFrame, responses: DataFrame, evaluations: DataFrame, acceptances: DataFrame, receipts: DataFrame) -> DataFrame:
    """Lineage of sent turns to a commit: the first reason against, else eligible; one commit a sent turn."""
    joined = sent.join(responses, "sent_id", "left").join(evaluations, "sent_id", "left").join(acceptances.select("sent_id", F.lit(True).alias("accepted")), "sent_id", "left").join(receipts.select("sent_id", F.lit(True).alias("committed")).distinct(), "sent_id", "left")
    return joined.select("sent_id", first_reason(
        (F.col("committed").isNotNull(), "already_committed"), (F.col("complete").isNull() | ~F.col("complete"), "incomplete"), (~F.col("sent_hash").eqNullSafe(F.col("seen_hash")), "hash_mismatch"),
        (F.col("open_findings").isNull(), "not_evaluated"), (F.col("open_findings") > 0, "open_findings"), (F.col("accepted").isNull(), "not_accepted"), otherwise="eligible").alias("outcome"))


def stale_contexts(contexts: DataFrame, projects: DataFrame) -> DataFrame:
    """Contexts prepared for another version than the project's current one."""
    return contexts.join(projects.select("project_id", "current_version"), "project_id").where(F.col("version") != F.col("current_version")).select("context_id", "project_id", "version", "current_version")


def conversation_view(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """One row a conversation: its turns in order with their marks; a conversation's turns are what is gathered."""
    row = F.struct("turn", "role", F.coalesce("mark", F.lit("-")).alias("mark"))
    seen = turns.join(marks, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(row)).alias("rows"))
    return seen.select("conv_id", "turns", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["turn"].cast("string"), r["role"], r["mark"])), ";").alias("view"))


def latest_run(runs: DataFrame) -> DataFrame:
    return top(runs, ["project_id"], [F.desc("ts"), F.desc("event_id")], 1).drop("rank")


def continuity(turns: DataFrame, least: int = 3) -> DataFrame:
    """(conv_id, committed, window, triggered): whether a conversation has ``least`` turns, and how many of them to carry."""
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("committed"))
    return n.select("conv_id", "committed", F.least(F.lit(least).cast("long"), "committed").alias("window"), (F.col("committed") >= least).alias("triggered"))


def visible_turns(turns: DataFrame, n: int) -> DataFrame:
    """Last ``n`` turns of each conversation as one text, oldest first."""
    last = top(turns, ["conv_id"], [F.desc("turn")], n)
    return last.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n").alias("history"))


def evict(front: DataFrame, serving: DataFrame, capacity: int) -> DataFrame:
    """(project_id, id, outcome): strength at or below 0 is ``decayed``; above capacity, non-serving rows go first by
    (strength, access count, id) as ``capacity``; the rest is kept."""
    alive = front.where("strength > 0").join(serving.select("id", F.lit(True).alias("serving")).distinct(), "id", "left")
    order = Window.partitionBy("project_id").orderBy(F.col("serving").isNotNull(), "strength", "access_count", "id")
    placed = alive.withColumns({"nth": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("project_id"))})
    outcome = F.when((F.col("nth") <= F.col("n") - capacity) & F.col("serving").isNull(), "capacity").otherwise("kept")
    return union(placed.select("project_id", "id", outcome.alias("outcome")), front.where("not (strength > 0)").select("project_id", "id", F.lit("decayed").alias("outcome")))


def readmit(front: DataFrame, library: DataFrame, admitted: DataFrame) -> DataFrame:
    """Seats after an admission ``(id, tick)``: seated rows, plus admitted ones restored from the library; both note the access."""
    seated = front.select("id", "access_count").withColumn("restored", F.lit(False))
    back = admitted.join(front, "id", "left_anti").join(library.select("id"), "id").select("id", F.lit(0).cast("long").alias("access_count"), F.lit(True).alias("restored"))
    touched = union(seated, back).join(admitted.select("id", "tick"), "id", "left")
    return touched.select("id", "restored", (F.col("access_count") + F.col("tick").isNotNull().cast("long")).alias("access_count"), F.col("tick").alias("last_access"))


def reconcile(source: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """(id, status, mismatched): source and stored objects by id; fields compared null-safely."""
    a, b = source.select("id", *[F.col(c).alias(f"a_{c}") for c in fields], F.lit(1).alias("in_a")), stored.select("id", *[F.col(c).alias(f"b_{c}") for c in fields], F.lit(1).alias("in_b"))
    j = a.join(b, "id", "full")
    wrong = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in fields])), ",")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return j.select("id", F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(wrong != "", "differs").otherwise("exact").alias("status"), F.when(both, wrong).otherwise("").alias("mismatched"))


def structural_history(commits: DataFrame, active: DataFrame) -> DataFrame:
    """Commits with an active key, numbered by tick then arrival."""
    return numbered(commits.join(active, "key", "left_semi"), ["project_id"], ["tick", "seq"], "position")


def retrieval_outcomes(admitted: DataFrame, trace: DataFrame, library: DataFrame) -> DataFrame:
    """Fact rows of admitted ``(commit, id, rank)`` with their trace; refused where the durable twin is missing or an id repeats."""
    times = F.count(F.lit(1)).over(Window.partitionBy("commit", "id"))
    joined = admitted.withColumn("times", times).join(trace, ["commit", "id"], "left").join(library.select("id", F.lit(True).alias("twin")).distinct(), "id", "left")
    return joined.withColumn("outcome", first_reason((F.col("times") > 1, "duplicate"), (F.col("twin").isNull(), "missing_twin"), otherwise="recorded")).drop("times", "twin")
