"""Checks of responses against rules in tables, and their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digest, first_reason, if_small, top, union, uuid_from
from .rank import cosine_topk


def rule_hits(responses: DataFrame, rules: DataFrame, least: int = 4) -> DataFrame:
    """(response_id, code, state_id): responses that contain a phrase of a rule ``(code, state_id, phrase)``, in any case."""
    usable = rules.where(F.length("phrase") >= least).select("code", "state_id", F.lower("phrase").alias("phrase"))
    j = responses.select("response_id", F.lower("text").alias("low")).join(if_small(usable), F.contains("low", F.col("phrase")))
    return j.select("response_id", "code", "state_id").distinct()


def ledger_hits(mentions: DataFrame) -> DataFrame:
    """Hits of the ledger checks over ``(response_id, state_id, scope, asked_scope, status, asserted, evidence_version,
    version, superseded_by, reason, dependency_mentioned, has_dependency)``."""
    checks = [
        ("scope_mismatch", F.col("scope") != F.col("asked_scope")), ("asserted_candidate", (F.col("status") == "candidate") & F.col("asserted")), ("stale_evidence", F.col("evidence_version") < F.col("version")),
        ("supersession_without_reason", F.col("superseded_by").isNotNull() & (F.coalesce(F.trim("reason"), F.lit("")) == "")), ("ignored_dependency", F.col("has_dependency") & ~F.col("dependency_mentioned")),
    ]
    return union(*[mentions.where(test).select("response_id", F.lit(code).alias("code"), "state_id") for code, test in checks])


def interventions(hits: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with severity, confidence and a deterministic id; state of each response).  policy: one row a code."""
    once = hits.select("response_id", "code", "state_id").distinct().join(F.broadcast(policy), "code")
    found = once.withColumn("id", uuid_from(digest("response_id", "code", "state_id")))
    worst = F.max(F.when(F.col("severity") == "blocking", 2).otherwise(1))
    return found, found.groupBy("response_id").agg(F.count(F.lit(1)).alias("findings"), F.when(worst == 2, "conflict").otherwise("review").alias("state"))


def guardrail_hits(spans: DataFrame, anchors: DataFrame, direct: DataFrame, least: float = 0.98, own_rows: bool = False) -> DataFrame:
    """Best response span of each anchor ``(anchor_id, embedding)`` with a cosine of ``least``; anchors hit directly are left out.

    ``own_rows``: anchors are rows of ``spans`` themselves, by id (once each); an anchor's own row is no span of it.
    """
    open_ = anchors.join(direct, "anchor_id", "left_anti").select(F.col("anchor_id").alias("query_id"), "embedding")
    best = cosine_topk(open_, spans.select(F.col("span_id").alias("id"), "embedding"), 2 if own_rows else 1)
    others = best.where("query_id <> id") if own_rows else best
    first = top(others.where(F.col("score") >= least).drop("rank"), ["query_id"], [F.desc("score"), "id"], 1)
    return first.select(F.col("query_id").alias("anchor_id"), F.col("id").alias("span_id"), "score", F.lit("review").alias("state"))


def guardrail_anchors(objects: DataFrame) -> DataFrame:
    """State that guards responses: active constraints and decisions of the user or owner within scope."""
    return objects.where(F.col("type").isin("constraint", "decision") & (F.col("status") == "active") & F.col("authority").isin("user", "owner") & F.col("in_scope"))


def resolve_findings(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """(project_id, findings, open): a finding's status is its latest action's, else open."""
    last = actions.groupBy("finding_id").agg(F.max_by("status", F.struct("at", "action_id")).alias("status"))
    j = findings.join(last, "finding_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))
    return j.groupBy("project_id").agg(F.count(F.lit(1)).alias("findings"), F.sum((F.col("status") == "open").cast("long")).alias("open"))


def review_precision(labels: DataFrame) -> DataFrame:
    """By code: reviewed share and precision among reviewed; null where there is nothing to divide by."""
    seen = F.sum(F.col("verdict").isNotNull().cast("long"))
    right = F.sum(F.coalesce(F.col("verdict") == "right", F.lit(False)).cast("long"))
    return labels.groupBy("code").agg(F.count(F.lit(1)).alias("n"), seen.alias("reviewed"), (seen / F.count(F.lit(1))).alias("coverage"), (right / F.when(seen > 0, seen)).alias("precision"))


def rules_from_packets(items: DataFrame, sections: dict[str, str]) -> DataFrame:
    """Phrase rules from admitted packet items ``(state_id, section, text)``: the text after its marker, by section's code."""
    code = F.coalesce(*[F.when(F.col("section") == s, F.lit(c)) for s, c in sections.items()])
    return items.withColumn("code", code).where("code is not null").select("code", "state_id", F.lower(F.trim(F.regexp_replace("text", r"^[A-Za-z]+:", ""))).alias("phrase"))


def first_failure(df: DataFrame, *rules) -> DataFrame:
    return df.withColumn("reason", first_reason(*rules, otherwise="pass"))
