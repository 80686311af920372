"""Admission of ranked rows into bounded packets: score, collapse, fit, close dependencies, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, first_reason, settled, sha, slice_text, squash, top
from .fold import fold, skip_ahead

#: weights of the score's components
WEIGHTS = {"semantic": 0.25, "structural": 0.30, "sequence": 0.15, "authority": 0.20, "recency": 0.10, "stale": -0.45, "conflict": -0.40, "redundant": -0.20}
SECTIONS = ("authority", "constraints", "decisions", "evidence", "history")

# Sections in packet order with their headers, budgets in tokens, and what a packet's frame and marks take.
HEADERS = {
    "objective": "ACTIVE_OBJECTIVE",
    "concepts": "LOAD_BEARING_CONCEPTS",
    "constraints": "BINDING_CONSTRAINTS",
    "decisions": "HELD_DECISIONS",
    "rejected": "REJECTED_OR_SUPERSEDED - DO NOT REVIVE WITHOUT EXPLICIT RECONSIDERATION",
    "completed": "COMPLETED_WORK - DO NOT REPROPOSE AS OPEN",
    "dependencies": "UNRESOLVED_DEPENDENCIES",
    "evidence": "EVIDENCE_BOUNDARY",
    "coverage": "DOCUMENT_COVERAGE_LIMITS",
    "supersession": "SUPERSESSION_NOTES",
    "anchors": "RETRIEVED_ANCHORS",
}
MANDATORY = ("objective", "constraints", "rejected")
DEFAULT_TOKENS, CEILINGS = 500, {"standard": 1_200, "research": 9_000}
FRAME, DOCUMENT_FRAME = 650, 400
STATE_MARK, PROVENANCE_MARK, NO_PROVENANCE = "- [state_id=] ", " - provenance: ", "not supplied"


def score_candidates(df: DataFrame) -> DataFrame:
    """Weighted score of components clamped to [0, 1] (not a number counts as 0); an RRF value replaces the first two."""
    part = lambda c: clamp(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))) * WEIGHTS[c]
    rest = sum((part(c) for c in list(WEIGHTS)[3:]), part("sequence"))
    both = F.when(F.col("rrf").isNotNull(), clamp(61 * F.col("rrf")) * 0.55).otherwise(part("semantic") + part("structural"))
    return df.withColumn("score", F.round(both + rest, 9))


def collapse_duplicates(df: DataFrame) -> DataFrame:
    """First of candidates ``(request_id, id, seq, text)`` with equal squashed text; empty ones have a reason."""
    body = squash(F.col("text"))
    nth = F.row_number().over(Window.partitionBy("request_id", sha(body)).orderBy("seq"))
    return df.select("request_id", "id", first_reason((body == "", "empty"), (nth > 1, "duplicate"), otherwise="kept").alias("reason"))


def admit(df: DataFrame, tokens: int = 500, cap: int = 1200, page: int | None = None) -> DataFrame:
    """(request_id, id, decision): mandatory rows, then by section, score and id, those that fit ``4 * tokens`` characters; skips ahead.

    Every candidate gets a decision; with a ``page``, only the first so many of a request are looked at.
    """
    order = F.coalesce(*[F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(SECTIONS)], F.lit(len(SECTIONS)))
    placed = df.withColumn("place", order)
    if page is not None:
        placed = top(placed, ["request_id"], [F.desc("mandatory"), "place", F.desc("score"), "id"], page, "nth")
    rows = placed.select("request_id", F.col("id").cast("long").alias("id"), "mandatory", "place", "score", "size")
    return _fit(rows, F.lit(4 * min(tokens, cap)))


def _fit(rows: DataFrame, room: Column, rooms: DataFrame | None = None) -> DataFrame:
    """Decisions on ``rows (request_id, id, mandatory, place, score, size)``: mandatory ones are in and take their size from
    ``room`` first (a column of ``rooms`` by request, if given); the others follow by place, score from above and id."""
    forced = F.coalesce("mandatory", F.lit(False))
    sums = rows.where(forced).groupBy("request_id").agg(F.sum("size").alias("taken"))
    free = rows.where(~forced)
    for small in (sums, rooms) if rooms is not None else (sums,):  # a row a request
        free = free.join(settled(small).hint("merge"), "request_id", "left")
    free = free.select("request_id", "id", "place", F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("down"), F.col("size").cast("long").alias("size"), (room - F.coalesce("taken", F.lit(0))).cast("long").alias("room"))
    decided = skip_ahead(free, "request_id", ["place", "unscored", "down", "id"], unsized="budget")
    return rows.where(forced).select("request_id", "id", F.lit("mandatory").alias("decision")).unionByName(decided.select("request_id", "id", F.col("reason").alias("decision")))


def request_rooms(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request_id, tokens, room): a request's budget, and the characters that its frame leaves for rendered rows.

    ``requests (request_id, budget_tokens, profile, project, workstream)``; no budget, or 0, means the default, others end at
    the profile's ceiling.  The frame grows by the boundary of documents where a candidate stems from one.
    """
    ceiling = F.coalesce(*[F.when(F.col("profile") == p, F.lit(n)) for p, n in CEILINGS.items()], F.lit(CEILINGS["standard"]))
    asked = F.coalesce("budget_tokens", F.lit(0))
    tokens = F.when(asked == 0, DEFAULT_TOKENS).otherwise(F.least(asked, ceiling)).cast("long")
    documents = candidates.where(_from_document() | (F.col("pool") == "coverage_limit")).select("request_id", F.lit(True).alias("documents")).distinct()
    frame = FRAME + sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in ("project", "workstream")), F.when(F.col("documents"), DOCUMENT_FRAME).otherwise(0))
    return requests.join(documents.hint("merge"), "request_id", "left").select("request_id", tokens.alias("tokens"), (4 * tokens - frame).alias("room"))


def _from_document() -> Column:
    return F.coalesce(F.col("pool") == "evidence", F.lit(False)) | F.coalesce(F.col("authority") == "user_supplied_document", F.lit(False))


def rendered_cost() -> Column:
    """Characters that a candidate ``(id, text, section, pool, authority, provenance)`` takes in a packet: its text, id and
    section's header, the mark before it, and its provenance if it stems from a document."""
    chars = lambda c: F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))
    header = F.coalesce(*[F.when(F.col("section") == s, F.lit(len(h))) for s, h in HEADERS.items()], F.lit(0))
    provenance = F.length(F.coalesce("provenance", F.lit(NO_PROVENANCE))) + len(PROVENANCE_MARK) + 3
    return (chars("text") + chars("id") + header + len(STATE_MARK) + F.when(_from_document(), provenance).otherwise(0)).cast("long")


def admit_rendered(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id, decision, cost): candidates within what their request's budget leaves, each counted as it is rendered.

    ``candidates (request_id, id, text, section, score, pool, authority, provenance, binding)``.  Binding ones, coverage limits
    and the sections of objective, constraints and rejected are in whatever the budget.  Candidates of unknown requests are left out.
    """
    forced = F.coalesce("binding", F.lit(False)) | F.coalesce(F.col("pool") == "coverage_limit", F.lit(False)) | F.coalesce(F.col("section").isin(*MANDATORY), F.lit(False))
    place = F.coalesce(*[F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(HEADERS)], F.lit(len(HEADERS)))
    known = candidates.join(requests.select("request_id").distinct().hint("merge"), "request_id", "left_semi")
    rows = settled(known.select("request_id", "id", forced.alias("mandatory"), place.alias("place"), "score", rendered_cost().alias("size")))
    decided = _fit(rows, F.col("room"), request_rooms(requests, candidates).select("request_id", "room"))
    return decided.join(rows.select("request_id", "id", F.col("size").alias("cost")).hint("merge"), ["request_id", "id"])


def close_dependencies(selected: DataFrame, edges: DataFrame, available: DataFrame, depth: int = 2) -> DataFrame:
    """Dependencies ``(a, b)`` of the selected ids to a depth: added, unavailable, beyond the cap, or a cycle."""
    known = available.select(F.col("id").alias("b"), F.lit(True).alias("there")).distinct()
    frontier = selected.select(F.col("id").alias("origin"), F.col("id").alias("a"), F.array("id").alias("path"))
    out = None
    for level in range(1, depth + 2):
        step = frontier.join(edges, "a").join(known, "b", "left")
        cycle = F.array_contains("path", F.col("b"))
        outcome = first_reason((cycle, "dependency-cycle"), (F.lit(level > depth), "depth-cap"), (F.col("there").isNull(), "unavailable"), otherwise="added")
        found = step.select("origin", F.col("b").alias("id"), F.lit(level).alias("level"), outcome.alias("outcome"))
        out = found if out is None else out.unionByName(found)
        frontier = step.where(~cycle & F.col("there").isNotNull()).select("origin", F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path"))
    return out.groupBy("origin", "id", "outcome").agg(F.min("level").alias("level"))


def fit_dependencies(selected: DataFrame, edges: DataFrame, available: DataFrame, budget: int, depth: int = 2) -> DataFrame:
    """(request_id, a, id, outcome): dependencies of a request's selected ids, as far as they fit what its ``budget`` has left.

    ``selected (request_id, id)`` and ``available (id, size, mandatory)``; ids in order, each followed down to ``depth`` before
    the next.  An added one takes its size from the budget, a mandatory one always; one that is refused (``budget``) isn't
    followed; one already there is followed without a row.  The walk starts at the ids that no other selected one depends
    on, or at all.  Others are ``unavailable``, ``depth-cap`` (not looked behind) or ``dependency-cycle``.
    """
    known = available.select(F.col("id").alias("b"), F.col("size").cast("long").alias("size"), F.coalesce("mandatory", F.lit(False)).alias("mandatory")).dropDuplicates(["b"])
    links = edges.select("a", "b").distinct()
    own = selected.select("request_id", "id").distinct()
    below = own.withColumnRenamed("id", "a").join(links, "a").select("request_id", F.col("b").alias("id"))
    free = own.join(below.hint("merge"), ["request_id", "id"], "left_anti")
    roots = free.unionByName(own.join(free.select("request_id").distinct().hint("merge"), "request_id", "left_anti"))
    none = F.array().cast("array<long>")
    chosen = own.join(known, F.col("id") == F.col("b"), "left").select("request_id", none.alias("path"), "id", "size", "mandatory", F.lit(0).alias("level"), F.lit(True).alias("there"), F.lit(False).alias("cycle"))
    frontier, out = roots.select("request_id", F.col("id").alias("a"), F.array(F.col("id").cast("long")).alias("path")), chosen
    for level in range(1, depth + 2):
        step = frontier.join(links, "a").join(known.hint("merge"), "b", "left").withColumn("cycle", F.array_contains("path", F.col("b"))).withColumn("path", F.concat("path", F.array(F.col("b").cast("long"))))
        found = step.withColumns({"id": F.col("b"), "level": F.lit(level), "there": F.col("size").isNotNull()})
        out = out.unionByName(found.select(*chosen.columns))
        frontier = found.where("there and not cycle").select("request_id", F.col("b").alias("a"), "path")

    def fresh() -> dict:
        return {"ids": set(), "used": 0, "shut": None}

    def step_(state: dict, r: dict) -> tuple:
        path, id_, size, outcome = r["path"], r["id"], r["size"] or 0, None
        shut = state["shut"]
        if r["level"] == 0:
            state["ids"].add(id_)
            state["used"] += size
        elif shut is not None and path[: len(shut)] == shut:
            pass  # below one that was refused
        elif r["cycle"]:
            outcome = "dependency-cycle"
        elif id_ not in state["ids"]:
            outcome = "depth-cap" if r["level"] > depth else "unavailable" if not r["there"] else "added"
            if outcome == "added" and state["used"] + size > budget and not r["mandatory"]:
                outcome, state["shut"] = "budget", path
            if outcome == "added":
                state["ids"].add(id_)
                state["used"] += size
        return path[-2] if len(path) > 1 else None, id_, outcome

    done = fold(out.withColumn("id", F.col("id").cast("long")), "request_id", ["path", "id"], fresh, step_, "a long, id long, outcome string")
    return done.where("outcome is not null").distinct()


def coverage_rows(references: DataFrame) -> DataFrame:
    """One mandatory row for every unresolved reference ``(request_id, identifier, status)``."""
    return references.where("status <> 'resolved'").select("request_id", F.concat_ws(" ", F.lit("not covered:"), F.col("identifier")).alias("text"), F.lit(True).alias("mandatory")).distinct()


def packet_digest(df: DataFrame) -> DataFrame:
    """SHA-256 of a packet's sorted distinct ``id@version`` entries; a packet is bounded by its page."""
    entry = F.concat_ws("@", F.col("id").cast("string"), F.col("version").cast("string"))
    return df.groupBy("request_id").agg(F.countDistinct(entry).alias("entries"), sha(F.concat_ws(",", F.array_sort(F.collect_set(entry)))).alias("digest"))


def packet_stats(df: DataFrame, tokens: int) -> DataFrame:
    """Characters, estimated tokens and whether they are above the budget, by packet."""
    n = df.groupBy("request_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").cast("long").alias("chars"))
    return n.withColumn("tokens", F.ceil(F.col("chars") / 4).cast("long")).withColumn("over_budget", F.col("tokens") > tokens)


def mark_admitted(units: DataFrame, trace: DataFrame) -> DataFrame:
    return units.join(trace.select("request_id", "id", "decision"), ["request_id", "id"], "left").withColumn("admitted", F.coalesce(F.col("decision").isin("mandatory", "admitted"), F.lit(False)))


def match_roles(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence roles ``(query_id, role, value)`` against ``(source_id, role, value)``: a source must have every role's value.

    Queries that want the same values are one class, and so are sources that have the same of the wanted ones; classes are
    matched, not queries and sources, so a value that very many share joins once a pair of classes.
    """
    pair = F.struct("role", "value")
    wants = queries.where("value is not null").groupBy("query_id").agg(F.array_sort(F.collect_set(pair)).alias("wants"))
    asked = settled(wants.select("wants").distinct().withColumn("asked", F.monotonically_increasing_id()))
    each = asked.select("asked", F.size("wants").alias("need"), F.inline("wants"))
    useful = sources.join(each.select("role", "value").distinct().hint("merge"), ["role", "value"], "left_semi")
    has = useful.groupBy("source_id").agg(F.array_sort(F.collect_set(pair)).alias("has"))
    kinds = settled(has.groupBy("has").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first")).withColumn("kind", F.monotonically_increasing_id()))
    got = each.join(kinds.select("kind", F.inline("has")).hint("merge"), ["role", "value"]).groupBy("asked", "kind", "need").agg(F.count(F.lit(1)).alias("got"))
    full = got.where("got = need").join(kinds.select("kind", "n", "first").hint("merge"), "kind").groupBy("asked").agg(F.sum("n").alias("n"), F.min("first").alias("source_id"))
    answers = asked.join(full.hint("merge"), "asked").select("wants", "n", "source_id")
    j = queries.select("query_id").distinct().join(wants.join(answers.hint("merge"), "wants"), "query_id", "left")
    return j.select("query_id", F.when(F.col("n").isNull(), "not_supported").when(F.col("n") == 1, "supported").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("source_id")).alias("source_id"))


def bind_sources(packets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted sources ``(packet, source)``: bound if the packet has it; a packet lacking one is refused."""
    have = packets.select("packet", "source", F.lit(True).alias("there")).distinct()
    j = wanted.join(have, ["packet", "source"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return j.groupBy("packet").agg(F.count(F.lit(1)).alias("wanted"), F.sum(F.col("there").cast("long")).alias("bound"), F.min("there").alias("accepted"))


def resolve_sources(selected: DataFrame, references: DataFrame, docs: DataFrame) -> DataFrame:
    """Full text of selected references ``(query_id, ref)`` by ``(ref, doc_id, start, end, sha)``, or the reason against it."""
    times = F.count(F.lit(1)).over(Window.partitionBy("query_id", "ref"))
    j = selected.withColumn("times", times).join(references, "ref", "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    body = slice_text("text", "start", "end")
    reason = first_reason((F.col("times") > 1, "repeated"), (F.col("doc_id").isNull(), "unregistered"), (F.col("text").isNull(), "no_document"), (F.col("end") > F.length("text"), "bounds"), (sha(body) != F.col("sha"), "hash"))
    return j.withColumn("reason", reason).select("query_id", "ref", "reason", F.when(F.col("reason").isNull(), body).alias("text"))


