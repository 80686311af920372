"""Projections, filters and integrity checks.  What is excluded comes out with a reason; nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest, dot, first_reason, settled, sha, slice_text, union, uuid_from


def active_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of documents that are not withdrawn, with their text cut from the document, in ingest order."""
    live = docs.where(F.col("tombstoned_at").isNull()).select("doc_id", "ingested_tick", "text")
    return chunks.join(live, "doc_id").select("doc_id", "idx", "start", "end", "ingested_tick", slice_text("text", "start", "end").alias("text"))


def withdraw(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents with the first withdrawal's timestamp; whether this batch withdrew them."""
    first = requests.groupBy("doc_id").agg(F.min("at").alias("at"))
    return docs.join(first, "doc_id", "left").select("doc_id", F.coalesce("tombstoned_at", "at").alias("tombstoned_at"), (F.col("tombstoned_at").isNull() & F.col("at").isNotNull()).alias("withdrawn_now"))


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose key begins with ``prefix`` literally."""
    return df.where(F.startswith(F.col(column), F.lit(prefix)))


def gate_candidates(candidates: DataFrame, requests: DataFrame, least_integrity: float = 0.5) -> DataFrame:
    """First reason against each candidate for its request: project, workstream, privacy, integrity, superseded, archived."""
    j = candidates.join(requests, "request_id")
    return j.select("request_id", "candidate_id", first_reason(
        (F.col("project") != F.col("want_project"), "cross_project"), (F.col("workstream") != F.col("want_workstream"), "cross_workstream"), (F.col("private") & ~F.col("may_see_private"), "privacy"),
        (F.col("integrity") < least_integrity, "low_integrity"), (F.col("status") == "superseded", "superseded"), (F.col("status") == "archived", "archived"), otherwise="pass").alias("reason"))


def assign_section(df: DataFrame) -> DataFrame:
    """Packet section and mandatory flag from pool, type and status."""
    section = F.when(F.col("pool") == "pinned", "authority").when(F.col("type") == "constraint", "constraints").when((F.col("type") == "decision") & (F.col("status") == "active"), "decisions").when(F.col("status") == "superseded", "history").otherwise("evidence")
    return df.withColumns({"section": section, "mandatory": (F.col("pool") == "pinned") | ((F.col("type") == "constraint") & (F.col("status") == "active"))})


def redact(df: DataFrame, allow: list[str]) -> DataFrame:
    return df.select([c for c in allow if c in df.columns])


def check_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """First reason against spans ``(id, doc_id, start, end, quote)``: no text, bounds, other words; else ok."""
    j = spans.join(texts.select("doc_id", "text"), "doc_id", "left")
    return j.select("id", first_reason((F.col("text").isNull(), "no_text"), ((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("text")), "bounds"), (slice_text("text", "start", "end") != F.col("quote"), "mismatch"), otherwise="ok").alias("reason"))


#: quotes that one task searches in one text at once
QUOTES_AT_ONCE = 4096


def occurrences(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, doc_id, at): every place of a quote ``(id, doc_id, quote)`` in its document, overlapping ones too; empty quotes have none.

    Equal quotes of a document are searched once, all of a document's in one pass a power of two: a rolling hash of the first
    2^k characters finds the places of all quotes with 2^k to 2^(k+1) - 1 characters, and each is compared in full.
    """
    distinct = quotes.where(F.length("quote") > 0).select("doc_id", "quote").distinct()
    n = distinct.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / QUOTES_AT_ONCE).alias("parts"))
    dealt = distinct.join(n.hint("merge"), "doc_id").withColumn("part", F.pmod(F.xxhash64("quote"), F.col("parts")))
    lists = dealt.groupBy("doc_id", "part").agg(F.collect_list("quote").alias("quotes"))
    joined = lists.join(texts.select("doc_id", "text").where("text is not null").hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, held, text in zip(batch.column("doc_id"), batch.column("quotes"), batch.column("text")):
                wanted = held.as_py()
                which, at = places(text.as_py(), wanted)
                yield pa.RecordBatch.from_arrays([pa.repeat(doc, len(at)), held.values.take(pa.array(which)), pa.array(at)], names=["doc_id", "quote", "at"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = joined.select("doc_id", "quotes", "text").mapInArrow(run, f"doc_id {kind}, quote string, at long")
    return quotes.select("id", "doc_id", "quote").join(found.hint("merge"), ["doc_id", "quote"]).select("id", "doc_id", "at")


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _rolling(text: str, n: int) -> np.ndarray:
    """Hash of every run of ``n`` characters, equal for equal runs of any text; ``n`` is a power of two."""
    run = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(29)
    width = 1
    while width < n:  # two neighbours of half the length
        run = (run[:-width] * _STEP) ^ (run[width:] + (run[:-width] >> np.uint64(31)))
        width *= 2
    return run


def places(text: str, quotes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the quote, place) of every occurrence of distinct, non-empty quotes."""
    which, at = [], []
    classes: dict[int, list[int]] = {}
    for i, q in enumerate(quotes):
        classes.setdefault(len(q).bit_length() - 1, []).append(i)
    for k, members in classes.items():
        size = 1 << k
        if size > len(text):
            continue
        run = _rolling(text, size)
        heads = np.array([_rolling(quotes[i][:size], size)[0] for i in members], dtype=np.uint64)
        order = np.argsort(heads, kind="stable")
        heads = heads[order]
        low, high = np.searchsorted(heads, run, "left"), np.searchsorted(heads, run, "right")
        for p in np.flatnonzero(high > low).tolist():
            for m in order[low[p] : high[p]].tolist():
                if text.startswith(quotes[members[m]], p):
                    which.append(members[m])
                    at.append(p)
    return np.array(which, dtype=np.int64), np.array(at, dtype=np.int64)


def bind_quotes(quotes: DataFrame, texts: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Bind ``(id, doc_id, quote, hint)``: a unique place; else the one nearest the hint if no other is as near; else the only
    one within a span of ``anchors (id, start, end)``; else ambiguous; missing if there is none."""
    at = settled(occurrences(quotes, texts)).join(quotes.select("id", "hint").hint("merge"), "id").withColumn("far", F.abs(F.col("at") - F.col("hint")))
    least = at.groupBy("id").agg(F.min("far").alias("least"))
    seen = at.join(least.hint("merge"), "id").withColumn("near", F.col("far") == F.col("least")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("near"), 1)).alias("nearest"), F.min("at").alias("only"), F.min(F.when(F.col("near"), F.col("at"))).alias("hinted"))
    j = quotes.select("id").join(seen.hint("merge"), "id", "left")
    if anchors is None:
        j = j.withColumns({"inside": F.lit(0), "anchored": F.lit(None).cast("long")})
    else:
        sized = quotes.select("id", F.length("quote").alias("size"))
        spans = at.join(sized.hint("merge"), "id").join(anchors.select("id", "start", "end").distinct().hint("merge"), "id").where("start <= at and at + size <= end")
        inside = spans.groupBy("id").agg(F.countDistinct("at").alias("inside"), F.min("at").alias("anchored"))
        j = j.join(inside.hint("merge"), "id", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "unique").when(F.col("nearest") == 1, "hinted").when(F.col("inside") == 1, "anchored").otherwise("ambiguous")
    place = F.when(F.col("n") == 1, F.col("only")).when(F.col("nearest") == 1, F.col("hinted")).when(F.col("inside") == 1, F.col("anchored"))
    return j.select("id", status.alias("status"), place.cast("int").alias("start"))


def validate_candidates(entities: DataFrame, relations: DataFrame, kinds: list[str], cap: int = 64) -> DataFrame:
    """Violations of extracted tables: repeated ids, unknown or equal endpoints, unknown kinds, confidence, size."""
    name = lambda df, what: df.select("chunk", F.col("id").cast("string").alias("id"), F.lit(what).alias("violation"))
    repeated = entities.groupBy("chunk", "id").count().where("count > 1")
    ends = relations.select("chunk", "id", F.explode(F.array("source", "target")).alias("end"))
    dangling = ends.join(entities.select("chunk", F.col("id").alias("end")), ["chunk", "end"], "left_anti").select("chunk", "id").distinct()
    large = relations.groupBy("chunk").count().where(F.col("count") > cap).withColumn("id", F.lit(-1))
    return union(name(repeated, "duplicate_entity"), name(dangling, "unknown_endpoint"), name(relations.where("source = target"), "equal_endpoints"), name(relations.where(~F.col("kind").isin(kinds)), "unknown_kind"), name(relations.where("confidence < 0 or confidence > 1"), "confidence"), name(large, "too_many"))


def validate_vectors(df: DataFrame, dim: int, tolerance: float) -> DataFrame:
    """First reason against vectors ``(id, embedding)``: missing, dimension, not finite, norm; else ok."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select("id", first_reason((F.col("embedding").isNull(), "missing"), (F.size("embedding") != dim, "dimension"), (bad, "not_finite"), (F.abs(F.sqrt(dot("embedding", "embedding")) - 1) > tolerance, "norm"), otherwise="ok").alias("reason"))


def policy_violations(records: DataFrame, channels: DataFrame) -> DataFrame:
    """Problems of ``(record_id, channel, value, support, zero_kind)`` against the list of channels (a fixed table)."""
    every = records.select("record_id").distinct().crossJoin(F.broadcast(channels))
    j = every.join(records, ["record_id", "channel"], "left")
    problem = first_reason((F.col("value").isNull(), "missing"), (F.col("value") < 0, "negative"), ((F.col("value") > 0) & (F.col("support") == 0), "unsupported"), ((F.col("value") > 0) & F.col("zero_kind").isNotNull(), "zero_kind_on_positive"), ((F.col("value") == 0) & ~F.coalesce(F.col("zero_kind").isin("absent", "not_applicable"), F.lit(False)), "zero_kind_refused"))
    return j.select("record_id", "channel", problem.alias("problem")).where("problem is not null")


def inflight_violations(exchanges: DataFrame) -> DataFrame:
    """Projects with more than one exchange in flight."""
    return exchanges.where(F.col("status").isin("sending", "evaluation_pending")).groupBy("project_id").agg(F.count(F.lit(1)).alias("in_flight")).where("in_flight > 1")


def with_digest(df: DataFrame, cols: list[str], name: str = "digest") -> DataFrame:
    return df.withColumn(name, digest(*cols))


def with_uuid(df: DataFrame, cols: list[str], name: str = "uuid") -> DataFrame:
    return df.withColumn(name, uuid_from(digest(*cols)))


def check_twins(live: DataFrame, library: DataFrame) -> DataFrame:
    """Live rows without an equal durable twin: missing, other content, or a stored hash that its content does not have."""
    own = library.select("id", F.col("content_hash").alias("kept"), sha(F.col("text")).alias("real"))
    j = live.select("id", sha(F.col("text")).alias("now")).join(own, "id", "left")
    return j.select("id", first_reason((F.col("kept").isNull(), "missing"), (F.col("kept") != F.col("real"), "hash"), (F.col("now") != F.col("real"), "content")).alias("violation")).where("violation is not null")


def allowed(column: str, values: list[str]) -> Column:
    return F.coalesce(F.col(column).isin(values), F.lit(False))
