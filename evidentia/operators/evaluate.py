"""Evaluation of retrieval and extraction runs: metrics, intervals, audits and comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_reason, numbered, settled, sha, top, union, wilson
from . import lists as L
from .sets import similar_sets


def ir_metrics(rankings: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, arm, p_at_k..., rr): precision with the fixed denominator k, and reciprocal rank (0 without a hit)."""
    hit = rankings.join(labels.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    at = [(F.sum(F.when(F.col("hit").isNotNull() & (F.col("rank") <= k), 1).otherwise(0)) / k).alias(f"p_at_{k}") for k in ks]
    return hit.groupBy("query_id", "arm").agg(*at, F.coalesce(1 / F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))), F.lit(0.0)).alias("rr"))


def mean_metrics(per_query: DataFrame, columns: list[str], base: str, other: str) -> DataFrame:
    """Means of each metric for two arms and their difference."""
    arm = lambda a, c: F.avg(F.when(F.col("arm") == a, F.col(c)))
    wide = [x for c in columns for x in (arm(base, c).alias(f"{c}_{base}"), arm(other, c).alias(f"{c}_{other}"), (arm(other, c) - arm(base, c)).alias(f"{c}_delta"))]
    return per_query.agg(*wide)


def recall_metrics(scores: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query of ``(query_id, id, score)``: recall at k, rank of the first hit, extremes and spread of scores, top five."""
    ranked = numbered(scores, ["query_id"], [F.desc("score"), "id"]).join(labels.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    hits = F.count("hit")
    at = [(F.count(F.when(F.col("rank") <= k, F.col("hit"))) / F.when(hits > 0, hits)).alias(f"recall_{k}") for k in ks]
    five = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "id")))), lambda x: x["id"].cast("string")), ",")
    return ranked.groupBy("query_id").agg(*at, F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"), F.min("score").alias("low"), F.max("score").alias("high"), (F.max("score") - F.min("score")).alias("spread"), five.alias("top_five"))


def recall_lists(lists: L.Lists, ks: list[int], scale: int = L.NINE) -> DataFrame:
    """``recall_metrics`` of packed lists, whose marked rows are the relevant ones."""
    def each(query, ids, codes, hit):
        order = L.largest_first(codes)
        at = np.flatnonzero(hit[order]) + 1
        known = codes[codes != L.NULL]
        low, high = (float(L.scores(np.array([x]), scale)[0].as_py()) for x in (known.min(), known.max())) if len(known) else (None, None)
        recall = {f"recall_{k}": int((at <= k).sum()) / len(at) if len(at) else None for k in ks}
        return {"query_id": query, **recall, "first_hit": int(at[0]) if len(at) else None, "low": low, "high": high, "spread": None if low is None else high - low, "top_five": ",".join(str(i) for i in ids[order[:5]].tolist() if i != L.NO_ID)}

    recall = ", ".join(f"recall_{k} double" for k in ks)
    return L.per_query(lists, each, f"query_id {L._kind(lists, 'query_id')}, {recall}, first_hit int, low double, high double, spread double, top_five string")


def rank_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Absolute rank difference of every id; an absent rank is one more than the list's length."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"], "full")
    both = both.join(n(a, "na"), "query_id", "left").join(n(b, "nb"), "query_id", "left")
    x, y = F.coalesce("ra", F.coalesce("na", F.lit(0)) + 1), F.coalesce("rb", F.coalesce("nb", F.lit(0)) + 1)
    return both.select("query_id", "id", F.abs(x - y).cast("long").alias("delta"), F.col("ra").isNull().alias("only_b"), F.col("rb").isNull().alias("only_a"))


def cohort_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query: sizes of the overlap and the symmetric difference of two lists, Jaccard, and whether their orders differ."""
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"], "full")
    common = F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1))
    return both.groupBy("query_id").agg(common.alias("overlap"), (F.count(F.lit(1)) - common).alias("apart"), (common / F.count(F.lit(1))).alias("jaccard"), F.max(~F.col("ra").eqNullSafe(F.col("rb"))).alias("differs"))


def rank_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation of rank positions over common ids; null below two or without variance."""
    j = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"])
    ok = (F.count(F.lit(1)) >= 2) & (F.min("ra") < F.max("ra")) & (F.min("rb") < F.max("rb"))
    return j.groupBy("query_id").agg(F.count(F.lit(1)).alias("common"), F.when(ok, F.corr("ra", "rb")).alias("correlation"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, minimum, median, nearest-rank 90th percentile, maximum and mean of a group's values."""
    w = Window.partitionBy(*by)
    placed = df.withColumns({"nth": F.row_number().over(w.orderBy(value)), "n": F.count(value).over(w)})
    return placed.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.expr(f"percentile({value}, 0.5)").alias("median"),
        F.max(F.when(F.col("nth") == F.ceil(F.col("n") * 0.9), F.col(value))).alias("p90"), F.max(value).alias("high"), F.avg(value).alias("mean"),
    )


def collisions(vectors: DataFrame, least: int = 2) -> DataFrame:
    """Groups of identical vectors: members, smallest id, and their share of all vectors."""
    groups = vectors.groupBy("embedding").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id")).where(F.col("members") >= least)
    return groups.select("first_id", "members")


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum, median, 95th percentile (linear between neighbours) and maximum."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.max(value).alias("high"))


def rates(df: DataFrame, by: list[str], success: Column) -> DataFrame:
    """Rate of success by group with its 95 % Wilson interval."""
    counted = df.groupBy(*by).agg(F.sum(success.cast("long")).alias("successes"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return counted.withColumns({"rate": F.col("successes") / F.col("n"), "low": low, "high": high})


def macro_rates(df: DataFrame, arm: str, family: str, success: Column) -> DataFrame:
    """Mean over families of the families' rates, by arm."""
    per = df.groupBy(arm, family).agg(F.avg(success.cast("double")).alias("rate"))
    return per.groupBy(arm).agg(F.count(F.lit(1)).alias("families"), F.avg("rate").alias("macro"))


def hypotheses(macro: DataFrame, arm: str, base: str, thresholds: dict[str, float]) -> DataFrame:
    """Whether each arm's macro rate exceeds the base arm's by its threshold."""
    other = macro.where(F.col(arm) != base).crossJoin(F.broadcast(macro.where(F.col(arm) == base).select(F.col("macro").alias("base"))))
    least = F.coalesce(*[F.when(F.col(arm) == a, F.lit(v)) for a, v in thresholds.items()])
    return other.select(arm, F.round(F.col("macro") - F.col("base"), 9).alias("difference"), least.alias("threshold"), (F.round(F.col("macro") - F.col("base"), 9) >= least).alias("supported"))


def cluster_bootstrap(rows: DataFrame, draws: DataFrame, base: str, other: str) -> DataFrame:
    """Bootstrap of the macro difference between two arms, resampling domains.

    rows: (domain, family, arm, success); draws: (replicate, domain, times), how often each domain was drawn.  A family
    without rows of either arm makes a replicate invalid.  Counts per domain are summed first, so a replicate joins sums.
    """
    cell = rows.groupBy("domain", "family", "arm").agg(F.sum(F.col("success").cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    families = rows.select("family").distinct().count()
    per = draws.join(cell, "domain").groupBy("replicate", "family", "arm").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("rate"))
    pair = per.groupBy("replicate", "family").agg(F.max(F.when(F.col("arm") == other, F.col("rate"))).alias("o"), F.max(F.when(F.col("arm") == base, F.col("rate"))).alias("b"))
    rep = pair.groupBy("replicate").agg(F.count(F.col("o") - F.col("b")).alias("families"), F.avg(F.col("o") - F.col("b")).alias("difference"))
    return _interval(rep, families)


def _interval(replicates: DataFrame, families: int) -> DataFrame:
    ok = F.when(F.col("families") == families, F.col("difference"))
    return replicates.agg(F.count(ok).alias("valid"), F.sum((F.col("families") != families).cast("long")).alias("invalid"), F.percentile(ok, F.lit(0.025)).alias("low"), F.percentile(ok, F.lit(0.975)).alias("high"), F.avg(ok).alias("mean"))


#: sums of a domain, family and arm that tasks hold, and weights that a task holds at once
CELLS, WEIGHTS = 1_000_000, 4_000_000


def bootstrap(rows: DataFrame, replicates: int, base: str, other: str) -> DataFrame:
    """``cluster_bootstrap`` on ``hash_draws`` of the rows' domains, without a table of replicates and draws.

    A task turns a batch of replicates into weight vectors, how often each domain is drawn, and multiplies them with the sums of
    all domains.  Beyond ``CELLS`` sums the draws are joined instead.
    """
    both = rows.where(F.col("arm").isin(base, other)).groupBy("domain", "family").agg(*[F.sum(F.when(F.col("arm") == arm, value)).alias(f"{arm_}{name}") for arm, arm_ in ((base, "b"), (other, "o")) for name, value in (("s", F.col("success").cast("long")), ("n", F.lit(1)))])
    # domains and families that have rows of other arms alone count too
    every = rows.select("domain", "family").distinct().join(both.hint("merge"), ["domain", "family"], "left")
    held = every.orderBy("domain", "family").limit(CELLS + 1).toArrow()
    if held.num_rows > CELLS:
        return cluster_bootstrap(rows, hash_draws(rows, replicates), base, other)
    places = [np.unique(held.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), return_inverse=True) for c in ("domain", "family")]
    (domains, at), (kinds, family) = places
    sums = np.zeros((4, len(kinds), len(domains)))
    for i, c in enumerate(("bs", "bn", "os", "on")):
        sums[i, family, at] = held.column(c).fill_null(0).to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = shared.value
        n = sums.shape[2]
        for batch in batches:
            step = max(1, WEIGHTS // max(n, 1))
            for first in range(0, batch.num_rows, step):
                ids = batch.column(0).slice(first, step)
                weights = np.zeros((len(ids), n))
                for row, replicate in enumerate(ids.to_pylist()):
                    picks = [int(hashlib.md5(f"{replicate}:{draw}".encode()).hexdigest()[:8], 16) % n for draw in range(1, n + 1)]
                    weights[row] = np.bincount(picks, minlength=n)
                bs, bn, os, on = (weights @ sums[i].T for i in range(4))
                with np.errstate(divide="ignore", invalid="ignore"):
                    difference = os / on - bs / bn
                seen = (on > 0) & (bn > 0)
                count = seen.sum(axis=1)
                mean = np.where(seen, difference, 0).sum(axis=1) / np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(count), pa.array(mean, mask=count == 0)], names=["replicate", "families", "difference"])

    return _interval(rows.sparkSession.range(replicates).mapInArrow(run, "replicate long, families long, difference double"), len(kinds))


def hash_draws(domains: DataFrame, replicates: int) -> DataFrame:
    """(replicate, domain, times): draws with replacement from a hash of the replicate and the draw, the same in any engine."""
    numbered_ = numbered(domains.select("domain").distinct().withColumn("one", F.lit(1)), ["one"], ["domain"], "nth")
    n = F.count(F.lit(1)).over(Window.partitionBy("one"))
    base = numbered_.withColumn("n", n)
    reps = domains.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    drawn = base.select(F.col("nth").alias("draw"), "n").crossJoin(F.broadcast(reps)).withColumn("pick", F.conv(F.substring(F.md5(F.concat_ws(":", F.col("replicate").cast("string"), F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n") + 1)
    return drawn.groupBy("replicate", "pick").agg(F.count(F.lit(1)).alias("times")).join(F.broadcast(base.select("domain", F.col("nth").alias("pick"))), "pick").select("replicate", "domain", "times")


def gate_report(details: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Per family: counts, rates of valid and exact, and whether both reach their thresholds."""
    flag = lambda c: F.avg(F.col(c).cast("double"))
    out = details.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(flag("valid"), 9).alias("valid"), F.round(flag("exact"), 9).alias("exact"), F.min("exact").alias("all_exact"))
    return out.withColumn("passed", (F.col("valid") >= thresholds["valid"]) & (F.col("exact") >= thresholds["exact"]))


def pair_diff(a: DataFrame, b: DataFrame, key: str, atom: str) -> DataFrame:
    """Per key: multiset symmetric difference of two runs' atoms, and whether they agree; null where one run lacks the key."""
    n = lambda df, name: df.groupBy(key, atom).agg(F.count(F.lit(1)).alias(name))
    both = n(a, "x").join(n(b, "y"), [key, atom], "full").groupBy(key).agg(F.sum(F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)))).alias("difference"), F.count("x").alias("in_a"), F.count("y").alias("in_b"))
    there = (F.col("in_a") > 0) & (F.col("in_b") > 0)
    return both.select(key, F.when(there, F.col("difference")).alias("difference"), F.when(there, F.col("difference") == 0).alias("agree"))


def arm_summary(df: DataFrame) -> DataFrame:
    """By arm: entity-weighted mean span, share failed closed, share unknown."""
    return df.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("span") * F.col("entities")) / F.sum("entities")).alias("mean_span"), F.avg(F.col("failed").cast("double")).alias("failed"), F.avg(F.col("unknown").cast("double")).alias("unknown"))


def list_delta(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per key of ``(key, pos, item)`` lists: exact, equal as multisets, differing in order only, missing and extra items."""
    n = lambda df, name: df.groupBy("key", "item").agg(F.count(F.lit(1)).alias(name))
    sets = n(expected, "x").join(n(actual, "y"), ["key", "item"], "full").groupBy("key").agg(F.sum(F.greatest(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)), F.lit(0))).alias("missing"), F.sum(F.greatest(F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0)), F.lit(0))).alias("extra"))
    place = expected.select("key", "pos", F.col("item").alias("i")).join(actual.select("key", "pos", F.col("item").alias("j")), ["key", "pos"], "full").groupBy("key").agg(F.min(F.coalesce(F.col("i") == F.col("j"), F.lit(False))).alias("exact"))
    out = sets.join(place, "key")
    same = (F.col("missing") == 0) & (F.col("extra") == 0)
    return out.select("key", "exact", same.alias("multiset_equal"), (same & ~F.col("exact")).alias("order_only"), "missing", "extra")


def score_answers(answers: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Per case: number of matching fields (null-safe) and the verdict: missing, consistent or mismatch."""
    j = expected.join(answers.select("case_id", *[F.col(f).alias(f"got_{f}") for f in fields], F.lit(True).alias("there")), "case_id", "left")
    match = sum((F.col(f).eqNullSafe(F.col(f"got_{f}")).cast("int") for f in fields[1:]), F.col(fields[0]).eqNullSafe(F.col(f"got_{fields[0]}")).cast("int"))
    return j.select("case_id", match.alias("matching"), F.when(F.col("there").isNull(), "missing").when(match == len(fields), "consistent").otherwise("mismatch").alias("verdict"))


def score_terms(df: DataFrame) -> DataFrame:
    """Term oracle of ``(id, text, required, forbidden)``: required terms absent, forbidden ones present, passed."""
    low = F.lower("text")
    absent, present = F.size(F.filter("required", lambda w: ~F.contains(low, F.lower(w)))), F.size(F.filter("forbidden", lambda w: F.contains(low, F.lower(w))))
    return df.select("id", absent.alias("absent"), present.alias("present"), ((absent == 0) & (present == 0)).alias("passed"))


def classify_failures(errors: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """First matching rule ``(stage, pattern, class)`` of each error ``(id, stage, message)``, else unclassified."""
    tests = [((F.col("stage") == stage) & F.col("message").rlike(pattern), name) for stage, pattern, name in rules]
    return errors.select("id", "stage", first_reason(*tests, otherwise="unclassified").alias("class"))


def packet_audit(expected: DataFrame, admitted: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per expected ``(packet, id)``: admitted, excluded with its reason, or unseen."""
    j = expected.join(admitted.select("packet", "id", F.lit(True).alias("in")).distinct(), ["packet", "id"], "left").join(excluded.select("packet", "id", "reason"), ["packet", "id"], "left")
    return j.select("packet", "id", F.when(F.col("in"), "admitted").when(F.col("reason").isNotNull(), F.concat(F.lit("excluded:"), F.col("reason"))).otherwise("unseen").alias("fate"))


def packet_summary(audit: DataFrame, by: list[str]) -> DataFrame:
    return audit.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.sum((F.col("fate") == "admitted").cast("long")).alias("admitted"), F.min(F.col("fate") == "admitted").alias("covered"))


def id_space(cited: DataFrame, known: DataFrame, foreign: DataFrame) -> DataFrame:
    """Cited ids ``(arm, id)`` counted by arm as known, foreign or unknown."""
    j = cited.join(known.select("id", F.lit(1).alias("k")).distinct(), "id", "left").join(foreign.select("id", F.lit(1).alias("f")).distinct(), "id", "left")
    kind = F.when(F.col("k").isNotNull(), "known").when(F.col("f").isNotNull(), "foreign").otherwise("unknown")
    return j.groupBy("arm").agg(*[F.sum((kind == x).cast("long")).alias(x) for x in ("known", "foreign", "unknown")])


def telemetry(df: DataFrame, counters: list[str], by: list[str]) -> DataFrame:
    """Sums of counters, and whether in every row all counters are equal."""
    equal = F.lit(True)
    for c in counters[1:]:
        equal = equal & F.col(counters[0]).eqNullSafe(F.col(c))
    return df.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in counters], F.min(equal).alias("complete"))


def split_leakage(df: DataFrame) -> DataFrame:
    """Texts of ``(id, split, text)`` that stand in more than one split."""
    return df.groupBy(sha(F.col("text")).alias("sha")).agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id")).where("splits > 1")


def contrast_violations(df: DataFrame) -> DataFrame:
    """Groups whose contrast rows have the label of their base row."""
    base = df.where("not contrast").groupBy("group").agg(F.min("label").alias("base"))
    return df.where("contrast").join(base, "group").where(F.col("label") == F.col("base")).groupBy("group").agg(F.count(F.lit(1)).alias("rows"))


def stratified_groups(df: DataFrame, version: str, seed: int, size: int) -> DataFrame:
    """Whole groups with the smallest SHA-256 of (version, seed, stratum, group), ``size`` of them a stratum."""
    groups = df.groupBy("stratum", "group").agg(F.count(F.lit(1)).alias("rows"))
    key = F.sha2(F.concat_ws("|", F.lit(version), F.lit(str(seed)), F.col("stratum").cast("string"), F.col("group").cast("string")), 256)
    return top(groups.withColumn("key", key), ["stratum"], ["key", "group"], size).select("stratum", "group", "rows", "rank")


def rotate_arms(cases: DataFrame, arms: list[str]) -> DataFrame:
    """Order of arms per case, rotated by the case's number."""
    placed = numbered(cases.withColumn("one", F.lit(1)), ["family"], ["case_id"], "nth")
    order = F.posexplode(F.array(*[F.lit(a) for a in arms])).alias("i", "arm")
    return placed.select("family", "case_id", "nth", order).select("family", "case_id", "arm", (F.pmod(F.col("i") - (F.col("nth") - 1), F.lit(len(arms))) + 1).alias("turn"))


def pilot_selection(cases: DataFrame, long: int = 2, control: int = 1) -> DataFrame:
    """Per family the first ``long`` long cases and ``control`` controls by id."""
    ranked = numbered(cases, ["family", "mode"], ["case_id"])
    return ranked.where(((F.col("mode") == "long") & (F.col("rank") <= long)) | ((F.col("mode") == "control") & (F.col("rank") <= control))).select("family", "mode", "case_id")


def audit_cases(cases: DataFrame) -> DataFrame:
    """Counts per family and mode, with distinct groups and repeated ids."""
    return cases.groupBy("family", "mode").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("group").alias("groups"), (F.count(F.lit(1)) - F.countDistinct("case_id")).alias("repeated_ids"))


def region_comparison(selected: DataFrame, least: float = 0.02) -> DataFrame:
    """Pairs of queries of ``(query_id, family, id)`` whose sets of ids have a Jaccard of ``least``: it, identical, same family."""
    j = similar_sets(*[selected.select(F.col("query_id").alias("id"), F.col("id").alias("element"))] * 2, least, ordered=True)
    family = settled(selected.groupBy("query_id").agg(F.min("family").alias("family")))
    of = lambda side, name: family.select(F.col("query_id").alias(side), F.col("family").alias(name)).hint("merge")
    j = j.withColumnsRenamed({"left_id": "a", "right_id": "b"}).join(of("a", "fa"), "a").join(of("b", "fb"), "b")
    whole = (F.col("shared") == F.col("left_size")) & (F.col("shared") == F.col("right_size"))
    return j.select("a", "b", (F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared"))).alias("jaccard"), whole.alias("identical"), (F.col("fa") == F.col("fb")).alias("same_family"))


def stage_summary(df: DataFrame) -> DataFrame:
    """By stage of ``(stage, query_id, first_rank)``: mean and median rank and the number of top hits."""
    return df.groupBy("stage").agg(F.count(F.lit(1)).alias("queries"), F.avg("first_rank").alias("mean_rank"), F.expr("percentile(first_rank, 0.5)").alias("median_rank"), F.sum((F.col("first_rank") == 1).cast("long")).alias("top_one"))


def complete_cases(rows: DataFrame, arms: int) -> DataFrame:
    """Every case of ``(case_id, arm)`` with the number of arms that captured it and whether it is complete."""
    return rows.groupBy("case_id").agg(F.countDistinct("arm").alias("captured")).withColumn("complete", F.col("captured") == arms)


def source_fidelity(original: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, status): equal, changed, missing or extra, by SHA-256 of texts."""
    j = original.select("id", sha(F.col("text")).alias("a")).join(stored.select("id", sha(F.col("text")).alias("b")), "id", "full")
    return j.select("id", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "equal").otherwise("changed").alias("status"))


def range_checks(values: DataFrame, conditions: DataFrame) -> DataFrame:
    """Per channel of ``(id, channel, value)``: rows, rows outside ``(channel, low, high)``, all within.  Conditions: one row a channel."""
    j = values.join(F.broadcast(conditions), "channel")
    return j.groupBy("channel").agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("value").between(F.col("low"), F.col("high"))).cast("long")).alias("outside"), F.min(F.col("value").between(F.col("low"), F.col("high"))).alias("within"))


def duplicate_relations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: relations whose meaning key occurs more than once, and the surplus rows."""
    many = df.groupBy("case_id", *keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.groupBy("case_id").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("surplus"))


def label_audit(df: DataFrame) -> DataFrame:
    """Sources of ``(id, text, label)`` with more than one label."""
    return df.groupBy(sha(F.col("text")).alias("sha")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("label").alias("labels"), F.min("id").alias("first_id")).where("labels > 1")


def hash_audit(df: DataFrame) -> DataFrame:
    """Which rule gives a recorded hash: the raw text, the trimmed text, the lower-cased text, or none."""
    rule = first_reason((F.col("recorded") == sha(F.col("text")), "raw"), (F.col("recorded") == sha(F.trim("text")), "trimmed"), (F.col("recorded") == sha(F.lower("text")), "lower"), otherwise="none")
    return df.select("id", rule.alias("rule"))


def json_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two path tables ``(id, path, value)`` of flattened records."""
    j = a.select("id", "path", F.col("value").alias("x")).join(b.select("id", "path", F.col("value").alias("y")), ["id", "path"], "full")
    return j.where(~F.col("x").eqNullSafe(F.col("y"))).select("id", "path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def score_extraction(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per case of relations ``(case_id, source, kind, target)``: matched, missing, reversed and unexpected, and exact."""
    keys = ["case_id", "source", "kind", "target"]
    e, a = expected.select(keys).distinct(), actual.select(keys).distinct()
    flip = a.select("case_id", F.col("target").alias("source"), "kind", F.col("source").alias("target"))
    matched = e.join(a, keys, "left_semi").withColumn("what", F.lit("matched"))
    lost = e.join(a, keys, "left_anti")
    reversed_ = lost.join(flip, keys, "left_semi").withColumn("what", F.lit("reversed"))
    missing = lost.join(flip, keys, "left_anti").withColumn("what", F.lit("missing"))
    extra = a.join(e, keys, "left_anti").withColumn("what", F.lit("unexpected"))
    n = union(matched, reversed_, missing, extra).groupBy("case_id").agg(*[F.sum((F.col("what") == w).cast("long")).alias(w) for w in ("matched", "missing", "reversed", "unexpected")])
    return n.withColumn("exact", (F.col("missing") + F.col("reversed") + F.col("unexpected")) == 0)
