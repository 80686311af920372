"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by every document.

Texts are normalised to their words (A-Z lower-cased, one blank between words).  A test item's windows are its runs of
``n`` words, or all of its words if it has fewer.  Distinct windows, with their words and a number, are written once.
They reach the tasks as a sorted set of 64-bit hashes with the windows' own bytes beside it, at most ``set_bytes`` at a
time: a set beyond that is cut by hash into parts, each of which scans the documents in turn, so that neither the driver
nor a task ever holds more than one part.  A scan hashes all word windows of a text at once, looks them up, and verifies
every hit on the bytes of its words.  Documents are never shuffled; only which windows were found is joined to the items.

Equal sets of found windows are resolved to items once, however many documents share them.

Defined cases: a null text has no words; a null or empty item has no window; rows that repeat an id get a row each;
items that repeat an id are one item with the windows of all its rows; windows of an item without id mark words but
name no item; very long texts are scanned whole, a bounded number of windows at a time; an empty table gives no rows,
an empty benchmark leaves every document clean; columns other than those named are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, byte_chunks, column, gram_hash, prefix_hash, read_table, span_hash, staged, table, words

N_WORDS, SET_BYTES = 10, 64 << 20

#: bytes of a word: digits, letters and all bytes of characters beyond ASCII
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

#: what a window takes in a set besides its bytes: hash, number, length in words, bounds
_ENTRY = 28
#: verified at once
_HITS = 1 << 16

SPANS, FOUND = "array<struct<start:long,end:long>>", "array<long>"


def normalised(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts and what they look like end to end, a blank behind each.

    Returns starts and ends of words in ``data``, each row's first word, hashes of words, the words' bytes and each word's
    place in these.
    """
    lowered = ASCII_LOWER[data]
    starts, ends, first = words(lowered, bounds, IS_WORD)
    edge = np.zeros(len(lowered) + 1, dtype=np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    keep = np.cumsum(edge[:-1]) > 0
    place = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    body = np.full(place[-1], 32, dtype=np.uint8)
    blank = np.zeros(len(body), dtype=bool)
    blank[place[1:] - 1] = True
    body[~blank] = lowered[keep]
    return starts, ends, first, span_hash(prefix_hash(lowered), starts, ends), body, place


def item_windows(tests: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(item, gram, n_words, body) for every window of every row of ``tests(item_id, text)``; item as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in byte_chunks(batches):
            _, _, first, word, body, place = normalised(data, bounds)
            whole = gram_hash(word, n)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                if a < b:
                    k = min(n, b - a)
                    gram = whole[a : b - k + 1] if k == n else gram_hash(word[a:b], k)
                    bodies = [body[place[j] : place[j + k] - 1].tobytes() for j in range(a, b - k + 1)]
                    yield table({"item": (pa.repeat(rows.column(0)[i], len(gram)), None), "gram": (gram.view(np.int64), pa.int64()), "n_words": (np.full(len(gram), k), pa.int32()), "body": (bodies, pa.binary())})

    return tests.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, gram long, n_words int, body binary")


class GramSet:
    """One part of the set: distinct windows sorted by hash, with their bytes."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by("gram")
        self.gram = rows.column("gram").to_numpy()
        self.number = rows.column("window").to_numpy()
        self.n_words = rows.column("n_words").to_numpy()
        bodies = rows.column("body").to_pylist()
        self.end = np.cumsum([len(b) for b in bodies], dtype=np.int64)
        self.body = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        self.sizes = sorted(set(self.n_words.tolist()))

    def find(self, gram: np.ndarray, k: int, place: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the gram, window number) of every gram whose words equal a window's; windows of equal hash are all compared."""
        low, high = np.searchsorted(self.gram, gram, "left"), np.searchsorted(self.gram, gram, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        where = np.repeat(hit, many)
        entry = np.repeat(low[hit], many) + np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
        right = np.zeros(len(where), dtype=bool)
        for at in range(0, len(where), _HITS):
            w, e = where[at : at + _HITS], entry[at : at + _HITS]
            size = place[w + k] - 1 - place[w]
            begin = self.end[e] - np.diff(self.end, prepend=0)[e]
            same = (self.n_words[e] == k) & (self.end[e] - begin == size)
            w, size, begin = w[same], size[same], begin[same]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differ = body[np.repeat(place[w], size) + step] != self.body[np.repeat(begin, size) + step]
            wrong = np.bincount(np.repeat(np.arange(len(w)), size), weights=differ, minlength=len(w)) > 0
            right[at + np.flatnonzero(same)] = ~wrong
        return where[right], self.number[entry[right]]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal ones; touching spans are one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return start[head], reach[np.append(head[1:], len(start)) - 1] if len(head) else reach


def _scan(rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, grams: GramSet) -> tuple[np.ndarray, list, list]:
    """Each row's number of words, and the rows' spans (word numbers) and windows found, with those of earlier parts."""
    _, _, first, word, body, place = normalised(data, bounds)
    doc, at, length, number = [], [], [], []
    for k in grams.sizes:
        gram = gram_hash(word, k).view(np.int64)
        where, found = grams.find(gram, k, place, body)
        row = np.searchsorted(first, where, "right") - 1
        inside = where + k <= first[row + 1]
        doc, at, length, number = doc + [row[inside]], at + [where[inside]], length + [np.full(inside.sum(), k)], number + [found[inside]]
    row = np.concatenate(doc) if doc else np.zeros(0, dtype=np.int64)
    start = np.concatenate(at) if at else row
    end, number = (start + np.concatenate(length), np.concatenate(number)) if at else (row, row)
    spans, windows = column(rows, "spans").to_pylist(), column(rows, "windows").to_pylist()
    order = np.argsort(row, kind="stable")
    row, start, end, number = row[order], start[order], end[order], number[order]
    for i in np.unique(row).tolist():
        a, b = np.searchsorted(row, (i, i + 1))
        old = np.array([(s["start"], s["end"]) for s in spans[i]], dtype=np.int64).reshape(-1, 2)
        s, e = merged(np.concatenate([old[:, 0], start[a:b] - first[i]]), np.concatenate([old[:, 1], end[a:b] - first[i]]))
        spans[i] = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]
        windows[i] = sorted({*windows[i], *number[a:b].tolist()})
    return np.diff(first), spans, windows


def _pass(rows: DataFrame, part: Broadcast, keep_text: bool) -> DataFrame:
    """``rows`` with spans and windows of one part added."""
    out = rows if keep_text else rows.drop("text")
    names = out.columns
    kind = {"n_words": pa.int64(), "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})), "windows": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = part.value
        for chunk, data, bounds in byte_chunks(batches):
            n_words, spans, windows = _scan(chunk, data, bounds, grams)
            new = {"n_words": n_words, "spans": spans, "windows": windows}
            yield table({c: (new[c], kind[c]) if c in new else (column(chunk, c), None) for c in names})

    return rows.mapInArrow(run, out.schema)


def found_windows(docs: DataFrame, numbered: DataFrame, passed: list[str], set_bytes: int = SET_BYTES, keep_text: bool = False) -> DataFrame:
    """``passed`` columns, n_words, spans (word numbers) and windows (and text) of every row of ``docs``, scanned part by part.

    ``numbered``: (gram, n_words, body, window), distinct.  With one part nothing is written between.
    """
    sc = docs.sparkSession.sparkContext
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("body") + _ENTRY), F.lit(0)).alias("size")).first()["size"]
    parts = max(1, -(-2 * size // set_bytes)) if size > set_bytes else 1
    rows = docs.select(*passed, F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast(FOUND).alias("windows"))
    for i in range(parts):
        held = numbered.where(F.pmod(F.xxhash64("body"), F.lit(parts)) == i).select("gram", "n_words", "body", "window").toArrow()
        rows = _pass(rows, sc.broadcast(GramSet(held)), keep_text or i + 1 < parts)
        if i + 1 < parts:
            rows = staged(rows, "scanned")
    return rows


def numbered_windows(tests: DataFrame, n: int = N_WORDS) -> tuple[DataFrame, DataFrame]:
    """(gram, n_words, body, window): distinct windows of the items; and (window, item): who has them."""
    windows = staged(item_windows(tests, n).distinct(), "item-windows")
    numbered = staged(windows.select("gram", "n_words", "body").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return numbered, windows.join(numbered.hint("merge"), ["gram", "n_words", "body"]).select("window", "item")


def contamination(docs: DataFrame, tests: DataFrame, n: int = N_WORDS, set_bytes: int = SET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs(doc_id, text)``."""
    numbered, members = numbered_windows(tests, n)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = found_windows(ids, numbered, ["doc_id"], set_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    scanned = staged(scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), "windows"), "scanned")
    # every set of windows once, under a name of 128 bits
    name = F.substring(F.sha2(F.array_join("windows", ","), 256), 1, 32)
    hit = scanned.where("n_hit > 0").withColumn("name", name)
    sets = hit.select("name", "windows").groupBy("name").agg(F.first("windows").alias("windows"))
    pairs = sets.select("name", F.explode("windows").alias("window")).join(members.hint("merge"), "window").select("name", "item").distinct()
    items = F.array_sort(F.collect_list("item"))  # a set's items, which its digest needs in one row
    named = pairs.groupBy("name").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    named = staged(named, "named")
    rest = scanned.where("n_hit = 0").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    return hit.join(named.hint("merge"), "name").select(columns).union(rest.select(columns)).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, tests: DataFrame, remove: str = "spans", n: int = N_WORDS, share: float = 0.0, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` without contaminated text, with n_words and n_hit; other columns stay (but for these two, which are replaced).

    ``remove="spans"`` cuts, in every text, from the first byte of each run of hit words to its last; a text that loses
    nothing is returned as it is.  ``remove="documents"`` drops the rows in which more than ``share`` of the words are hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    numbered, _ = numbered_windows(tests, n)
    passed = [c for c in docs.columns if c not in ("text", "n_words", "n_hit", "spans", "windows")]
    scanned = found_windows(docs, numbered, passed, set_bytes, keep_text=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    scanned = scanned.withColumn("n_hit", n_hit)
    if remove == "documents":
        return scanned.where((F.col("n_hit") == 0) | (F.col("n_hit") <= share * F.col("n_words"))).drop("spans", "windows")
    kept = scanned.drop("spans", "windows")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, bounds in byte_chunks(batches):
            starts, ends, first = words(ASCII_LOWER[data], bounds, IS_WORD)
            out = column(chunk, "text").to_pylist()
            for i, spans in enumerate(column(chunk, "spans").to_pylist()):
                at, left = bounds[i], []
                for s in spans:
                    left.append(data[at : starts[first[i] + s["start"]]].tobytes())
                    at = ends[first[i] + s["end"] - 1]
                if spans:
                    out[i] = b"".join([*left, data[at : bounds[i + 1]].tobytes()]).decode()
            yield table({c: (out, pa.string()) if c == "text" else (column(chunk, c), None) for c in names})

    return scanned.mapInArrow(run, kept.schema)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
tests AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
spans AS (SELECT item_id, w, least(len(w), {N_WORDS}) AS k FROM tests WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS body FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM spans)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS body FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
hits AS (SELECT r, g.k, i, item_id FROM grams g JOIN windows USING (k, body)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hits)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
