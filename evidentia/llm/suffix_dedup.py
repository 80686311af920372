"""Removal of passages that already stand earlier in the corpus, by distributed prefix doubling over sampled positions.

Plain prefix doubling ranks every byte position at lengths 1, 2, 4 ... and sorts a pair of ranks per position and
round; at many times the input a round, that is beyond a bounded disk.  Here the rounds run over positions that content
itself selects, and a position leaves as soon as its rank is unique or the threshold is passed:

* *Positions.* A window of ``length`` bytes is represented by the smallest hash among its ``seed``-byte strings.  Equal
  windows select the same string at the same place, so windows are compared only where their strings are equal; about
  one position in 35 is selected, and every window has one.
* *Round 1* ranks positions by ``seed`` bytes.  Positions of a unique rank are dropped with all their windows.
* *Round 2* pairs that rank with the rank of the whole stretch that the position's windows span.  In a tie, every
  occurrence but the first loses all its windows at once.
* *Round 3* takes the first occurrences whose first rank is tied while the second differs (where copies begin, end or are
  edited, and lines shorter than the threshold that many texts share).  Their windows are dealt into four by how far they
  begin before the position; what the windows of a quarter have in common, 83 bytes or more, is ranked, and quarters of a
  unique rank are dropped.
* *Round 4* ranks what is left at the threshold, window by window.

Ranks are 64-bit names of byte strings (fingerprints), so that no round needs a renumbering sort; Spark groups and joins
them.  A window is a repeat if it also starts in a document of smaller id, or earlier in its own; repeats' bytes go.

Defined cases: a null text is empty and keeps the hash of no bytes; texts shorter than ``length`` keep everything; a
null id comes after all others; rows that repeat an id (or have none) are told apart by a 64-bit hash of their text and its
length and don't count as earlier for one another; rows equal in id and text have equal results; a very long text is read
whole by one task, packed; columns other than those named are not read, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, column, mix, prefix_hash, read_table, span_hash, staged, table

LENGTH, SEED = 100, 32
#: bytes whose hashes fit a core's cache; rows of names that go out at once
CACHED_BYTES, ROWS_OUT = 1 << 18, 1 << 16


def selected(data: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Row, first and last window start (in the row), the string's own start, first and second rank of every selected position."""
    n, none = len(data), np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    run = prefix_hash(data)
    at = np.arange(n - seed + 1)
    gram = span_hash(run, at, at + seed)
    low_bits = np.uint64((1 << max(24, n.bit_length())) - 1)
    best = (gram & ~low_bits) | at.astype(np.uint64)  # the smallest hash, the first of equal ones, and where it stands
    width, span = length - seed + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: span - width], best[width - span :])
    inside = np.ones(n - length + 1, dtype=bool)
    for end in bounds[1:].tolist():
        inside[max(end - length + 1, 0) : end] = False
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = (best[start] & low_bits).astype(np.int64)
    head = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    low, high, place = start[head], start[np.concatenate([head[1:] - 1, [len(start) - 1]])], place[head]
    row = np.searchsorted(bounds, low, side="right") - 1
    second = mix(span_hash(run, low, high + length) + (place - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, low - bounds[row], high - bounds[row], place - bounds[row], gram[place], second


def _first_in_row(row: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """Whether no earlier entry of the same row has the same ranks."""
    name = mix(row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for r in ranks:
        name = mix(name * np.uint64(0xD6E8FEB86659FD93) + r)
    first = np.zeros(len(row), dtype=bool)
    first[np.unique(name, return_index=True)[1]] = True
    return first


def _positions(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in byte_chunks(batches, limit=CACHED_BYTES):
            row, low, high, at, first, second = selected(data, bounds, length, seed)
            if len(row):
                new = _first_in_row(row, first, second)
                yield table({"rank1": (first.view(np.int64), pa.int64()), "rank2": (second.view(np.int64), pa.int64()), "doc": (rows.column(0).take(pa.array(row)), None), "tkey": (rows.column(1).take(pa.array(row)), None), "place": (low << 32 | (at - low) << 16 | (high - low) << 1 | ~new, pa.int64())})

    return keyed.select("doc", "tkey", "text").mapInArrow(run, "rank1 long, rank2 long, doc long, tkey long, place long")


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Rows of (doc, tkey, packed, spans) one by one: the row, its bytes, and its spans."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row, np.frombuffer(unpress.decompress(column(row, "packed")[0].as_py()), dtype=np.uint8), column(row, "spans")[0].values


def _gathered(found: Iterator[tuple[pa.RecordBatch, dict[str, tuple[np.ndarray, pa.DataType]]]]) -> Iterator[pa.RecordBatch]:
    """Columns found in single texts, with the texts' doc and tkey, in batches of about ``ROWS_OUT`` rows."""
    held: list[dict[str, tuple[np.ndarray, pa.DataType]]] = []
    size = 0
    joined = lambda: table({c: (np.concatenate([h[c][0] for h in held]), held[0][c][1]) for c in held[0]})
    for row, cols in found:
        n = len(cols["name"][0])
        own = {c: (np.full(n, column(row, c)[0].as_py()), pa.int64()) for c in ("doc", "tkey")}
        held.append({"name": cols.pop("name"), **own, **cols})
        size += n
        if size > ROWS_OUT:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _quarters(joined: DataFrame, length: int, seed: int) -> DataFrame:
    """(name, doc, tkey, low, high): the quarters of the windows of every listed position, named by what a quarter's have in common."""
    extra = length - seed
    step = -(-(extra + 1) // 4)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, tuple[np.ndarray, pa.DataType]]]]:
        for row, data, spans in _each_text(batches):
            running = prefix_hash(data)
            low, high, at = (spans.field(c).to_numpy().astype(np.int64) for c in ("low", "high", "at"))
            names, nears, fars = [], [], []
            for i in range(4):
                first, last = i * step, min((i + 1) * step - 1, extra)
                nearest, farthest = np.maximum(at - high, first), np.minimum(at - low, last)
                some = nearest <= farthest
                names.append(mix(span_hash(running, (at - first)[some], (at - last + length)[some]) + np.uint64(i)))
                nears.append((at - nearest)[some])
                fars.append((at - farthest)[some])
            yield row, {"name": (np.concatenate(names).view(np.int64), pa.int64()), "low": (np.concatenate(fars).astype(np.int32), pa.int32()), "high": (np.concatenate(nears).astype(np.int32), pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(found(batches))

    return joined.select("doc", "tkey", "packed", "spans").mapInArrow(run, "name long, doc long, tkey long, low int, high int")


def _windows(joined: DataFrame, length: int) -> DataFrame:
    """(name, doc, tkey, low, again) of the single windows listed in ``spans`` of every row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, tuple[np.ndarray, pa.DataType]]]]:
        for row, data, spans in _each_text(batches):
            low, high = spans.field("low").to_numpy(), spans.field("high").to_numpy()
            start = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low.tolist(), high.tolist())]))
            name = span_hash(prefix_hash(data), start, start + length)
            new = _first_in_row(np.zeros(len(start), dtype=np.int64), name)
            yield row, {"name": (name.view(np.int64), pa.int64()), "low": (start.astype(np.int32), pa.int32()), "again": (~new, pa.bool_())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(found(batches))

    return joined.select("doc", "tkey", "packed", "spans").mapInArrow(run, "name long, doc long, tkey long, low int, again boolean")


def _pack(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for rows, data, bounds in byte_chunks(batches):
            packed = [press.compress(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i, f in enumerate(rows.schema.names) if f != "text"), pa.array(packed, pa.binary())], names=[*(f for f in rows.schema.names if f != "text"), "packed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text") + ", packed binary"
    return keyed.mapInArrow(run, schema)


def _doc_order(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))


def removed_spans(keyed: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc, tkey, low, end) of ``keyed(doc, tkey, text)``: byte stretches that repeat, possibly overlapping."""
    positions = _positions(keyed, length, seed)
    tied = positions.groupBy("rank1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank1")
    # ranks that are tied are written before each join, so that Spark can split the rows of a rank that very many share
    tied = staged(tied, "tied-ranks")
    # a position's place: its first window start, where its string begins after it, how many more windows it has, and
    # whether its text has the same earlier
    part = lambda shift, mask: F.shiftright("place", shift).bitwiseAND(mask).cast("int")
    low = F.shiftright("place", 32).cast("int")
    placed = {"low": low, "high": low + part(1, 32767), "at": low + part(16, 65535), "again": F.col("place").bitwiseAND(1) == 1}
    tied = staged(positions.join(tied.hint("merge"), "rank1"), "round-1").withColumns(placed)

    classes = staged(tied.where("not again").groupBy("rank1", "rank2").agg(F.min("doc").alias("first_doc")), "round-2")
    ranked = tied.join(classes.hint("merge"), ["rank1", "rank2"])
    whole = ranked.where("again or doc > first_doc").select("doc", "tkey", "low", (F.col("high") + length).alias("end"))

    open_ranks = staged(classes.groupBy("rank1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank1"), "open-ranks")
    open_spans = ranked.where("not again and doc = first_doc").join(open_ranks.hint("merge"), "rank1")
    spans_of = lambda df, *cols: df.groupBy("doc", "tkey").agg(F.collect_list(F.struct(*cols)).alias("spans"))  # noqa: E731  at most a text's own positions
    with_text = lambda listed: _pack(keyed).join(listed.hint("merge"), ["doc", "tkey"])
    quarters = staged(_quarters(with_text(spans_of(open_spans, "low", "high", "at")), length, seed), "round-3")
    tied_quarters = quarters.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    quarters = quarters.join(staged(tied_quarters, "tied-quarters").hint("merge"), "name")
    windows = staged(_windows(with_text(spans_of(quarters, "low", "high")), length), "round-4")
    first = windows.where("not again").groupBy("name").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc").select("name", "first_doc")
    first = staged(first, "tied-windows")
    late = windows.where("not again").join(first.hint("merge"), "name").where("doc > first_doc").select("doc", "tkey", "low").union(windows.where("again").select("doc", "tkey", "low"))
    return staged(whole.union(late.select("doc", "tkey", "low", (F.col("low") + length).alias("end"))), "removed")


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, passed: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """``passed`` columns of every row of ``docs(doc_id, text)``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked
    for, kept_text: the remaining bytes as text, without the halves of characters that a cut went through."""
    passed = passed or ["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(_doc_order("doc_id").alias("doc"), F.xxhash64(text, F.length(text)).alias("tkey"), *[F.col(c).alias(f"passed_{i}") for i, c in enumerate(passed)], text.alias("text"))
    spans = removed_spans(keyed.select("doc", "tkey", "text"), length, seed)
    listed = spans.groupBy("doc", "tkey").agg(F.collect_list(F.struct("low", "end")).alias("spans"))  # at most a text's own positions
    joined = _pack(keyed).join(listed.hint("merge"), ["doc", "tkey"], "left").drop("doc", "tkey")
    kept_columns = [f"passed_{i}" for i in range(len(passed))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, gone, runs, sha, kept = [], [], [], [], []
            for packed, spans in zip(column(batch, "packed"), column(batch, "spans")):
                data = np.frombuffer(unpress.decompress(packed.as_py()), dtype=np.uint8)
                cover = np.zeros(len(data) + 1, dtype=np.int64)
                if spans.is_valid:
                    low, end = (spans.values.field(c).to_numpy() for c in ("low", "end"))
                    own = end <= len(data)
                    np.add.at(cover, low[own], 1)
                    np.add.at(cover, end[own], -1)
                out = np.cumsum(cover)[:-1] > 0
                rest = data[~out].tobytes()
                sizes.append(len(data))
                gone.append(int(out.sum()))
                runs.append(int((out & ~np.concatenate([[False], out[:-1]])).sum()) if len(out) else 0)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept_columns), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=[*kept_columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    chosen = joined.select(*kept_columns, "packed", "spans")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name in kept_columns) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return chosen.mapInArrow(run, schema).withColumnsRenamed(dict(zip(kept_columns, passed)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
