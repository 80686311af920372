"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for each slot, a mask with one bit per language (a word for every 64 languages).  An n-gram's masks in its slots are
and-ed, and what is left names every language whose n-grams contain it.  A text's share of n-grams per language is
corrected for the language's false-positive rate, and the largest corrected share decides.

Training: occurrences of character n-grams per language, counted by Spark over at most ``sample`` labelled rows, a
documented bound of the fit.  They are drawn per language: every language has the same quota, those with fewer rows give
all of them and leave the rest of their quota to the others, and larger ones give the rows with the smallest hashes of
id and text.  So a language's rows in the fit never shrink because other languages have more.  An n-gram belongs to a language if it makes up at
least ``floor`` of the language's n-grams and at least ``ratio`` of its share in the language where it is most common;
at most ``keep`` n-grams a language enter the filter.  The filter's size is a parameter, so what is broadcast is fixed.

Prediction reads whole texts and nothing else.  Letters are lower-cased, every other character counts as a blank.

Defined cases: a null text and one without letters give ``und`` and score 0; ties go to the language that sorts first;
repeated rows give a row each; no labelled rows at all give ``und`` everywhere; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, column, mix, read_table, table

N = 4
SAMPLE, KEEP, FLOOR, RATIO = 20_000, 30_000, 2e-6, 0.25
SLOT_BITS, PROBES = 20, 3

_letter = np.zeros(0, dtype=bool)


def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def gram_rows(batches: Iterator[pa.RecordBatch], n: int, limit: int = CHUNK_BYTES // 2) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, the hashes of all their n-grams that hold a letter, each row's first one (rows + 1 values), letters a row."""
    letter = _letters()
    for batch in batches:
        every = column(batch, "text")
        at = 0
        while at < len(every):
            part, size = [], 0
            while at + len(part) < len(every) and (size < limit or not part):
                part.append(f" {(every[at + len(part)].as_py() or '').lower()} ")
                size += len(part[-1])
            code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            is_letter = letter[code]
            code = np.where(is_letter, code, np.uint32(32)).astype(np.uint64)
            seen = np.concatenate([[0], np.cumsum(is_letter)])
            windows = max(len(code) - n + 1, 0)
            value = np.zeros(windows, dtype=np.uint64)
            for i in range(n):
                value = (value << np.uint64(16)) ^ code[i : i + windows] if n <= 4 else mix(value + code[i : i + windows])
            inside = np.ones(windows, dtype=bool)
            for i in range(1, n):  # windows that begin in a row's last n - 1 characters reach into the next row
                edge = bounds[1:-1] - i
                inside[edge[(edge >= 0) & (edge < windows)]] = False
            inside &= seen[n : n + windows] > seen[:windows]
            where = np.flatnonzero(inside)
            yield batch.slice(at, len(part)), mix(value[where]), np.searchsorted(where, bounds), seen[bounds[1:]] - seen[bounds[:-1]]
            at += len(part)


def gram_counts(rows: DataFrame, n: int = N) -> DataFrame:
    """(lang, gram, n): occurrences in ``rows(lang, text)``, partly summed within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, gram, first, _ in gram_rows(batches, n):
            langs = part.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = np.concatenate([gram[first[i] : first[i + 1]] for i, x in enumerate(langs) if x == lang])
                value, count = np.unique(own, return_counts=True)
                yield table({"lang": ([lang] * len(value), pa.string()), "gram": (value.view(np.int64), pa.int64()), "n": (count, pa.int64())})

    return rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """The bit-sliced Bloom filter: ``slots`` masks, one bit per language, in as many words as there are 64 languages."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], slot_bits: int = SLOT_BITS, probes: int = PROBES):
        self.langs, self.probes, self.slot_bits = langs, probes, slot_bits
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.slots = np.zeros((max(-(-len(langs) // 64), 1), 1 << slot_bits), dtype=kind)
        for i, own in enumerate(grams):
            for at in self.places(own):
                self.slots[i // 64][at] |= kind(1 << i % 64)
        self.false_rate = np.array([float(((self.slots[i // 64] >> kind(i % 64)) & kind(1)).mean()) ** probes for i in range(len(langs))])

    def places(self, gram: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.slot_bits)
        return [((gram * np.uint64(odd)) >> shift).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[: self.probes]]

    def masks(self, gram: np.ndarray, word: int = 0) -> np.ndarray:
        out = None
        for at in self.places(gram):
            out = self.slots[word][at] if out is None else out & self.slots[word][at]
        return out

    def shares(self, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Corrected share of each row's n-grams per language (rows x languages)."""
        n = np.maximum(np.diff(first), 1)
        out = np.zeros((len(n), len(self.langs)))
        for i in range(len(self.langs)):
            if i % 64 == 0:
                mask = self.masks(gram, i // 64)
            total = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), dtype=np.int64)])
            share = (total[first[1:]] - total[first[:-1]]) / n
            out[:, i] = (share - self.false_rate[i]) / (1 - self.false_rate[i])
        return np.clip(out, 0, 1)


def quota(sizes: list[int], sample: int) -> int:
    """The largest number of rows a language, one at least, with which languages of these sizes give ``sample`` rows at most."""
    left = sample
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return max(share, 1)
        left -= size
    return max(sizes)


def drawn(known: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of ``known(lang, text, draw)`` (or one a language), the same number of every language that has it.

    Above its quota a language gives the rows with the smallest ``draw``, which is a uniform hash: a share of the hashes
    that surely holds the quota is ranked without texts, and the draw of the quota's last row is the language's limit.
    """
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return known
    rows = quota(list(sizes.values()), sample)
    share = {x: min((rows + 8 * rows**0.5 + 40) / n, 1.0) for x, n in sizes.items()}
    least, most = -(1 << 63), (1 << 63) - 1
    upto = [(x, min(least + int(share[x] * 2.0**64), most) if n > rows else most, n > rows) for x, n in sizes.items()]
    if not any(over for *_, over in upto):
        return known
    few = F.broadcast(known.sparkSession.createDataFrame(upto, "lang string, upto long, over boolean"))
    near = known.join(few, "lang").where("over and draw <= upto").select("lang", "draw")
    last = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("r") == rows).select("lang", F.col("draw").alias("last"))
    limits = few.join(F.broadcast(last), "lang", "left").select("lang", F.coalesce("last", "upto").alias("last"))
    return known.join(F.broadcast(limits), "lang").where(F.col("draw") <= F.col("last")).drop("last")


def fit(labelled: DataFrame, n: int = N, sample: int = SAMPLE, keep: int = KEEP, floor: float = FLOOR, ratio: float = RATIO) -> Filter:
    """Fit on at most ``sample`` rows of ``labelled(doc_id, lang, text)``."""
    known = labelled.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("draw"))
    rows = drawn(known, sample)
    counts = gram_counts(rows, n).where("n > 1")
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    best = share.withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    fit_in = best.where((F.col("share") >= floor) & (F.col("share") >= ratio * F.col("most")))
    top = fit_in.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))).where(F.col("r") <= keep)
    found = top.select("lang", "gram").toArrow()  # at most keep x languages values
    langs = sorted(found["lang"].unique().to_pylist())
    return Filter(langs, [found.filter(pc.equal(found["lang"], x))["gram"].to_numpy().view(np.uint64) for x in langs])


def predict(docs: DataFrame, model: Filter, passed: list[str], n: int = N) -> DataFrame:
    """``passed`` columns, lang_pred and score for every row of ``docs``; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is passed on goes to the task once
    text = [] if "text" in passed else [F.col("text").cast("string").alias("text")]
    chosen = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in passed], *text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, gram, first, letters in gram_rows(batches, n, CHUNK_BYTES // 8):
            share = model.shares(gram, first) if model.langs else np.zeros((part.num_rows, 1))
            known = (letters > 0) & bool(model.langs)
            best = share.argmax(axis=1)
            named = [model.langs[b] if k else "und" for b, k in zip(best, known)]
            score = np.where(known, share[np.arange(len(best)), best], 0.0)
            columns = [part.column(i) for i in range(len(passed))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(named, pa.string()), pa.array(score, pa.float64())], names=[*passed, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*passed).schema) + ", lang_pred string, score double"
    return chosen.mapInArrow(run, schema)


def remainder(doc_id: str, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(docs.where("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
