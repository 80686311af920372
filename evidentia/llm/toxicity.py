"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows (at most ``sample``, those with the smallest hash of doc_id; a documented bound of the fit) are dealt in
five parts, each label's rows evenly.  A row's features for the fit come from the lexicon learned on the other parts, so no
row is described by what it has itself supplied; the trees learn from four parts and the calibration from the fifth (from
all, if a label has fewer rows than parts).  Scoring uses the lexicon learned in the same way on all parts.

Lexicon: words and word beginnings whose share among toxic rows is many times that among the rest, in three grades.
Features: density and number of hits of each grade, hits near a second-person word, capitals, punctuation, and
obfuscation (letters replaced by look-alikes, or repeated) with the hits that it hides.  Only ``text`` is looked at.

Defined cases: a null or empty text has all rates 0 and is scored like any other; repeated rows give a row each;
without labels of both kinds the score is the share of label 1 (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read_table, staged, table, texts

SAMPLE, LEXICON, PARTS = 30_000, 3_000, 5
#: least occurrences among toxic rows, and least log ratio of shares, of the grades 1 to 3
GRADES = ((3, 2.0), (6, 3.0), (12, 4.0))
PREFIXES = (4, 5)
NEAR = 5

# Second-person words of the languages at hand, and look-alikes of letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
LOOK_ALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = [
    "words", "density_1", "density_2", "density_3", "hits_1", "hits_2", "hits_3", "near_second_person", "second_person",
    "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "obfuscated_hits",
]

_edges = re.compile(r"^\W+|\W+$")
_repeats = re.compile(r"(.)\1{2,}")


def bare(word: str) -> str:
    return word if word.isalpha() else _edges.sub("", word)


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings marked with a star."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def lexicon_counts(rows: DataFrame) -> DataFrame:
    """(unit, toxic, part, n): rows of each label and part that hold a unit, of ``rows(text, toxic, part)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows, seen = batch.slice(at, 1000), defaultdict(Counter)
                for text, toxic, part in zip(texts(rows), column(rows, "toxic").to_pylist(), column(rows, "part").to_pylist()):
                    seen[toxic, part].update({u for w in {bare(w) for w in text.lower().split()} if w for u in units(w)})
                for (toxic, part), counter in seen.items():
                    yield table({"unit": (list(counter), pa.string()), "toxic": ([toxic] * len(counter), pa.int32()), "part": ([part] * len(counter), pa.int32()), "n": (list(counter.values()), pa.int64())})

    return rows.select("text", "toxic", "part").mapInArrow(run, "unit string, toxic int, part int, n long")


def learn_lexicons(rows: DataFrame, size: int = LEXICON) -> list[dict[str, int]]:
    """Unit -> grade, at most ``size`` of them, the most telling first: learned on all parts but one, for each part of
    ``rows(text, toxic, part)``, and last on all parts.
    """
    totals = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = lambda toxic, part: F.sum(F.when((F.col("toxic") == toxic) & (F.col("part") == part), F.col("n")).otherwise(0))
    counts = lexicon_counts(rows).groupBy("unit").agg(*[number(t, p).alias(f"n{t}_{p}") for t in (0, 1) for p in range(PARTS)])
    # units that no lexicon can take go before anything is written
    counts = staged(counts.where(sum(F.col(f"n1_{p}") for p in range(PARTS)) >= GRADES[0][0]), "toxicity-units")
    out = []
    for left_out in [*range(PARTS), None]:
        used = [p for p in range(PARTS) if p != left_out]
        n = counts.select("unit", *[sum(F.col(f"n{t}_{p}") for p in used).alias(c) for t, c in ((0, "good"), (1, "bad"))])
        bad, good = (sum(totals.get((p, t), 0) for p in used) for t in (1, 0))
        ratio = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
        top = n.withColumn("ratio", ratio).where((F.col("bad") >= GRADES[0][0]) & (F.col("ratio") >= GRADES[0][1])).orderBy(F.desc(F.col("bad") * F.col("ratio")), "unit").limit(size)
        out.append({r["unit"]: sum(r["bad"] >= least and r["ratio"] >= edge for least, edge in GRADES) for r in top.collect()})
    return out


class Words(dict):
    """Code of a word as written: its lexicon grade (two bits), 4 for second person, 8 for obfuscation."""

    def __init__(self, lexicon: dict[str, int], keep: int = 200_000, longest: int = 60):
        self.lexicon, self.keep, self.longest = lexicon, keep, longest

    def grade(self, word: str) -> int:
        return max((self.lexicon.get(u, 0) for u in units(word)), default=0)

    def __missing__(self, word: str) -> int:
        low = bare(word.lower())
        code = self.grade(low) | (4 if low in SECOND_PERSON else 0)
        if low and (not low.isalpha() or _repeats.search(low)):
            plain = _repeats.sub(r"\1", low.translate(LOOK_ALIKES))
            plain = re.sub(r"\W|_", "", plain)
            if plain != low and plain.isalpha():
                code = max(code & 3, self.grade(plain)) | (code & 4) | 8
        if len(self) < self.keep and len(word) <= self.longest:
            self[word] = code
        return code


def feature_row(text: str, words: Words) -> list[float]:
    tokens = text.split()
    code = np.frombuffer(bytes(map(words.__getitem__, tokens)), dtype=np.uint8)
    n = max(len(code), 1)
    grade = code & 3
    hits = [int((grade >= g).sum()) for g in (1, 2, 3)]
    you = np.flatnonzero(code & 4)
    near = 0
    if hits[0] and len(you):
        at = np.flatnonzero(grade)
        i = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - at), np.abs(at - you[np.maximum(i - 1, 0)]))
        near = int((gap <= NEAR).sum())
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    chars, upper, lower = max(int(raw.sum()), 1), int(raw[65:91].sum()), int(raw[97:123].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    hidden = (code & 8) > 0
    return [
        math.log1p(len(code)), *(h / n for h in hits), *(math.log1p(h) for h in hits), math.log1p(near), len(you) / n,
        upper / max(upper + lower, 1), float(upper > lower), marks / chars, math.log1p(int(raw[33])), float(hidden.mean()) if len(code) else 0.0, math.log1p(int((hidden & (grade > 0)).sum())),
    ]


def with_features(docs: DataFrame, lexicons: list[dict[str, int]], passed: list[str], part: Column | None = None) -> DataFrame:
    """``passed`` columns and ``x``, the features of the whole text, by the lexicon that ``part`` names (the last, if not given)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    number = F.lit(len(lexicons) - 1) if part is None else part
    chosen = docs.select(*[F.col(c).alias(f"passed_{i}") for i, c in enumerate(passed)], F.col("text").cast("string").alias("text"), number.cast("int").alias("lexicon"))
    kept = [f"passed_{i}" for i in range(len(passed))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(lexicon) for lexicon in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                x = pa.array([feature_row(t, words[i]) for t, i in zip(texts(rows), column(rows, "lexicon").to_pylist())], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), x], names=[*kept, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*kept).schema) + ", x array<double>"
    return chosen.mapInArrow(run, schema).withColumnsRenamed(dict(zip(kept, passed)))


class Model:
    """Lexicon, trees and calibration; ``constant`` where there was nothing to learn from."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon or {}, trees, calibration, constant

    def score(self, docs: DataFrame, passed: list[str]) -> DataFrame:
        """``passed`` columns and ``score`` for every row of ``docs``."""
        if self.trees is None:
            return docs.select(*passed, F.lit(float(self.constant)).alias("score"))
        raw = _raw(self.trees, with_features(docs, [self.lexicon], passed), passed)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_calibrated")))
        return self.calibration.transform(raw).select(*passed, score.alias("score"))


def _raw(trees, featured: DataFrame, passed: list[str]) -> DataFrame:
    scored = trees.transform(featured.withColumn("_features", array_to_vector("x")))
    return scored.select(*passed, vector_to_array("_probability")[1].alias("_raw"))


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fit on at most ``sample`` rows of ``labelled(doc_id, text, toxic)``."""
    known = labelled.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).withColumn("draw", F.xxhash64("doc_id"))
    total = known.count()
    if total > sample:
        known = known.where(F.col("draw") <= known.agg(F.percentile_approx("draw", sample / total, 10_000)).first()[0])
    dealt = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(1)), F.xxhash64("text")))  # at most ``sample`` rows
    known = staged(known.withColumn("part", (dealt % PARTS).cast("int")), "toxicity-fit")
    seen = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return Model(constant=float(next(iter(seen), 0)))
    *others, lexicon = learn_lexicons(known)
    featured = with_features(known, others, ["part", "toxic"], F.col("part"))
    featured = staged(featured.withColumn("label", F.col("toxic").cast("double")), "toxicity-features").coalesce(4)
    enough = min(seen.values()) >= PARTS
    held = featured.where(F.col("part") == PARTS - 1) if enough else featured
    taught = featured.where(F.col("part") < PARTS - 1) if enough else featured
    booster = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction", maxIter=25, maxDepth=3, stepSize=0.25, seed=seed)
    booster = booster.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    trees = booster.fit(taught.withColumn("_features", array_to_vector("x")))
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated")
    return Model(lexicon, trees, calibration.fit(_raw(trees, held, ["label"])))


def remainder(doc_id: str, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def labelled_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that carry a label and are not held out; one label an id (the largest)."""
    marks = read_table(spark, sf_dir, "labels").where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    return docs.where(remainder("doc_id", 5) != 0).select("doc_id", "text").join(marks.where(remainder("_id", 5) != 0).hint("merge"), F.col("doc_id") == F.col("_id")).drop("_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(labelled_rows(spark, docs, sf_dir))
    out = model.score(docs.withColumn("held_out", remainder("doc_id", 5) == 0), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
