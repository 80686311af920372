"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of ``documents``.
Labels come from the tables at hand: languages from the stage's own input, toxicity from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import jaccard_join, language_id, packing, suffix_dedup, toxicity
from evidentia.llm.common import read_table, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: least corrected share of a language's n-grams; running text of any trained language has far more
LEAST_LANGUAGE = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: those predicted ``und`` go, and those of hardly any known n-gram."""
    model = language_id.fit(docs)
    kept = language_id.predict(docs, model, COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))
    return kept.select(COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents scored below one half; labels serve the fit alone."""
    model = toxicity.fit(toxicity.labelled_rows(spark, docs, sf_dir))
    rows = docs.withColumn("kept_text", F.col("text"))
    kept = model.score(rows, ["doc_id", "kept_text", "lang", "source", "n_chars"]).where(F.col("score") < 0.5)
    return kept.withColumnRenamed("kept_text", "text").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five-word shingles, Jaccard 0.8); of repeated rows (id and text), one.

    It is the one of least id; ids may be null or repeat, so rows are told apart by id and text together.
    """
    groups = jaccard_join.keyed(docs, k=5, num=80, den=100)
    named = groups.select(F.col("keeper.doc_id").alias("kept_id"), F.col("keeper.text_key").alias("kept_key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    kept = jaccard_join.with_text_key(docs).join(named.hint("merge"), same)
    return kept.dropDuplicates(["doc_id", "text_key"]).select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that stand earlier; halves of cut characters go too, and emptied documents."""
    kept = suffix_dedup.dedup(docs, passed=["doc_id", "lang", "source"]).withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long"))
    return kept.where((F.col("n_removed") == 0) | (F.col("text") != "")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]

#: the two models and the packing cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
