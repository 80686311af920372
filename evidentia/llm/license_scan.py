"""License scans by diagonal voting.

Every text's rolling word k-gram hashes are joined, in Spark, to the k-grams of the templates (a fixed, small table).
A hit at word ``i`` of the text and ``j`` of the template votes for the diagonal ``i - j``.  Votes are summed by
(text, template, diagonal); neighbouring diagonals, which an inserted or missing word makes, are merged; merged spans
are then verified by the share of the template's k-grams that they hold, each k-gram once.

Phrases of ``BASE`` count only where all their k-grams stand on one diagonal, which is where the words stand
consecutively.  Two independent 64-bit hashes of a k-gram must agree, so a chance hit needs 128 equal bits.

Words: ASCII letters (lower-cased), digits and every non-ASCII character; the rest separates.

Defined cases: a null text is empty and has no words; repeated rows give a row each, as each row carries its own number
within the job; very long texts are cut into no windows at all, since votes are summed by Spark; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, byte_chunks, gram_hash, mix, prefix_hash, read_table, span_hash, table, words

K = 3
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False

# Phrases whose every place counts, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Wordings by which public licences are commonly stated, and the labels the method adds for them.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]

HIT_SCHEMA = "row long, doc_id long, n_words long, pos int, gram long, proof long"


def _hashes(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lowered = ASCII_LOWER[data]
    starts, ends, first = words(lowered, bounds, IS_WORD)
    word = span_hash(prefix_hash(lowered), starts, ends)
    return gram_hash(word, k), gram_hash(mix(word ^ np.uint64(0xA0761D6478BD642F)), k), first


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    rows = []
    for number, (phrase, label) in enumerate(templates):
        data = np.frombuffer(phrase.encode(), dtype=np.uint8)
        gram, proof, _ = _hashes(data, np.array([0, len(data)]), k)
        n_words = len(gram) + k - 1
        rows += [(int(g), int(p), number, j, n_words) for j, (g, p) in enumerate(zip(gram.view(np.int64), proof.view(np.int64)))]
    return spark.createDataFrame(rows, "t_gram long, t_proof long, template int, t_pos int, t_words int")


def word_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """A row for every rolling k-gram of every text, and one without a k-gram for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for rows, data, bounds in byte_chunks(batches):
            gram, proof, first = _hashes(data, bounds, k)
            n = np.diff(first)
            grams = np.maximum(n - k + 1, 0)
            owner = np.repeat(np.arange(len(n)), grams)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
            at = first[owner] + pos
            ids = rows.column(0)
            numbers = row + np.arange(len(n))
            row += len(n)
            none = pa.nulls(len(n), pa.int64())
            yield table({"row": (numbers, pa.int64()), "doc_id": (ids, pa.int64()), "n_words": (n, pa.int64()), "pos": (pa.nulls(len(n), pa.int32()), pa.int32()), "gram": (none, pa.int64()), "proof": (none, pa.int64())})
            if len(owner):
                empty = pa.nulls(len(owner), pa.int64())
                yield table({"row": (numbers[owner], pa.int64()), "doc_id": (empty, pa.int64()), "n_words": (empty, pa.int64()), "pos": (pos.astype(np.int32), pa.int32()), "gram": (gram[at].view(np.int64), pa.int64()), "proof": (proof[at].view(np.int64), pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HIT_SCHEMA)


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, drift: int = 3, accept: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    ``drift``: diagonals that differ by at most so many words belong to one span.  ``accept``: the share of a
    template's k-grams that a span must hold.  ``score`` is the best such share, 1 for a base phrase, 0 without a span.
    """
    spark = docs.sparkSession
    every = base + templates
    labels = spark.createDataFrame([(i, label, i < len(base)) for i, (_, label) in enumerate(every)], "template int, label string, is_base boolean")
    grams = F.broadcast(template_grams(spark, every, k).join(F.broadcast(labels), "template"))
    found = word_grams(docs, k).join(grams, (F.col("gram") == F.col("t_gram")) & (F.col("proof") == F.col("t_proof")), "left")
    # a row per text and per hit; all other k-grams end here, before any shuffle
    # one deal by text serves all the groupings below; a text's hits are bounded by its own length
    hits = found.where("gram is null or template is not null").withColumn("diagonal", F.col("pos") - F.col("t_pos")).repartition("row")
    votes = hits.groupBy("row", "template", "diagonal").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("t_words").alias("t_words"),
        F.collect_set("t_pos").alias("t_at"), F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    # neighbouring diagonals of a text and a template: a new span starts where the step is larger than the drift
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    marked = votes.withColumn("start", F.when(F.col("is_base") | step.isNull() | (step > drift), 1).otherwise(0))
    spans = marked.withColumn("span", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "template", "span").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("is_base").alias("is_base"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("t_at")))) / (F.first("t_words") - (k - 1))).alias("share"),
        F.min("low").alias("low"), F.min("diagonal").alias("first_diagonal"),
    )
    is_base, whole = F.col("is_base"), F.col("share") >= 1
    kept = (is_base & whole) | (~is_base & (F.col("share") >= accept))
    place = F.when(is_base & whole, F.col("first_diagonal"))
    text_of = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.count(place).alias("n_base"), F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        text_of(F.when(is_base & whole, F.col("label"))).alias("base_labels"), text_of(F.when(kept, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.least(F.col("share"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
    ).drop("row")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
