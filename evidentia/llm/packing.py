"""Best-fit packing planned on a length histogram.

Token counts are made once, in Arrow batches.  The histogram of piece lengths has at most ``capacity`` entries whatever
the corpus, so best-fit decreasing runs on *counts*: one step fills many sequences of the same free space with the same
number of equal pieces.  The plan is a list of runs (length, first rank, sequences, pieces a sequence, offset).  Pieces
then take their planned slot by joining on their rank within their length; a length's ranks are made over buckets, so
that a common length does not fall to one task.

Defined cases: null text is empty (only the end id); repeated rows are packed once each; an empty table gives no rows;
texts holding the special token's own string are encoded as the tokenizer does by default.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged, table, texts, with_group_rank

CAPACITY, END_ID = 2048, 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUN_SCHEMA = "run_length long, first long, last long, seq long, each long, base long"


class Encoder(dict):
    """Ids of texts, as the bytes of little-endian 32-bit numbers.

    A blank followed by a visible character always begins a new pre-token, so a text without doubled blanks is encoded
    word by word; words are remembered, at most ``keep`` of them.
    """

    def __init__(self, json_path: str, keep: int = 300_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(json_path.removesuffix(".json") + ".tiktoken", "rb"))}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.keep = keep

    def __missing__(self, word: str) -> bytes:
        ids = self.plain(" " + word)
        if len(self) < self.keep:
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        # a word that is empty or begins with other white space would make a run of white space with its blank
        if not first or any(not w or w[0].isspace() or w[-1].isspace() for w in (first, *rest)):
            return self.plain(text)
        if len(self) >= self.keep:
            self.clear()
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones with the remainder first."""
    head = n % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                ids = encoder.encode(text) + end
                out += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*out)) or [()] * 5
            yield table({k: (cols[i], pa.int32() if k == "piece" else pa.int64()) for i, k in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, last rank, first sequence, pieces a sequence, base).

    Rank r of a run stands in sequence ``seq + (r - first) // each`` at ``base + length * ((r - first) % each)``.
    Open sequences are kept as intervals of equal free space; a step uses up an interval or a length.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    free: list[tuple[int, int, int]] = []  # (free space, first sequence, sequences), by free space
    used = 0
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(free, (length,))
            space, seq, n = free.pop(at) if at < len(free) else (capacity, used, -(-left // (capacity // length)))
            if seq == used:
                used += n
            each = min(space // length, left)
            full = min(n, left // each)
            runs.append((length, rank, rank + full * each - 1, seq, each, capacity - space))
            rank, left = rank + full * each, left - full * each
            for entry in ((space - each * length, seq, full), (space, seq + full, n - full)):
                if entry[2] and entry[0]:
                    bisect.insort(free, entry)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``."""
    spark = docs.sparkSession
    cut_docs = staged(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_docs.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(histogram, capacity), RUN_SCHEMA)
    ranked = with_group_rank(cut_docs, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    turn = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.col("length") * (turn % F.col("each"))).cast("long").alias("offset"),
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
