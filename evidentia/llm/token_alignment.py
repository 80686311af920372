"""Cross-tokenizer alignment: two tokenizations of each text laid over one another by pandas ``merge_asof``.

Both tokenizers read a blank and the text, so their tokens cut the same bytes.  Tokens of many documents make one batch:
``merge_asof``, keyed by document, finds for every token start the token of the other side that covers it; both
directions together give every overlap.  A token that starts where its covering token starts begins a group, so the
groups between byte offsets at which both sides end are running counts of such tokens.

A document's linked id pairs, each once with its number of links, are written packed.  Corpus counts come from these in
bounded buffers inside the tasks and one grouping by pair; a pair's count and whether it is its A id's highest go back to
the documents as sorted arrays, ``set_rows`` pairs at a time: a table beyond that is cut by hash into parts, and every
part is looked up by every document in turn.  Documents are not shuffled (but for one row each, if there are more parts).

Blanks between visible characters end tokens on both sides, so texts are encoded word by word and words are remembered,
at most ``keep`` bytes of them; a text in which another white space stands next to a blank is encoded whole, and every
text is if a vocabulary could join words.  Long texts are aligned in stretches of words, so memory stays bounded.

Defined cases: null and empty texts, and those whose tokens do not give back their bytes, have no tokens: zeros and an
empty digest; rows that repeat an id are documents each; ids of special tokens never occur; equal ids of a group's side
are linked once per occurrence; ties for the highest count all count; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, column, read_table, staged, table, texts

MARK = "▁"
#: tokens of a side aligned at once; words of a stretch; pairs expanded at once, and sorted at once to be counted
TOKENS, STRETCH, EXPANDED, BUFFER = 250_000, 60_000, 2_000_000, 4_000_000
#: links of a group beyond which its equal ids are counted before they are paired
LARGE_GROUP = 64
SET_ROWS = 2_000_000

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Ids of a text on both sides, as bytes of little-endian 32-bit numbers; None where they don't give back its bytes."""

    def __init__(self, json_path: str, model_path: str, keep: int = 48 << 20):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        spec = json.load(open(json_path, encoding="utf-8"))
        special = {t["id"] for t in spec["added_tokens"]}
        byte = byte_characters()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {i: token for token, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.n_a, self.n_b = max(self.a_bytes) + 1, len(pieces)
        # a mark behind another character would let a piece reach over a blank
        self.by_word = not any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.room = self.keep = keep

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(self.a_bytes.get(i, b"")) for i in range(self.n_a)], dtype=np.int64), np.array([len(p) for p in self.b_bytes], dtype=np.int64)

    def encoded(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        out = []
        for text, b in zip(parts, self.b.encode(parts, num_threads=1)):
            a = self.a.encode_ordinary(" " + text)
            whole = (" " + text).encode()
            same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
            out.append((np.asarray(a, dtype="<u4").tobytes(), np.asarray(b, dtype="<u4").tobytes()) if same else None)
        return out

    def split(self, text: str) -> list[str] | None:
        """Words to encode on their own, or None."""
        parts = text.split(" ")
        return None if not self.by_word or any(not w or w[0].isspace() or w[-1].isspace() for w in parts) else parts

    def learn(self, parts: set[str]) -> None:
        new = [w for w in parts if w not in self.known]
        if self.room <= 0:
            self.known.clear()
            self.room, new = self.keep, list(parts)
        for word, ids in zip(new, self.encoded(new)):
            self.known[word] = ids
            self.room -= 250 + 4 * len(word) + (len(ids[0]) + len(ids[1]) if ids else 0)


class Batch:
    """Aligned tokens of some stretches: ids, documents, groups of both sides."""

    def __init__(self, stretches: list[tuple[int, bytes, bytes]], len_a: np.ndarray, len_b: np.ndarray):
        side = lambda k, size: self._side([s[0] for s in stretches], [s[k] for s in stretches], size)
        a, b = side(1, len_a), side(2, len_b)
        other = lambda df: df.rename(columns={"token": "cover"}).assign(cover_start=df["start"])[["doc", "start", "cover", "cover_start"]]
        self.a = pd.merge_asof(a, other(b), on="start", by="doc")
        self.b = pd.merge_asof(b, other(a), on="start", by="doc")
        self.group_a, self.group_b = ((df["start"].to_numpy() == df["cover_start"].to_numpy()).cumsum() - 1 for df in (self.a, self.b))
        self.n_groups = int(self.group_a[-1]) + 1
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=self.n_groups), np.bincount(self.group_b, minlength=self.n_groups)
        first = np.cumsum(self.size_a) - self.size_a
        self.group_doc = self.a["doc"].to_numpy()[first]

    @staticmethod
    def _side(docs: list[int], parts: list[bytes], size: np.ndarray) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int64)
        n_bytes = size[ids]
        return pd.DataFrame({"doc": np.repeat(docs, [len(p) // 4 for p in parts]), "start": np.cumsum(n_bytes) - n_bytes, "end": np.cumsum(n_bytes), "id": ids, "token": np.arange(len(ids))})

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of every A token and B token that share a byte: the union of both directions."""
        n = len(self.b)
        both = np.concatenate([self.a["token"].to_numpy() * n + self.a["cover"].to_numpy(), self.b["cover"].to_numpy() * n + self.b["token"].to_numpy()])
        both = np.unique(both)
        return both // n, both % n

    def texts(self, digits: np.ndarray, n_digits: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` for every group, end to end, and where each group ends."""
        before_a, before_b = np.cumsum(self.size_a), np.cumsum(self.size_b) - self.size_b
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + before_a[self.group_b]
        ids, stop = np.empty(len(at_a) + len(at_b), dtype=np.int64), np.full(len(at_a) + len(at_b), ord(","), dtype=np.uint8)
        ids[at_a], ids[at_b] = self.a["id"].to_numpy(), self.b["id"].to_numpy()
        stop[at_a[before_a - 1]] = ord("|")
        last_b = at_b[np.cumsum(self.size_b) - 1]
        stop[last_b] = ord(";")
        rows, size = digits[ids], n_digits[ids]
        rows[np.arange(len(ids)), size] = stop
        ends = np.cumsum(size + 1)
        return rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes(), ends[last_b]

    def pairs(self, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, links) of the linked ids, once per document and slice; a pair is ``a * n_b + b``."""
        large = self.size_a * self.size_b > LARGE_GROUP

        def counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            again = large[group]
            key, n = np.unique(group[again] << 32 | ids[again], return_counts=True)
            group, ids = np.concatenate([group[~again], key >> 32]), np.concatenate([ids[~again], key & 0xFFFFFFFF])
            order = np.argsort(group, kind="stable")
            return group[order], ids[order], np.concatenate([np.ones((~again).sum(), dtype=np.int64), n])[order]

        group_a, ids_a, n_a = counted(self.group_a, self.a["id"].to_numpy())
        group_b, ids_b, n_b_each = counted(self.group_b, self.b["id"].to_numpy())
        size_b = np.bincount(group_b, minlength=self.n_groups)
        first_b = np.cumsum(size_b) - size_b
        reach = np.cumsum(size_b[group_a])
        doc_span = np.int64(int(max(ids_a.max(), 0)) + 1) * n_b
        at = 0
        while at < len(group_a):
            upto = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + EXPANDED, "right")))
            part = slice(at, upto)
            many = size_b[group_a[part]]
            i = np.repeat(np.arange(at, upto), many)
            j = first_b[group_a[i]] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            key = self.group_doc[group_a[i]] * doc_span + ids_a[i] * n_b + ids_b[j]
            if large.any():
                key, where = np.unique(key, return_inverse=True)
                links = np.bincount(where, weights=n_a[i] * n_b_each[j]).astype(np.int64)
            else:
                key, links = np.unique(key, return_counts=True)
            yield key // doc_span, key % doc_span, links
            at = upto


def packed(pair: np.ndarray, links: np.ndarray) -> bytes:
    """Sorted pairs as steps, beside their links, byte plane by byte plane."""
    planes = np.stack([np.diff(pair, prepend=0), links]).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    steps, links = np.ascontiguousarray(planes.T).view("<u8").reshape(2, -1).astype(np.int64)
    return np.cumsum(steps), links


class Document:
    """What the stretches of one document add up to."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.numbers, self.pairs = doc_id, [0, 0, 0, 0], []
        self.sha, self.open = hashlib.sha256(), False

    def add(self, text: bytes, n_a: int, n_b: int, n_groups: int, n_links: int) -> None:
        self.sha.update(b";" * self.open + text[:-1])
        self.open = True
        self.numbers = [x + y for x, y in zip(self.numbers, (n_a, n_b, n_groups, n_links))]

    def row(self) -> tuple:
        if not self.open:
            return (self.doc_id, 0, 0, 0, 0, "", None)
        pair, links = self.pairs[0] if len(self.pairs) == 1 else map(np.concatenate, zip(*self.pairs))
        if len(self.pairs) > 1:
            pair, where = np.unique(pair, return_inverse=True)
            links = np.bincount(where, weights=links).astype(np.int64)
        return (self.doc_id, *self.numbers, self.sha.hexdigest(), packed(pair, links))


def stretches(both: Tokenizers, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bytes]]:
    """(row, A ids, B ids) of stretches of the batch's texts, in order; nothing for rows without tokens."""
    held = texts(batch)
    at = 0
    while at < len(held):
        upto, size = at, 0
        while upto < len(held) and (upto == at or size + len(held[upto]) <= CHUNK_BYTES):
            size, upto = size + len(held[upto]), upto + 1
        parts = [both.split(t) if t else None for t in held[at:upto]]
        both.learn({w for p in parts if p for w in p})
        for row, text, part in zip(range(at, upto), held[at:upto], parts):
            if not text:
                continue
            ids = [both.known[w] for w in part] if part else both.encoded([text])
            if all(x is not None for x in ids):
                for i in range(0, len(ids), STRETCH):
                    a, b = zip(*ids[i : i + STRETCH])
                    yield row, b"".join(a), b"".join(b)
        at = upto


def aligned(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the packed linked id pairs of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(json_path, model_path)
        len_a, len_b = both.lengths()
        names = np.char.encode(np.arange(max(both.n_a, both.n_b)).astype(str), "ascii")
        n_digits = np.char.str_len(names)
        digits = np.zeros((len(names), int(n_digits.max()) + 1), dtype=np.uint8)
        digits[:, :-1] = names.view(np.uint8).reshape(len(names), -1)

        def add(held: list[tuple[int, bytes, bytes]], found: list[Document]) -> None:
            batch = Batch(held, len_a, len_b)
            text, ends = batch.texts(digits, n_digits)
            bounds = np.append(np.flatnonzero(np.diff(batch.group_doc, prepend=-1)), batch.n_groups)
            total = lambda x: np.add.reduceat(x, bounds[:-1]).tolist()
            begin = 0
            for doc, end, n_a, n_b, n_groups, n_links in zip(batch.group_doc[bounds[:-1]].tolist(), ends[bounds[1:] - 1].tolist(), total(batch.size_a), total(batch.size_b), np.diff(bounds).tolist(), total(batch.size_a * batch.size_b)):
                found[doc].add(text[begin:end], n_a, n_b, n_groups, n_links)
                begin = end
            for doc, pair, links in batch.pairs(both.n_b):
                cut = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    found[int(doc[a])].pairs.append((pair[a:b], links[a:b]))

        for batch in batches:
            found, done = [Document(i) for i in column(batch, "doc_id").to_pylist()], 0
            held, size = [], 0

            def rows(upto: int) -> pa.RecordBatch:
                cols = list(zip(*(d.row() for d in found[done:upto]))) or [()] * 7
                found[done:upto] = [None] * (upto - done)
                kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
                return table({n: (c, k) for n, c, k in zip(["doc_id", *NUMBERS, "groups_sha256", "pairs"], cols, kinds)})

            for stretch in stretches(both, batch):
                if held and size + len(stretch[2]) > 4 * TOKENS:
                    add(held, found)
                    yield rows(stretch[0])  # the documents before this stretch's are whole
                    held, size, done = [], 0, stretch[0]
                held.append(stretch)
                size += len(stretch[2])
            if held:
                add(held, found)
            yield rows(len(found))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def overlaps(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """(row, doc_id, a_token, b_token, a_id, b_id, start, end, group_start) for every pair of tokens that share bytes.

    Token numbers and byte offsets (of blank and text) count within the document; a group is named by its first byte.
    ``row`` tells documents of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = Tokenizers(json_path, model_path)
        len_a, len_b = both.lengths()
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, start, last = column(batch, "doc_id"), (0, 0, 0), -1
            for stretch in stretches(both, batch):
                doc = stretch[0]
                start, last = start if doc == last else (0, 0, 0), doc
                part = Batch([stretch], len_a, len_b)
                a, b = part.overlaps()
                of = lambda df, at: {c: df[c].to_numpy()[at] for c in ("id", "start", "end")}
                side_a, side_b = of(part.a, a), of(part.b, b)
                group = part.a["start"].to_numpy()[(np.cumsum(part.size_a) - part.size_a)[part.group_a[a]]]
                n = len(a)
                begin, end = np.maximum(side_a["start"], side_b["start"]), np.minimum(side_a["end"], side_b["end"])
                values = {"a_token": a + start[0], "b_token": b + start[1], "a_id": side_a["id"], "b_id": side_b["id"], "start": begin + start[2], "end": end + start[2], "group_start": group + start[2]}
                yield table({"row": (np.full(n, base + doc), pa.int64()), "doc_id": (pa.repeat(ids[doc], n), None), **{k: (v, pa.int64()) for k, v in values.items()}})
                start = (start[0] + len(part.a), start[1] + len(part.b), start[2] + int(part.a["end"].iloc[-1]))
            base += batch.num_rows

    schema = "row long, doc_id long, a_token long, b_token long, a_id long, b_id long, start long, end long, group_start long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many rows a pair is linked, and whether no pair of the same A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        counted = lambda: table({k: (v, pa.int64()) for k, v in zip(("pair", "n"), np.unique(np.concatenate(held), return_counts=True))})
        for batch in batches:
            for data in column(batch, "pairs"):
                held.append(unpacked(data.as_py())[0])
                size += len(held[-1])
                if size > BUFFER:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = rows.where("pairs is not null").select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("a", F.floor(F.col("pair") / n_b)), "pair-counts")
    tops = staged(counts.groupBy("a").agg(F.max("n").alias("top")), "tops")
    return staged(counts.join(tops.hint("merge"), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "ranked-pairs")


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum in place of pairs, of one part of the counts."""
    held = counts.toArrow().combine_chunks().sort_by("pair")
    part = rows.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "n", "best")))
    names = [c for c in rows.columns if c != "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = part.value
        for batch in batches:
            n_best, count_sum = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for i, data in enumerate(column(batch, "pairs")):
                if data.is_valid and len(pair):
                    own, links = unpacked(data.as_py())
                    at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
                    links = links * (pair[at] == own)
                    n_best[i], count_sum[i] = links[best[at]].sum(), (links * n[at]).sum()
            yield table({**{c: (column(batch, c), None) for c in names}, "n_best": (n_best, pa.int64()), "count_sum": (count_sum, pa.int64())})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(names).schema)
    return rows.mapInArrow(run, schema + ", n_best long, count_sum long")


def alignment(docs: DataFrame, json_path: str, model_path: str, set_rows: int = SET_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs(doc_id, text)``."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    rows = staged(aligned(docs, json_path, model_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, n_b)
    total = counts.count()
    parts = max(1, -(-2 * total // set_rows)) if total > set_rows else 1
    columns = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    if parts == 1:
        return _looked_up(rows.drop("row"), counts).select(columns)
    sums = None
    for i in range(parts):
        part = _looked_up(rows.select("row", "pairs"), counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i))
        sums = part if sums is None else sums.union(part)
    sums = staged(sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "sums")
    return rows.drop("pairs").join(sums.hint("merge"), "row").select(columns)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
