"""Dictionaries of terms as automata in arrays, run over whole texts in NumPy.

Words are runs of ASCII letters and digits, whatever the case; a term is the sequence of its words, whatever stands between
them.  The automaton is a trie of words: sorted arrays of the dictionary's words, of its edges (node and word to node), and
the terms of each node.  A text's words are looked up once; then all places of a text take their edges together, and only
places still on a path of the trie take the next, so the work does not grow with the longest term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import settled, tokens

#: terms of a part of the dictionary; code points of texts that are scanned at once
PART_TERMS, CHUNK = 1_000_000, 1 << 18

_CODES = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, 128, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_LOWER = np.zeros(128, dtype=np.uint8)
for _a, _z in ((48, 58), (65, 91), (97, 123)):
    _LOWER[_a:_z] = np.arange(_a, _z) + (32 if _a == 65 else 0)


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points (0 for those of no word), starts and ends of words, and a 64-bit hash of each word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.zeros(len(points) + 2, dtype=np.uint8)
    low[1:-1] = np.where(points < 128, _LOWER[np.minimum(points, 127)], 0)
    edge = np.diff((low > 0).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low = low[1:-1]
    powers = np.full(len(low) + 1, _STEP, dtype=np.uint64)
    powers[0] = 1
    running = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_CODES[low] * np.multiply.accumulate(powers)[:-1], out=running[1:])
    powers[1:] = _BACK
    return low, starts, ends, (running[ends] - running[starts]) * np.multiply.accumulate(powers)[starts]


class Automaton:
    """Terms given by their words joined by blanks; ``scan`` finds the numbers of those that stand in texts."""

    def __init__(self, surfaces: list[str]):
        each = pd.Series(surfaces, dtype=object).str.split(" ").explode()
        self.word, vocabulary = pd.factorize(each, sort=True)
        self.n_words = max(1, len(vocabulary))
        low, starts, ends, name = _words(" ".join(vocabulary))
        order = np.argsort(name, kind="stable")
        self.name, self.code = name[order], order
        self.size = (ends - starts)[order]
        self.begin, self.letters = starts[order], low
        self.same = int(np.max(np.unique(name, return_counts=True)[1], initial=0))  # words of one hash

        term = each.index.to_numpy()
        first = np.flatnonzero(np.diff(term, prepend=-1))
        depth = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
        node, edges, nodes, n = np.zeros(len(surfaces), dtype=np.int64), [], [], 1
        for d in range(depth.max(initial=-1) + 1):
            at = np.flatnonzero(depth == d)
            key, where = np.unique(node[term[at]] * self.n_words + self.word[at], return_inverse=True)
            edges.append(key)
            nodes.append(n + np.arange(len(key)))
            node[term[at]] = n + where
            n += len(key)
        key, nodes = np.concatenate([*edges, np.zeros(0, dtype=np.int64)]), np.concatenate([*nodes, np.zeros(0, dtype=np.int64)])
        order = np.argsort(key, kind="stable")
        self.edge, self.node = key[order], nodes[order]
        self.term = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.term], np.arange(n + 1))
        del self.word

    def _codes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Each word's number in the dictionary, -1 for others; equal hashes are told apart by their letters."""
        out = np.full(len(name), -1, dtype=np.int64)
        at = np.searchsorted(self.name, name)
        for step in range(self.same):
            near = np.minimum(at + step, len(self.name) - 1)
            maybe = np.flatnonzero((self.name[near] == name) & (self.size[near] == ends - starts) & (out < 0))
            size, word = (ends - starts)[maybe], near[maybe]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differ = low[np.repeat(starts[maybe], size) + inside] != self.letters[np.repeat(self.begin[word], size) + inside]
            right = np.bincount(np.repeat(np.arange(len(maybe)), size), weights=differ, minlength=len(maybe)) == 0
            out[maybe[right]] = self.code[word[right]]
        return out

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, start, end) of all occurrences; offsets within their text."""
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        low, starts, ends, name = _words("\n".join(texts))
        code = self._codes(low, starts, ends, name) if len(self.name) else np.full(len(name), -1)
        row = np.searchsorted(base, starts, side="right") - 1
        place, node, depth = np.arange(len(code)), np.zeros(len(code), dtype=np.int64), 0
        out = []
        while len(place):
            last = place + depth
            open_ = last < len(code)
            place, node, last = place[open_], node[open_], last[open_]
            on = (code[last] >= 0) & (row[last] == row[place])
            place, node, last = place[on], node[on], last[on]
            key = node * self.n_words + code[last]
            at = np.minimum(np.searchsorted(self.edge, key), max(len(self.edge) - 1, 0))
            taken = self.edge[at] == key if len(self.edge) else np.zeros(len(key), dtype=bool)
            place, node, last = place[taken], self.node[at[taken]], last[taken]
            many = self.first[node + 1] - self.first[node]
            i = np.repeat(np.arange(len(place)), many)
            term = self.term[np.repeat(self.first[node], many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)]
            out.append((row[place[i]], term, starts[place[i]] - base[row[place[i]]], ends[last[i]] - base[row[place[i]]]))
            depth += 1
        return tuple(np.concatenate([*(o[c] for o in out), np.zeros(0, dtype=np.int64)]).astype(np.int64) for c in range(4))


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
            size, upto = size + len(texts[upto]), upto + 1
        yield at, texts[at:upto]
        at = upto


def _found(batch: pa.RecordBatch, automaton: Automaton, names: pa.Array) -> Iterator[pa.RecordBatch]:
    for at, texts in _chunks(["" if t is None else t for t in batch.column("text").to_pylist()]):
        row, term, start, end = automaton.scan(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + at)), names.take(pa.array(term)), pa.array(start), pa.array(end)], names=["doc_id", "term_id", "start", "end"])


def cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Of slices of a batch with a text: (rows, row, n, start, end, word) of all their words, in order; ``n`` counts from 1 within a row."""
    for at, texts in _chunks(["" if t is None else t for t in batch.column("text").to_pylist()]):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        low, starts, ends, _ = _words("\n".join(texts))
        row = np.searchsorted(base, starts, side="right") - 1
        n = np.arange(1, len(row) + 1) - np.searchsorted(row, row)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        word = pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets.tobytes()), pa.py_buffer(low[low > 0].tobytes()))
        yield batch.slice(at, len(texts)), row, n.astype(np.int32), starts - base[row], ends - base[row], word


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, n, start, end, word): all words of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, row, n, start, end, word in cut(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array(n), pa.array(start), pa.array(end), word], names=["doc_id", "n", "start", "end", "word"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, start long, end long, word string")


def frequent(docs: DataFrame, k: int, least: int = 3, most_words: int = 1_000_000) -> DataFrame:
    """(surface, c): the ``k`` most frequent of all words of ``least`` letters and all pairs of neighbouring words; ties by surface.

    Words are counted first.  A pair is no more frequent than its words, so only pairs of words that are as frequent as the
    ``k``-th long one are counted; the result is that of counting all.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, word in cut(batch):
                n = word.value_counts()
                yield pa.RecordBatch.from_arrays([n.field("values"), n.field("counts")], names=["surface", "c"])

    texts = docs.select("text")
    total = lambda df: df.groupBy("surface").agg(F.sum("c").alias("c"))
    single = settled(total(texts.mapInArrow(counted, "surface string, c long")))
    long = single.where(F.length("surface") >= least)
    kth = long.orderBy(F.desc("c"), "surface").limit(k).agg(F.min("c"), F.count(F.lit(1))).first()
    common = single.where(F.col("c") >= (kth[0] if kth[1] == k else 0)).select("surface")
    few = common.limit(most_words + 1).toArrow().column("surface").combine_chunks()
    held = docs.sparkSession.sparkContext.broadcast(few) if len(few) <= most_words else None

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, *_, word in cut(batch):
                known = word.dictionary_encode() if held is None else None
                names = known.dictionary if held is None else held.value
                code = (known.indices if held is None else pc.index_in(word, names)).cast(pa.int64()).fill_null(-1).to_numpy()
                both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
                key, c = np.unique(code[both] * len(names) + code[both + 1], return_counts=True)
                first, second = (names.take(pa.array(x)) for x in np.divmod(key, max(1, len(names))))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, second, " "), pa.array(c)], names=["surface", "c"])

    return long.unionByName(total(texts.mapInArrow(paired, "surface string, c long"))).orderBy(F.desc("c"), "surface").limit(k)


def bind(docs: DataFrame, terms: DataFrame, part_terms: int | None = None) -> DataFrame:
    """(doc_id, term_id, start, end): whole-word occurrences of ``terms (term_id, surface)`` in all texts.

    At most ``part_terms`` terms are held at once: a larger dictionary is cut by hash into parts, and each scans the texts.
    """
    most = part_terms or PART_TERMS
    known = settled(terms.select("term_id", F.array_join(tokens(F.col("surface")), " ").alias("surface")).where("surface <> ''"))
    parts = -(-known.count() // most) or 1
    parts = 2 * parts if parts > 1 else 1
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = f"doc_id {kind(docs, 'doc_id')}, term_id {kind(terms, 'term_id')}, start long, end long"
    found = None
    for i in range(parts):
        held = known.where(F.pmod(F.xxhash64("surface"), F.lit(parts)) == i).toArrow().combine_chunks()
        part = docs.sparkSession.sparkContext.broadcast((Automaton(held.column("surface").to_pylist()), held.column("term_id").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            automaton, names = part.value
            for batch in batches:
                yield from _found(batch, automaton, names)

        scanned = docs.select("doc_id", "text").mapInArrow(run, out)
        found = scanned if found is None else found.unionByName(scanned)
    return found


def bind_scoped(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for ``terms (doc_id, term_id, surface, scope_start, scope_end)``, each in its own document and span only.

    A document meets its own terms alone, so the dictionary of all documents is never in one place.
    """
    own = terms.select("doc_id", F.struct("term_id", F.array_join(tokens(F.col("surface")), " ").alias("surface"), F.col("scope_start").cast("long").alias("a"), F.col("scope_end").cast("long").alias("b")).alias("t")).where("t.surface <> ''")
    joined = docs.select("doc_id", "text").join(own.groupBy("doc_id").agg(F.collect_list("t").alias("terms")).hint("merge"), "doc_id")
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = None, None
        for batch in batches:
            for at, texts in _chunks(["" if t is None else t for t in batch.column("text").to_pylist()]):
                rows = batch.slice(at, len(texts))
                own = rows.column("terms").flatten()
                owner = np.repeat(np.arange(len(texts)), rows.column("terms").value_lengths().to_numpy())
                a, b = (own.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                # one automaton for the surfaces of some documents; what it finds meets the terms of its own document
                surfaces = own.field("surface").unique().sort()
                if known is None or not surfaces.equals(known):
                    known, automaton = surfaces, Automaton(surfaces.to_pylist())
                key = owner * len(known) + pc.index_in(own.field("surface"), known).to_numpy()
                order = np.argsort(key, kind="stable")
                row, surface, start, end = automaton.scan(texts)
                asked = row * len(known) + surface
                low, high = (np.searchsorted(key[order], asked, side=x) for x in ("left", "right"))
                i = np.repeat(np.arange(len(asked)), high - low)
                entry = order[low[i] + np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
                inside = (a[entry] <= start[i]) & (end[i] <= b[entry])
                i, entry = i[inside], entry[inside]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row[i])), own.field("term_id").take(pa.array(entry)), pa.array(start[i]), pa.array(end[i])], names=["doc_id", "term_id", "start", "end"])

    return joined.mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, term_id {kind(terms, 'term_id')}, start long, end long")
