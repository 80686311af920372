"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

A text's lattice has an edge for every piece of the vocabulary that matches at a place, weighted with the piece's score,
and byte pieces for a character that is no piece.  The best path is found forwards (Viterbi); its scores of all prefixes
then are an exact heuristic for an A* search backwards from the end, which pops the N best paths in order.

Where two characters follow each other in no piece, every path has a border, so a lattice falls apart into words there
(at blanks, above all).  The forward and backward passes run for many words at once, step by step over their places;
a word's best path and the loss of its second best are remembered (words of ``LONG`` characters at most, ``keep`` bytes a
task).  The A* search runs for the N - 1 words of a text with the smallest loss, which alone can leave their best path in
the text's N best, and these are merged.  Equal words are told by a 64-bit hash.

Decoding joins the pieces, turns marks back into blanks and takes away the one that encoding put in front.  It gives back
any text that does not itself hold the mark character.

Defined cases: null and empty texts have no pieces, score 0 and decode to the empty text; a text with fewer paths than N
has as many scores as paths; ties go to the path whose last differing piece is longer; repeated rows give a row each; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ODD, _power, byte_chunks, mix, read_table, span_hash, table, texts

MARK = "▁"
N_BEST = 3
#: what a character that is no piece costs below the worst score
UNKNOWN_PENALTY = 10.0

#: words of more characters are passed through one at a time, and not remembered
LONG = 200


class Lattice:
    """Vocabulary of a model file, and the N best segmentations of words."""

    def __init__(self, model_file: str, n: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = n
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.scores = np.zeros(len(model))
        self.raw: list[bytes] = [b""] * len(model)
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.raw[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.scores[i] = model.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.score_of = {p: float(self.scores[i]) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        usual = self.scores[self.scores > -1e8]
        self.unknown = float(usual.min()) - UNKNOWN_PENALTY
        #: every beginning of a piece, with the score of those that are pieces
        self.beginnings: dict[str, float | None] = {p[:i]: None for p in self.ids for i in range(1, len(p))} | self.score_of

    def edges(self, word: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every edge, by start."""
        out, n, get = [], len(word), self.beginnings.get
        for start in range(n):
            single = False
            for end in range(start + 1, n + 1):
                score = get(word[start:end], False)
                if score is False:
                    break
                if score is not None:
                    out.append((start, end, score))
                    single |= end == start + 1
            if not single:
                out.append((start, start + 1, self.unknown))
        return out

    def viterbi(self, word: str) -> tuple[float, float, bytes]:
        """The best path's score, what the second best loses against it, and the best path's ids."""
        edges, n = self.edges(word), len(word)
        low = float("-inf")
        forward, came = [0.0] + [low] * n, [0] * (n + 1)
        for start, end, score in edges:
            total = forward[start] + score
            if total > forward[end]:
                forward[end], came[end] = total, start
        backward = [low] * n + [0.0]
        path, at = None, n
        on_path = set()
        while at:
            on_path.add((came[at], at))
            path, at = (came[at], at, path), came[at]
        second = low
        for start, end, score in reversed(edges):
            total = score + backward[end]
            if total > backward[start]:
                backward[start] = total
            total += forward[start]
            if total > second and (start, end) not in on_path:
                second = total
        return forward[n], forward[n] - second, self.encoded(word, path)

    def best(self, word: str) -> list[tuple[float, bytes]]:
        """The N best paths of a word (blanks as marks), Viterbi's first: score, and ids as little-endian 32-bit numbers."""
        edges, n = self.edges(word), len(word)
        forward = [0.0] + [float("-inf")] * n
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for start, end, score in edges:
            forward[end] = max(forward[end], forward[start] + score)
            ending[end].append((start, score))
        found: list[tuple[float, bytes]] = []
        # (minus the whole path's score, order of entry, place, score behind the place, path behind it)
        queue: list[tuple] = [(-forward[n], 0, n, 0.0, None)]
        entered = 0
        while queue and len(found) < self.n:
            _, _, place, behind, path = heapq.heappop(queue)
            if place == 0:
                found.append((behind, self.encoded(word, path)))
                continue
            for start, score in ending[place]:
                entered += 1
                total = behind + score
                heapq.heappush(queue, (-(forward[start] + total), entered, start, total, (start, place, path)))
        first = self.viterbi(word)
        return [(first[0], first[2]), *[p for p in found if p[1] != first[2]]][: self.n]

    def encoded(self, word: str, path) -> bytes:
        ids: list[int] = []
        while path is not None:
            start, end, path = path
            piece = self.ids.get(word[start:end])
            ids += [piece] if piece is not None else [self.byte_ids[b] for b in word[start:end].encode("utf-8", "surrogatepass")]
        return array("I", ids).tobytes()


class Trie:
    """A lattice's pieces as arrays, for passes over many words at once."""

    PAIRS = 1 << 20

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        chars = sorted({c for p in lattice.ids for c in p})
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.width = len(chars) + 1
        #: number of every character that is in a piece; 0 for others
        self.number = np.zeros(0x110000, dtype=np.int64)
        self.number[[ord(c) for c in chars]] = np.arange(1, self.width)
        #: whether two characters may follow each other in a piece (a table of hashes: if in doubt, they may)
        self.joined = np.zeros(self.PAIRS, dtype=bool)
        for p in lattice.ids:
            for x, y in zip(p, p[1:]):
                self.joined[self.pair(number[x], number[y])] = True
        self.joined[self.pair(0, 0)] = False
        nodes = {b: i + 1 for i, b in enumerate(sorted(lattice.beginnings, key=len))} | {"": 0}
        steps = sorted((nodes[b[:-1]] * self.width + number[b[-1]], i) for b, i in nodes.items() if b)
        self.steps, self.to = np.array([k for k, _ in steps]), np.array([i for _, i in steps])
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        self.piece[[nodes[p] for p in lattice.ids]] = list(lattice.ids.values())

    def pair(self, x, y):
        return (x * 40503 + y) & (self.PAIRS - 1)

    def cuts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words begin: at every text's first character, and between characters that no piece joins."""
        number = self.number[codes]
        at = np.ones(len(codes), dtype=bool)
        at[1:] = ~self.joined[self.pair(number[:-1], number[1:])] | (number[:-1] == 0) | (number[1:] == 0)
        at[first] = True
        return np.flatnonzero(at)

    def edges(self, codes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece (-1: unknown character) of every edge, by start; ``behind``: each character's word's end."""
        number = self.number[codes]
        at, node, length = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        starts, ends, found = [], [], []
        single = np.zeros(len(codes), dtype=bool)
        while len(at):
            key = node * self.width + number[at + length]
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            ok = self.steps[place] == key
            at, node, length = at[ok], self.to[place[ok]], length + 1
            piece = self.piece[node]
            ends_here = piece >= 0
            starts.append(at[ends_here])
            ends.append(at[ends_here] + length)
            found.append(piece[ends_here])
            if length == 1:
                single[at[ends_here]] = True
            more = at + length < behind[at]
            at, node = at[more], node[more]
        unknown = np.flatnonzero(~single)
        start = np.concatenate([*starts, unknown])
        order = np.argsort(start, kind="stable")
        return start[order], np.concatenate([*ends, unknown + 1])[order], np.concatenate([*found, np.full(len(unknown), -1)])[order]

    def passes(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words laid end to end: best score, loss of the second best, ids of the best path, and number of ids.

        The result is that of ``Lattice.viterbi``; place p of word w has one cell more than characters.
        """
        lattice, words = self.lattice, len(sizes)
        last = np.cumsum(sizes)
        begin = last - sizes
        word = np.repeat(np.arange(words), sizes)
        start, end, piece = self.edges(codes, last[word])
        score = np.where(piece >= 0, lattice.scores[piece], lattice.unknown)
        own = word[start]
        start, end = start + own, end + own  # cells
        head, tail = begin + np.arange(words), last + np.arange(words)
        step = start - head[own]
        by_step = np.argsort(step, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(step))])
        forward = np.full(len(codes) + words, -np.inf)
        forward[head] = 0.0
        came, via = np.zeros(len(forward), dtype=np.int64), np.zeros(len(forward), dtype=np.int64)
        for i, j in zip(bounds[:-1], bounds[1:]):
            e = by_step[i:j]
            total = forward[start[e]] + score[e]
            better = total > forward[end[e]]
            e = e[better]
            forward[end[e]], came[end[e]], via[end[e]] = total[better], start[e], e
        backward = np.full(len(forward), -np.inf)
        backward[tail] = 0.0
        for i, j in zip(bounds[-2::-1], bounds[:0:-1]):
            e = by_step[i:j]
            groups = np.concatenate([[0], np.flatnonzero(np.diff(start[e])) + 1])
            backward[start[e][groups]] = np.maximum.reduceat(score[e] + backward[end[e]], groups)
        taken, is_head = np.zeros((2, len(forward)), dtype=bool)
        is_head[head] = True
        at = tail
        while len(at):
            taken[at] = True
            at = came[at]
            at = at[~is_head[at]]
        edge = via[taken]  # the best paths' edges, word by word
        through = score + backward[end] + forward[start]
        through[edge] = -np.inf
        loss = forward[tail] - np.maximum.reduceat(through, np.searchsorted(own, np.arange(words)))
        ids, count = piece[edge], np.ones(len(edge), dtype=np.int64)
        odd = np.flatnonzero(ids < 0)
        owner = own[edge]
        if len(odd):
            raw = [chr(codes[i]).encode("utf-8", "surrogatepass") for i in (start - own)[edge[odd]].tolist()]
            count[odd] = list(map(len, raw))
            spread = np.repeat(ids, count)
            spread[spread < 0] = np.array(lattice.byte_ids)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            ids = spread
        return forward[tail], loss, ids.astype("<u4"), np.bincount(owner, weights=count, minlength=words).astype(np.int64)


class Encoder:
    """Segments texts, and remembers words by their hash: best score, loss, and place of the ids in one long array."""

    def __init__(self, model_file: str, n: int = N_BEST, keep: int = 100_000_000):
        self.lattice, self.n, self.keep = Lattice(model_file, n), n, keep
        self.trie = Trie(self.lattice)
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.top, self.loss = np.zeros(0), np.zeros(0)
        self.size, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        self.lists: dict[str, list[tuple[float, bytes]]] = {}

    def several(self, word: str) -> list[tuple[float, bytes]]:
        found = self.lists.get(word)
        if found is None:
            found = self.lattice.best(word)
            if len(word) <= LONG:
                self.lists[word] = found
        return found

    def learn(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add the words that stand there to the arrays."""
        sizes = ends - starts
        short = np.flatnonzero(sizes <= LONG)
        tops, losses, counts = np.zeros(len(starts)), np.zeros(len(starts)), np.zeros(len(starts), dtype=np.int64)
        parts: dict[int, np.ndarray] = {}
        for at in range(0, len(short), 20_000):
            own = short[at : at + 20_000]
            place = np.arange(sizes[own].sum()) + np.repeat(starts[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own])
            tops[own], losses[own], ids, counts[own] = self.trie.passes(codes[place], sizes[own])
            parts |= zip(own.tolist(), np.split(ids, np.cumsum(counts[own])[:-1]))
        for i in np.flatnonzero(sizes > LONG).tolist():
            tops[i], losses[i], ids = self.lattice.viterbi(codes[starts[i] : ends[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
            parts[i] = np.frombuffer(ids, dtype="<u4")
            counts[i] = len(parts[i])
        self.top, self.loss, self.size = np.append(self.top, tops), np.append(self.loss, losses), np.append(self.size, counts)
        self.ids = np.concatenate([self.ids, *(parts[i] for i in range(len(starts)))])

    def encode_all(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """The N best segmentations of each whole text: score and ids."""
        if len(self.known) * 200 + self.ids.nbytes > self.keep:
            self.reset()
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if not len(codes):
            return [[(0.0, b"")] for _ in texts]
        bound = np.concatenate([[0], np.cumsum([len(m) for m in marked])])
        starts = self.trie.cuts(codes, bound[:-1][np.diff(bound) > 0])
        ends = np.append(starts[1:], len(codes))
        running = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * _power(_ODD, len(codes), "odd"), out=running[1:])
        name, first, inverse = np.unique(span_hash(running, starts, ends), return_index=True, return_inverse=True)
        number = np.array([self.known.get(h, -1) for h in name.tolist()], dtype=np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.top) + np.arange(len(new))
            self.learn(codes, starts[first[new]], ends[first[new]])
            short = new[(ends - starts)[first[new]] <= LONG]
            self.known |= zip(name[short].tolist(), number[short].tolist())
        number = number[inverse]
        size, place = self.size[number], (np.cumsum(self.size) - self.size)[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(place - upto[:-1], size)]
        top, loss = self.top[number], self.loss[number]
        word_of = np.searchsorted(starts, bound)
        out = []
        for text, a, b, at in zip(marked, word_of[:-1].tolist(), word_of[1:].tolist(), bound[:-1].tolist()):
            if a == b:
                out.append([(0.0, b"")])
                continue
            word = lambda i: text[starts[a + i] - at : ends[a + i] - at]  # noqa: B023, E731
            paths: list[tuple[float, tuple]] = [(float(top[a:b].sum()), ())]
            own_loss = loss[a:b]
            least = np.argsort(own_loss, kind="stable")[: self.n - 1] if b - a <= 64 else np.argpartition(own_loss, self.n - 1)[: self.n - 1]
            for i in least.tolist() if self.n > 1 else []:
                own = self.several(word(i))
                merged = [(s + alt - own[0][0], (*swap, (i, j)) if j else swap) for s, swap in paths for j, (alt, _) in enumerate(own)]
                paths = heapq.nlargest(self.n, merged, key=lambda x: x[0])
            results = []
            for s, swaps in paths:
                parts, done = [], upto[a]
                for i, j in sorted(swaps):
                    parts += [ids[done : upto[a + i]].tobytes(), self.several(word(i))[j][1]]
                    done = upto[a + i + 1]
                results.append((s, b"".join([*parts, ids[done : upto[b]].tobytes()])))
            out.append(results)
        return out

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        raw = self.lattice.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model_file: str, n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, scores, decodes, ids, alternatives) for every row of ``docs(doc_id, text)``.

    ids: the best segmentation; alternatives: the others, best first; scores: of all, best first; decodes: whether the
    best one decodes to the text.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, decodes boolean, ids array<int>, alternatives array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file, n)
        numbers = lambda b: np.frombuffer(b, dtype="<i4").tolist() if with_ids else []
        for batch in batches:
            for part in _parts(batch):
                own = texts(part)
                paths = encoder.encode_all(own)
                yield table({
                    "doc_id": (part.column(0), None), "n_pieces": ([len(p[0][1]) // 4 for p in paths], pa.int64()), "ids_crc32": ([zlib.crc32(p[0][1]) for p in paths], pa.int64()),
                    "scores": ([[s for s, _ in p] for p in paths], pa.list_(pa.float64())), "decodes": ([encoder.decode(p[0][1]) == t for p, t in zip(paths, own)], pa.bool_()),
                    "ids": ([numbers(p[0][1]) for p in paths], pa.list_(pa.int32())), "alternatives": ([[numbers(b) for _, b in p[1:]] if with_ids else [] for p in paths], pa.list_(pa.list_(pa.int32()))),
                })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part, _, _ in byte_chunks([batch]):
        yield part


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of ``rows(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file, 1)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield table({"doc_id": (batch.column(0), None), "text": ([encoder.decode(np.asarray(i or [], dtype="<u4").tobytes()) for i in ids], pa.string())})

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's segmentation: its length, checksum, the N best scores, and whether it decodes."""
    out = encode(read_table(spark, sf_dir, "documents"), model_path(), with_ids=False).drop("ids", "alternatives")
    return out.withColumn("scores", F.transform("scores", lambda s: F.round(s, 6)))
