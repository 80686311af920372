"""N-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct word shingles.  Documents link when their sets' Jaccard similarity reaches the
threshold; the result names each document's connected component.  Nothing is lost and no group is expanded into pairs:

1. *Equal sets* share all answers: documents are classed by a 64-bit name of their set, and only classes go on.
2. *Block-skipped index lists*: a set, ordered by hash, is cut by position into blocks, more than two linked sets of its
   size can differ in, so linked sets have blocks in common.  A list holds the sets with one and the same block; lists of
   one set are skipped, and with them all that a set merely shares with others (passages, frequent words).  Linked sets
   have as many blocks in common as exceed the most they can differ in, so each set leaves as many lists but one, its
   longest.  Sets of one size class and of the next smaller one meet on the larger one's blocks.
3. *Answers derived from a similar set*: each list has two leaders.  Members are compared with them and verified; what
   links to a leader takes over the leader's component, and two members of one component are never compared again.
4. Sets of lists that still hold two components are cut anew into three times the blocks, which makes the lists they may
   leave many more.  What is left joins within its lists, in the first list that a pair shares, skipping equal components;
   size and a parity sketch, whose differing bits are a lower bound of the sets' symmetric difference, are part of the join
   condition, and a four times wider sketch follows, so that hardly any pair but links is verified on whole texts.

Rows of a list meet in one task while it is counted (20 bytes each, and they spill); afterwards lists are written before
they are joined, so that Spark can split them.  What still grows with the square of a group are pairs of sets just below
the threshold that no list tells apart.

Empty blocks are no signature.  A few are allowed for by as many more blocks; sets with more of them than that share one
further list per size class, so that no link hangs on an empty block alone.

Defined cases: null or empty texts have an empty set and link with nothing; texts of fewer words than a shingle have
their whole word sequence as one shingle; repeated rows are copies; a null id never becomes a component's name unless
all its documents lack an id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, byte_chunks, column, connected_components, gram_hash, mix, prefix_hash, read_table, span_hash, staged, table, words

IS_WORD = np.ones(256, dtype=bool)
NO_ID = -(1 << 63)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

PARITY = ["p0", "p1", "p2", "p3"]
#: the second cut into blocks has so many times more of them
FINER = 2
#: so many of a set's shorter lists tell whether a pair met there already
EARLIER = 8


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    lowered = ASCII_LOWER[data]
    starts, ends, first = words(lowered, bounds, IS_WORD)
    word = span_hash(prefix_hash(lowered), starts, ends)
    gram = gram_hash(word, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(gram[a : b - k + 1]))
        elif b > a:
            out.append(gram_hash(word[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _name(shingles: np.ndarray) -> int:
    """64-bit name of a set; two different sets share one with a chance of 2^-64."""
    return int(mix(np.array([np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def _parity(shingles: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the number of elements that hash to it."""
    odd = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & 1023, minlength=1024).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


class Levels:
    """Size classes and their numbers of blocks, for the threshold ``num / den``.

    A class ends where its smallest set cannot link any more, so linked sets are of one class or of neighbouring ones.
    """

    def __init__(self, num: int, den: int, finer: int = 0, largest: int = 1 << 40):
        first = [1]
        while first[-1] < largest:
            first.append(first[-1] * den // num + 1)
        self.num, self.den, self.first = num, den, np.array(first)
        self.differ = np.array([2 * (b - 1) * (den - num) // (den + num) for b in first[1:]])
        smallest = np.array([first[max(i - 1, 0)] for i in range(len(self.differ))])
        spare = 3 + (2 * (self.differ + 1) * np.exp(-smallest / (self.differ + 1))).astype(np.int64)
        self.blocks = (finer + 1) * (self.differ + 1) + spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, n, side="right") - 1

    def most(self, sizes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """In how many elements a set can differ from one that it links with on a level."""
        partner = np.minimum(sizes * self.den // self.num, self.first[level + 1] - 1)
        return np.minimum((sizes + partner) * (self.den - self.num) // (self.den + self.num), self.differ[level])


def signatures(sets: list[np.ndarray], levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every block of every set, on its own level and on the next: set number, signature, level (0 own, 1 next), and
    how many of its longest lists the set may leave there.
    """
    sizes = np.array([len(s) for s in sets])
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    if not len(token):
        return owner, token, owner, owner
    weight = np.zeros(len(token) + 1, dtype=np.uint64)
    np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)), out=weight[1:])
    owners, names, ups, leaves = [], [], [], []
    for up in (0, 1):
        level = levels.of(np.maximum(sizes, 1)) + up
        blocks = levels.blocks[level].astype(np.uint64)
        block = ((token >> np.uint64(32)) * blocks[owner]) >> np.uint64(32)
        head = np.concatenate([[0], np.flatnonzero((np.diff(owner) != 0) | (np.diff(block) != 0)) + 1])
        content = weight[np.concatenate([head[1:], [len(token)]])] - weight[head]
        own = owner[head]
        spare = np.bincount(own, minlength=len(sets)) - levels.most(sizes, level) - 1
        thin = np.flatnonzero((sizes > 0) & (spare < 0))
        names += [mix(mix(content + block[head]) + level[own].astype(np.uint64)), mix(level[thin].astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))]
        owners += [own, thin]
        ups.append(np.full(len(own) + len(thin), up))
        leaves += [np.maximum(spare, 0)[own], np.zeros(len(thin), dtype=np.int64)]
    return np.concatenate(owners), np.concatenate(names), np.concatenate(ups), np.concatenate(leaves)


def with_text_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_key``: rows that share it and their id (a null one too) repeat each other."""
    return docs.withColumn("text_key", F.xxhash64(F.col("text").cast("string")))


def _described(docs: DataFrame, k: int) -> DataFrame:
    """A row per document: its set's size, name and parity sketch."""
    schema = "doc_id long, text_key long, n int, sid long, parity array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in byte_chunks(batches):
            sets = shingle_sets(data, bounds, k)
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([_parity(s) for s in sets])), 16).cast(pa.list_(pa.int64()))
            yield table({"doc_id": (column(rows, "doc_id"), pa.int64()), "text_key": (column(rows, "text_key"), pa.int64()), "n": ([len(s) for s in sets], pa.int32()), "sid": ([_name(s) for s in sets], pa.int64()), "parity": (sketch, None)})

    return with_text_key(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def _blocks(texts: DataFrame, k: int, num: int, den: int, finer: int = 0) -> DataFrame:
    """(block, sid, tag): a row per block of the sets of ``texts(text or packed)``, of copies within a task once.

    tag: twice the number of lists that the set may leave, plus its level (0 own, 1 next).
    """
    plain = "text" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den, finer)
        seen = np.zeros(0, dtype=np.int64)
        for data, bounds in ((d, b) for _, d, b in byte_chunks(batches)) if plain else _unpacked(batches):
            sets = shingle_sets(data, bounds, k)
            names = np.array([_name(s) for s in sets], dtype=np.int64)
            first = np.zeros(len(sets), dtype=bool)
            first[np.unique(names, return_index=True)[1]] = True
            new = np.flatnonzero(first & ~np.isin(names, seen))
            seen = np.concatenate([seen, names[new]])
            if len(new):
                owner, name, up, leaves = signatures([sets[i] for i in new], levels)
                yield table({"block": (name.view(np.int64), pa.int64()), "sid": (names[new[owner]], pa.int64()), "tag": (leaves << 1 | up, pa.int32())})

    return texts.select(F.col("text").cast("string") if plain else "packed").mapInArrow(run, "block long, sid long, tag int")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for packed in column(batch, "packed").to_pylist():
            data = np.frombuffer(unpress.decompress(packed), dtype=np.uint8)
            yield data, np.array([0, len(data)])


def _lists(blocks: DataFrame) -> DataFrame:
    """(block, sid, up, c) of lists with two sets at least, without those that a set may leave; c: the list's rows.

    Nearly all blocks are of one set, so rows are sorted into lists once; counting first would shuffle them twice.
    """
    whole_list = Window.partitionBy("block")
    counted = blocks.withColumns({"lo": F.min("sid").over(whole_list), "hi": F.max("sid").over(whole_list), "lowest": F.min(F.col("tag") % 2).over(whole_list), "c": F.count(F.lit(1)).over(whole_list)})
    members = counted.where("lo < hi and lowest = 0").select("block", "sid", "tag", "c").distinct()
    up = (F.col("tag") % 2).alias("up")
    longest_first = Window.partitionBy("sid", up).orderBy(F.desc("c"), "block")
    return members.withColumn("_at", F.row_number().over(longest_first)).where("_at > shiftright(tag, 1)").select("block", "sid", up, "c")


def _packed(docs: DataFrame) -> DataFrame:
    """(id, text_key, packed): the compressed text of every document; a null id is compared as a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for rows, data, bounds in byte_chunks(batches):
            yield table({"id": (column(rows, "id"), pa.int64()), "text_key": (column(rows, "text_key"), pa.int64()), "packed": ([press.compress(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})

    return with_text_key(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string"))).mapInArrow(run, "id long, text_key long, packed binary")


def _of_class(texts: DataFrame, k: int) -> DataFrame:
    """Rows of ``texts(sid, packed)`` whose text has the set of that name: hashes of texts may collide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            kept = []
            for sid, packed in zip(column(batch, "sid").to_pylist(), column(batch, "packed").to_pylist()):
                data = np.frombuffer(unpress.decompress(packed), dtype=np.uint8)
                kept.append(_name(shingle_sets(data, np.array([0, len(data)]), k)[0]) == sid)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return texts.select("sid", "packed").mapInArrow(run, "sid long, packed binary")


def _verified(pairs: DataFrame, packed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold."""
    one = packed.select(F.col("sid").alias("a"), F.col("packed").alias("text_a"))
    two = packed.select(F.col("sid").alias("b"), F.col("packed").alias("text_b"))
    joined = pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()

        def shingles(packed: bytes) -> np.ndarray:
            data = np.frombuffer(unpress.decompress(packed), dtype=np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), k)[0]

        last: dict[str, tuple[bytes, np.ndarray]] = {}
        for batch in batches:
            kept = []
            for row in zip(column(batch, "text_a").to_pylist(), column(batch, "text_b").to_pylist()):
                for side, text in zip("ab", row):
                    if side not in last or last[side][0] != text:
                        last[side] = (text, shingles(text))
                x, y = last["a"][1], last["b"][1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def keyed(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, keeper) for every row of ``docs(doc_id, text)``; threshold ``num / den``.

    ``keeper(doc_id, text_key)`` is the same for all rows of a component and of one component only: its row of least id
    (one without an id only if all are), and of those the least ``text_key``.  A row of an empty set is its own.
    """
    rows = staged(_described(docs, k), "sets")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    own = rows.where("n > 0").groupBy("sid").agg(F.min(key).alias("keeper"), F.max("n").alias("n"), F.first("parity").alias("parity"))
    # four xor-ed quarters of the parity sketch are the sketch of a quarter of its bits
    own = staged(own.withColumns({p: F.col("parity")[i].bitwiseXOR(F.col("parity")[i + 4]).bitwiseXOR(F.col("parity")[i + 8]).bitwiseXOR(F.col("parity")[i + 12]) for i, p in enumerate(PARITY)}), "set-classes")

    members = staged(_lists(_blocks(docs, k, num, den)), "members")
    # a list's first leader is on its own level, where it can meet all others
    led = members.groupBy("block").agg(F.min(F.struct("up", "sid"))["sid"].alias("first"), F.max(F.struct("up", "sid"))["sid"].alias("last"))
    led = staged(led.where("first <> last"), "leaders")
    lists = staged(members.join(led.hint("merge"), "block"), "lists")

    involved = lists.select("sid").distinct().join(own.select("sid", F.coalesce("keeper.doc_id", F.lit(NO_ID)).alias("id"), "keeper.text_key").hint("merge"), "sid")
    texts = _of_class(_packed(docs).join(involved.hint("merge"), ["id", "text_key"]), k)
    texts = staged(texts.dropDuplicates(["sid"]), "texts")

    side = lambda s: own.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(p).alias(f"{p}_{s}") for p in PARITY])
    differ = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY[1:]), F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    size_ok = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")
    close = (differ * (den + num)) <= (F.col("n_a") + F.col("n_b")) * (den - num)

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that the whole parity sketches allow; what they refuse cannot link."""
        wide = lambda s: own.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}"))
        bits = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = pairs.select("a", "b").join(wide("a").hint("merge"), "a").join(wide("b").hint("merge"), "b")
        return both.where(bits * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b")

    to_leader = lists.select(F.explode(F.array("first", "last")).alias("a"), F.col("sid").alias("b")).where("a <> b")
    to_leader = to_leader.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    to_leader = to_leader.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(size_ok & close)
    links = staged(_verified(likely(to_leader), texts, k, num, den), "leader-links")
    component = staged(connected_components(links), "leader-components")

    def open_lists(lists: DataFrame) -> DataFrame:
        """The rows, with their components, of lists that still hold two."""
        labelled = lists.select("block", "sid", "up", "c").join(component.select(F.col("node").alias("sid"), "component").hint("merge"), "sid", "left")
        labelled = staged(labelled.withColumn("component", F.coalesce("component", "sid")), "labelled")
        still = labelled.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("block")
        return labelled.join(staged(still, "open").hint("merge"), "block")

    unsettled = staged(texts.join(open_lists(lists).select("sid").distinct().hint("merge"), "sid"), "unsettled")
    rest = open_lists(_lists(_blocks(unsettled.select("packed"), k, num, den, FINER)))
    shorter = Window.partitionBy("sid", "up").orderBy("c", F.desc("block")).rowsBetween(-EARLIER, -1)
    rest = rest.withColumn("earlier", F.collect_list("block").over(shorter)).join(own.select("sid", "n", *PARITY).hint("merge"), "sid")
    rest = staged(rest, "open-lists")
    named = lambda s: rest.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "up", "n", "component", "earlier", *PARITY)])
    other = (F.col("component_a") != F.col("component_b")) & (F.col("sid_a") < F.col("sid_b")) & (F.least("up_a", "up_b") == 0)
    found = named("a").hint("merge").join(named("b"), "block").where(other & size_ok & close & ~F.arrays_overlap("earlier_a", "earlier_b"))
    more = staged(_verified(likely(found.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct()), texts, k, num, den), "more-links")

    ids = own.select("sid", "keeper").join(component.select(F.col("node").alias("sid"), "component").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    if not more.isEmpty():
        # the few links found last join components
        of = component.select("node", F.col("component").alias("of"))
        named = more.join(of.hint("merge"), F.col("a") == F.col("node"), "left").select(F.coalesce("of", "a").alias("a"), "b")
        named = named.join(of.hint("merge"), F.col("b") == F.col("node"), "left").select("a", F.coalesce("of", "b").alias("b"))
        merged = connected_components(named).toDF("component", "merged")
        ids = ids.join(merged.hint("merge"), "component", "left").withColumn("component", F.coalesce("merged", "component")).drop("merged")
    ids = staged(ids, "class-components")
    least = staged(ids.groupBy("component").agg(F.min("keeper").alias("keeper")), "keepers")
    answer = staged(ids.select("sid", "component").join(least.hint("merge"), "component").select("sid", "keeper.doc_id", "keeper.text_key").toDF("sid", "keeper_id", "keeper_key"), "answers")
    out = rows.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "sid").join(answer.hint("merge"), "sid", "left")
    of = lambda own, shared: F.when(F.col("n_shingles") == 0, F.col(own)).otherwise(F.col(shared))
    keeper = F.struct(of("doc_id", "keeper_id").alias("doc_id"), of("text_key", "keeper_key").alias("text_key"))
    return out.select("doc_id", "text_key", "n_shingles", of("doc_id", "keeper_id").alias("component_id"), keeper.alias("keeper"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``; threshold ``num / den``."""
    return keyed(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 90 * (x.n + y.n - both_n)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(seen) FROM r WHERE r.node = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
