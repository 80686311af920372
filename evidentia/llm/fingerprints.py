"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in built-in functions only.

A text is cut into paragraphs (up to a line break or a sentence mark, at most 200 characters).  Each distinct
paragraph's 64-bit digest goes into one cell of each of three tables; a cell holds a count and the xor of the digests
and of their check hashes.  Two sketches subtract cell by cell; peeling cells that hold a single digest recovers the
paragraphs that one side has and the other lacks.  Comparisons that cannot be peeled are retried on larger sketches
(one bucket of three tables for every five paragraphs, then for every two), and what is still left is counted on the
digests themselves, so a likeness is always exact for the digests: the share of distinct paragraphs that both texts have.

The fingerprint lists the non-empty cells of the smallest sketch; its length is bounded.

All groupings are by document, so after one deal by document the cells are made, subtracted and peeled without another
shuffle, as plain sums and xors.

Order of documents: descending id; documents of equal id by descending hash of their text.

Defined cases: a null text is empty and has no paragraphs; two texts without paragraphs have likeness 1; rows equal in id
and text are one document of the order and get a row each; a null id comes last; a lone document's next one is itself;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

#: cells of one of a bucket's three tables
CELLS = 6
#: paragraphs of both texts for which a larger sketch has a bucket; peeling rounds by size
LARGER, ROUNDS = (5, 2), (4, 7, 7)
DOCS_A_TASK = 2000
PARAGRAPH = r"[^\n.!?]{1,200}[\n.!?]*|[\n.!?]+"
DOC = ["doc", "th"]
NO_ID = -(1 << 63)


def digests(text: str) -> Column:
    """Digests of the distinct paragraphs of a text column."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(g: Column, table: int) -> Column:
    """Cell of a digest within its bucket, from its check hash."""
    return F.lit(table * CELLS) + F.pmod(F.shiftright(g, 9 * table).bitwiseAND(511), F.lit(CELLS)).cast("int")


def in_cells(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell, c, k, g): cells of ``elements(keys, buckets, sign, k)``."""
    e = elements.withColumn("g", F.xxhash64("k"))
    base = F.pmod(F.shiftright("k", 3), F.col("buckets")) * (3 * CELLS)
    spread = e.withColumn("cell", F.explode(F.array(*[(base + _cell(F.col("g"), t)).cast("int") for t in range(3)])))
    return spread.groupBy(*keys, "cell").agg(F.sum("sign").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("g").alias("g"))


def peel(cells: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """(keys, found, left): digests recovered from differences and cells that could not be emptied.

    A round removes every digest that stands alone in some cell from its three cells; the cell -1 counts them.  A digest
    that stands alone in several cells is removed once, because removals are first made distinct by its check hash.
    """
    for _ in range(rounds):
        alone = (F.abs("c") == 1) & (F.col("cell") >= 0) & (F.xxhash64("k") == F.col("g"))
        entry = lambda cell, own, tag, c, k, g: F.struct(cell.cast("int").alias("cell"), F.lit(own).alias("own"), tag.cast("long").alias("tag"), c.cast("int").alias("c"), k.cast("long").alias("k"), g.cast("long").alias("g"))
        base = F.col("cell") - F.col("cell") % (3 * CELLS)
        itself = entry(F.col("cell"), True, F.lit(0), F.col("c"), F.col("k"), F.col("g"))
        gone = [entry(base + _cell(F.col("g"), t), False, F.col("g"), -F.col("c"), F.col("k"), F.col("g")) for t in range(3)]
        counted = entry(F.lit(-1), False, F.col("g"), F.lit(1), F.lit(0), F.lit(0))
        rows = cells.select(*keys, F.explode(F.when(alone, F.array(itself, *gone, counted)).otherwise(F.array(itself))).alias("x")).select(*keys, "x.*")
        once = rows.groupBy(*keys, "cell", "own", "tag").agg(F.max("c").alias("c"), F.max("k").alias("k"), F.max("g").alias("g"))
        cells = once.groupBy(*keys, "cell").agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("g").alias("g")).where("c <> 0 or k <> 0 or g <> 0")
    return cells.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("cell") == -1, F.col("c"))), F.lit(0)).cast("int").alias("found"), F.count(F.when(F.col("cell") >= 0, 1)).alias("left"))


def _compared(rows: DataFrame, buckets: Column, due: tuple[Column, Column], rounds: int) -> DataFrame:
    """(doc, th, d_edited, d_next): recovered differences of both comparisons of ``rows``, null where peeling stops early."""
    side = lambda kind, sign, ids: F.struct(F.lit(kind).alias("kind"), F.lit(sign).alias("sign"), F.when(due[kind], F.col(ids)).alias("ids"))
    sides = rows.select(*DOC, buckets.alias("buckets"), F.explode(F.array(side(0, 1, "own"), side(0, -1, "after"), side(1, 1, "own"), side(1, -1, "following"))).alias("s"))
    elements = sides.select(*DOC, "buckets", "s.kind", "s.sign", F.explode("s.ids").alias("k"))
    cells = in_cells(elements, [*DOC, "kind"]).where("c <> 0 or k <> 0 or g <> 0")
    ended = peel(cells, [*DOC, "kind"], rounds)
    # no cell at all: nothing differs
    number = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("left") == 0), F.col("found")))
    seen = lambda kind: F.max((F.col("kind") == kind).cast("int"))
    per_doc = ended.groupBy(*DOC).agg(number(0).alias("n0"), number(1).alias("n1"), seen(0).alias("s0"), seen(1).alias("s1"))
    joined = rows.select(*DOC).join(per_doc.hint("merge"), DOC, "left")
    return joined.select(*DOC, *[F.when(F.coalesce(F.col(f"s{kind}"), F.lit(0)) == 0, 0).otherwise(F.col(f"n{kind}")).alias(name) for kind, name in ((0, "d_edited"), (1, "d_next"))])


def order_of(keys: DataFrame) -> DataFrame:
    """(doc, th, copies, need, prev_doc, prev_th, give) of ``keys(doc, th, need)``.

    prev: the key whose next document this is, in descending order and round the end; give: the characters that it needs.
    """
    counted = keys.groupBy(*DOC).agg(F.count(F.lit(1)).cast("int").alias("copies"), F.max("need").alias("need"))
    line = staged(counted.repartitionByRange(F.desc("doc"), F.desc("th")).sortWithinPartitions(F.desc("doc"), F.desc("th")).withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    sizes = line.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("head"))  # a row per partition
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = sizes.agg(F.sum("n")).first()[0] or 1
    ranked = line.withColumn("p", part).join(starts.hint("shuffle_hash"), "p").withColumn("rank", F.col("start") + F.col("at") - F.col("head"))
    previous = ranked.select(F.col("doc").alias("prev_doc"), F.col("th").alias("prev_th"), F.col("need").alias("give"), F.pmod(F.col("rank") + 1, F.lit(total)).alias("rank"))
    return ranked.select(*DOC, "copies", "need", "rank").join(previous.hint("merge"), "rank").drop("rank")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    order = staged(order_of(keyed.select(*DOC, F.floor(F.length("text") / 3).cast("int").alias("need"))), "order")
    once = keyed.join(order.hint("merge"), DOC).dropDuplicates(DOC)
    donors = once.select(F.col("prev_doc").alias("doc"), F.col("prev_th").alias("th"), F.expr("substring(text, 1, give)").alias("head"), digests("text").alias("following"))
    edited = once.select(*DOC, "copies", "need", "text").join(donors.hint("merge"), DOC).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - need)"), F.col("head")))
    digested = staged(edited.select(
        *DOC, "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests("text").alias("own"), digests("edited").alias("after"), "following",
    ), "digests")
    # cells take far more room than the digests that they are made of, so a task gets a bounded number of documents
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), digested.count() // DOCS_A_TASK)
    rows = digested.repartition(tasks, *DOC)

    total = lambda other: F.size("own") + F.size(other)
    yes = F.lit(True)
    found = staged(_compared(rows, F.lit(1), (yes, yes), ROUNDS[0]), "peeled")
    for share, rounds in zip(LARGER, ROUNDS[1:]):
        open_ = rows.join(found.where("d_edited is null or d_next is null").hint("merge"), DOC)
        again = _compared(open_, F.ceil(F.greatest(total("after"), total("following")) / share).cast("int"), (F.col("d_edited").isNull(), F.col("d_next").isNull()), rounds).withColumnsRenamed({"d_edited": "e", "d_next": "n"})
        found = staged(found.join(again.hint("merge"), DOC, "left").select(*DOC, F.coalesce("d_edited", "e").alias("d_edited"), F.coalesce("d_next", "n").alias("d_next")), "peeled")

    sides = rows.select(*DOC, F.lit(1).alias("buckets"), F.lit(1).alias("sign"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("own").alias("ids")), F.struct(F.lit(1).alias("side"), F.col("after").alias("ids")))).alias("s"))
    cells = in_cells(sides.select(*DOC, "buckets", "sign", "s.side", F.explode("s.ids").alias("k")), [*DOC, "side"])
    shown = F.lower(F.concat(F.lpad(F.hex("cell"), 2, "0"), F.lpad(F.hex("c"), 4, "0"), F.lpad(F.hex("k"), 16, "0"), F.lpad(F.hex("g"), 16, "0")))
    listed = lambda side: F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == side, shown))), "")  # noqa: E731  at most 18 cells
    prints = cells.groupBy(*DOC).agg(listed(0).alias("fingerprint"), listed(1).alias("edited_fingerprint"))

    differing = lambda known, other: F.coalesce(F.col(known), F.size(F.array_except("own", other)) + F.size(F.array_except(other, "own")))
    share_of = lambda known, other: F.when(total(other) == 0, 1.0).otherwise((total(other) - differing(known, other)) / (total(other) + differing(known, other)))
    joined = rows.join(found.hint("merge"), DOC).join(prints.hint("merge"), DOC, "left")
    every = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return every.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        share_of("d_edited", "after").alias("near_edited"), share_of("d_next", "following").alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(read_table(spark, sf_dir, "documents"))
