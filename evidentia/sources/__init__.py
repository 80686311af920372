"""Readers, writers and their checks.  Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import first_reason, sha


def read_cases(spark: SparkSession, paths: str | list[str], schema: T.StructType, id_: str = "test_id") -> DataFrame:
    """JSON-lines case files; an id that repeats is an error."""
    cases = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return refuse_repeats(cases, id_)


def refuse_repeats(df: DataFrame, id_: str) -> DataFrame:
    repeated = repeats(df, id_).limit(5).collect()
    if repeated:
        raise ValueError(f"repeated {id_}: {[r[id_] for r in repeated]}")
    return df


def repeats(df: DataFrame, id_: str) -> DataFrame:
    return df.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Registry CSV ``id,kind,label`` with an enforced header: (accepted, rejected with a reason)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "kind", "label")])
    return split_registry(spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path))


def split_registry(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a missing field, or whose id has two kinds, are rejected."""
    kinds = rows.groupBy("id").agg(F.countDistinct("kind").alias("kinds"))
    blank = F.coalesce(F.trim("id"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("kind"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("label"), F.lit("")).eqNullSafe("")
    judged = rows.join(kinds, "id", "left").withColumn("reason", first_reason((blank, "missing_field"), (F.col("kinds") > 1, "two_kinds"))).drop("kinds")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def ingest_documents(new: DataFrame, existing: DataFrame, digits: int = 16) -> DataFrame:
    """New ``(seq, text)`` with id (the first digits of the content's SHA-256) and decision: insert, duplicate or conflict.

    The first of equal contents is inserted; an id that already has other content is a conflict.
    """
    own = new.withColumn("sha", sha(F.col("text"))).withColumn("document_id", F.substring("sha", 1, digits))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("sha").orderBy("seq")))
    known = existing.select("document_id", F.col("content_sha256").alias("known"))
    j = own.join(known, "document_id", "left")
    return j.select("seq", "document_id", F.when(F.col("known") == F.col("sha"), "duplicate").when(F.col("known").isNotNull(), "conflict").when(F.col("nth") > 1, "duplicate").otherwise("insert").alias("decision"))


def gate_documents(df: DataFrame, media: list[str], longest: int = 2_000_000) -> DataFrame:
    """First reason against ``(id, name, text, media_type)``: name, media type, empty, too long; else accepted."""
    return df.select("id", first_reason((F.coalesce(F.trim("name"), F.lit("")) == "", "name"), (~F.coalesce(F.col("media_type").isin(media), F.lit(False)), "media_type"), (F.coalesce(F.trim("text"), F.lit("")) == "", "empty"), (F.length("text") > longest, "too_long"), otherwise="accepted").alias("reason"))


def slice_passages(texts: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages on form feeds with running offsets; passages ``(doc_id, passage, page, line_start, line_end)`` cut from them, with hashes."""
    pages = texts.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "body"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = pages.withColumn("offset", F.coalesce(F.sum(F.length("body") + 1).over(before), F.lit(0)))
    j = plan.join(placed, ["doc_id", "page"])
    lines = F.slice(F.split("body", "\n"), F.col("line_start") + 1, F.col("line_end") - F.col("line_start"))
    return j.select("doc_id", "passage", "page", F.col("offset").alias("page_offset"), F.array_join(lines, "\n").alias("text")).withColumn("sha", sha(F.col("text")))


def export_project(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str]], project: DataFrame, path: str) -> None:
    """Write each table's rows of the projects; a table in ``parents`` is filtered through ``(parent table, key)``."""
    for name, df in tables.items():
        parent, key = parents.get(name, (None, None))
        keep = tables[parent].join(project, "project_id", "left_semi").select(key).distinct() if parent else None
        (df.join(keep, key, "left_semi") if parent else df.join(project, "project_id", "left_semi")).write.mode("overwrite").parquet(f"{path}/{name}")


def through_parent(child: DataFrame, parent: DataFrame, key: str, project: DataFrame) -> DataFrame:
    return child.join(parent.join(project, "project_id", "left_semi").select(key), key, "left_semi")


def write_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below ``path``, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", f"^.*{path.rstrip('/')}/", "").alias("path"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, checksum_mismatch, missing or unexpected."""
    j = manifest.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    return j.select("path", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("have"), "ok").otherwise("checksum_mismatch").alias("status"))


def import_project(bundle: DataFrame, target: DataFrame, surrogate: str = "audit_id") -> tuple[DataFrame, DataFrame]:
    """(rows re-numbered after the target's largest surrogate id, colliding projects); any collision refuses all."""
    collisions = bundle.select("project_id").distinct().join(target, "project_id", "left_semi")
    if collisions.limit(1).count():
        return bundle.limit(0), collisions
    return renumber(bundle, target, surrogate), collisions


def renumber(bundle: DataFrame, target: DataFrame, surrogate: str) -> DataFrame:
    """New surrogate ids in the old ones' order, by project-wise numbering on top of running project sizes."""
    largest = F.broadcast(target.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("_base")))
    sizes = bundle.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("project_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("project_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy(surrogate))
    return bundle.withColumn("_nth", nth).join(starts, "project_id").crossJoin(largest).withColumn(surrogate, F.col("_base") + F.col("_start") + F.col("_nth")).drop("_nth", "_start", "_base")


def messages(df: DataFrame) -> DataFrame:
    """Rows ``(split, question, answer)`` as chat messages."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.select("split", F.array(turn("user", "question"), turn("assistant", "answer")).alias("messages"))


def export_messages(df: DataFrame, path: str) -> None:
    """:func:`messages` as JSON lines, a folder per split."""
    messages(df).write.mode("overwrite").partitionBy("split").json(path)


def events_after(df: DataFrame, after: int, n: int, id_: str = "event_id") -> DataFrame:
    """Keyset page: the next ``n`` rows after an id."""
    return df.where(F.col(id_) > after).orderBy(id_).limit(n)


def validate_labels(df: DataFrame, note: int = 500) -> DataFrame:
    """First violation of labels ``(passage_id, source_text, source_sha256, note, provenance)``; none is null."""
    times = F.count(F.lit(1)).over(Window.partitionBy("passage_id"))
    return df.withColumn("times", times).select("passage_id", first_reason((F.col("times") > 1, "repeated_id"), (F.coalesce(F.trim("source_text"), F.lit("")) == "", "empty_source"), (F.col("source_sha256") != sha(F.col("source_text")), "hash"), (F.length("note") > note, "note"), (F.coalesce(F.trim("provenance"), F.lit("")) == "", "provenance")).alias("violation"))


