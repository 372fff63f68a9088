"""Corpus bookkeeping: listings, quotas, versions, idempotency, imports and exact duplicates, all as joins, groups and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def quota_usage(chunks: DataFrame, quota: int = 1 << 30) -> DataFrame:
    """Characters of each workspace, and whether they exceed its quota."""
    used = chunks.groupBy("workspace").agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("used_chars"))
    return used.withColumn("over_quota", F.col("used_chars") > quota)


def workspace_counts(workspaces: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of each workspace, 0 for those without; the group comes before the join."""
    counts = documents.groupBy("workspace").agg(F.count("*").alias("n_documents"))
    return workspaces.join(counts, "workspace", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def listing(documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Documents with their workspace's name, ``Unknown`` where it is missing."""
    return documents.join(workspaces, "workspace_id", "left").withColumn("workspace_name", F.coalesce("workspace_name", F.lit("Unknown")))


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n"))


def resume(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records that are not yet done."""
    return records.join(done.select(key), key, "left_anti")


def remapped(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with their document's new id; ``ids`` has document_id and new_document_id."""
    return rows.join(ids, "document_id").drop("document_id").withColumnRenamed("new_document_id", "document_id")


def cache_split(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts with text_hash and whether the cache has them for a model; the anti side is what remains to embed."""
    have = cache.where(F.col("model") == model).select("text_hash", F.lit(True).alias("cached"))
    return texts.withColumn("text_hash", T.source_hash(F.col("content"))).join(have, "text_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def idempotent(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """What to do with each incoming file: ``skipped_duplicate`` if its workspace holds the content, committed by the same parser and model."""
    keys = ["workspace", "file_hash", "parser_version", "embedding_model"]
    have = known.where("status = 'committed'").select(*keys).distinct().withColumn("_known", F.lit(True))
    return incoming.join(have, keys, "left").withColumn("action", F.when(F.col("_known"), "skipped_duplicate").otherwise("process")).drop("_known")


def lineage(documents: DataFrame) -> DataFrame:
    """Version of each document among those of its name, and whether a later one supersedes it."""
    w = Window.partitionBy("workspace", "filename").orderBy("ingested_at", "document_id")
    return documents.select("*", F.row_number().over(w).cast("long").alias("version"), F.lead("document_id").over(w).isNotNull().alias("is_superseded"))


def header_diff(versions: DataFrame) -> DataFrame:
    """Headers added, removed and retained against the version before; ``versions`` has workspace, filename, version and headers."""
    before = F.coalesce(F.lag("headers").over(Window.partitionBy("workspace", "filename").orderBy("version")), F.array().cast("array<string>"))
    rows = versions.withColumn("_before", before)
    return rows.select(
        "workspace",
        "filename",
        "version",
        F.array_sort(F.array_except("headers", "_before")).alias("added"),
        F.array_sort(F.array_except("_before", "headers")).alias("removed"),
        F.array_sort(F.array_intersect("headers", "_before")).alias("retained"),
    )


def exact_dedup(chunks: DataFrame) -> DataFrame:
    """One chunk for each content hash, the least id: a group with partial sums, so a text with many copies is no hot key."""
    return chunks.withColumn("source_hash", T.source_hash(F.col("content"))).groupBy("source_hash").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies"))


def exhibit_siblings(documents: DataFrame) -> DataFrame:
    """Exhibits and attachments of a document: files of its workspace whose name begins with its own.

    Each exhibit's name gives all its prefixes, and the join is by workspace and prefix, so a name may end anywhere in the other.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    d = documents.select("workspace", "document_id", stem.alias("stem"))
    s = d.where(F.lower("stem").rlike("exhibit|attachment")).select("workspace", F.col("document_id").alias("sibling_id"), F.col("stem").alias("sibling"))
    s = s.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.length("sibling")), lambda n: F.substring("sibling", F.lit(1), n))).alias("stem"))
    return d.join(s, ["workspace", "stem"]).where("sibling_id != document_id").select("workspace", "document_id", "sibling_id", "sibling")


#: Orders of listings: columns, ``-`` for descending.
ORDERS = {"chunks": ("chunk_index", "chunk_id"), "lineage": ("version",), "audit": ("-at", "event_id"), "poison": ("-failed_at", "path"), "workspaces": ("workspace",)}


def ordered(rows: DataFrame, listing: str) -> DataFrame:
    """Rows in the order of a kind of listing."""
    return rows.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[listing]])


def report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each document: its chunks, pages, characters, headers in order of first mention, and mean confidence if it has any."""
    first = chunks.groupBy("document_id", "header").agg(F.min("chunk_index").alias("i"))
    headers = first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "header"))), lambda x: x["header"]).alias("headers"))
    sums = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("page").alias("n_pages"), F.sum(F.length("content")).alias("n_chars"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_pages", "n_chars")}
    return documents.join(sums, "document_id", "left").join(headers, "document_id", "left").withColumns({**zero, "headers": F.coalesce("headers", F.array().cast("array<string>"))})


def reprocessed(chunks: DataFrame, document: DataFrame) -> DataFrame:
    """Chunks without those of documents (workspace, file_hash) that are to be made again."""
    return chunks.join(document.select("workspace", "file_hash").distinct(), ["workspace", "file_hash"], "left_anti")
