"""Cartridges: a corpus of documents and embedded chunks in a folder, with a manifest that names the model; built by Spark, searched by BM25 and cosine.

`documents` has doc_id, title, jurisdiction, source_table and any others; `chunks` has chunk_id, doc_id, chunk_index, filename, header, locator,
heading_path, content, citation, char_start, char_end, embedding. `write` also makes a lexical index (stems, three fields), from which `find` takes its candidates; a
cartridge without one is searched by a scan of its texts. Defined cases: rows of a key that the cartridge has already replace it; a
query without a lexical hit falls back to a scan of the first chunks; equal scores go by chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import CartridgeError
from quillspark.functions import text as T
from quillspark.functions.vectors import cosine
from quillspark.operators import chunker, embedding, postings, search

# Pool of lexical candidates, weight of their rank, and least lengths of source texts.
POOL, BONUS, CASE_CHARS, CODE_CHARS = 300, 0.05, 50, 30
MANIFEST = "embed_model string, dimension int, n_documents long, n_chunks long"


@dataclass(frozen=True)
class Cartridge:
    documents: DataFrame
    chunks: DataFrame
    embed_model: str
    dimension: int
    n_documents: int
    n_chunks: int
    index: postings.Index | None = None


def _index(spark: SparkSession, path: str) -> postings.Index:
    return postings.Index(spark, f"{path}/index", parts=1)  # built once, as a whole


def write(documents: DataFrame, chunks: DataFrame, path: str, embed_model: str, dimension: int) -> None:
    """Writes a new cartridge. The manifest comes last, so a broken build has none and doesn't open."""
    spark = documents.sparkSession
    documents.write.mode("errorifexists").parquet(f"{path}/documents")
    chunks.write.mode("errorifexists").parquet(f"{path}/chunks")
    _index(spark, path).put(spark.read.parquet(f"{path}/chunks").select("doc_id", "chunk_id", *postings.FIELDS))
    n, m = (spark.read.parquet(f"{path}/{t}").count() for t in ("documents", "chunks"))
    spark.createDataFrame([(embed_model, dimension, n, m)], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new``; those of a key that both have are the new ones."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def open_cartridge(spark: SparkSession, path: str, embed_model: str | None = None) -> Cartridge:
    """A cartridge whose counts match its manifest and, where given, whose model is ``embed_model``."""
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
        documents, chunks = (spark.read.parquet(f"{path}/{t}") for t in ("documents", "chunks"))
    except Exception as e:  # noqa: BLE001 - Spark raises several kinds for a missing folder
        raise CartridgeError(f"no cartridge at {path}") from e
    if manifest is None or (manifest["n_documents"], manifest["n_chunks"]) != (documents.count(), chunks.count()):
        raise CartridgeError(f"the cartridge at {path} is incomplete")
    if embed_model is not None and embed_model != manifest["embed_model"]:
        raise CartridgeError(f"the cartridge was made with {manifest['embed_model']}, not {embed_model}")
    index = _index(spark, path)
    return Cartridge(documents, chunks, **manifest.asDict(), index=index if index.store.version().number else None)


def bundle(cartridge: Cartridge, path: str) -> None:
    """The cartridge as JSON lines, a folder a table, vectors included."""
    for name, df in (("documents", cartridge.documents), ("chunks", cartridge.chunks)):
        df.write.mode("errorifexists").json(f"{path}/{name}")



def find(cartridge: Cartridge, query: str, vector: Sequence[float], jurisdiction: str | None = None, source_table: str | None = None, limit: int = 10, pool: int = POOL, terms: Sequence[str] | None = None) -> DataFrame:
    """Chunks for a query with score (cosine) and sort_score (with the bonus of the lexical rank), best first.

    ``terms`` are those of `T.match_terms` unless given.
    """
    spark = cartridge.chunks.sparkSession
    embedding.check_dimension(len(vector), cartridge.dimension)
    docs = cartridge.documents.select("doc_id", "title", "jurisdiction", "source_table")
    if jurisdiction:
        docs = docs.where(F.col("jurisdiction").ilike(f"%{jurisdiction}%"))
    if source_table:
        docs = docs.where(F.col("source_table") == source_table)
    rows = cartridge.chunks.join(docs, "doc_id")
    if terms is None:
        terms = spark.createDataFrame([(query,)], "q string").select(T.match_terms(F.col("q"))).first()[0]
    if terms and cartridge.index is not None:
        within = rows.select("chunk_id") if jurisdiction or source_table else None
        best = cartridge.index.bm25([(0, terms)], pool, within).drop("query_id")
    else:
        full = rows.select("chunk_id", F.concat_ws(" ", "citation", F.concat_ws(" ", "heading_path"), "content").alias("content"))
        best = search.bm25_topk(full, terms, pool) if terms else None
    q = F.array(*[F.lit(float(x)) for x in vector])
    near = F.coalesce(cosine(F.col("embedding"), q), F.lit(0.0))
    if best is not None and not best.isEmpty():
        hits = rows.join(F.broadcast(best), "chunk_id").withColumn("_r", F.col("bm25_rank") - 1)  # at most `pool` rows
        hits = hits.withColumn("_s", near).withColumn("sort_score", F.round(F.col("_s") + BONUS * search.RRF_K / (search.RRF_K + F.col("_r")), 6))
        order = [F.desc("sort_score"), F.desc("_s"), "_r", "chunk_id"]
    else:
        hits = rows.orderBy("chunk_id").limit(pool).withColumn("_s", near).withColumns({"sort_score": F.round("_s", 6), "_r": F.lit(0)})
        order = [F.desc("_s"), "chunk_id"]
    return hits.orderBy(*order).limit(limit).select("chunk_id", "doc_id", "chunk_index", "citation", "title", "heading_path", "locator", "content", "jurisdiction", "source_table", "char_start", "char_end", F.round("_s", 4).alias("score"), "sort_score")


def cases(rows: DataFrame) -> DataFrame:
    """Decisions that have a text: rows with opinion_text of more than 50 characters, as ``text``."""
    return rows.where(F.length("opinion_text") > CASE_CHARS).withColumnRenamed("opinion_text", "text")


def codes(rows: DataFrame, data_type: str) -> DataFrame:
    """Provisions of a kind: rows of a data_type with content of more than 30 characters, as ``text``."""
    return rows.where((F.col("data_type") == data_type) & (F.length("content") > CODE_CHARS)).withColumnRenamed("content", "text")


def key_ranges(counts: Callable[[int, int, int], Sequence[tuple[int, int]]], low: int, high: int, parts: int, steps: int = 4096) -> list[tuple[int, int]]:
    """About ``parts`` ranges (from, to; both included) of an integer key with near equal numbers of rows.

    ``counts(low, high, width)`` gives (step, rows) of the steps of ``width`` keys from ``low`` to ``high``. A step with more rows than a range should have is
    counted again in finer steps, until it has one key. At most ``steps`` counts come at a time.
    """
    width = max(1, -(-(high - low + 1) // steps))
    found = [(low + s * width, min(low + (s + 1) * width - 1, high), n) for s, n in sorted(counts(low, high, width))]
    share = max(1, -(-sum(n for *_, n in found) // parts))
    while any(n > share and b > a for a, b, n in found):
        finer = []
        for a, b, n in found:
            if n > share and b > a:
                w = max(1, -(-(b - a + 1) // steps))
                finer += [(a + s * w, min(a + (s + 1) * w - 1, b), m) for s, m in sorted(counts(a, b, w))]
            else:
                finer.append((a, b, n))
        found = finer
    out, held = [[low, low]], 0
    for a, b, n in found:
        if held and held + n > share:
            out.append([a, b])
            held = 0
        out[-1][1] = b
        held += n
    return [(a, next_[0] - 1 if next_ else high) for (a, _), next_ in zip(out, [*out[1:], None], strict=True)]


def read_sql(spark: SparkSession, url: str, table: str, key: str, parts: int, where: str = "", **options: str) -> DataFrame:
    """A table of a database in about ``parts`` ranges of an integer key, near equal in rows however the keys are spread; rows without a key are in the first.

    The database counts the rows for the ranges; filters on the result, and ``where``, go to it.
    """
    reader = lambda: spark.read.format("jdbc").options(url=url, fetchsize="1000", **options)
    rows = f"{table} t WHERE {where}" if where else f"{table} t WHERE 1 = 1"
    ask = lambda sql: reader().option("query", sql).load().collect()  # noqa: E731 - at most a row for each of the steps
    low, high = ask(f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {rows}")[0]
    whole = f"(SELECT * FROM {rows}) t"
    if low is None or parts < 2:
        return reader().option("dbtable", whole).load()

    def counts(a: int, b: int, width: int) -> list[tuple[int, int]]:
        step = f"({key} - ({a})) / {width}"  # of integers, so an integer
        found = ask(f"SELECT s, COUNT(*) AS n FROM (SELECT {step} AS s FROM {rows} AND {key} BETWEEN {a} AND {b}) x GROUP BY s")
        return [(int(r[0]), int(r[1])) for r in found]

    ranges = key_ranges(counts, int(low), int(high), parts)
    predicates = [f"{key} BETWEEN {a} AND {b}" + (f" OR {key} IS NULL" if i == 0 else "") for i, (a, b) in enumerate(ranges)]
    return spark.read.jdbc(url, whole, predicates=predicates, properties={"fetchsize": "1000", **options})


def forge(rows: DataFrame, done: DataFrame | None = None, backend: str = "deterministic", dimension: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Documents and embedded chunks of source rows (record_id, title, jurisdiction, source_table, text), without those that ``done`` (record_id) has.

    Ids are 31 bits of a hash of source and record; chunks are numbered within their document.
    """
    if done is not None:
        rows = rows.join(done.select("record_id"), "record_id", "left_anti")
    doc_id = T.short_id(F.concat_ws(":", "source_table", F.col("record_id").cast("string")))
    docs = rows.withColumn("doc_id", doc_id)
    pages = docs.select("doc_id", F.col("title").alias("filename"), F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("text").alias("text"))).alias("pages"))
    made = chunker.chunk_documents(pages)
    told = T.contextual(F.col("content"), F.col("filename"), F.col("heading_path"), F.col("header"))
    chunk_id = F.xxhash64("doc_id", "chunk_index")
    chunks = made.select("*", chunk_id.alias("chunk_id"), embedding.embed(told, backend, dimension).alias("embedding"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    documents = docs.drop("text").join(counts, "doc_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0).cast("long")))
    return documents, chunks
