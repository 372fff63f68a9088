"""From a watched folder to searchable chunks, as a stream with a state for each file.

Events by file (seen in the folder, how a try ended, asked for again) go to a keyed state of Spark's state store: which try is next, and a timer for it. What the
state lets out are tries, and each micro-batch works them off, `FILES` at a time: load, check, parse, chunk, embed, commit. So a batch costs what its own files cost,
however long the history is: state is kept for files that aren't done, the ledger is only appended to, and chunks of new files are added to a `versions.Store`
in one commit with their document; files asked for again replace their own. Two things grow slowly: the look-up of vectors reads the column of hashes of its buckets, and
folders and manifests gather until `Store.compact`, `Store.vacuum` and `compact_vectors` are called, between batches.

Below ``out``: ``store`` (documents, chunks), ``vectors`` (text_hash, embedding, by model), ``ledger``, ``outcomes`` (which the stream reads back), ``requests``, and ``metrics``.

A file's rows in the ledger tell its story: DETECTED, STAGED, HASHED, PARSED, CHUNKED, EMBEDDED, COMMITTED and ARCHIVED, or where it failed FAILED, and QUARANTINED once
no try is left. A batch that runs twice after a crash writes the same folders again, and its commits count once.

Defined cases: Spark's file source passes over an empty file; a refused file, or one that is gone, is quarantined at once; a file that fails otherwise is tried `TRIES` times, each after twice the time of the one before; two
files of one content are both documents, but their texts are embedded once; a file without text is a document without chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quillspark.functions import text as T
from quillspark.operators import chunker, embedding, versions
from quillspark.sources import files as S
from quillspark.streaming.ingest import workspace

STATES = ("DETECTED", "STAGED", "HASHED", "PARSED", "CHUNKED", "EMBEDDED", "COMMITTED", "ARCHIVED", "FAILED", "QUARANTINED")
TRIES, BACKOFF_SECONDS = 3, 2.0
#: Pages that a file may have (a fixed value).
PAGES = 500
#: Files that are worked on together, and that a micro-batch takes from the folder.
FILES = 1000
EVENTS = "path string, event string, tries int"
WORK = "path string, tries int, again boolean"
LEDGER = "batch long, workspace string, path string, file_hash string, state string, step int, reason string, tries int, at timestamp"
VECTORS = "text_hash string, embedding array<float>, bucket string"
_FILES = "path string, modificationTime timestamp, length long, content binary"


class Attempts(StatefulProcessor):
    """The next try of each file: at once when it is seen or asked for, later when the last one failed, none when it is done or refused."""

    def __init__(self, tries: int, backoff: float) -> None:
        self.tries, self.backoff = tries, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "tries int, again boolean")

    def _drop(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted(((r.event, int(r.tries)) for df in rows for r in df.itertuples()), key=lambda e: e[0] in ("seen", "asked"))  # outcomes are of tries before
        work = None
        for event, tries in events:
            if event in ("seen", "asked"):
                self._drop()
                self.state.update((1, event == "asked"))
                work = (1, event == "asked")
            elif not self.state.exists() or tries != self.state.get()[0]:
                continue  # of a try that was given up
            elif event == "failed" and tries < self.tries:
                again = self.state.get()[1]
                self.state.update((tries + 1, again))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1 + int(1000 * self.backoff * 2 ** (tries - 1)))
            else:
                self._drop()
        yield _work(key[0], *work) if work else _work()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield _work(key[0], *self.state.get()) if self.state.exists() else _work()

    def close(self) -> None:
        pass


def _work(*row: object) -> pd.DataFrame:
    return pd.DataFrame([row] if row else [], columns=["path", "tries", "again"]).astype({"tries": "int32", "again": "bool"})


@dataclass(frozen=True)
class Folder:
    """Where a stream's results are, how its texts are embedded, and what it refuses: files of more than ``most_pages`` pages, and files that with the characters
    that their workspace holds would exceed ``quota``."""

    out: str
    backend: str = "deterministic"
    dimension: int = 1024
    parts: int = 16
    tries: int = TRIES
    backoff: float = BACKOFF_SECONDS
    most_pages: int = PAGES
    quota: int | None = None

    def store(self, spark: SparkSession) -> versions.Store:
        return versions.Store(spark, f"{self.out}/store", "doc_id", self.parts)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the ledger; none before the first batch."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{out}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def last_states(rows: DataFrame) -> DataFrame:
    """The last row of each file."""
    return rows.groupBy("path").agg(F.max_by(F.struct("workspace", "file_hash", "state", "reason", "tries", "batch"), F.struct("batch", "tries", "step")).alias("l")).select("path", "l.*")


def _exists(spark: SparkSession, paths: list[str]) -> list[bool]:
    """Which files are there, asked sixteen at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001

    def there(path: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf).exists(where)

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(there, paths))


def _load(spark: SparkSession, work: DataFrame) -> DataFrame:
    """``work`` with the files' content; null where a file is gone."""
    paths = [r["path"] for r in work.select("path").collect()]  # about `FILES`
    there = [p for p, found in zip(paths, _exists(spark, paths), strict=True) if found]
    plain = [p if not any(c in p for c in "\\*?[]{}") else "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in p) for p in there]  # names may look like patterns
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(plain) if plain else spark.createDataFrame([], _FILES)
    return work.join(files, "path", "left")


def with_vectors(chunks: DataFrame, folder: Folder, mark: str) -> DataFrame:
    """Chunks with their embedding: from the table of vectors, or made, once for each distinct text, and put there under ``mark``.

    The table is split by the first digit of the text's hash and by mark, and holds each model apart; `compact_vectors` joins the marks.
    """
    spark = chunks.sparkSession
    path = vectors_path(spark, folder)
    told = chunks.withColumn("_told", T.contextual(F.col("content"), F.col("filename"), F.col("heading_path"), F.col("header")))
    told = told.withColumn("text_hash", T.source_hash(F.col("_told"))).withColumn("bucket", F.substring("text_hash", 1, 1))
    new = f"{path}/mark={mark}"
    wanted = told.select("text_hash", "bucket", "_told").dropDuplicates(["text_hash"])
    known = _vectors(spark, path).where(F.col("mark") != mark)
    missing = wanted.join(known.select("text_hash"), "text_hash", "left_anti")
    missing.select("text_hash", embedding.embed(F.col("_told"), folder.backend, folder.dimension).alias("embedding"), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(new)
    # Two batches can't have embedded one text, but two streams over one table can: one vector of each text is enough.
    have = _vectors(spark, path).join(wanted.select("text_hash", "bucket"), ["text_hash", "bucket"], "left_semi").dropDuplicates(["text_hash"])
    return told.drop("_told", "bucket").join(have.select("text_hash", "embedding"), "text_hash", "left").drop("text_hash")


def vectors_path(spark: SparkSession, folder: Folder) -> str:
    checksum = spark.range(1).select(T.model_checksum(F.lit(folder.backend), F.lit("stream"), F.lit(folder.dimension))).first()[0]
    return f"{folder.out}/vectors/{checksum.replace(':', '-')}"


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{VECTORS}, mark string").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{VECTORS}, mark string")


def compact_vectors(spark: SparkSession, folder: Folder, mark: str) -> None:
    """Joins all marks of the table of vectors into one new mark. No stream may be at work."""
    path = vectors_path(spark, folder)
    old = _vectors(spark, path)
    gone = [r["mark"] for r in old.select("mark").distinct().collect() if r["mark"] != mark]  # a row for a commit since the last time
    old.dropDuplicates(["text_hash"]).drop("mark").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/mark={mark}")
    for name in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/mark={name}")  # noqa: SLF001
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def _documents(pages: DataFrame, files: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("_o"), F.col("n").alias("_n"), "page", "text")))
    grouped = pages.groupBy("path").agg(F.transform(parts, lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"))).alias("pages"))
    return files.select("path", "workspace", "file_hash").join(grouped, "path").withColumns({"doc_id": F.xxhash64("path"), "filename": F.regexp_extract("path", r"([^/]*)$", 1)})


def work_off(work: DataFrame, folder: Folder, batch: int, slice_: int = 0) -> None:
    """One try of each file of ``work`` (path, tries, again): `FILES` or so."""
    spark, at = work.sparkSession, f"batch={batch}-{slice_}"
    scratch = f"{folder.out}/_work/{at}"
    files = _load(spark, work).withColumns({"file_hash": F.sha2("content", 256), "workspace": workspace()})
    gone = F.col("content").isNull()
    files = files.withColumn("reject", F.when(gone, "file is gone").otherwise(S.reject_reason(files)))
    if folder.quota is not None:  # what was committed before this batch; a row a document is read
        files = files.join(usage(spark, folder).withColumnRenamed("used", "_used"), "workspace", "left")
        over = F.coalesce("_used", F.lit(0)) + F.col("length") > folder.quota
        files = files.withColumn("reject", F.coalesce("reject", F.when(over, "quota of the workspace"))).drop("_used")
    pages = S.parse(files.where("reject is null")).withColumn("n", F.monotonically_increasing_id())
    pages.write.mode("overwrite").parquet(f"{scratch}/pages")
    files.drop("content").write.mode("overwrite").parquet(f"{scratch}/files")
    pages, files = (spark.read.parquet(f"{scratch}/{t}") for t in ("pages", "files"))
    broken = pages.where("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    long = pages.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") > folder.most_pages).select("path", F.lit("too many pages").alias("_long"))
    files = files.join(long, "path", "left").withColumn("reject", F.coalesce("reject", "_long")).drop("_long")
    ends = files.join(broken, "path", "left").withColumn("reason", F.coalesce("reject", "error"))
    docs = _documents(pages.join(ends.where("reason is not null"), "path", "left_anti"), files)
    chunks = chunker.chunk_documents(docs).join(docs.select("doc_id", "path", "workspace"), "doc_id")
    own = {"chunk_id": F.xxhash64("path", "chunk_index"), "doc_type": F.lit("general"), "is_superseded": F.lit(False), "ingested_at": F.lit(pd.Timestamp.now("UTC").tz_localize(None))}
    with_vectors(chunks.withColumns(own), folder, f"{batch}-{slice_}").write.mode("overwrite").parquet(f"{scratch}/chunks")
    made = spark.read.parquet(f"{scratch}/chunks")
    counts = made.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))
    docs = docs.withColumn("n_pages", F.size("pages")).drop("pages").join(counts, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_chunks", "n_chars")})
    docs.write.mode("overwrite").parquet(f"{scratch}/documents")
    _commit(spark, folder, spark.read.parquet(f"{scratch}/documents"), made, files.where("again").select(F.xxhash64("path").alias("doc_id")), batch, slice_)
    _record(spark, folder, ends, batch, slice_, at)


def _commit(spark: SparkSession, folder: Folder, docs: DataFrame, chunks: DataFrame, again: DataFrame, batch: int, slice_: int) -> None:
    """Adds new documents with their chunks, then replaces those that were asked for again."""
    store = folder.store(spark)
    new = lambda df: df.join(again, "doc_id", "left_anti")
    old = lambda df: df.join(again, "doc_id", "left_semi")
    store.add({"documents": new(docs), "chunks": new(chunks)}, "stream", batch * FILES + slice_)
    if not old(docs).isEmpty():
        store.replace({"documents": old(docs), "chunks": old(chunks)}, old(docs).select("doc_id"))


def _record(spark: SparkSession, folder: Folder, ends: DataFrame, batch: int, slice_: int, at: str) -> None:
    """Outcomes for the state, their counts for the metrics, and rows for the ledger: once the ledger tells of a try, the totals hold it."""
    refused, failed = F.col("reject").isNotNull(), F.col("reason").isNotNull()
    steps = lambda *names: F.array(*[F.lit(n) for n in names])
    last = F.when(refused | (F.col("tries") >= folder.tries), steps("FAILED", "QUARANTINED")).otherwise(steps("FAILED"))
    story = F.when(F.col("reject") == "file is gone", F.concat(steps("DETECTED"), last)).when(refused, F.concat(steps(*STATES[:3]), last)).when(failed, F.concat(steps(*STATES[:3]), last)).otherwise(steps(*STATES[:8]))
    rows = ends.withColumn("_s", story).select(F.lit(batch).cast("long").alias("batch"), "workspace", "path", "file_hash", F.posexplode("_s").alias("step", "state"), "reason", "tries", F.current_timestamp().alias("at"))
    rows = rows.withColumn("reason", F.when(F.col("state").isin("FAILED", "QUARANTINED"), F.col("reason")))
    seen = Observation(f"ingest-{at}")
    count = lambda name, condition: F.count(F.when(condition, 1)).alias(name)
    counted = ends.observe(seen, count("processed", ~failed), count("failed", failed), count("quarantined", failed & (F.array_size(last) == 2)), count("retries", F.col("tries") > 1))
    event = F.when(~failed, "done").when(refused, "refused").otherwise("failed")
    counted.select("path", event.alias("event"), "tries").write.mode("overwrite").parquet(f"{folder.out}/outcomes/{at}")
    _add_metrics(spark, folder.out, f"{batch:012d}-{slice_:06d}", seen.get)
    rows.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.mode("overwrite").parquet(f"{folder.out}/ledger/{at}")


# Metrics -----------------------------------------------------------------------------------------------------------------------------


@dataclass
class Metrics:
    """Totals since the first batch, and two gauges."""

    processed: int = 0
    failed: int = 0
    quarantined: int = 0
    retries: int = 0
    queue_depth: int = 0

    @property
    def active_retries(self) -> int:
        """Files that failed and will be tried again: each failure that wasn't the last, less the retries there were."""
        return self.failed - self.quarantined - self.retries


def _path(spark: SparkSession, name: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)  # noqa: SLF001
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where  # noqa: SLF001


def _add_metrics(spark: SparkSession, out: str, name: str, counts: dict[str, int]) -> None:
    """Writes the totals after a slice of a batch: those before it, whose name is less, and its own. A slice that runs again writes the same."""
    before = metrics(spark, out, name)
    now = {k: getattr(before, k) + int(counts[k] or 0) for k in ("processed", "failed", "quarantined", "retries")}
    fs, where = _path(spark, f"{out}/metrics/{name}.json")
    stream = fs.create(where, True)
    stream.write(bytearray(json.dumps(now).encode()))
    stream.close()
    names = sorted(s.getPath().getName() for s in fs.listStatus(where.getParent()))
    for old in names[:-2]:  # the one before stays for a slice that runs again
        fs.delete(_path(spark, f"{out}/metrics/{old}")[1], False)


def metrics(spark: SparkSession, out: str, before: str | None = None) -> Metrics:
    """The newest totals, or those before a slice."""
    fs, where = _path(spark, f"{out}/metrics")
    names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
    names = [n for n in names if before is None or n < f"{before}.json"]
    if not names:
        return Metrics()
    stream = fs.open(_path(spark, f"{out}/metrics/{names[-1]}")[1])
    try:
        return Metrics(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))  # noqa: SLF001
    finally:
        stream.close()


NAMES = (
    ("files_processed_total", "counter", "Files that became documents", "processed"),
    ("files_failed_total", "counter", "Tries that failed", "failed"),
    ("files_quarantined_total", "counter", "Files that are not tried again", "quarantined"),
    ("retry_attempts_total", "counter", "Tries after the first", "retries"),
    ("queue_depth", "gauge", "Files in the folder that no batch has taken", "queue_depth"),
    ("active_retries", "gauge", "Files that wait for another try", "active_retries"),
)


def prometheus(values: Metrics, prefix: str = "quillspark_ingest") -> str:
    """Metrics in Prometheus' text format."""
    return "".join(f"# HELP {prefix}_{n} {told}\n# TYPE {prefix}_{n} {kind}\n{prefix}_{n} {getattr(values, field)}\n" for n, kind, told, field in NAMES)


class Queue(StreamingQueryListener):
    """Keeps how many files the folder holds that no batch has taken."""

    depth = 0

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self.depth = 0

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        found = [s.metrics.get("numFilesOutstanding") for s in event.progress.sources if "outcomes" not in s.description and "requests" not in s.description]
        self.depth = sum(int(n) for n in found if n)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        self.depth = 0

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self.depth = 0

    def metrics(self, spark: SparkSession, out: str) -> Metrics:
        return Metrics(**{**asdict(metrics(spark, out)), "queue_depth": self.depth})


# The stream --------------------------------------------------------------------------------------------------------------------------


def run_batch(work: DataFrame, batch: int, folder: Folder) -> None:
    """All tries of a micro-batch, about `FILES` at a time."""
    spark = work.sparkSession
    path = f"{folder.out}/_work/batch={batch}/work"
    work.write.mode("overwrite").parquet(path)  # the state is asked once
    rows = spark.read.schema(WORK).parquet(path)
    slices = -(-rows.count() // FILES)
    for i in range(slices):
        work_off(rows.where(F.pmod(F.xxhash64("path"), F.lit(slices)) == i), folder, batch, i)
    fs, where = _path(spark, f"{folder.out}/_work")
    for status in fs.listStatus(where):
        fs.delete(status.getPath(), True)


def events(spark: SparkSession, watched: str, out: str) -> DataFrame:
    """The stream of events: files seen, outcomes, and requests. Contents aren't read."""
    for name in ("outcomes", "requests"):
        fs, where = _path(spark, f"{out}/{name}")
        fs.mkdirs(where)
    seen = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES).load(watched)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    seen = seen.where(~name.startswith(".") & ~name.rlike(r"(?i)\.(part|lock|tmp)$")).select("path", F.lit("seen").alias("event"), F.lit(0).alias("tries"))
    told = [spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{out}/{n}") for n in ("outcomes", "requests")]
    return seen.unionByName(told[0]).unionByName(told[1])


def watch(spark: SparkSession, watched: str, folder: Folder, checkpoint: str, once: bool = False, seconds: int = 2) -> StreamingQuery:
    """Starts the stream over ``watched``; with ``once`` it ends when what is at hand is done, and tries that are due later wait for the next start."""
    conf = {  # a query keeps what it was started with
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",  # timers need it
        "spark.sql.streaming.noDataMicroBatches.enabled": str(not once).lower(),  # timers run in batches without data, of which there is no last one
    }
    before = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        work = events(spark, watched, folder.out).groupBy("path").transformWithStateInPandas(Attempts(folder.tries, folder.backoff), WORK, "Append", "ProcessingTime")
        writer = work.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: run_batch(df, i, folder))
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def ask_again(paths: DataFrame, out: str) -> None:
    """Requests another round of tries for files (path), quarantined or done; the stream takes them with its next batch."""
    paths.select("path", F.lit("asked").alias("event"), F.lit(0).alias("tries")).write.mode("append").parquet(f"{out}/requests")


def quarantined(rows: DataFrame) -> DataFrame:
    """Files that are not tried again."""
    return last_states(rows).where("state = 'QUARANTINED'")


def chunks(spark: SparkSession, folder: Folder) -> DataFrame:
    """The chunks of the newest version, as `search` takes them."""
    return folder.store(spark).read("chunks")


def usage(spark: SparkSession, folder: Folder) -> DataFrame:
    """(workspace, used): characters of each workspace's chunks."""
    rows = folder.store(spark).read("documents", None, "workspace string, n_chars long")
    return rows.groupBy("workspace").agg(F.sum("n_chars").alias("used"))


def documents(spark: SparkSession, folder: Folder) -> DataFrame:
    return folder.store(spark).read("documents")


