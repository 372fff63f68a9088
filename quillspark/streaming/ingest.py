"""A watched folder as a stream: each micro-batch parses new files together with those that failed before, three tries at most.

State lives in tables next to the output (pages, ledger, poison), a folder for each batch, so a batch that runs twice after a failure
writes the same folder again. A file's rows in the ledger tell its story: HASHED and then COMMITTED, FAILED or, at the third failure,
QUARANTINED. Pages of a file that was parsed again replace the earlier ones in `current_pages`.

Defined cases: an empty or refused file is quarantined at once, as another try can't help; a file that is gone when it is tried again is left
out; two files of one content are both parsed.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quillspark.operators.governance import WrongToken, token
from quillspark.sources import files as S

TRIES = 3
#: Failed files that go with a batch, at most; the others go with the next one.
RETRIED = 1000
_FILES = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "batch long, workspace string, path string, file_hash string, state string, reason string, tries int, at timestamp"


def workspace() -> Column:
    """The folder right above a file; files of the root belong to ``General``."""
    return F.coalesce(F.nullif(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), F.lit("")), F.lit("General"))


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the ledger; none before the first batch."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{out}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def last_states(rows: DataFrame) -> DataFrame:
    """The last row of each file."""
    latest = F.max_by(F.struct("workspace", "file_hash", "state", "reason", "tries", "batch"), F.struct("batch", F.col("state") != "HASHED"))
    return rows.groupBy("path").agg(latest.alias("l")).select("path", "l.*")


def to_retry(rows: DataFrame) -> DataFrame:
    """Files whose last try failed, with their number of tries."""
    return last_states(rows).where(f"state = 'FAILED' and tries < {TRIES}").select("workspace", "path", "tries")


def quarantined(rows: DataFrame) -> DataFrame:
    """Files that have failed for good, the last first."""
    return last_states(rows).where("state = 'QUARANTINED'").orderBy(F.desc("batch"), "path")


def _load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files that are still there; a missing one would end the read."""
    read = lambda names: spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(names)
    there = []
    for path in paths:
        name = re.sub(r"([\\*?\[\]{}])", r"\\\1", path)  # names may look like patterns
        try:
            read(name)
            there.append(name)
        except AnalysisException:
            continue
    return read(there) if there else spark.createDataFrame([], _FILES)


def ingest_batch(new: DataFrame, out: str, batch_id: int, retry: bool = True) -> None:
    """Parses one batch, once; good pages go to ``pages``, rows for each file to ``ledger``, failures to ``poison``."""
    spark, at = new.sparkSession, f"batch_id={batch_id}"
    before = last_states(ledger(spark, out).where(F.col("batch") != batch_id))
    again = [r["path"] for r in to_retry(ledger(spark, out).where(F.col("batch") != batch_id)).orderBy("path").limit(RETRIED).collect()] if retry else []
    files = new.unionByName(_load(spark, again)).dropDuplicates(["path"])
    files = files.withColumns({"file_hash": F.sha2("content", 256), "reject": S.reject_reason(files), "workspace": workspace()})
    parsed = S.parse(files.where("reject is null")).join(files.select("path", "workspace", "file_hash"), "path")
    parsed.write.mode("overwrite").parquet(f"{out}/_parsed/{at}")  # read twice below
    parsed = spark.read.parquet(f"{out}/_parsed/{at}")
    parsed.where("error is null").drop("error").withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/pages/{at}")
    broken = parsed.where("error is not null").groupBy("path").agg(F.min("error").alias("reason"))
    keys = files.select("path", "workspace", "file_hash", "reject").join(broken, "path", "left").join(before.select("path", "tries"), "path", "left")
    failed, tries = F.coalesce("reject", "reason").isNotNull(), F.coalesce("tries", F.lit(0)) + 1
    state = F.when(~failed, "COMMITTED").when(F.col("reject").isNotNull() | (tries >= TRIES), "QUARANTINED").otherwise("FAILED")
    named = [F.lit(batch_id).cast("long").alias("batch"), "workspace", "path", "file_hash"]
    ends = keys.select(*named, state.alias("state"), F.coalesce("reject", "reason").alias("reason"), tries.alias("tries"), F.current_timestamp().alias("at"))
    begins = keys.select(*named, F.lit("HASHED").alias("state"), F.lit(None).cast("string").alias("reason"), tries.alias("tries"), F.current_timestamp().alias("at"))
    begins.unionByName(ends).write.mode("overwrite").parquet(f"{out}/ledger/{at}")
    poison = spark.read.schema(LEDGER).parquet(f"{out}/ledger/{at}").where("state in ('FAILED', 'QUARANTINED')")
    poison.select("workspace", "path", "file_hash", "reason", F.col("at").alias("failed_at")).write.mode("overwrite").parquet(f"{out}/poison/{at}")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream over ``folder``; with ``once`` it ends when all files at hand are done."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder)
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: ingest_batch(df, out, i))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def retry_failed(spark: SparkSession, out: str) -> int:
    """Tries the failed files again without waiting for new ones; returns how many."""
    paths = [r["path"] for r in to_retry(ledger(spark, out)).orderBy("path").limit(RETRIED).collect()]
    if paths:
        ingest_batch(_load(spark, paths), out, _next(spark, out), retry=False)
    return len(paths)


def replay(spark: SparkSession, out: str, paths: list[str] | None = None) -> int:
    """Parses quarantined files again, all or some; those that succeed leave the quarantine. Returns how many were tried."""
    held = quarantined(ledger(spark, out)).select("path")
    chosen = [r["path"] for r in held.collect() if paths is None or r["path"] in paths]
    if chosen:
        ingest_batch(_load(spark, chosen), out, _next(spark, out), retry=False)
    return len(chosen)


def reparse(spark: SparkSession, out: str, path: str, typed: str) -> None:
    """Parses a committed file again; its new pages replace the old ones. Needs the token ``CONFIRM_REPARSE_<path>``."""
    if typed != token("REPARSE", path):
        raise WrongToken(f"reparse needs {token('REPARSE', path)}")
    ingest_batch(_load(spark, [path]), out, _next(spark, out), retry=False)


def _next(spark: SparkSession, out: str) -> int:
    """A batch number beyond all of the stream's own: batches by hand count from a trillion."""
    last = ledger(spark, out).agg(F.max("batch")).first()[0]
    return max(10**12, (last or 0) + 1)


def current_pages(spark: SparkSession, out: str) -> DataFrame:
    """Pages of each file's last committed batch: what earlier batches left of a file that was parsed again is gone."""
    last = last_states(ledger(spark, out).where("state = 'COMMITTED'")).select("path", "batch")
    return spark.read.parquet(f"{out}/pages").drop("batch_id").join(last, ["path", "batch"])


def reports(rows: DataFrame) -> DataFrame:
    """Files by workspace and last state, newest first within a workspace."""
    return last_states(rows).groupBy("workspace", "state").agg(F.count("*").alias("n"), F.max("batch").alias("last_batch")).orderBy("workspace", F.desc("last_batch"), "state")


def attempts(rows: DataFrame) -> DataFrame:
    """Each file's story in order."""
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("path").orderBy("batch", F.col("state") != "HASHED")))


class Progress(StreamingQueryListener):
    """Counters of a stream, written as JSON after each batch."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)
        self.state = {"batches": 0, "files": 0, "seconds": 0.0, "running": True, "error": None}

    def _save(self) -> None:
        self.path.write_text(json.dumps(self.state))

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self._save()

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        self.state["batches"] += 1
        self.state["files"] += event.progress.numInputRows
        self.state["seconds"] += event.progress.batchDuration / 1000
        self._save()

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        self._save()

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self.state.update(running=False, error=event.exception and event.exception[:200])
        self._save()
