"""What the operators share: the shared folder, stored intermediate tables, and ranks without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as the contracts define words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch that a Python stage gets at once, at most; texts may be long.
BATCH_ROWS, BATCH_BYTES = "512", str(16 << 20)
#: A key is hot if it holds more than this part of the rows, and more than so many.
HOT, HOT_ROWS = 1000, 1000
_written: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a new folder (tests), and
    a cluster raises: executors would write where nobody else reads."""
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillspark-"))
    return (folder or sc.getCheckpointDir()).rstrip("/")


def clear(spark: SparkSession, frames: Sequence[DataFrame] = ()) -> int:
    """Removes the tables that `stored` has written in this session, but for those that ``frames`` still read; returns how many.

    For callers that have their result: a frame that reads a removed table fails.
    """
    kept = {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}
    gone = [p for p in _written if not any(k == p or k.endswith(p) for k in kept)]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
        _written.remove(path)
    return len(gone)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing.

    The files stay until `clear` is called: the frame returned may be read later, and more than once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, step: Callable, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size, by two Arrow settings of the session; where the caller has set one, it stays."""
    conf = df.sparkSession.conf
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            conf.set(f"spark.sql.execution.arrow.{name}", value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()  # a worker outlives its task

    return df.mapInArrow(run, schema)


def join_hot(rows: DataFrame, side: DataFrame, key: str, spread: str, how: str = "inner", counts: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """``rows.join(side, key, how)`` where any key may hold a large share of ``rows``; ``how`` is inner or left.

    At most `HOT` keys hold more than a `HOT`-th of the rows, so a table of them is broadcast. Their rows are dealt to ``salts`` tasks
    by a hash of ``spread``, and their rows of ``side`` are repeated for each. The keys are counted first, from ``counts`` (key, count) if given.
    """
    counts = rows.groupBy(key).count() if counts is None else counts
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    if (most or 0) <= max(HOT_ROWS, (total or 0) // HOT):
        return rows.join(side, key, how)
    hot = F.broadcast(counts.where((F.col("count") > HOT_ROWS) & (F.col("count") * HOT > total)).select(F.col(key).alias("_key"), F.lit(True).alias("_hot")))
    marked = lambda df: df.join(hot, F.col(key) == F.col("_key"), "left")
    zero = F.lit(0).cast("long")
    dealt = marked(rows).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(zero)).drop("_key", "_hot")
    each = F.explode(F.when(F.col("_hot"), F.sequence(zero, F.lit(salts - 1).cast("long"))).otherwise(F.array(zero)))
    return dealt.join(marked(side).withColumn("_salt", each).drop("_key", "_hot"), [key, "_salt"], how).drop("_salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once in each row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def with_start(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], spread: Sequence[str], name: str, weight: str | None = None, buckets: int = 256
) -> DataFrame:
    """Adds, within each group, the sum of ``weight`` over all rows before this one (its rank from 0 without a weight).

    A group may hold any share of the rows: each is dealt to ``buckets`` parts by a hash of ``spread``; the sums of the parts,
    ``buckets`` rows a group, give each part its start, and a window adds what comes before within the part. The order is by
    part, then ``order``. ``df`` is read twice, the first time only for the columns of ``group``, ``spread`` and ``weight``.
    Group columns must not be null; a column called ``name`` is replaced. Helper columns have names that ``df`` hasn't.
    """
    own, start, total, part = (unused(df, f"_{x}") for x in ("own", "start", "total", "part"))
    w = F.col(weight) if weight else F.lit(1).cast("long")
    keys = [*group, part]
    df = df.drop(name).withColumn(part, F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(w).alias(total)).select(*keys, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(*keys).orderBy(*order)
    here = F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inside) - 1
    return df.withColumn(own, here).join(sums, keys).withColumn(name, (F.col(start) + F.col(own)).cast("long")).drop(own, start, part)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def range_parts(ids: DataFrame, key: str, rows_per_part: int, most_parts: int = 1 << 16) -> list[int]:
    """Ascending boundaries of an integer key, about one for ``rows_per_part`` rows; part i holds keys of boundary i-1 (exclusive) to i (inclusive).

    Counts in steps of equal width give the boundaries, and steps with too many rows are counted again in finer steps, so parts are
    near equal for any spread of the keys. At most ``most_parts`` counts reach the driver at a time; beyond that, parts grow with the
    rows: at 100 TB and the default, one holds about 1.5 GB of text.
    """
    low, high, n = ids.agg(F.min(key), F.max(key), F.count(key)).first()
    parts = max(1, min(most_parts // 4, -(-n // rows_per_part)))
    if parts == 1 or low == high:
        return []
    share = -(-n // parts)
    width = max(1, -(-(high - low + 1) // most_parts))
    step = lambda w: F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(w).cast("decimal(20,0)")).cast("decimal(20,0)")
    counts = {(int(r["s"]), width): r["n"] for r in ids.where(F.col(key).isNotNull()).groupBy(step(width).alias("s")).agg(F.count("*").alias("n")).collect()}
    while width > 1 and (large := [s for (s, w), c in counts.items() if w == width and c > 2 * share]):
        fine = max(1, width // max(2, most_parts // len(large)))
        found = ids.where(F.col(key).isNotNull() & step(width).isin([Decimal(s) for s in large])).groupBy(step(fine).alias("s")).agg(F.count("*").alias("n")).collect()
        for s in large:
            del counts[s, width]
        counts |= {(int(r["s"]), fine): r["n"] for r in found}
        width = fine
    bounds, held = [], 0
    for (s, w), c in sorted(counts.items(), key=lambda x: x[0][0] * x[0][1]):
        if held and held + c > share:
            bounds.append(low + s * w - 1)
            held = 0
        held += c
    return bounds
