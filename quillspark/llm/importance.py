"""Importance resampling towards a target distribution: documents whose hashed n-grams look like the target's are drawn more likely.

Each bucket of n-grams has a gain, the scaled logarithm of its share in the target over its share in the corpus. A document's weight is the mean of
its n-grams' gains, taken from an array that every task has. A random number of its doc_id (Gumbel) is added, which makes the highest scores a draw without
replacement. Scores are integers, so the draw needs no sort of the corpus: counts by score, summed from the highest down, give the cutoff score and each
score's first rank; within a score, rows are numbered by doc_id. No score holds many rows, as the random part spreads them; still, each is split
into slices of doc_ids, whose counts give each slice its first rank.

Defined cases: a null or empty text has no n-grams and weight 0; a text of any length is read whole; ties in score go to the smaller doc_id, then, among rows
that share one, to any order; a null doc_id is hashed as an empty text and comes after all others of its score; rows that share a doc_id are drawn each
for itself; without documents the result is empty, without target texts all gains are those of an empty target; other columns of the documents aren't
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import bytewords
from quillspark.llm.common import in_batches, stored

WORDS, BUCKETS, SCALE = 2, 10_000, 1000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Ranges of doc_ids that the rows of one score are split into.
SLICES = 64


@dataclass(frozen=True)
class Gains:
    """Integer gain of each bucket, for n-grams of 1 to ``words`` words."""

    values: tuple[int, ...]
    words: int = WORDS


def counts(texts: DataFrame, words: int = WORDS, n_buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """N-grams of a table by bucket. Tasks send one array each; ``n_buckets`` sums reach the driver, however many rows there are."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, part in bytewords.slices(batch.column(0)):
                held += np.bincount(bytewords.gram_buckets(part, words, n_buckets)[0], minlength=n_buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in in_batches(texts.select(text), step, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def fit(corpus: DataFrame, target: DataFrame, words: int = WORDS, n_buckets: int = BUCKETS, text: str = "text") -> Gains:
    """Gains from all texts of both tables, with one n-gram added to each bucket."""
    s, t = counts(corpus, words, n_buckets, text), counts(target, words, n_buckets, text)
    all_s, all_t = float(s.sum()) + n_buckets, float(t.sum()) + n_buckets
    return Gains(tuple(math.floor(SCALE * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t, strict=True)), words)


def weighted(docs: DataFrame, gains: Gains, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the floored mean of its n-grams' gains."""
    values, n = np.array(gains.values, np.int64), gains.words

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in bytewords.slices(batch.column(1)):
                found, row, n_words = bytewords.gram_buckets(part, n, len(values))
                size = np.bincount(row, minlength=len(part))
                total = np.bincount(row, values[found], len(part)).astype(np.int64)  # sums of integers, exact
                weight = total // np.maximum(size, 1)
                ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x.astype(np.int64)) for x in (n_words, size, weight)]], names=["doc_id", "n_words", "n_features", "weight"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), text), step, "doc_id long, n_words long, n_features long, weight long")


def luck(doc_id: Column, seed: int = SEED) -> Column:
    """The scaled Gumbel number of a doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-F.lit(float(SCALE)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank, from 1, to the ``percent`` percent of the rows with ``least_words`` words or more that score highest; null for the others.

    ``scored`` has doc_id, n_words and score, and is read several times, so it should be stored. Counts by score reach the driver: a score is a
    mean of gains plus a Gumbel number of 32 bits, so there are no more than some 100,000, however many rows there are.
    """
    able = F.col("n_words") >= least_words
    low, high, n = scored.where(able).agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    drawn = n * percent // 100
    width = F.lit(max(1, -(-((high or 0) - (low or 0) + 1) // SLICES))).cast("decimal(20,0)")
    ranged = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low or 0)) / width).cast("int")
    # Rows without a doc_id tie wholly: they are dealt out in the order of the stored files, after all others.
    dealt = F.lit(SLICES) + F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)).cast("int")
    rows = stored(scored.withColumn("_slice", F.coalesce(ranged, dealt)), "importance")
    parts = stored(rows.where(able).groupBy("score", "_slice").agg(F.count("*").alias("_n")), "importance-counts")
    first, held = [], 0
    for r in parts.groupBy("score").agg(F.sum("_n").alias("n")).orderBy(F.desc("score")).collect():
        if held >= drawn:
            break
        first.append((r["score"], held))
        held += r["n"]
    spark = scored.sparkSession
    heads = F.broadcast(spark.createDataFrame(first, "score long, _first long"))  # one row a score
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("score").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.join(heads, "score").select("score", "_slice", (F.col("_first") + before).alias("_start"))  # at most twice SLICES rows a score
    cutoff = first[-1][0] if first else None
    high_enough = F.coalesce(able & (F.col("score") >= F.lit(cutoff)), F.lit(False))
    inside = F.row_number().over(Window.partitionBy("score", "_slice").orderBy("doc_id"))
    ranked = rows.where(high_enough).withColumn("_own", inside).join(starts, ["score", "_slice"]).withColumn("rank", F.col("_start") + F.col("_own")).drop("_own", "_start")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(~high_enough).withColumn("rank", F.lit(None).cast("long"))).drop("_slice")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, words: int = WORDS, n_buckets: int = BUCKETS) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank in the draw towards the texts of ``target`` (null: not drawn)."""
    scored = weighted(docs, fit(docs, target, words, n_buckets)).withColumn("score", F.col("weight") + luck(F.col("doc_id"), seed))
    return draw(scored, percent, least_words)
