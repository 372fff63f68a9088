"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k smallest of the distinct 48-bit hashes of a text's 5-word shingles. Sketches of parts merge to the sketch of the
whole, and two of them estimate resemblance, containment and the number of distinct shingles. Written as text, 8 characters (base64)
a hash.

Defined cases: a null text is empty; texts with fewer than five words have one shingle, all their words; two empty sketches are alike
(1.0), an empty one and another aren't (0.0); rows of one doc_id follow each other in the order of a checksum of their texts; a null
doc_id is the least; a text of any length is read whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import in_batches, range_parts
from quillspark.llm.shingles import shingles
from quillspark.llm.tokens import in_slices

K, WORDS = 128, 5
_ALL = float(1 << 48)


def sketch(texts: Sequence[str | None], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k smallest distinct hashes of each text, ascending."""
    out = []
    for h in shingles(texts, words):
        h = h >> np.uint64(16)
        if len(h) > 4 * k:  # only the lowest are sorted
            some = np.unique(np.partition(h, 2 * k)[: 2 * k])
            h = some if len(some) >= k else h
        out.append(np.unique(h)[:k])
    return out


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    low = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(low), 2), np.uint8), low], 1).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of common hashes among the k smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * _ALL / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has too."""
    j, n, m = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, j * (n + m) / (1 + j) / n) if n else 1.0


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint and the number of distinct shingles of every row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in in_slices(texts):
                own = sketch(texts[part], k, words)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(map(to_text, own), pa.string()), pa.array([distinct(s, k) for s in own])], names=["doc_id", "fingerprint", "n_distinct"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)), step, "doc_id long, fingerprint string, n_distinct double")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint for each key. Each task first reduces its own rows to k hashes a key, so a hot key sends k rows a task."""
    hashes = prints.where(F.col("fingerprint") != "").select(key, F.explode(F.expr("regexp_extract_all(fingerprint, '.{8}', 0)")).alias("_h"))
    hashes = hashes.withColumn("_o", F.hex(F.unbase64("_h")))
    low = hashes.withColumn("_r", F.dense_rank().over(Window.partitionBy(key).orderBy("_o"))).where(F.col("_r") <= k)
    return low.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("_o", "_h"))).alias("_s")).select(key, F.concat_ws("", F.col("_s._h")).alias("fingerprint"))


def _heads(ids: DataFrame, cuts: np.ndarray) -> list[tuple[int, int]]:
    """The greatest key of each range that has rows: a row for each range reaches the driver."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, batch.column(0).to_numpy()).astype(np.int32)), batch.column(0)], names=["part", "_key"])

    rows = in_batches(ids, step, "part int, _key long").groupBy("part").agg(F.max("_key").alias("head")).collect()
    return sorted((r["part"], r["head"]) for r in rows)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of the text whose last half is replaced by the start of the next document's, descending doc_id.

    Rows are dealt to ranges of doc_id and sorted there; a range also gets a copy of the first row of the range that follows, so each
    row meets its next one while the rows stream by. Texts travel once, compressed.
    """
    least = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(least))
    ids = docs.select(key.alias("_key"))
    bounds = range_parts(ids, "_key", 50)
    cuts = np.array(bounds, np.int64)
    heads = _heads(ids, cuts)
    follows = [(heads[i - 1][1], heads[i][0]) for i in range(len(heads))]  # the head of the range below, or of the highest, goes to a range
    table = docs.sparkSession.createDataFrame(follows, "_key long, _to int")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            part = np.searchsorted(cuts, batch.column(0).to_numpy()).astype(np.int32)
            cols = [batch.column(0), pa.array(part), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array([pack(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_key", "_part", "_sum", "z"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: tuple[int, int, str, np.ndarray] | None = None
        for batch in batches:
            parts, ghost, keys, z = (c.to_pylist() for c in batch.columns)
            texts = [unpack(x).decode() for x in z]
            own = [s for part in in_slices(texts) for s in sketch(texts[part], k, words)]
            met: list[tuple[int, str, np.ndarray, str, np.ndarray]] = []
            for p, g, key, text, s in zip(parts, ghost, keys, texts, own, strict=True):
                if held and held[0] == p:
                    met.append((held[1], held[2], held[3], text, s))
                held = None if g else (p, key, text, s)
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in met]
            new = [s for part in in_slices(edited) for s in sketch(edited[part], k, words)]
            rows = [
                (None if key == least else key, len(t), hashlib.sha256(e.encode()).hexdigest(), to_text(s), to_text(n), resemblance(s, n, k), resemblance(s, other, k))
                for (key, t, s, _, other), e, n in zip(met, edited, new, strict=True)
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    rows = in_batches(docs.select(key.alias("_key"), "text"), squeeze, "_key long, _part int, _sum long, z binary").join(F.broadcast(table), "_key", "left")
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("ghost"))
    more = F.struct(F.col("_to").alias("part"), F.lit(True).alias("ghost"))
    dealt = rows.select(F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, more))).alias("p"), "_key", "_sum", "z")
    dealt = dealt.select("p.part", "p.ghost", "_key", "_sum", "z").repartition("part").sortWithinPartitions("part", "ghost", F.desc("_key"), "_sum", "z").drop("_sum")
    return in_batches(dealt, compare, RESULT)
