"""Packing into fixed-length sequences: shortest pack first over the length histogram.

`pieces` encodes every text and cuts it into pieces of at most ``size`` ids. `plan` works on the histogram of piece lengths alone
(at most ``size`` counts, whatever the corpus): lengths go longest first into the open pack with the most room, whole counts at a
time, which gives a few thousand packing patterns. `pack` then joins the patterns back to the pieces by their rank among pieces of
the same length.

Defined cases: a null or empty text gives one piece, the end id; a text of more ids than a sequence is cut into as many pieces as it takes;
pieces of one length go by doc_id and start, so ties are repeated rows, which are packed each on their own; an empty table gives no
pieces; other columns of the pieces are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_batches, stored, with_start
from quillspark.llm.tokens import BYTE_BPE, column_slices, encoder, id_bytes

SIZE = 1024
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """One row for each piece; ``ids`` holds little-endian unsigned 32-bit integers. Written to the shared folder, as it is read
    for the histogram and again for the placement."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in column_slices(batch.column(1)):
                some = batch.slice(part.start, part.stop - part.start)
                ids, at = enc.encode(some.column(1))
                ids = np.insert(ids.astype("<u4"), at[1:], end_id)
                at = at + np.arange(len(at))  # with an end id for each text
                n = np.diff(at)
                many = -(-n // size)
                doc = np.repeat(np.arange(len(n)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * size
                length = np.minimum(size, n[doc] - start)
                cols = [some.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), id_bytes(ids, np.append(0, np.cumsum(length)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    key = F.col("doc_id").cast("long").alias("doc_id")
    return stored(in_batches(docs.select(key, "text"), cut, PIECES), "pieces")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns as (how many sequences, their lengths in order). Shortest pack first: a length goes to the open pack with most room.

    A placement either uses up a pattern or ends a length, and only the latter splits one, so there are at most twice as many
    patterns as lengths.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    spaces: list[int] = []

    def put(space: int, count: int, lengths: list[int]) -> None:
        if space not in room:
            room[space] = []
            heapq.heappush(spaces, -space)
        room[space].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not spaces or -spaces[0] < length:
                put(size - length, left, [length])
                break
            space = -spaces[0]
            count, lengths = room[space].pop()
            if not room[space]:
                del room[space]
                heapq.heappop(spaces)
            used = min(count, left)
            if count > used:
                put(space, count - used, lengths)
            # a pack that is empty enough takes the same length again at once, as long as enough of them are left
            put(space - length, used, [*lengths, length])
            left -= used
    return [p for some in room.values() for p in some]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, repeats): which ranks of a length a pattern takes.

    Equal lengths follow each other in a pattern, so a pattern has one row for each different length, at most 44 for 1,024.
    """
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        at, i = 0, 0
        while i < len(lengths):
            length, same = lengths[i], 1
            while i + same < len(lengths) and lengths[i + same] == length:
                same += 1
            low = taken.get(length, 0)
            taken[length] = low + count * same
            out.append((length, low, taken[length], sequence, at, same))
            at, i = at + length * same, i + same
        sequence += count
    return out


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, start, length and any others)."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # at most 2 * size patterns of at most 44 lengths: the broadcast is bounded by the sequence length alone
    table = spark.createDataFrame(slots(plan(histogram, size)), "length long, _low long, _high long, _first long, _at long, _same long")
    ranked = with_start(parts, ["length"], ["doc_id", "start"], ["doc_id", "start"], "_rank")
    r = F.col("_rank") - F.col("_low")
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))).drop(table["length"])
    return placed.select(
        *parts.columns,
        (F.col("_first") + F.expr("(_rank - _low) div _same")).alias("sequence_id"),
        (F.col("_at") + (r % F.col("_same")) * F.col("length")).alias("offset"),
    )


def digest(parts: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
