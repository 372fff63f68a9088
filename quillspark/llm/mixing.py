"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, form blocks of `BLOCK`, and each block two halves. On a line of slots, one half a slot, a source of
target share w is due floor(w t) or ceil(w t) halves by slot t. The line is cut into periods. At each period's end the halves that are due go
first, then the sources whose next half has the earliest deadline, so the ends keep to the exact shares; the driver only steps from end to
end. Within a period, a source with c of its P slots has for its i-th half the window from release floor(i P / c) to deadline
ceil((i + 1) P / c), and Spark tasks fill the slots earliest deadline first. Both steps stay within one half, so at every point of the
mixture a source is less than one block away from its share. Shares are exact ratios of the given weights, not rounded.

The mixture ends with the slot in which the last source has shown all its documents; by then others start again (``epoch`` > 0), so
nothing is dropped and each source has its weight.

Defined cases: a null source is a source; a source without a given weight has none and is left out only if weights are given;
repeated rows are separate documents; documents of one hash follow by doc_id; texts of any length count as one document; an empty table
gives an empty mixture; columns named as those added are replaced; more than `SOURCES` sources raise ValueError.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_batches, unused, with_start

BLOCK = 8
#: Slots of a period, about: as many whole rounds of the shares as fit, if one does.
PERIOD = 1 << 16
#: Sources of a mixture, at most: each has a row on the driver.
SOURCES = 100_000
#: Numbers of kept ends, at most: beyond it every other end goes.
KEPT = 1 << 21
#: Default weights are the sources' sizes to this power: large sources shrink a little against small ones.
TEMPER = 0.9
_NONE = "\x00none"


def source_key() -> Column:
    return F.coalesce(F.col("source"), F.lit(_NONE))


def sizes(docs: DataFrame) -> dict[str, int]:
    """Documents of each source."""
    rows = docs.groupBy(source_key().alias("s")).agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"a mixture has {SOURCES} sources at most; group them first")
    return {r["s"]: r["n"] for r in rows}


def tempered(counts: dict[str, int], power: float = TEMPER) -> dict[str, float]:
    total = sum(n**power for n in counts.values())
    return {s: n**power / total for s, n in counts.items()}


def shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights above 0 as whole numbers in exactly their ratios; a float that is the nearest to a short fraction, as 0.3, is that fraction."""
    exact = {s: Fraction(w) for s, w in sorted(weights.items()) if w > 0}
    exact = {s: short if float(short := f.limit_denominator(10**6)) == float(f) else f for s, f in exact.items()}
    scale = math.lcm(*[f.denominator for f in exact.values()])
    return {s: int(f * scale) for s, f in exact.items()}


def period_of(whole: list[int]) -> int:
    total = sum(whole)
    return PERIOD // total * total if 0 < total <= PERIOD else PERIOD


def next_end(done: list[int], whole: list[int], total: int, at: int) -> list[int]:
    """Halves done of each source by slot ``at``, a period's end, from those by the end before.

    A half that is done stays done: first come the halves that are due by then, those taken ahead at an earlier end, and then the
    next halves of earliest deadline. There are always enough slots for the first two, as each lacks less than its own share of the rest.
    """
    out = [max(d, w * at // total) for d, w in zip(done, whole, strict=True)]
    free = [s for s, w in enumerate(whole) if w * at % total and out[s] == w * at // total]
    free.sort(key=lambda s: (-(-(out[s] + 1) * total // whole[s]), s))
    for s in free[: at - sum(out)]:
        out[s] += 1
    return out


def ends(whole: list[int], needed: list[int], period: int) -> Iterator[list[int]]:
    """Halves done of each source before every ``period`` slots, until each has done what it needs."""
    total, done, at = sum(whole), [0] * len(whole), 0
    yield done
    while any(d < n for d, n in zip(done, needed, strict=True)):
        at += period
        done = next_end(done, whole, total, at)
        yield done


def kept_ends(whole: list[int], needed: list[int], period: int, most: int | None = None) -> tuple[list[list[int]], int, int, int, list[int]]:
    """Every so many-th end, how many periods lie between two of them, the number of periods, and what `finish` gives."""
    out, every, n, before, done = [], 1, -1, [0] * len(whole), [0] * len(whole)
    for n, end in enumerate(ends(whole, needed, period)):
        before, done = done, end
        if n % every == 0:
            out.append(end)
        if len(out) * len(whole) > (KEPT if most is None else most) and len(out) > 1:
            out, every = out[::2], 2 * every
    if n < 1:
        return out, every, 0, -1, done
    last, most_done = finish([before, done], needed, period)
    return out, every, n, (n - 1) * period + last, most_done


def fill(counts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, its i-th half, slot, release, deadline) for sum(counts) slots, earliest deadline first."""
    total = sum(counts)
    job = lambda s, i: (i * total // counts[s], -(-(i + 1) * total // counts[s]), s, i)
    waiting = [job(s, 0) for s, c in enumerate(counts) if c]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    for at in range(total):
        while waiting and waiting[0][0] <= at:
            release, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        if i + 1 < counts[s]:
            heapq.heappush(waiting, job(s, i + 1))
        yield s, i, at, release, deadline


def finish(edges: list[list[int]], needed: list[int], period: int) -> tuple[int, list[int]]:
    """The slot in which the last source has all it needs, and the halves that each has done by its end."""
    if len(edges) < 2:
        return -1, list(edges[0])
    done, after = list(edges[-2]), edges[-1]
    left = sum(d < n for d, n in zip(done, needed, strict=True))
    for s, _, t, _, _ in fill([b - a for a, b in zip(done, after, strict=True)]):
        done[s] += 1
        left -= done[s] == needed[s]
        if not left:
            break
    return (len(edges) - 2) * period + t, done


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One round of sum(slots) as (source, half, slot, release, deadline)."""
    names = list(slots)
    return [(names[s], *rest) for s, *rest in islice(fill(list(slots.values())), sum(slots.values()))]


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with epoch, block, slot, release, deadline and position; a row appears once for each epoch it is in."""
    if block < 2 or block % 2:
        raise ValueError("a block has two halves")
    spark, half = docs.sparkSession, block // 2
    docs = docs.drop("epoch", "block", "slot", "release", "deadline", "position")
    counts = sizes(docs)
    share = shares({s: (weights or tempered(counts)).get(s, 0.0) for s in counts})
    names, whole = list(share), list(share.values())
    needed = [-(-counts[s] // half) for s in names]
    period = period_of(whole)
    edges, every, n_periods, last, most = kept_ends(whole, needed, period)
    total = sum(whole)

    def steps(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int]]]:
        for first, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for p in range(first, min(first + every, n_periods)):
                high = next_end(low, whole, total, (p + 1) * period)
                yield p, low, high
                low = high  # noqa: PLW2901

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int64()] * 4]
        for batch in batches:
            for p, low, high in steps(batch):
                start = p * period
                rows = [(names[s], low[s] + i, start + t, start + r, start + d) for s, i, t, r, d in islice(fill([b - a for a, b in zip(low, high, strict=True)]), max(0, last + 1 - start))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_s", "_half", "slot", "release", "deadline"])

    periods = spark.createDataFrame([(i * every, e) for i, e in enumerate(edges) if i * every < n_periods], "p long, low array<long>")
    of_slot = in_batches(periods.repartition(max(1, min(len(edges), 4096)), "p"), slots, "_s string, _half long, slot long, release long, deadline long")
    # a row for each source, `SOURCES` at most
    of_source = spark.createDataFrame([(s, counts[s], most[j] * half) for j, s in enumerate(names)], "_s string, _n long, _most long")
    ranked = with_start(docs.withColumn("_s", source_key()), ["_s"], [F.xxhash64("doc_id"), "doc_id"], ["doc_id"], "_rank")
    rows = ranked.join(F.broadcast(of_source), "_s").withColumn("epoch", F.explode(F.expr("sequence(0L, greatest(0L, (_most - 1 - _rank) div _n))")))
    rows = rows.withColumn("_g", F.col("_rank") + F.col("epoch") * F.col("_n")).withColumn("_half", F.expr(f"_g div {half}"))
    rows = rows.join(of_slot.hint("merge"), ["_s", "_half"])  # a row for each half block: it grows with the documents
    return rows.select(*docs.columns, "epoch", F.expr(f"_g div {block}").alias("block"), "slot", "release", "deadline", (F.col("slot") * half + F.col("_g") % half).alias("position"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents of the mixture, with their own columns, in its order: files and rows follow the position.

    Places are made for a 128-bit hash of each row; whole rows meet them once, equal rows being one, and move once more into order.
    """
    one, two = unused(docs, "_one"), unused(docs, "_two")
    keyed = docs.withColumns({one: F.xxhash64(*docs.columns), two: F.xxhash64(F.lit(1), *docs.columns)})
    place = mixture(keyed.select("doc_id", "source", one, two), weights, block).select(one, two, F.col("position").alias("_position"))
    rows = keyed.dropDuplicates([one, two]).withColumnsRenamed(names := {c: f"_c{i}" for i, c in enumerate(docs.columns)}).join(place.hint("merge"), [one, two])
    return rows.repartitionByRange("_position").sortWithinPartitions("_position").select(*[F.col(names[c]).alias(c) for c in docs.columns])
