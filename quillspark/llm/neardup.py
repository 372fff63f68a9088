"""Near-duplicates by SetSketch registers: band, estimate by likelihood, verify on whole sets, join components.

A document's set holds its distinct 2-word shingles, A-Z in lower case. Documents with equal sets form a class, and only the class's
least doc_id goes on. Register bands put similar classes in common buckets, and every two members of a bucket are either joined or
compared:

1. Each member is compared with one leader of its bucket, which joins most of a crowd at the cost of its size. While much work is left, rounds
   with other leaders follow, as long as they help.
2. In each bucket that still holds more than one component, the members of all but its largest component are compared with each other and with the
   largest; small buckets give their pairs, each once for all bands. In large ones members are dealt to blocks, and two blocks are a group of their own, so a crowded bucket is spread over many tasks. A pair
   is compared in the first band that it shares, and not at all once it is joined or if its sizes rule it out.

A comparison first estimates the similarity from the registers and set sizes, then counts the common shingles of the full sets (64-bit
hashes). What can be missed: a pair at 0.8 that shares no band, once in 29 million times, or whose estimate is below `LEAST_ESTIMATE`,
less than once in 700 million times (the binomial bound for the share of equal registers); less above 0.8.

Defined cases: a null or empty text has an empty set and is linked with nothing; a text of one word has that word as its shingle; texts
of any length are read whole; repeated rows, and rows that share a doc_id, are one document; ties go to the least doc_id; a row without
a doc_id joins its text's component but never represents it; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import setsketch
from quillspark.llm.common import in_batches, join_hot, stored
from quillspark.llm.components import components
from quillspark.llm.shingles import shingles
from quillspark.llm.tokens import in_slices

WORDS, PERCENT = 2, 80
#: Members of a block, about, and shingles of a slice of the tables of members by shingles; buckets up to `SMALL` are compared pair by pair.
BLOCK, SLICE, SMALL = 512, 8192, 8
LEAST_ESTIMATE = 0.68
#: Leader rounds go on while more comparisons than this for each member of a bucket are left, and each round saves a fifth of them.
WORK = 64
#: Most bits of the filter that keeps documents outside all buckets from being read in full. Beyond some millions of candidates it fills
#: up, and documents outside the buckets are read in full too; nothing is lost by that.
FILTER_BITS = 1 << 26


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    return [np.unique(h) for h in shingles(texts, WORDS, lower=True)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size, a key that equal sets share, and the band keys."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in in_slices(texts, 500_000):
                sets = _sets(texts[part])
                bands = setsketch.band_keys(setsketch.registers(sets))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                offsets = pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32))
                cols = [batch.column(0)[part.start : part.stop], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_key", "bands"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _payloads(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Registers and sets of the documents that buckets hold (and of a few more), read without a shuffle of texts.

    The members' ids set bits of a filter of bounded size; whatever passes it is kept, so a full filter costs work but loses nothing.
    """
    spark = docs.sparkSession
    size = min(FILTER_BITS, 1 << max(16, (16 * members.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    word = members.select(slot("rep").alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[word.column("w").to_numpy()] = word.column("b").to_numpy()  # at most FILTER_BITS / 64 rows
    filled = spark.sparkContext.broadcast(zstandard.ZstdCompressor().compress(bits.tobytes()))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(zstandard.ZstdDecompressor().decompress(filled.value), np.uint64)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            s = batch.column(2).to_numpy()
            here = pa.array((held[s // 64] >> (s % 64).astype(np.uint64)) & np.uint64(1) == 1)
            batch = batch.filter(here)  # noqa: PLW2901
            texts = batch.column(1).to_pylist()
            for part in in_slices(texts, 500_000):
                sets = _sets(texts[part])
                regs = setsketch.registers(sets)
                rows = [batch.column(0)[part.start : part.stop], pa.array([len(x) for x in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([pack(_planes(x)) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["id", "n", "regs", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", slot(F.col("doc_id").cast("long")).alias("s"))
    return in_batches(rows.where(F.col("doc_id").isNotNull()), step, "id long, n long, regs binary, set binary")


def _planes(x: np.ndarray) -> bytes:
    """Differences of an ascending array, in byte planes: the high bytes compress."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().reshape(-1).view("<u8"), dtype=np.uint64)


def _registers(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), setsketch.M)


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The estimated similarity of pairs of register rows with set sizes."""
    out = [np.zeros(0)]
    for low in range(0, len(a), 20_000):
        x, y = a[low : low + 20_000], b[low : low + 20_000]
        out.append(setsketch.estimate((x > y).sum(1), (x < y).sum(1), n[low : low + 20_000], m[low : low + 20_000]))
    return np.concatenate(out)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(pairs: DataFrame, payloads: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have ``100 * common >= percent * all``. A leader v may be in any share of the pairs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            u, v, n, m, ra, rb, a, b = (c.to_pylist() for c in batch.columns)
            ok = []
            for i in np.flatnonzero(_near(_registers(ra), _registers(rb), np.array(n), np.array(m)) >= LEAST_ESTIMATE).tolist():
                if last[0] != b[i]:
                    last = (b[i], _unpacked(b[i]))
                if _linked(_unpacked(a[i]), last[1], percent):
                    ok.append((u[i], v[i]))
            yield _pairs(ok)

    side = lambda end: payloads.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("regs").alias(f"r{end}"), F.col("set").alias(f"s{end}"))
    both = join_hot(pairs.join(side("u"), "u"), side("v"), "v", "u", counts=pairs.groupBy("v").count()).select("u", "v", "nu", "nv", "ru", "rv", "su", "sv")
    return in_batches(both, step, "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _joined(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``left`` (rows) and ``right`` (columns) have ``100 * common >= percent * all``."""
    size = np.array([len(x) for x in left])[:, None], np.array([len(x) for x in right])[None, :]
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    common = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, x = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
        held = shared[at] == x
        return row[held], at[held]

    if len(shared):
        sides = [(places(sets), len(sets)) for sets in (left, right)]
        for low in range(0, len(shared), SLICE):
            tables = []
            for (row, at), n in sides:
                here = (at >= low) & (at < low + SLICE)
                table = np.zeros((n, min(SLICE, len(shared) - low)), np.float32)
                table[row[here], at[here] - low] = 1
                tables.append(table)
            common += tables[0] @ tables[1].T
    both = common.astype(np.int64)
    return (both > 0) & (100 * both >= percent * (size[0] + size[1] - both))


def _compared(bucket: int, left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of members (rep, component, size, registers, set), or within one, that join their components.

    Pairs that share an earlier band than the bucket's are left to that band; the surest are compared first, and a pair is skipped once
    others have joined it.
    """
    same, right = right is None, left if right is None else right
    (a, b), (n, m) = (_registers([r[3] for r in x]) for x in (left, right)), (np.array([r[2] for r in x]) for x in (left, right))
    c, d = (np.array([r[1] for r in x]) for x in (left, right))
    open_ = (c[:, None] != d[None, :]) & (100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :]))
    if same:
        open_ = np.triu(open_, 1)
    own, other = setsketch.band_keys(a), setsketch.band_keys(b)
    for k in range(int(np.flatnonzero(own[0] == bucket)[0])):
        open_ &= own[:, k][:, None] != other[:, k][None, :]
    i, j = np.nonzero(open_)
    sure = _near(a[i], b[j], n[i], m[j])
    order = np.argsort(-sure, kind="stable")[: int((sure >= LEAST_ESTIMATE).sum())]
    i, j = i[order], j[order]
    sets: dict[bytes, np.ndarray] = {}

    def of(row: tuple) -> np.ndarray:
        if row[4] not in sets:
            sets[row[4]] = _unpacked(row[4])
        return sets[row[4]]

    if len(i) > 8 * (len(left) + len(right)):  # so many that all at once is faster
        rows, columns = np.unique(i), np.unique(j)
        near = np.zeros(open_.shape, bool)
        near[np.ix_(rows, columns)] = _joined([of(left[x]) for x in rows], [of(right[x]) for x in columns], percent)
        keep = near[i, j]
        i, j, check = i[keep], j[keep], False
    else:
        check = True
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    found = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(left[x][1]), find(right[y][1])
        if p != q and (not check or _linked(of(left[x]), of(right[y]), percent)):
            root[max(p, q)] = min(p, q)
            found.append((left[x][0], right[y][0]))
    return found


def _rest(own: DataFrame, open_: DataFrame, payloads: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join all components with a link between members of one bucket.

    ``own`` has bucket, rep and component c; ``open_`` the buckets with more than one component, their size n, their largest component
    top and its size m.
    """
    blocks = lambda n: F.expr(f"({n} + {BLOCK - 1}) div {BLOCK}")
    rows = join_hot(own.drop("size"), open_.select("bucket", "top", blocks("n - m").alias("_few"), blocks("m").alias("_many")), "bucket", "rep")
    few = F.col("c") != F.col("top")
    rows = rows.withColumn("block", F.when(few, F.pmod(F.xxhash64("rep"), F.col("_few"))).otherwise(F.col("_few") + F.pmod(F.xxhash64("rep"), F.col("_many"))))
    met = F.when(few, F.sequence(F.lit(0).cast("long"), F.col("_few") + F.col("_many") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_few") - 1))
    rows = rows.withColumn("_o", F.explode(met)).select("bucket", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), "block", "rep", "c")
    keys = ["bucket", "low", "high"]
    dealt = rows.join(payloads.withColumnRenamed("id", "rep"), "rep").select(*keys, "block", "rep", "c", "n", "regs", "set")

    def compare(key: tuple, held: list[tuple]) -> list[tuple[int, int]]:
        left = [r[1:] for r in held if r[0] == key[1]]
        right = [r[1:] for r in held if r[0] == key[2]] if key[1] != key[2] else None
        return _compared(key[0], left, right, percent) if left and (right or right is None) else []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        held: list[tuple] = []
        for batch in batches:
            found = []
            for bucket, low, high, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (bucket, low, high):
                    found += compare(key, held) if held else []
                    key, held = (bucket, low, high), []
                held.append(tuple(member))
            yield _pairs(found)
        yield _pairs(compare(key, held) if held else [])

    return in_batches(dealt.repartition(*keys).sortWithinPartitions(*keys), step, "u long, v long")


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _small_pairs(own: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) of different components in the open buckets of at most `SMALL` members."""
    held = own.join(open_.where(F.col("n") <= SMALL).select("bucket"), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("rep", "c", "size")).alias("x"))
    later = lambda a: F.filter("x", lambda b: (b["rep"] > a["rep"]) & (b["c"] != a["c"]) & _fits(a["size"], b["size"], percent))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(later(a), lambda b: F.struct(a["rep"].alias("u"), b["rep"].alias("v")))))
    return held.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def _open(own: DataFrame, turn: int) -> DataFrame:
    """Buckets with more than one component: size n, the largest component top, its size m, and a member of it by turn."""
    parts = own.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.min_by(F.struct("rep", "size"), F.xxhash64("rep", F.lit(turn))).alias("leader"))
    most = F.max(F.struct("m", "c", "leader")).alias("t")
    return parts.groupBy("bucket").agg(F.sum("m").alias("n"), F.count("*").alias("_k"), most).where("_k > 1").select("bucket", "n", "t.m", F.col("t.c").alias("top"), "t.leader")


def _components(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the representatives of classes that are linked with another."""
    rows = classes.where(F.col("rep").isNotNull()).select("rep", "size", F.explode("bands").alias("bucket"))
    leaders = stored(rows.groupBy("bucket").agg(F.count("*").alias("count"), F.min_by(F.struct("rep", "size"), F.xxhash64("rep")).alias("leader")).where("count > 1"), "leaders")
    members = stored(join_hot(rows, leaders.drop("count"), "bucket", "rep", counts=leaders), "members")
    payloads = stored(_payloads(docs, members), "payloads")

    def starred(met: DataFrame) -> DataFrame:
        use = met.where((F.col("rep") != F.col("leader.rep")) & _fits(F.col("size"), F.col("leader.size"), percent))
        return stored(use.select(F.col("rep").alias("u"), F.col("leader.rep").alias("v")).distinct(), "pairs")

    links = stored(_links(starred(members), payloads, percent), "links")
    labels = components(links)
    turn, left, few = 0, None, WORK * members.count()
    while True:
        turn += 1
        named = labels.select(F.col("id").alias("rep"), F.col("component").alias("c"))
        own = stored(members.select("bucket", "rep", "size").join(named, "rep", "left").select("bucket", "rep", "size", F.coalesce("c", "rep").alias("c")), "own")
        open_ = stored(_open(own, turn), "open")
        work = open_.agg(F.sum(F.expr("double(n - m) * n"))).first()[0] or 0
        if not work:
            return labels
        if work <= few or left is not None and work > 0.8 * left:
            break
        left = work
        met = join_hot(own, open_.select("bucket", "top", "leader"), "bucket", "rep").where("c != top")
        links = links.union(stored(_links(starred(met), payloads, percent), "links"))
        labels = components(links)
    found = _links(stored(_small_pairs(own, open_, percent), "pairs"), payloads, percent)
    large = stored(open_.where(F.col("n") > SMALL), "open")
    if not large.isEmpty():
        found = found.union(_rest(own, large, payloads, percent))
    found = stored(found, "links")
    return labels if found.isEmpty() else components(links.union(found))


def _found(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The result of `near_duplicates`, and the classes."""
    drawn = stored(sketches(docs), "sketches")
    classes = stored(drawn.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands")), "classes")
    labels = _components(docs, classes, percent)
    member = classes.select("set_key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = join_hot(drawn.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), member, "set_key", "doc_id").drop("set_key")
    empty = drawn.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), classes


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether it is the component's representative) for every row."""
    return _found(docs, percent)[0]


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that represent their components, one row each, with all their columns.

    Of rows that share a doc_id the one with the least hash stays. A row without a doc_id stays if no document has its set, and it has the
    least hash of those with its set.
    """
    columns = docs.columns
    once = lambda df, key: df.withColumn("_all", F.struct(*columns)).groupBy(key).agg(F.min_by("_all", F.xxhash64("_all")).alias("_all")).select("_all.*")
    result, classes = _found(docs, percent)
    found = stored(result.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")), "kept")
    one = docs.join(found.where("_rows = 1").select("doc_id"), "doc_id", "left_semi").select(*columns)
    several = once(docs.join(found.where("_rows > 1").select("doc_id"), "doc_id", "left_semi").select(*columns), "doc_id")
    unnamed = docs.where(F.col("doc_id").isNull()).withColumn("_row", F.xxhash64(*columns))
    keys = sketches(unnamed.select(F.col("_row").alias("doc_id"), "text"))
    free = keys.where("n_shingles > 0").join(classes.where("rep is not null").select("set_key"), "set_key", "left_anti").groupBy("set_key").agg(F.min("doc_id").alias("_row")).select("_row")
    free = free.unionByName(keys.where("n_shingles = 0").select(F.col("doc_id").alias("_row"))).distinct()
    return one.unionByName(several).unionByName(once(unnamed.join(free, "_row", "left_semi"), "_row"))
