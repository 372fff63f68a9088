"""Token ids as grammar-compressed binary shards with random access.

Documents are encoded, dealt to ranges of ascending doc_id and written as shards of about a million ids. In a shard, Re-Pair replaces
frequent pairs of neighbouring symbols by nonterminals until no pair occurs `LEAST` times; no pair holds the end id, so each document
starts at a symbol. A shard keeps the rules, the number of ids each nonterminal stands for, the symbols, and where each document starts
among symbols and ids, so that any range of ids is decoded by expanding only the symbols that cover it.

A shard is one binary value of a Parquet row (part, shard, n_docs, n_ids, payload): Spark's writer commits it, and any task can write
it again after a lost executor. Payload: ``<4sIIIIQ`` magic, first nonterminal, documents, rules, symbols, ids; then the sections of
`SECTIONS`, each with its length as ``<I``, compressed with zstd, integers split in byte planes.

Defined cases: a null text is empty (the end id alone); a null doc_id comes first; repeated rows, and rows of one doc_id in the order of
their ids, are stored each; a text of more ids than a shard has a shard of its own; an empty table has no shards; other columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import in_batches, range_parts, shared_dir
from quillspark.llm.tokens import BYTE_BPE, column_slices, encoder, id_bytes

MAGIC = b"QRP1"
_HEAD = struct.Struct("<4sIIIIQ")
#: Most ids gathered for a shard, unless one document has more.
SHARD_IDS = 1 << 20
#: Uses below which a pair gets no rule; pairs of a round occur at least a `STEP`-th as often as the most frequent one.
LEAST, STEP = 16, 8
#: The pair table has two to this many slots.
BITS = 18
#: Sections of a payload and their integers: whether a doc_id is null, doc_ids, where documents start among ids and among symbols,
#: rules as left and right symbols, how many ids each nonterminal stands for, symbols.
SECTIONS = {"null": "u1", "doc_id": "<i8", "at": "<u4", "symbol_at": "<u4", "rules": "<u4", "size": "<u4", "symbols": "<u4"}
SHARDS = "part int, shard int, n_docs int, n_ids long, payload binary"


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b


def _slots(code: np.ndarray, bits: int) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


def _pairs(code: np.ndarray, slot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each pair, how often each numbered pair occurs, and which it is. Exact: pairs that share a table slot with another are
    sorted out."""
    which = np.zeros(1 << bits, np.uint64)
    which[slot] = code
    number = slot
    if len(other := np.flatnonzero(code != which[slot])):
        more, own = np.unique(code[other], return_inverse=True)
        number[other] = (1 << bits) + own
        which = np.concatenate([which, more])
    return number, np.bincount(number, minlength=len(which)), which


def re_pair(ids: np.ndarray, first: int, end_id: int, least: int = LEAST, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that stand for ``ids``, and the rules as rows (left, right); rule i makes the nonterminal ``first + i``.

    Each round takes the pairs that occur a ``step``-th as often as the most frequent one, and replaces occurrences that don't overlap, the
    more frequent first. It ends when no pair occurs ``least`` times. Places are linked to the next and the one before, so only pairs at
    replaced places and before them are counted anew. A pair that has become rare stays rare unless a symbol of it is made again; then all
    pairs with that symbol are counted anew.
    """
    n, rules = len(ids), {}
    seq = np.append(ids, end_id).astype(np.uint32)  # the last is no symbol but what follows, and what is before the first
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    live = np.ones(n + 1, bool)
    number = np.full(n + 1, -1, np.int32)  # of the pair that begins here; -1: rare, or none
    pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    changed, a, b = np.arange(n), seq[:-1], seq[1:]
    held = twins = changed[:0]  # places of numbered pairs, and of those of one symbol
    while True:
        bits = min(BITS, max(8, len(changed).bit_length()))
        code = _codes(a, b)
        slot = _slots(code, bits)
        use = (np.bincount(slot, minlength=1 << bits) >= least)[slot] & (a != end_id) & (b != end_id)
        at, code = changed[use], code[use]
        own, many, which = _pairs(code, slot[use], bits)
        new = np.flatnonzero(many >= least)
        names = np.full(len(many), -1, np.int32)
        names[new] = len(counts) + np.arange(len(new))
        few, twins = len(held) + len(at) <= n >> 5, twins[number[twins] >= 0]
        held = held[number[held] >= 0] if few else held
        number[at] = own = names[own]
        held = np.sort(np.concatenate([held, at[own >= 0]])) if few else np.flatnonzero(number >= 0)
        two = np.flatnonzero(code >> np.uint64(32) == code & np.uint64(0xFFFFFFFF))
        twins = np.sort(np.concatenate([twins, at[two[own[two] >= 0]]]))
        pairs = np.concatenate([pairs, which[new]])
        counts = np.concatenate([counts, many[new]])
        head = np.flatnonzero(np.append(True, after[twins[:-1]] != twins[1:])[: len(twins)])
        odd = (np.arange(len(twins)) - np.repeat(head, np.diff(head, append=len(twins)))) % 2 == 1  # in a run of one symbol, every other pair overlaps
        own = number[twins]
        counts[own] = np.bincount(own[~odd], minlength=len(counts))[own]
        if (top := counts.max(initial=0)) < least:
            break
        chosen = np.flatnonzero(counts >= max(least, top // step))
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")]
        rank = np.append(np.where(counts < least, len(chosen) + 1, len(chosen)), len(chosen)).astype(np.int32)
        rank[chosen] = np.arange(len(chosen))
        own = number[twins[odd]]
        number[twins[odd]] = -1  # not to be chosen in this round
        ranks = rank[number[held]]
        number[twins[odd]] = own
        number[held[ranks > len(chosen)]] = -1
        use = ranks < len(chosen)
        at, own = held[use], ranks[use]
        near = after[at[:-1]] == at[1:]
        use = np.ones(len(at), bool)
        use[1:] &= ~near | (own[1:] < own[:-1])
        use[:-1] &= ~near | (own[:-1] <= own[1:])
        at, own = at[use], own[use]
        uses = np.bincount(own, minlength=len(chosen))
        worth = uses >= max(2, least // 2)
        worth[0] = True
        at, own = at[worth[own]], own[worth[own]]
        names, made = np.zeros(len(chosen), np.uint32), first + len(rules)
        for i, pair in zip(np.flatnonzero(worth).tolist(), pairs[chosen[worth]].tolist(), strict=True):
            names[i] = rules.setdefault(pair, first + len(rules))
        gone = after[at]
        seq[at] = names[own]
        after[at] = after[gone]
        before[after[gone]] = at
        live[gone] = False
        if len(again := names[worth & (names < made)]):
            known = np.zeros(first + len(rules), bool)
            known[again] = True
            known = known[seq] & live
            known[at] = True
            at = np.flatnonzero(known)
        left = before[at]
        changed = np.concatenate([at, left[left != np.append(-1, at[:-1])]])
        for x in (changed, gone):
            own = number[x]
            counts -= np.bincount(own[own >= 0], minlength=len(counts))
            number[x] = -1
        a, b = seq[changed], seq[after[changed]]
    made = np.array(list(rules), np.uint64)
    return seq[:n][live[:n]], np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule only holds earlier nonterminals."""
    out = np.ones(len(rules), np.int64)
    left, right = rules[:, 0] - first, rules[:, 1] - first
    low = 0
    while low < len(rules):  # the run of rules that need none of the run itself
        ready = np.maximum(left[low:], right[low:]) >= low
        high = low + int(np.argmax(ready)) if ready.any() else len(rules)
        part = slice(low, high)
        out[part] = sum(np.where(x[part] >= 0, out[np.maximum(x[part], 0)], 1) for x in (left, right))
        low = high
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: each step opens all nonterminals at once."""
    while len(at := np.flatnonzero(symbols >= first)):
        opened = rules[symbols[at] - first]
        wide = np.empty(len(symbols) + len(at), symbols.dtype)
        new = at + np.arange(len(at))
        plain = np.ones(len(wide), bool)
        plain[new] = plain[new + 1] = False
        wide[plain] = np.delete(symbols, at)
        wide[new], wide[new + 1] = opened[:, 0], opened[:, 1]
        symbols = wide
    return symbols


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if len(values) else values
    data = zstandard.ZstdCompressor(level=3).compress(planes.tobytes())
    return struct.pack("<I", len(data)) + data


def _unpack(payload: memoryview, at: int, kind: str) -> tuple[np.ndarray, int]:
    n = struct.unpack_from("<I", payload, at)[0]
    data = zstandard.ZstdDecompressor().decompress(payload[at + 4 : at + 4 + n])
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind), at + 4 + n


def write_shard(keys: list[int | None], docs: list[np.ndarray], first: int, end_id: int = 0) -> bytes:
    """The payload of one shard. ``docs`` have no end id yet; ``first`` is above all ids."""
    ids = np.concatenate([x for d in docs for x in (d, np.array([end_id], d.dtype))])
    seq, rules = (x.astype(np.int64) for x in re_pair(ids, first, end_id))
    size = lengths_of(rules, first)
    width = np.where(seq >= first, size[np.maximum(seq - first, 0)] if len(size) else 1, 1)
    at = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    symbol_at = np.searchsorted(np.concatenate([[0], np.cumsum(width)]), at)
    null = np.array([k is None for k in keys], np.uint8)
    head = _HEAD.pack(MAGIC, first, len(docs), len(rules), len(seq), len(ids))
    parts = [null, np.array([k or 0 for k in keys]), at, symbol_at, rules.reshape(-1), size, seq]
    return head + b"".join(_pack(x.astype(kind)) for x, kind in zip(parts, SECTIONS.values(), strict=True))


class Shard:
    """An opened payload: documents in order, and any range of ids of one."""

    def __init__(self, payload: bytes) -> None:
        magic, self.first, self.n_docs, n_rules, _, self.n_ids = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        view, at, got = memoryview(payload), _HEAD.size, []
        for kind in SECTIONS.values():
            x, at = _unpack(view, at, kind)
            got.append(x)
        null, keys, self.at, self.symbol_at, rules, self.size, self.symbols = got
        self.keys = [None if n else k for n, k in zip(null.tolist(), keys.tolist(), strict=True)]
        self.rules = rules.reshape(-1, 2)

    def read(self, doc: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids of a document from ``start``; only symbols that cover them are expanded."""
        n = int(self.at[doc + 1]) - int(self.at[doc])
        stop = n if length is None else min(n, start + length)
        own = self.symbols[self.symbol_at[doc] : self.symbol_at[doc + 1]]
        if (start, stop) == (0, n):
            return expand(own, self.rules, self.first)
        width = np.where(own >= self.first, self.size[np.where(own >= self.first, own - self.first, 0)] if len(self.size) else 1, 1)
        ends = np.cumsum(width)
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[low - 1]) if low else 0)
        return expand(own[low:high], self.rules, self.first)[skip : skip + stop - start]

    def ids(self) -> np.ndarray:
        """All ids of the shard: each rule is expanded once, unless rules together stand for more ids than the shard holds."""
        if self.size.sum(dtype=np.int64) > self.n_ids:
            return expand(self.symbols, self.rules, self.first)
        table = expand(np.arange(self.first, self.first + len(self.rules), dtype=self.symbols.dtype), self.rules, self.first)
        size, begin = self.size.astype(np.int64), np.cumsum(self.size, dtype=np.int64) - self.size
        at = np.flatnonzero(self.symbols >= self.first)
        rule = self.symbols[at] - self.first
        length = np.ones(len(self.symbols), np.int64)
        length[at] = size[rule]
        start = len(table) + np.arange(len(self.symbols))
        start[at] = begin[rule]
        done = np.cumsum(length)
        return np.concatenate([table, self.symbols])[np.arange(self.n_ids) + np.repeat(start - (done - length), length)]


def _gathered(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a bounded size, so that more segments are met again within one; a batch that is larger stays."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order to ``path``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = np.array(range_parts(docs.select("doc_id"), "doc_id", 500), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in _gathered(batches):
            for part in column_slices(batch.column(1), 8 << 20):
                some = batch.slice(part.start, part.stop - part.start)
                keys = some.column(0)
                at = np.where(keys.is_valid(), np.searchsorted(cuts, keys.fill_null(0).to_numpy()), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.array(at), id_bytes(*enc.encode(some.column(1)))], names=["doc_id", "part", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        first = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        held: list[tuple[int | None, np.ndarray]] = []
        part = number = total = 0

        def flush() -> pa.RecordBatch:
            keys, docs = zip(*held, strict=True)
            n = sum(len(d) + 1 for d in docs)
            row = (part, number, len(keys), n, write_shard(list(keys), list(docs), first, end_id))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for p, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(raw) // enc.width.itemsize + 1
                if held and (p != part or total + n > shard_ids):
                    yield flush()
                    number = number + 1 if p == part else 0
                    held, total = [], 0
                elif p != part:
                    number = 0
                part, total = p, total + n
                held.append((key, np.frombuffer(raw, enc.width)))
        if held:
            yield flush()

    dealt = in_batches(docs, encode, "doc_id long, part int, ids binary")
    dealt = dealt.select("part", "doc_id", "ids").repartition("part").sortWithinPartitions("part", "doc_id", "ids")
    in_batches(dealt, shards, SHARDS).write.option("compression", "none").parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Reads shards back: for each document, ids before it in all files, its ids and their checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, s, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(payload)
                n, at = shard.n_docs, shard.at.astype(np.int64)
                raw, ends = memoryview(shard.ids()).cast("B"), (4 * at).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                cols = ([p] * n, [s] * n, shard.keys, at[:-1], np.diff(at), crc)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SHARDS).parquet(path)
    docs = in_batches(files.select("part", "shard", "payload"), read, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_part = files.select("part", "shard", "n_ids", before(Window.partitionBy("part").orderBy("shard")).alias("in_part"))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row for each range
    parts = parts.select("part", before(Window.orderBy("part")).alias("to_part"))
    starts = in_part.join(F.broadcast(parts), "part").select("part", "shard", (F.col("to_part") + F.col("in_part")).alias("before"))
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
