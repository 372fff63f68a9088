"""Groups words with their spelling variants: each word of a corpus points to its most frequent neighbour at one edit, if that is frequent enough.

Words are counted in tasks and summed. The frequent ones, in code-point order, are cut into compact tries: one byte for a node's letter, one for its
number of children, level by level, and count and node of each word. Rounds of tries, bounded in bytes, are broadcast, and each task walks them with
the Levenshtein automata of its own words: a state is (word, node, letters read, edits), and after the one edit only the word's own letters lead on, so
most states end at once. Edits are taken in one canonical place (no insertion of the next letter, of a run of equal letters the last is deleted), so a
neighbour is accepted once. Each task reduces what it accepts to a count and the best neighbour of each of its words.

The walk goes down position by position for a block of words, and finishes the states of one position before the next, so memory is bounded by
block, branching and trie. Vocabulary grows slower than text, and rounds with the vocabulary.

Defined cases: a null or empty text has no words; a run of any length is read whole; a null doc_id counts as an empty text in what an ``edit`` gets; repeated
rows count again; of equally frequent neighbours the smallest in code-point order is the best; an empty table gives an empty result; columns but doc_id and
text aren't read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytewords
from quillspark.llm.common import in_batches, join_hot, stored

LETTERS, OCCURRENCES, DROP, TIMES = 5, 3, 97, 2
#: Code points of the words of a trie, bytes of the tries that are broadcast at a time, words that walk together, and words that a task holds while it counts.
TRIE, ROUND, BLOCK, HELD = 1 << 20, 16 << 20, 4096, 400_000
#: Letters a to z and U+00C0 to U+00FF have the codes 0 to 89, in code-point order.
_ASCII, _CODES = 26, 90


def _counted(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _runs(ids: list[object], texts: pa.Array, least: int, drop: int) -> pa.Table:
    """Words of at least ``least`` letters with their counts, after the drops."""
    data, start, size, row = bytewords.words(texts, bytewords.in_run)
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) ^ 0xFFFFFFFF for i in ids], np.uint32)
    h = bytewords.continued(heads[row], data, start, size) ^ np.uint32(0xFFFFFFFF) if drop else None
    leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
    letters = size - (leads[start + size] - leads[start])
    changed = h % np.uint32(drop) == 0 if drop else np.zeros(len(start), bool)
    own = ~changed & (letters >= least)
    begin, length = start[own], size[own]
    ends = np.cumsum(length)
    at = np.repeat(begin - np.concatenate([[0], ends[:-1]]), length) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    words = [pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])]
    edited = []
    for i in np.flatnonzero(changed & (letters > least)):
        word = bytes(data[start[i] : start[i] + size[i]]).decode()
        gone = int(h[i]) % len(word)
        edited.append(word[:gone] + word[gone + 1 :])
    table = pa.table({"word": pa.chunked_array([*words, pa.array(edited, pa.large_string())])})
    return _counted([table.append_column("n", pa.array(np.ones(len(table), np.int64)))])


def vocabulary(docs: DataFrame, least: int = LETTERS, occurrences: int = OCCURRENCES, drop: int = DROP) -> DataFrame:
    """(word, n): runs of letters with A to Z lower-cased, of ``least`` letters or more, that occur so many times in all texts.

    Where ``drop`` divides the CRC-32 of ``<doc_id>:<run>``, one letter of the run goes first, by that number; 0 leaves all as they are.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for at, part in bytewords.slices(batch.column(1)):
                held.append(_runs(batch.column(0).slice(at, len(part)).to_pylist(), part, least, drop))
                if sum(map(len, held)) > HELD:
                    held = [_counted(held)]
                if len(held[0]) > HELD // 2:
                    yield from _out(held.pop(0))
        if held:
            yield from _out(_counted(held))

    def _out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches(max_chunksize=1 << 16)

    found = in_batches(docs.select("doc_id", "text"), step, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters, one after the other, and the offsets of words in them."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(words) + 1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lead = data == 0xC3
    code = np.where(np.concatenate([[False], lead[:-1]]), data - 0x80 + _ASCII, data - 97).astype(np.uint8)
    places = np.concatenate([[0], np.cumsum(~lead)])
    return code[~lead], places[offsets - offsets[0]]


def pack_trie(words: pa.Array, n: np.ndarray) -> bytes:
    """A trie of sorted, distinct words: letters and numbers of children by level, then node and count of each word."""
    codes, offsets = _codes(words)
    size = np.diff(offsets)
    node, terminal = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    letters, children, base, width = [], [], 0, 1  # of the level: first node, number of nodes
    alive = np.flatnonzero(size > 0)
    depth = 0
    while len(alive):
        label, parent = codes[offsets[alive] + depth], node[alive]
        new = np.concatenate([[True], (label[1:] != label[:-1]) | (parent[1:] != parent[:-1])])
        children.append(np.bincount(parent[new] - base, minlength=width).astype(np.uint8))
        letters.append(label[new])
        base, width = base + width, int(new.sum())
        node[alive] = base + np.cumsum(new) - 1
        depth += 1
        terminal[alive] = node[alive]
        alive = alive[size[alive] > depth]
    children.append(np.zeros(width, np.uint8))
    parts = [np.concatenate([np.zeros(0, np.uint8), *letters]), np.concatenate(children), terminal.astype(np.int32), np.asarray(n, np.int64)]
    head = np.array([len(parts[0]), len(size)], np.int64)
    return b"".join(x.tobytes() for x in (head, *parts))


class Trie:
    """An unpacked trie: the letters below each node as bits, so that a step is a shift and a count of bits."""

    def __init__(self, blob: bytes) -> None:
        edges, n_words = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        at = 16
        self.letter = np.concatenate([[0], np.frombuffer(blob, np.uint8, edges, at)]).astype(np.uint8)
        self.size = np.frombuffer(blob, np.uint8, edges + 1, at + edges).astype(np.int64)
        at += 2 * edges + 1
        self.node_of = np.frombuffer(blob, np.int32, n_words, at).astype(np.int64)
        self.n = np.frombuffer(blob[at + 4 * n_words :], np.int64)
        self.first = 1 + np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.parent = np.concatenate([[0], np.repeat(np.arange(edges + 1), self.size)])
        high = (self.letter[1:] >= _ASCII).astype(np.int64)
        self.below = np.zeros((2, edges + 1), np.uint64)
        np.add.at(self.below, (high, self.parent[1:]), np.uint64(1) << (self.letter[1:] - _ASCII * high).astype(np.uint64))
        self.word_at = np.full(edges + 1, -1, np.int64)
        self.word_at[self.node_of] = np.arange(n_words)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, -1 where there is none."""
        high = (letter >= _ASCII).astype(np.int64)
        bit = np.uint64(1) << (letter - _ASCII * high).astype(np.uint64)
        below = self.below[high, node]
        place = np.bitwise_count(below & (bit - np.uint64(1))).astype(np.int64) + high * np.bitwise_count(self.below[0, node])
        return np.where(below & bit, self.first[node] + place, -1)

    def text(self, word: int) -> str:
        node, out = self.node_of[word], []
        while node:
            code = int(self.letter[node])
            out.append(chr(code + 97 if code < _ASCII else code - _ASCII + 0xC0))
            node = self.parent[node]
        return "".join(reversed(out))


def neighbours(trie: Trie, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of the block, word of the trie) for all pairs at distance one."""
    size, found = np.diff(offsets), []

    def finish(word: np.ndarray, node: np.ndarray, read: np.ndarray) -> None:
        """States after the edit: the word's own letters lead to an accepting node, or nowhere."""
        while len(word):
            done = read == size[word]
            end = trie.word_at[node[done]]
            found.append((word[done][end >= 0], end[end >= 0]))
            word, node, read = word[~done], node[~done], read[~done]
            node = trie.child(node, codes[offsets[word] + read])
            on = node >= 0
            word, node, read = word[on], node[on], read[on] + 1

    word, node, depth = np.arange(len(size)), np.zeros(len(size), np.int64), 0
    while len(word):
        n = trie.size[node]
        at = np.repeat(np.arange(len(word)), n)
        below = trie.first[node][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        more = size[word] > depth
        here = np.where(more, codes[np.minimum(offsets[word] + depth, max(len(codes) - 1, 0))], _CODES) if len(codes) else np.full(len(word), _CODES)
        other = trie.letter[below] != here[at]
        of, to = word[at[other]], below[other]
        finish(of, to, np.full(len(of), depth))  # a letter more
        left = size[of] > depth
        finish(of[left], to[left], np.full(int(left.sum()), depth + 1))  # another letter
        word, node, here = word[more], node[more], here[more]
        last = (size[word] == depth + 1) | (codes[np.minimum(offsets[word] + depth + 1, max(len(codes) - 1, 0))] != here) if len(word) else np.zeros(0, bool)
        finish(word[last], node[last], np.full(int(last.sum()), depth + 1))  # a letter less
        node = trie.child(node, here.astype(np.uint8))
        word, node, depth = word[node >= 0], node[node >= 0], depth + 1
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def tries(words: DataFrame, letters: int = TRIE) -> DataFrame:
    """(first, trie): the sorted words cut into tries of about ``letters`` code points. ``words`` has word and n and is read three times."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    ordered = words.select("word", "n").repartitionByRange(max(1, -(-total // letters)), "word").sortWithinPartitions("word")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.column(0).nbytes
            if n > letters:
                yield _packed(held)
                held, n = [], 0
        if held:
            yield _packed(held)

    def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        word = table.column(0).chunk(0)
        blob = pack_trie(word, table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([word.slice(0, 1).cast(pa.string()), pa.array([blob], pa.binary())], names=["first", "trie"])

    return in_batches(ordered, step, "first string, trie binary")


_unpacked: dict[object, list[Trie]] = {}


def _tries_of(sent: Broadcast) -> list[Trie]:
    """The tries of a broadcast, unpacked once in a Python worker."""
    name, blobs = sent.value
    if name not in _unpacked:
        _unpacked.clear()
        _unpacked[name] = [Trie(b) for b in blobs]
    return _unpacked[name]


def _nearest(words: DataFrame, sent: Broadcast) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have neighbours in the tries that were sent."""

    def block(held: list[pa.Array]) -> pa.RecordBatch:
        word = pa.chunked_array(held).combine_chunks()
        word = word.chunk(0) if isinstance(word, pa.ChunkedArray) else word
        codes, offsets = _codes(word)
        count, most, best = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), [None] * len(word)
        for trie in _tries_of(sent):
            mine, theirs = neighbours(trie, codes, offsets)
            count += np.bincount(mine, minlength=len(word))
            order = np.lexsort((theirs, -trie.n[theirs], mine))
            mine, theirs = mine[order], theirs[order]
            head = np.flatnonzero(np.diff(mine, prepend=-1))
            for w, t in zip(mine[head].tolist(), theirs[head].tolist(), strict=True):
                n = int(trie.n[t])
                if n >= most[w] and (n > most[w] or (text := trie.text(t)) < best[w]):
                    best[w] = trie.text(t) if n > most[w] else text
                    most[w] = n
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([word.take(pa.array(some)).cast(pa.string()), pa.array(count[some]), pa.array(most[some]), pa.array([best[i] for i in some], pa.string())], names=["word", "n_near", "best_n", "best"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0))
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return in_batches(words.select("word"), step, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for each word (word, n) with a neighbour at distance one; ``words`` should be stored."""
    spark = words.sparkSession
    shards = stored(tries(words), "tries")
    rounds, used = [], ROUND
    for r in shards.select("first", F.octet_length("trie").alias("size")).orderBy("first").collect():  # a row for a megabyte of words
        if used + r["size"] > ROUND:
            rounds.append([])
            used = 0
        rounds[-1].append(r["first"])
        used += r["size"]
    found = []
    for names in rounds:
        blobs = [r["trie"] for r in shards.where(F.col("first").between(names[0], names[-1])).collect()]  # ROUND bytes, or one trie
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, blobs))
        found.append(stored(_nearest(words, sent), "near-words"))
        sent.destroy()
    none = spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    if len(found) < 2:
        return found[0] if found else none
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return reduce(DataFrame.unionByName, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far each time. Forms must not lead back."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        moved = stored(join_hot(now, on, "root", "word", "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = LETTERS, occurrences: int = OCCURRENCES, drop: int = DROP, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word: its most frequent neighbour if that is ``times`` as frequent, and the last form it leads to."""
    words = stored(vocabulary(docs, least, occurrences, drop), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    best = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    rows = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best.alias("form"), F.when(best.isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
