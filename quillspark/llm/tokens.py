"""Token ids of whole texts with a public tokenizer file, encoded in segments that are remembered.

A byte-level tokenizer starts a new piece at the last white space before anything else, after it if it is a line end, and at plain
punctuation after a plain letter or digit. Cut at such points, found in the bytes of an Arrow column at once, a text falls into segments whose ids don't depend on their
neighbours. Each distinct segment is encoded by the tokenizers library once and its ids are gathered from a table from then on. The
result is that of encoding the whole text.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa

BYTE_BPE = "byte_bpe_50k.json"
#: Segments remembered by a worker, and words that the model gets in one string.
KEPT, JOINED = 400_000, 64
#: Kinds of bytes, as bits: white space that a cut may precede; bytes that surely begin no white space (code points of the blocks that
#: hold some begin with C2, E1, E2 or E3) and no special token (they begin with ``<``); plain letters and digits; plain punctuation that no
#: special token holds; plain letters; C3, and what makes a letter after it (U+00C0 to U+00FF but for two signs).
BLANK, SOLID, ALNUM, STOP, LETTER, LEAD, TAIL = 1, 2, 4, 8, 16, 32, 64
_KIND = np.zeros(256, np.uint8)
_KIND[[10, 32]] |= BLANK
_KIND[[*range(33, 60), *range(61, 127), *(b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3))]] |= SOLID
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= ALNUM
_KIND[[ord(c) for c in string.punctuation if c not in "<|>"]] |= STOP
_KIND[[*range(65, 91), *range(97, 123)]] |= LETTER
_KIND[0xC3] |= LEAD
_KIND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] |= TAIL


def tokenizer_file(name: str) -> str:
    """A path, or the name of a file of the installed public vocabularies; looked up where it is used, on executors too."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> np.ndarray:
    """The code points of the printable characters by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = np.arange(256, dtype="<u2")
    out[rest] = 256 + np.arange(len(rest))
    return out


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text begins and the last one ends; a null is empty. Nothing is copied."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text's begin, at a blank before something solid, after such a line end, and at a stop after a letter or digit.

    Letters are those of ASCII and of U+00C0 to U+00FF.
    """
    mark = np.zeros(len(data) + 1, np.uint8)
    kind = _KIND[data]
    blank = ((kind[:-1] & BLANK) << 1) & kind[1:]
    mark[:-2] = blank
    mark[at[1:] - 1] = 0  # what follows a text's last byte is another text
    mark[1:-1] |= blank * (data[:-1] == 10)
    ends = kind & ALNUM
    ends[1:] |= (((kind[:-1] & LEAD) << 1) & kind[1:]) >> 4
    mark[1:-1] |= (ends[:-1] << 1) & kind[1:]
    mark[at] = 1
    mark[len(data)] = 0
    return np.flatnonzero(mark)


def _letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a plain letter or one of two bytes of a letter of U+00C0 to U+00FF."""
    kind = _KIND[data]
    out = (kind & LETTER) > 0
    two = (((kind[:-1] & LEAD) << 1) & kind[1:]) > 0
    out[:-1] |= two
    out[1:] |= two
    return out


def _joins(token: bytes) -> bool:
    """Whether a token may reach from one word to the next where words are written on end, each after a space or a line end."""
    if not re.search(rb"[^\n][ \n]|\n.", token, re.DOTALL) or re.search(rb"[ \n]{2}", token):
        return False
    for piece in filter(None, re.split(rb"[ \n]", token)):
        try:
            if not piece.decode().isalpha():
                return False
        except UnicodeDecodeError:
            pass
    return True


class Encoder:
    """The library's tokenizer, and its model alone for segments that are one piece: a word of letters after at most a space.

    Such words go to the model in bulk, already written in the vocabulary's letters, `JOINED` on end: a string for each costs as much again
    as its merges. No token reaches over a word's end (`_joins`; with a vocabulary that has one that may, words stay apart), and a word
    without a space gets a line end before it as a mark, so the model merges each word as if alone. Token lengths tell where words end.
    """

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.model = Tokenizer(self.tokenizer.model)
        self.letters = _byte_letters()
        byte = {chr(c): b for b, c in enumerate(self.letters)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))
        self.joined = 1 if any(_joins(bytes(byte[c] for c in t)) for t in vocabulary if all(c in byte for c in t)) else JOINED
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros(0, self.width)
        self.start = np.zeros(1, np.int64)  # of each segment, and where the last one ends

    def _add(self, segments: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments)), strict=True))
        self.table = np.concatenate([self.table, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])

    def _ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments by number, one after the other, and where each begins and the last one ends."""
        low = self.start[which]
        length = self.start[which + 1] - low
        done = np.concatenate([[0], np.cumsum(length)])
        return self.table[np.arange(done[-1]) + np.repeat(low - done[:-1], length)], done

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, and how many each has."""
        mark = b"\n" if self.joined > 1 else b""
        written = [w if w[0] == 32 else mark + w for w in words]
        strings = [b"".join(written[i : i + self.joined]) for i in range(0, len(written), self.joined)]
        letters = self.letters[np.frombuffer(b"\0".join(strings), np.uint8)].tobytes().decode("utf-16-le").split(chr(self.letters[0]))
        found = self.model.encode_batch_fast(letters, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), self.width)
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(np.fromiter(map(len, written), np.int64, len(written)))) + 1
        lengths = np.diff(ends, prepend=0)
        if mark:
            marked = np.fromiter((w[0] != 32 for w in words), bool, len(words))
            ids = np.delete(ids, (ends - lengths)[marked])
            lengths = lengths - marked
        return ids, lengths

    def _learn(self, new: list[bytes]) -> None:
        """Encodes segments."""
        data = np.frombuffer(b"".join(new), np.uint8)
        size = np.fromiter(map(len, new), np.int64, len(new))
        at = np.cumsum(size) - size
        spaced = data[at] == 32
        letter = _letters(data)
        letter[at] |= spaced
        word = np.logical_and.reduceat(letter, at) & (size > spaced)
        for i in np.flatnonzero(~word & (np.maximum.reduceat(data, at) > 127)).tolist():
            word[i] = new[i].decode().removeprefix(" ").isalpha()
        if word.any():
            words = [new[i] for i in np.flatnonzero(word).tolist()]
            self._add(words, *self._words(words))
        if not word.all():
            other = [new[i] for i in np.flatnonzero(~word).tolist()]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([s.decode() for s in other], add_special_tokens=False)]
            self._add(other, np.fromiter(chain.from_iterable(found), self.width), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and the last one's end; a null text has none."""
        data, at = column_bytes(texts)
        begin = cuts(data, at)
        if not len(begin):
            return np.zeros(0, self.width), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(begin, len(data))
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        _, offsets, raw = segments.dictionary.buffers()
        raw, at_ = raw.to_pybytes(), np.frombuffer(offsets, np.int64)[: len(segments.dictionary) + 1].tolist()
        distinct = [raw[a:b] for a, b in zip(at_, at_[1:], strict=False)]
        which = list(map(self.known.get, distinct))
        if new := [s for s, i in zip(distinct, which, strict=True) if i is None]:
            if len(self.known) + len(new) > KEPT:  # only what is met here stays
                met = {s: i for s, i in zip(distinct, which, strict=True) if i is not None}
                ids, done = self._ids(np.fromiter(met.values(), np.int64, len(met)))
                self._forget()
                self._add(list(met), ids, np.diff(done))
            self._learn(new)
            which = map(self.known.__getitem__, distinct)
        ids, done = self._ids(np.fromiter(which, np.int64, len(distinct))[segments.indices.to_numpy()])
        return ids, done[np.searchsorted(begin, at)]


def id_bytes(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of ids as a column of little-endian bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each worker process, which outlives a task."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def in_slices(texts: list[str | None], most_chars: int = 2_000_000) -> list[slice]:
    """Runs of texts of bounded total length, one text at least."""
    return _runs([len(t) if t else 0 for t in texts], most_chars)


def column_slices(texts: pa.Array, most_bytes: int = 4 << 20) -> list[slice]:
    """Runs of a column's texts of bounded size, one text at least."""
    return _runs(np.diff(column_bytes(texts)[1]).tolist(), most_bytes)


def _runs(sizes: list[int], most: int) -> list[slice]:
    out, low, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > low and held + n > most:
            out.append(slice(low, i))
            low, held = i, 0
        held += n
    return [*out, slice(low, len(sizes))] if sizes else []
