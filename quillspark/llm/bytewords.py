"""Words of whole texts and their CRC-32, from the bytes of an Arrow column at once: no Python object for a word.

A column is taken in slices of some megabytes (a longer text is a slice of its own), and memory is a small multiple of a slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Words of more bytes than this are hashed one by one, so that one very long word doesn't cost a pass for each of its bytes.
LONG = 48
SLICE = 4 << 20
_BYTE = np.arange(256, dtype=np.uint32)


def _table() -> np.ndarray:
    """The CRC-32 step of each byte, by its definition."""
    out = _BYTE.copy()
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


TABLE = _table()
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_ALPHA = (LOWER >= 97) & (LOWER <= 122)
_WORD = (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | _ALPHA


def in_word(data: np.ndarray) -> np.ndarray:
    """Digits, letters a to z, and all bytes beyond ASCII."""
    return _WORD[data]


def in_run(data: np.ndarray) -> np.ndarray:
    """Letters a to z and the two bytes of U+00C0 to U+00FF, which alone begin with 0xC3."""
    lead = data == 0xC3
    return _ALPHA[data] | lead | np.concatenate([[False], lead[:-1]])


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """First row and rows of each slice of about ``most`` bytes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def words(texts: pa.Array, inside: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A to Z lower-cased, start and length of each run of bytes ``inside``, and its row. Null texts have none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[low:high]] if high > low else np.zeros(0, np.uint8)
    own = inside(data) if len(data) else np.zeros(0, bool)
    first = np.zeros(len(data) + 1, bool)
    first[offsets - low] = True  # a run ends with its text
    start = np.flatnonzero(own & ~(np.concatenate([[False], own])[:-1] & ~first[:-1]))
    size = np.flatnonzero(own & ~(np.concatenate([own, [False]])[1:] & ~first[1:])) + 1 - start
    row = np.searchsorted(offsets - low, start, "right") - 1
    if texts.null_count:  # the bytes under a null, if any, are no text
        valid = texts.is_valid().to_numpy(zero_copy_only=False)[row]
        start, size, row = start[valid], size[valid], row[valid]
    return data, start, size, row


def continued(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC register after each word's bytes, from a register before them. The CRC is the register inverted, and 0xFFFFFFFF begins."""
    state = state.copy()
    short = np.minimum(size, LONG + 1)
    order = np.argsort(-short, kind="stable")
    n_long = int(np.count_nonzero(short > LONG))
    for i in order[:n_long]:
        state[i] = zlib.crc32(data[start[i] : start[i] + size[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    rest = order[n_long:]
    own, at = state[rest], start[rest]
    alive = len(rest) - np.cumsum(np.bincount(short[rest], minlength=LONG + 1))  # words of more than k bytes, which come first
    for k in range(LONG):
        n = alive[k]
        if not n:
            break
        own[:n] = TABLE[(own[:n] ^ data[at[:n] + k]) & 0xFF] ^ (own[:n] >> 8)
    state[rest] = own
    return state


def gram_buckets(texts: pa.Array, n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket (CRC-32 of the words joined by one space, modulo ``count``) and row of each run of 1 to ``n`` words, and the words of each row."""
    data, start, size, row = words(texts, in_word)
    state = continued(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, size)
    found, rows = [(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(count)], [row]
    for k in range(1, n):
        same = np.flatnonzero(row[k:] == row[: len(row) - k]) if len(row) > k else np.zeros(0, np.int64)
        full = np.zeros(len(start), np.uint32)
        full[same] = continued(TABLE[(state[same] ^ 32) & 0xFF] ^ (state[same] >> 8), data, start[same + k], size[same + k])
        found.append((full[same] ^ np.uint32(0xFFFFFFFF)) % np.uint32(count))
        rows.append(row[same])
        state = full  # a longer n-gram begins with a shorter one, so only the rows of `same` are read again
    return np.concatenate(found), np.concatenate(rows), np.bincount(row, minlength=len(texts))
