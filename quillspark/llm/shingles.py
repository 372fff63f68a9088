"""Hashes of word shingles for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x5851F42D4C957F2D  # an odd multiplier
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def shingles(texts: Sequence[str | None], words: int, lower: bool = False) -> list[np.ndarray]:
    """For each text, the 64-bit hashes of its shingles in order, repeats included.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``lower`` turns A-Z to lower case. A text of fewer words has one shingle, all its words; one
    without words, or null, has none.
    """
    raw = [(t or "").encode() for t in texts]
    if not raw:
        return []
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    low, high = edge[0::2], edge[1::2]  # the last byte is a separator, so each word ends
    up, down = _tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))
    first = np.searchsorted(low, starts)  # words of text i: first[i] to first[i + 1]
    many = np.diff(first)
    if words == 1:
        run = word
    else:
        run = word[: max(0, len(word) - words + 1)].copy()
        for j in range(1, words):
            run = mix(run * np.uint64(_P) + word[j : j + len(run)])
    out = []
    for i, n in enumerate(many.tolist()):
        at = first[i]
        if n >= words:
            out.append(run[at : at + n - words + 1])
        elif n:
            h = word[at : at + 1]
            for j in range(1, n):
                h = mix(h * np.uint64(_P) + word[at + j : at + j + 1])
            out.append(mix(h + np.uint64(n)))  # not equal to the shingle of a longer text by chance of form
        else:
            out.append(run[:0])
    return out
