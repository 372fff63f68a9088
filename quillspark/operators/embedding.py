"""Embedding backends by name. A backend turns a batch of texts into vectors; `deterministic` needs no model."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.errors import DimensionMismatch


# SHA-256's first state and the constants of its rounds, the fractions of roots of primes.
_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
_STATE, _ROUNDS = (np.array([int(p**root % 1 * 2**32) for p in _PRIMES[:n]], np.uint32) for root, n in ((1 / 2, 8), (1 / 3, 64)))
#: Hashes that are made at once; texts that are; and bytes of draws that a Python worker keeps.
HASHES, TEXTS, KEPT = 65_536, 256, 3 << 26


def _hashed(words: Sequence[str], dim: int) -> np.ndarray:
    """For each word, ``dim`` unsigned numbers: the first 32 bits of the SHA-256 of the word's own and a number. All go through the rounds together, in place."""
    seeds = np.frombuffer(b"".join([hashlib.sha256(w.encode()).digest() for w in words]), ">u4").reshape(-1, 8)
    block, state = np.zeros((16, len(words) * dim), np.uint32), np.repeat(_STATE[:, None], len(words) * dim, axis=1)
    block[:8], block[8] = np.repeat(seeds.T, dim, axis=1), np.tile(np.arange(dim, dtype=np.uint32), len(words))
    block[9], block[15] = 1 << 31, 36 * 8  # the end of the message, and its bits
    own, more = np.empty_like(block[:2])

    def mixed(x: np.ndarray, first: int, turns: Sequence[int], turned: bool = True) -> np.ndarray:
        np.right_shift(x, np.uint32(first), out=own)
        for n in turns:
            np.bitwise_xor(own, np.right_shift(x, np.uint32(n), out=more), out=own)
        for n in (first, *turns) if turned else turns:
            np.bitwise_xor(own, np.left_shift(x, np.uint32(32 - n), out=more), out=own)
        return own

    for i, constant in enumerate(_ROUNDS):
        w = block[i % 16]
        if i >= 16:
            w += block[(i + 9) % 16]
            w += mixed(block[(i + 1) % 16], 3, (7, 18), False)
            w += mixed(block[(i + 14) % 16], 10, (17, 19), False)
        a, b, c, d, e, f, g, h = (state[(k - i) % 8] for k in range(8))
        h += mixed(e, 6, (11, 25))
        h += w
        h += constant
        h += np.bitwise_xor(np.bitwise_and(np.bitwise_xor(f, g, out=own), e, out=own), g, out=own)
        d += h
        h += mixed(a, 2, (13, 22))
        h += np.bitwise_or(np.bitwise_and(np.bitwise_xor(a, b, out=own), c, out=own), np.bitwise_and(a, b, out=more), out=own)
    return (state[0] + _STATE[0]).reshape(-1, dim)


def _drawn(words: Sequence[str], dim: int) -> np.ndarray:
    """`_hashed`, a bounded number at a time."""
    step = max(1, HASHES // dim)
    return np.concatenate([np.empty((0, dim), np.uint32), *[_hashed(words[i : i + step], dim) for i in range(0, len(words), step)]])


def _numbers(drawn: np.ndarray) -> np.ndarray:
    """Numbers from -1 to 1."""
    return drawn / float(0xFFFFFFFF) * 2.0 - 1.0


class _Memory:
    """Draws of words, `KEPT` bytes at most. When they are full, those that were met again stay, half of them at most."""

    def __init__(self, dim: int) -> None:
        self.most = max(2, KEPT // (4 * dim))
        self.at: dict[str, int] = {}
        self.rows, self.met = np.empty((self.most, dim), np.uint32), np.zeros(self.most, bool)

    def find(self, words: Sequence[str]) -> np.ndarray:
        """The row of each word; there are ``most`` / 2 words at most."""
        at, new = self.at, list(dict.fromkeys(w for w in words if w not in self.at))
        if len(at) + len(new) > self.most:
            kept = [w for w, i in at.items() if self.met[i]][-(self.most // 2) :]
            self.rows[: len(kept)] = self.rows[[at[w] for w in kept]]
            at = self.at = {w: i for i, w in enumerate(kept)}
            self.met[:] = False
            new = list(dict.fromkeys(w for w in words if w not in at))
        known = len(at)
        self.rows[known : known + len(new)] = _drawn(new, self.rows.shape[1])
        at.update(zip(new, range(known, known + len(new)), strict=True))
        found = np.array([at[w] for w in words], np.int64)
        self.met[found[found < known]] = True
        return found


_memory = lru_cache(maxsize=2)(_Memory)


def deterministic(texts: Sequence[str], dim: int) -> list[np.ndarray]:
    """The draw of the text (white space collapsed) and twice that of each of its words, at unit length, rounded to 6 places.

    A draw is ``dim`` numbers from -1 to 1, each from the SHA-256 of the word's own and its number. Words are runs of two word characters or more
    in lower case, repeats counted; a text without one counts as a word itself, an empty one as ``_empty_``.
    """
    memory, out = _memory(dim), []
    for low in range(0, len(texts), TEXTS):
        clean = [re.sub(r"\s+", " ", t).strip() for t in texts[low : low + TEXTS]]
        counts = [Counter(w for w in re.findall(r"\w+", t.lower()) if len(w) > 1) or Counter([t.lower() or "_empty_"]) for t in clean]
        sums, met = _numbers(_drawn(clean, dim)), [(i, w, n) for i, c in enumerate(counts) for w, n in c.items()]
        for part in range(0, len(met), memory.most // 2):
            of, words, times = zip(*met[part : part + memory.most // 2], strict=True)
            rows, weight, ends = memory.find(words), 2.0 * np.array(times)[:, None], np.searchsorted(of, np.arange(len(clean) + 1))
            for i in range(of[0], of[-1] + 1):
                own = slice(ends[i], ends[i + 1])
                sums[i] = np.concatenate([sums[i : i + 1], _numbers(memory.rows[rows[own]]) * weight[own]]).sum(axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        out += list(np.round(sums / np.where(length, length, 1.0), 6))
    return out


BACKENDS: dict[str, Callable[[Sequence[str], int], list[np.ndarray]]] = {"deterministic": deterministic}


def register_backend(name: str, embed: Callable[[Sequence[str], int], list[np.ndarray]]) -> None:
    BACKENDS[name] = embed


def embed(text: Column, backend: str = "deterministic", dim: int = 1024) -> Column:
    """A vector column; texts go to the backend in Arrow batches."""
    make = BACKENDS[backend]

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([v.astype(np.float32) for v in make([t or "" for t in batch], dim)])

    return run(text)


def check_dimension(found: int, expected: int) -> None:
    """Refuses stored and query vectors of different lengths, before a search is planned."""
    if found != expected:
        raise DimensionMismatch(f"vectors have {found} dimensions, the corpus has {expected}")
