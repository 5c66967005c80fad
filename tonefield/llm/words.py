"""Hashes of words and word n-grams, whole batches at a time in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random number for each byte, A-Z as a-z.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
PIECE = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, PIECE + 1)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of raw."""
    b = np.frombuffer(raw, np.uint8)
    word = ~BLANK[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * up[:-1], dtype=np.uint64)])
    value = (total[end] - total[start]) * down[start]
    return start, mix(value + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts in order: hashes, and bounds[k]:bounds[k + 1] are those of text k."""
    found, counts, k = [], [], 0
    while k < len(texts):
        n, size = k, 0
        while n < len(texts) and (n == k or size + len(texts[n]) < PIECE):
            size += len(texts[n]) + 1
            n += 1
        if n == k + 1 and size > PIECE:  # one long text: cut at blanks
            raw, a, total = texts[k], 0, 0
            while a < len(raw):
                b = min(len(raw), a + PIECE)
                while b < len(raw) and not BLANK[raw[b]]:
                    b += 1
                h = _hash_piece(raw[a:b])[1]
                found.append(h)
                total += len(h)
                a = b
            counts.append(total)
        else:
            group = texts[k:n]
            start, h = _hash_piece(b" ".join(group))
            edges = np.cumsum([0] + [len(t) + 1 for t in group])
            counts += np.diff(np.searchsorted(start, edges)).tolist()
            found.append(h)
        k = n
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum([0, *counts])


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; of fewer words, the whole sequence is the one shingle."""
    words, bounds = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + 1]
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
