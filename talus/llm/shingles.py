"""Word shingles of whole texts as sets of 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
#: Cached words in one worker; the cache starts anew when it is full.
CACHE_WORDS = 250_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word):
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_cache = _Hashes()


def shingle_sets(texts: list[bytes | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts one after another, sorted, and n + 1 offsets.

    Words lie between ASCII white space, A-Z in lower case. A text of fewer words
    has its whole sequence as one shingle; one without words has an empty set.
    """
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    flat: list[bytes] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            flat += t.lower().split()
        counts[i + 1] = len(flat)
    h = np.fromiter(map(_cache.__getitem__, flat), np.uint64, len(flat))
    sets, offsets = [], np.zeros(len(texts) + 1, np.int64)
    n = len(h) - words + 1
    shingles = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        shingles += mixed(h[k : k + n] + _C[k]) * _C[k]
    shingles = mixed(shingles)
    starts, ends = counts[:-1].tolist(), counts[1:].tolist()
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if b - a >= words:
            s = np.unique(shingles[a : b - words + 1])
        elif b > a:
            s = mixed(np.array([sum(int(x) * int(_C[k]) for k, x in enumerate(h[a:b].tolist(), 1)) + b - a & 0xFFFFFFFFFFFFFFFF], np.uint64))
        else:
            s = h[:0]
        sets.append(s)
        offsets[i + 1] = offsets[i] + len(s)
    return (np.concatenate(sets) if sets else h[:0]), offsets


def digests(sets: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set; none for an empty one."""
    raw = memoryview(np.ascontiguousarray(sets).view(np.uint8))
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def minhashes(sets: np.ndarray, offsets: np.ndarray, symbols: int, seed: int = 11) -> np.ndarray:
    """Signatures (texts, symbols) of 16-bit minhash symbols; rows of empty sets are 0."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, symbols, np.uint64)
    out = np.zeros((len(offsets) - 1, symbols), np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        at = offsets[:-1][some]
        for k in range(symbols):
            out[some, k] = (mixed(np.minimum.reduceat(sets * odd[k] + plus[k], at)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out
