"""Vectorised word hashing for tasks: every byte is looked up once, no Python loop over words."""
from __future__ import annotations

import numpy as np

#: Texts are hashed in blocks of about so many bytes, cut between words, so temporaries stay small.
BLOCK = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_u = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _u(seed * 1_000_003)) * _u(0x9E3779B97F4A7C15))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(seed: int, n: int) -> np.ndarray:
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        size = 1 << max(8, (n - 1).bit_length())
        factor = stream(seed, 1)[0] | _u(1)
        have = _POWERS[seed] = np.concatenate(([_u(1)], np.full(size - 1, factor, np.uint64))).cumprod(dtype=np.uint64)
    return have


_TABLES = {seed: np.where(_IS_SPACE, _u(0), stream(seed + 100, 256)) for seed in (1, 2)}


def _block(a: np.ndarray, seed: int) -> np.ndarray:
    space = _IS_SPACE[a]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(first):
        return np.empty(0, np.uint64)
    a = a[first[0]:]
    first = first - first[0]
    sizes = np.diff(np.append(first, len(a)))
    at = np.arange(len(a)) - np.repeat(first, sizes)
    return mix(np.add.reduceat(_TABLES[seed][a] * _powers(seed, int(sizes.max()))[at], first))


def word_hashes(data: bytes, seed: int = 1) -> np.ndarray:
    """uint64 hash of each word, that is each maximal run of bytes that aren't ASCII white space."""
    if len(data) <= BLOCK:
        return _block(np.frombuffer(data, np.uint8), seed)
    parts, at = [], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(whole):
        end = min(at + BLOCK, len(whole))
        while end < len(whole):  # up to the next white space
            gap = np.flatnonzero(_IS_SPACE[whole[end:end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(whole))
        parts.append(_block(whole[at:end], seed))
        at = end
    return np.concatenate(parts)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, put together from two shorter grams."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    have = {1: words}

    def make(k: int) -> np.ndarray:
        if k not in have:
            half = 1 << ((k - 1).bit_length() - 1)
            have[k] = pair(make(half), make(k - half), half)
        return have[k]

    return make(n)


def pair(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """Hash of gram i of ``a`` followed by gram i + by of ``b``."""
    n = min(len(a), len(b) - by)
    return mix(a[:n] * _u(0x9E3779B97F4A7C15) + b[by:by + n] + _u(0x632BE59BD9B4E019))


def least(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive entries."""
    done = 1
    while done < width and len(a):
        by = min(done, width - done)
        a = np.minimum(a[:-by], a[by:]) if len(a) > by else a[:0]
        done += by
    return a


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
