"""Words of many texts at once, cut and hashed on their UTF-8 bytes.

Both word classes used here are separated by ASCII bytes only, so cutting bytes equals cutting code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ._shared import raw

_BYTE = np.arange(256)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
#: ``[^\x20\x09-\x0D]+``
SPACED = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))

_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE)
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each bit of ``h``."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one for each word
    bounds: np.ndarray  # words of text i: bounds[i] .. bounds[i + 1]
    starts: np.ndarray  # byte where the word starts, over all texts end to end
    ends: np.ndarray
    heads: list[np.ndarray]  # hashes of the words' first bytes, for each length asked for


def words(col: pa.Array, kind: np.ndarray = ALNUM, heads: tuple[int, ...] = ()) -> Words:
    """Lower-cased (A-Z) words of each text, as 64-bit hashes in order."""
    data, off = raw(col)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z, [np.zeros(0, np.uint64) for _ in heads])
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * _power(_P, n), dtype=np.uint64)])
    back = _power(_Q, n)[starts]

    def hashed(to: np.ndarray) -> np.ndarray:
        return mix((sums[to] - sums[starts]) * back ^ (to - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    first = [hashed(np.minimum(starts + k, ends)) for k in heads]
    return Words(hashed(ends), np.searchsorted(starts, off).astype(np.int64), starts, ends, first)


def word_hash(word: str) -> np.uint64:
    """The hash that ``words`` gives a single word."""
    return words(pa.array([word], pa.large_string())).hashes[0]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted by hash; shorter texts give their whole sequence as one.

    Returns hashes and bounds.
    """
    n = np.diff(w.bounds)
    docs = len(n)
    windows = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    h = np.zeros(0, np.uint64)
    if len(w.hashes):
        long = np.flatnonzero(n >= k)
        count = windows[long]
        begin = np.repeat(w.bounds[:-1][long], count) + _ranges(count)
        acc = np.full(len(begin), k, np.uint64)
        for i in range(k):
            acc = mix(acc * np.uint64(_P) + w.hashes[begin + i])
        doc = np.repeat(long, count)
        short = np.flatnonzero((n > 0) & (n < k))
        tail = np.zeros(len(short), np.uint64) + n[short].astype(np.uint64)
        for i in range(k - 1):
            more = n[short] > i
            tail[more] = mix(tail[more] * np.uint64(_P) + w.hashes[w.bounds[:-1][short[more]] + i])
        h, doc = np.concatenate([acc, tail]), np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
        return h, np.searchsorted(doc, np.arange(docs + 1)).astype(np.int64)
    return h, np.zeros(docs + 1, np.int64)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)


ranges = _ranges
