"""Words and shingle hashes of whole texts, with memory bounded by a slice of the text."""
from __future__ import annotations

import numpy as np

SLICE = 1 << 20
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: One random number a byte; A-Z have those of a-z.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, 4096)
_DOWN = _powers(_INVERSE, 4096)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << n.bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    return _UP, _DOWN


def _slice_words(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    if not len(edge):
        return np.empty(0, np.uint64)
    starts, ends = edge[::2], edge[1::2]
    up, down = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    poly = (total[ends] - total[starts]) * down[starts]
    return _mix(poly + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, a run of bytes other than \\x20 and \\x09-\\x0D, A-Z as a-z.

    Texts are hashed slice by slice, each cut at white space.
    """
    if len(text) <= SLICE:
        return _slice_words(np.frombuffer(text, np.uint8))
    out, at, data = [], 0, np.frombuffer(text, np.uint8)
    while at < len(data):
        stop = min(at + SLICE, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        out.append(_slice_words(data[at:stop]))
        at = stop
    return np.concatenate(out)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of `width` words; of fewer words, the one of the whole
    sequence; of none, nothing."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = words[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(_BASE) + words[k:k + n]
    return np.unique(_mix(out + np.uint64(width)))
