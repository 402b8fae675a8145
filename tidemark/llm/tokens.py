"""Vectorised ASCII-white-space words and their 64-bit hashes, straight from UTF-8 buffers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of [\x20\x09-\x0D], the white space of every contract here (fixed values).
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE)] = True
#: Bytes that end a word of letters and digits: all ASCII ones that are neither.
IS_BREAK = np.ones(256, bool)
IS_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time, and the longest span that is hashed by running sums.
_BLOCK, _LONG = 1 << 20, 1 << 16
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(_BLOCK + _LONG + 1, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand; ``starts`` ascend.

    Running sums are taken over a block of bytes at a time, so memory beyond the result doesn't grow with the text; the rare
    spans of over 64 KB are hashed each by itself.
    """
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = int(np.searchsorted(starts, lo + _BLOCK))
        part = data[lo : lo + _BLOCK + _LONG]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, size = starts[at:stop] - lo, ends[at:stop] - starts[at:stop]
        out[at:stop] = mix((sums[np.minimum(s + size, len(part))] - sums[s]) * down[s] + size.astype(np.uint64))
        for k in np.flatnonzero(size > _LONG).tolist():
            out[at + k] = xxhash.xxh3_64_intdigest(data[starts[at + k] : ends[at + k]].tobytes())
        at = stop
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes outside ``breaks``, and the index of each row's first (one more than rows)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
