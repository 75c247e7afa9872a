"""Words of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

Texts are handled in runs of half a MB, so memory follows the run, not the Arrow batch. A text
longer than a run is hashed piece by piece, cut between words; it is never cut short.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)

#: Bytes of words: all but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words: a-z, 0-9 and whatever isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


@dataclass
class Run:
    """Texts lo..hi of a batch. words: hashes in order; first: where each text's words begin, with the end."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    words: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _hashes(data: np.ndarray, bounds: np.ndarray, word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word. bounds: places where a word can't go on although the bytes would allow it."""
    low = fold[data]
    inside = word[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    bounds = bounds[bounds < len(data)]
    begins[bounds] = inside[bounds]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), at
    kept = np.flatnonzero(inside)
    head = np.searchsorted(kept, at)
    length = np.diff(np.append(head, len(kept)))
    power = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
    place = np.arange(len(kept)) - np.repeat(head, length)
    return mixed(np.add.reduceat(_BYTE[low[kept]] * power[place], head) + length.astype(np.uint64) * _STEP), at


def runs(column: pa.Array, word: np.ndarray = NOT_SPACE, fold: np.ndarray = FOLD) -> Iterator[Run]:
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1)
        base = offsets[lo]
        own, inner = data[base : offsets[hi]], offsets[lo : hi + 1] - base
        if len(own) <= 2 * RUN_BYTES:
            words, at = _hashes(own, inner[:-1], word, fold)
        else:  # one long text
            parts, places, start = [], [], 0
            while start < len(own):
                end = min(len(own), start + RUN_BYTES)
                while end < len(own):  # on to the next place between words
                    gap = np.flatnonzero(~word[fold[own[end : end + RUN_BYTES]]])
                    end = min(len(own), end + (int(gap[0]) if len(gap) else RUN_BYTES))
                    if len(gap):
                        break
                h, p = _hashes(own[start:end], np.zeros(1, np.int64), word, fold)
                parts.append(h)
                places.append(p + start)
                start = end
            words, at = np.concatenate(parts), np.concatenate(places)
        yield Run(lo, hi, own, inner, words, np.searchsorted(at, inner))
        lo = hi
    trim()


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mixed(out * _STEP + words[k : n + k])
    return out


def whole(words: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a window; differs from any window's."""
    out = np.full(1, np.uint64(len(words)) + np.uint64(1 << 40))
    for w in words:
        out = mixed(out * _STEP + w)
    return out[0]
