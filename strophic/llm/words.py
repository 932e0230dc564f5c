"""Words and word hashes of whole texts, vectorised over Arrow buffers.

A text is its UTF-8 bytes. A 256-entry table says which bytes belong to words; a word is a maximal run
of them inside one document. Words get a 64-bit hash that mixes 8 bytes at a time; it isn't linear in the bytes, so
that no simple family of words has equal hashes. Hashes propose; callers whose contract says so compare bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_STEP = 0x9E3779B97F4A7C15
#: Multipliers of places in a run; odd, so that no place loses bits.
_PLACES = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
#: Byte ranges longer than this are hashed one by one with xxh3.
_LONG = 32

_every = np.arange(256)
#: Words of the form [^\x20\x09-\x0D]+
SPACED = ~((_every == 0x20) | ((_every >= 0x09) & (_every <= 0x0D)))
#: Words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = ((_every >= 0x30) & (_every <= 0x39)) | ((_every >= 0x61) & (_every <= 0x7A)) | (_every >= 0x80)
_LOWER = np.where((_every >= 0x41) & (_every <= 0x5A), _every + 32, _every).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values (public splitmix64 constants)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each byte, as little-endian integers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _chunks(length: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each 8 bytes of byte ranges: the ranges that reach there, the place, and a mask of their bytes."""
    at, place = np.flatnonzero(length <= longest), 0
    at = at[length[at] > 0]
    while len(at):
        left = np.minimum(length[at] - place, 8).astype(U)
        yield at, place, ~U(0) >> (U(64) - left * U(8))
        place += 8
        at = at[length[at] > place]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: mixed 8 bytes at a time, so equal hashes of ranges of equal length up to 8 are equal bytes."""
    length = end - start
    h = mix(length.astype(U) * U(_STEP))
    eights = _eights(data)
    for at, place, mask in _chunks(length, _LONG):
        h[at] = mix(h[at] * U(_STEP) + (eights[start[at] + place] & mask))
    for k in np.flatnonzero(length > _LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return h


def same_bytes(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether byte ranges of two texts are equal, byte by byte."""
    same, mine, theirs = np.ones(len(length), bool), _eights(data), _eights(other)
    for at, place, mask in _chunks(length, _LONG):
        same[at] &= (mine[start[at] + place] & mask) == (theirs[other_start[at] + place] & mask)
    for k in np.flatnonzero(length > _LONG).tolist():
        same[k] = np.array_equal(data[start[k] : start[k] + length[k]], other[other_start[k] : other_start[k] + length[k]])
    return same


class Words:
    """Words of some documents. ``start``/``end``: byte ranges in ``data``; ``off``: first word of each document."""

    def __init__(self, data: np.ndarray, doc_off: np.ndarray, table: np.ndarray = SPACED, lower: bool = False):
        if lower:
            data = _LOWER[data]
        self.data, self.doc_off = data, doc_off
        inside = table[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[doc_off] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.off = np.searchsorted(self.start, doc_off)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), joined by one space."""
        raw = self.data
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` items; run i begins at item i. Runs that cross documents are the caller's to drop.

    Every place has a multiplier of its own, so no order of two items is worse than any other.
    """
    size = max(0, len(h) - n + 1)
    out = np.full(size, U(n))
    for j in range(n):
        out += h[j : j + size] * _place(j)
    return mix(out)


def _place(j: int) -> np.uint64:
    return _PLACES[j] if j < len(_PLACES) else mix(np.array([j], U))[0] | U(1)


def run_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of any lengths: :func:`rolling` for each."""
    out = length.astype(U)
    for j in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > j)
        out[at] += h[start[at] + j] * _place(j)
    return mix(out)


def release_memory() -> None:
    """Give memory that a finished task no longer uses back to the system: a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def slices(texts: pa.Array, budget: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``budget`` bytes of text: first row, end row, bytes, offsets. Nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + budget, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
