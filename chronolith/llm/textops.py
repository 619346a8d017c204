"""Vectorised text primitives over Arrow string buffers.

All functions work on the UTF-8 bytes of a whole Arrow batch at once, cut into chunks of whole
documents so that the temporary arrays stay bounded; one document larger than a chunk gets a
chunk of its own and is never cut.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the same as a maximal
run of such code points, as UTF-8 continuation bytes lie above both ranges.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: One less than a power of two, as tables by byte have an entry more.
CHUNK_BYTES = (2 << 20) - 1
_LIBC = ctypes.CDLL(None)


def _return_freed_memory() -> None:
    """Workers are reused, and what an allocator keeps counts against the executor: let arrays of a
    megabyte or more come from the system and go back to it as soon as they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(_LIBC, "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


_return_freed_memory()


def trim() -> None:
    """Give what is free back to the system: a worker that waits for its next task counts against its executor, too."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        inv = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [_geometric(_BASE, n), _geometric(inv, n)]
    return _POWERS[0], _POWERS[1]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step = 1
    while step < n:
        end = min(n, 2 * step)
        out[step:end] = out[: end - step] * np.uint64(pow(base, step, 1 << 64))
        step = end
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Consecutive documents of a batch: bytes, document bounds in them, first row number."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(col: pa.Array, chunk_bytes: int = CHUNK_BYTES, max_docs: int = 1 << 22) -> Iterator[Chunk]:
    """Chunks of whole documents, at most ``max_docs`` in each; a null is an empty document."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + chunk_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + max_docs, len(col))
        yield Chunk(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo)
        lo = hi
    trim()


def words(c: Chunk, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (lower-cased A-Z on demand), word starts, word ends, and each document's first word
    number as bounds (length n + 1)."""
    data = LOWER[c.data] if lower else c.data
    inside = ~WS[data]
    return (data, *runs(inside, c.offsets))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a document's bound."""
    n = len(inside)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = inside[inner]
    stop[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows of each document, in order, and bounds by document. A document
    of 1 to k - 1 words has one window, its whole sequence; one without words has none."""
    counts = np.diff(bounds)
    full = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    out_counts = np.where(short, 1, full)
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    out = np.empty(int(out_bounds[-1]), np.uint64)
    if len(h) >= k:
        w = mix(h[: len(h) - k + 1] + np.uint64(k))
        for i in range(1, k):
            w = mix(w * np.uint64(0xFF51AFD7ED558CCD) + h[i : len(h) - k + 1 + i])
        at = positions(bounds[:-1], full)
        out[positions(out_bounds[:-1], full)] = w[at]
    for d in np.flatnonzero(short):
        w = np.uint64(0x1234567)
        with np.errstate(over="ignore"):
            for x in h[bounds[d] : bounds[d + 1]]:
                w = mix(np.array([w * np.uint64(0xFF51AFD7ED558CCD) + x], np.uint64))[0]
        out[out_bounds[d]] = w
    return out, out_bounds


def positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def owner(bounds: np.ndarray) -> np.ndarray:
    """The document of each element, from bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
