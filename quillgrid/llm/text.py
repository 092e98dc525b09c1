"""Vectorised text kernels over UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits:
a polynomial over a table of random byte values modulo 2**64, then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at a time; bounds the working memory of a task.
BLOCK = 1 << 20
_rng = np.random.default_rng(20250801)
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=U) | U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", BASE), ("_inverse", INVERSE)):
            out = np.full(size, base, U)
            out[0] = 1
            globals()[name] = np.multiply.accumulate(out)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (null: empty) and the n+1 offsets in them."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def keep_freed() -> None:
    """Use freed memory again instead of fetching new pages for every large array (where the C library has these settings)."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes of text (a longer row stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def spans_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one text."""
    word = ~IS_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    if len(word) and word[-1]:
        edge = np.concatenate((edge, [len(word)]))
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending spans, block by block."""
    out = np.empty(len(starts), U)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        stop = int(np.searchsorted(ends, base + BLOCK, "right"))
        stop = max(stop, done + 1)
        top = int(ends[stop - 1]) - base
        pw, inv = powers(top + 1)
        total = np.empty(top + 1, U)
        total[0] = 0
        np.cumsum(BYTE_VALUES[data[base : base + top]] * pw[:top], out=total[1:])
        s, e = starts[done:stop] - base, ends[done:stop] - base
        out[done:stop] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        done = stop
    return out


class Words:
    """The words of several texts: hash, span and owner of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        parts_s, parts_e = [], []
        #: A word ends where its text ends: texts are cut apart after the scan for spaces.
        begin = 0
        while begin < len(data):
            end = min(begin + BLOCK, len(data))
            while end < len(data) and not IS_SPACE[data[end]]:
                end += 1
            s, e = spans_of(data[begin:end])
            parts_s.append(s + begin)
            parts_e.append(e + begin)
            begin = end
        s = np.concatenate(parts_s) if parts_s else np.zeros(0, np.int64)
        e = np.concatenate(parts_e) if parts_e else np.zeros(0, np.int64)
        inner = np.sort(offsets[1:-1])
        cuts = inner[run_starts(inner)]
        at = np.searchsorted(s, cuts, "right") - 1
        hit = (at >= 0) & (len(s) > 0)
        hit[hit] = (s[at[hit]] < cuts[hit]) & (cuts[hit] < e[at[hit]])
        if hit.any():
            s = np.sort(np.concatenate((s, cuts[hit])))
            e = np.sort(np.concatenate((e, cuts[hit])))
        self.starts, self.ends = s, e
        #: bounds[i]:bounds[i+1] are the words of text i
        self.bounds = np.searchsorted(s, offsets, "left")
        self.hashes = span_hashes(data, s, e)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    pw, inv = powers(len(h) + 1)
    total = np.empty(len(h) + 1, U)
    total[0] = 0
    np.cumsum(h * pw[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * inv[:n])


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first entry of each run of equal keys."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
