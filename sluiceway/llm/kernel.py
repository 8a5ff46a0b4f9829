"""Vectorised text kernels over Arrow string columns.

They work on the UTF-8 buffer of a column, a slice of whole documents at a time,
so a batch of long texts needs no Python object per word.  Words are runs of bytes
outside ``[\\x20\\x09-\\x0D]``; hashes are 64-bit polynomials over a fixed byte
table, finished with an avalanche step.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def tidy(run):
    """The same function of batches, which gives unused memory back to the system when a task is done: workers live on."""

    def go(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library has no such call
            pass

    return go


U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values; a bijection."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
#: Byte values with A-Z folded to a-z.
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("q", inverse)):
            step = np.full(size, base, U)
            step[0] = 1
            _POWERS[key] = np.cumprod(step, dtype=U)
    return _POWERS["p"], _POWERS["q"]


class Slice:
    """Whole documents ``[first, last)`` of a batch: their bytes and offsets."""

    __slots__ = ("first", "last", "data", "offsets")

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets

    def __len__(self) -> int:
        return self.last - self.first


def slices(column: pa.Array, most: int = 1 << 18, rows: int | None = None) -> Iterator[Slice]:
    """Cut a string column into runs of whole documents of about ``most`` bytes, and ``rows`` documents at most; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column), first + rows if rows else len(column))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words:
    """Word boundaries of a slice: ``start``/``end`` byte positions, ``doc`` index, ``bounds`` of each document's words."""

    __slots__ = ("start", "end", "doc", "bounds", "slice")

    def __init__(self, s: Slice):
        inside = ~SPACE[s.data]
        n = len(inside)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edge = s.offsets[(s.offsets > 0) & (s.offsets < n)]
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, s.offsets)
        self.doc = np.repeat(np.arange(len(s)), np.diff(self.bounds))
        self.slice = s

    def hashes(self, fold: bool = True) -> np.ndarray:
        """64-bit hash of each word; A-Z count as a-z if ``fold``."""
        data = self.slice.data
        p, q = _powers(len(data) + 1)
        total = np.empty(len(data) + 1, U)
        total[0] = 0
        np.cumsum((_FOLDED if fold else _BYTES)[data] * p[: len(data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(U))


def shingles(words: Words, hashes: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of every k-word shingle; with ``whole``, a shorter document's words make one."""
    n = len(hashes)
    if n >= k:
        first = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
        h = np.zeros(len(first), U)
        for j in range(k):
            h = h * U(0xD6E8FEB86659FD93) + hashes[first + j]
        h = mix(h + U(k))
    else:
        first, h = np.zeros(0, np.int64), np.zeros(0, U)
    doc = words.doc[first]
    if whole:
        counts = np.diff(words.bounds)
        extra = np.flatnonzero((counts > 0) & (counts < k))
        if len(extra):
            add = []
            for d in extra:
                x = U(0)
                with np.errstate(over="ignore"):
                    for w in hashes[words.bounds[d] : words.bounds[d + 1]]:
                        x = x * U(0xD6E8FEB86659FD93) + w
                    add.append(x + U(counts[d]))
            h = np.concatenate([h, mix(np.array(add, U))])
            doc = np.concatenate([doc, extra])
            first = np.concatenate([first, words.bounds[extra]])
    return h, doc, first


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, by document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.empty(len(h), bool)
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, doc


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each ``[bounds[i], bounds[i+1])``; zero for empty ranges."""
    kind = values.dtype if values.dtype.kind in "uf" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:], dtype=kind)
    return total[bounds[1:]] - total[bounds[:-1]]


def varlen(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i is the little-endian bytes of ``values[bounds[i]:bounds[i+1]]``."""
    raw = np.ascontiguousarray(values)
    offsets = (bounds * raw.itemsize).astype(np.int64)
    kind = pa.binary() if offsets[-1] < 2**31 else pa.large_binary()
    offsets = offsets.astype(np.int32 if kind == pa.binary() else np.int64)
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
