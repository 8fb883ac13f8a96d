"""Whole-array text work on Arrow string columns: slices, code points, words and rolling hashes.

Every function here covers the whole of each text. A slice holds whole documents; a document longer than the slice
size is a slice of its own, so memory follows the longest document rather than the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SLICE_BYTES = 1 << 20
LETTER, DIGIT, SPACE, OTHER, BREAK = 0, 1, 2, 3, 4
#: Odd, with an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls: a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `size` bytes of text each, at least one row."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def released(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run, which gives memory that it has freed back to the system when it ends: Python workers live on between tasks."""

    @wraps(run)
    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # only glibc has it
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return ending


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls, offsets from 0."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def codepoints(array: pa.Array, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, where each text starts, where it ends); `gap` NULs stand after each text."""
    texts = array.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = ("\0" * gap).join(texts) + "\0" * gap
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths + gap) - lengths - gap
    return cp, starts, starts + lengths


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, DIGIT, SPACE or OTHER of every code point, by Unicode's categories."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


@lru_cache(1)
def word_table() -> np.ndarray:
    """Whether a code point belongs to a word: letters, marks, digits."""
    table = np.zeros(0x110000, bool)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(0x110000))
    for m in regex.finditer(r"[\p{L}\p{N}\p{M}]+", every):
        table[m.start() : m.end()] = True
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input; for scalars and arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, BASE)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, BASE_INVERSE)], dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def span_sums(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What summed_spans needs of these code points."""
    up, down = _powers.get(len(cp) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mix64(cp.astype(np.uint64) + np.uint64(0x51)) * up[: len(cp)], out=sums[1:])
    return sums, down


def summed_spans(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, equal for equal spans wherever they stand."""
    with np.errstate(over="ignore"):
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """summed_spans of the code points' sums."""
    return summed_spans(*span_sums(cp), starts, ends)


def words(array: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of each word of the lower-cased texts, where each text's words start plus the end, (cp, starts, ends))."""
    cp, _, ends = codepoints(pc.utf8_lower(array), 1)
    inside = word_table()[cp]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.r_[0, np.searchsorted(first, ends)]
    return span_hashes(cp, first, last), at, (cp, first, last)


def ragged(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, ... for lengths[0] items, then the same for the next."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    shift = begins - (np.cumsum(lengths) - lengths)
    return out + np.repeat(shift, lengths)


def spread(column: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(column, kind))
