"""Texts of an Arrow batch as one byte array, cut into words with numpy.

All functions work on slices of a batch whose size is bounded by ``SLICE_BYTES`` (a longer text is a
slice of its own), so that memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows; null counts as empty. Nulls are filled run by run, so that the batch is not copied."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    width = np.int32 if pa.types.is_string(texts.type) else np.int64
    ends = _offsets(texts, width)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(ends, int(ends[first]) + most, "right")) - 1)
        run = texts.slice(first, end - first)
        if run.null_count:
            run = pc.fill_null(run, "")
        offsets = _offsets(run, width).astype(np.int64)
        data = np.frombuffer(run.buffers()[2], np.uint8) if run.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield first, end, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        first = end


def _offsets(texts: pa.Array, width: type) -> np.ndarray:
    """Where the texts of an array begin in its bytes, and where the last one ends."""
    return np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, width)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, (n + 1).bit_length()))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of True bytes; runs end with their text."""
    if not inside.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < inside.size]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space and the controls 9 to 13."""
    return runs(~_SPACE[data], offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span of bytes."""
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(data.size)[0][: data.size], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(sums.size)[1][starts])
