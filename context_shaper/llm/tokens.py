"""Words of Arrow text columns as 64-bit hashes, computed for whole batches with numpy.

A batch's bytes are classified by a table of 256 entries, cut where the class changes, and every
token is hashed by a polynomial over random byte values followed by a mixing step.  Temporary
memory is bounded by a segment of about a megabyte; only eight bytes per token are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SEGMENT_BYTES = 1 << 20
BATCH_ROWS = 1000

_rng = np.random.default_rng(20_240_517)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_CASED = _BYTES.copy()
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def space_separated() -> np.ndarray:
    """Classes of the bytes: 0 for the six ASCII spaces, 1 for everything else."""
    classes = np.ones(256, np.uint8)
    classes[[32, 9, 10, 11, 12, 13]] = 0
    return classes


def words_and_marks() -> np.ndarray:
    """0 for spaces, 1 for letters, digits and all non-ASCII bytes, 2 for punctuation runs."""
    classes = space_separated()
    for mark in range(33, 127):
        if not chr(mark).isalnum():
            classes[mark] = 2
    return classes


def power(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        factors = np.full(max(size, SEGMENT_BYTES + 1), base & (2**64 - 1), np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows in them; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string())
    else:
        column = pc.fill_null(column, "")
    rows = len(column)
    if not rows:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def token_bounds(data: np.ndarray, edges: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens; none reaches over an edge."""
    kinds = classes[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    changes = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    cut[changes] = True
    cut[[0, -1]] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    tokens = kinds[starts] != 0
    return starts[tokens], ends[tokens]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cased: bool = False) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and do not overlap.  ``cased`` tells A from a."""
    table = _CASED if cased else _BYTES
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + SEGMENT_BYTES, "right"))
        last = max(last, first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        size = high - low
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(table[data[low:high]] * power(_BASE, size)[:size], out=sums[1:])
        begin, end = starts[first:last] - low, ends[first:last] - low
        value = (sums[end] - sums[begin]) * power(_BASE_INVERSE, size + 1)[begin]
        out[first:last] = mix(value + (end - begin).astype(np.uint64))
        first = last
    return out


def token_hashes(column: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and per row the position of its first one (with the total at the end)."""
    data, offsets = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = token_bounds(data, offsets, classes)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` neighbouring tokens."""
    count = max(len(hashes) - size + 1, 0)
    out = np.full(count, size, np.uint64)
    for place in range(size):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[place : place + count])
    return out


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: rows vary from a few bytes to megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per row."""
    sizes = np.fromiter((len(part) for part in parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts[:-1], cuts[1:]):
        if last > first:
            yield batch.slice(first, last - first)
