"""A bitmap of doc_ids, of fixed size, that spares a join most rows it does not want.

It is a filter before an exact join: false marks cost time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from context_shaper.llm.tokens import mix

MARK_BUCKETS = 1 << 23
MARK_BLOCK = 1 << 15


def mark_bucket(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(MARK_BUCKETS - 1)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's wanted documents, as blocks of bits."""
    marks = np.zeros(MARK_BUCKETS, bool)
    for batch in batches:
        marks[mark_bucket(batch.column(0).to_numpy(zero_copy_only=False))] = True
    blocks = marks.reshape(-1, MARK_BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array([np.packbits(blocks[b]).tobytes() for b in used], pa.binary())],
        names=["block", "bits"],
    )


def _add_marks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(MARK_BLOCK // 8, np.uint8)
    for batch in batches:
        for block in batch.column("bits"):
            total |= np.frombuffer(block.as_buffer(), np.uint8)
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "bits": [total.tobytes()]})


def marks_of(ids: DataFrame) -> np.ndarray:
    """A bit for each bucket that holds one of these doc_ids: a table of fixed size."""
    blocks = ids.mapInArrow(_mark, "block int, bits binary").groupBy("block").applyInArrow(
        _add_marks, "block int, bits binary"
    )
    marks = np.zeros((MARK_BUCKETS // MARK_BLOCK, MARK_BLOCK), bool)
    for row in blocks.toLocalIterator():
        marks[row.block] = np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
    return marks.reshape(-1)


def marked_rows(marks: np.ndarray, column: pa.Array) -> pa.Array:
    """A mask of the rows whose id may be wanted; a missing id always may."""
    ids = column.fill_null(0).to_numpy(zero_copy_only=False)
    mask = marks[mark_bucket(ids)]
    if column.null_count:
        mask = mask | column.is_null().to_numpy(zero_copy_only=False)
    return pa.array(mask)
