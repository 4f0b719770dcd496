"""Texts as numbers, in Arrow batches: the code points of all texts of a block at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task has as numbers at a time, if no single text is longer.
ROOM = 1 << 20


def points(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All code points in order, and how many each text has; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.cast(texts.fill_null(""), pa.large_string())
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint32), sizes
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = bytes(memoryview(data)[ends[0] : ends[-1]]).decode()
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), sizes


def parts(batches: Iterator[pa.RecordBatch], room: int = ROOM) -> Iterator[pa.Table]:
    """The rows of a task in tables of about `room` bytes of text in the first column, one row at least."""
    held, size = [], 0
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = int(total[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + room - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(total[hi - 1]) - before
            lo = hi
            if size >= room or lo < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def summed(codes: np.ndarray, weights: np.ndarray, dense: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their sums of weights."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if int(codes.max()) < dense:
        seen = np.flatnonzero(np.bincount(codes))
        return seen, np.bincount(codes, weights)[seen].astype(np.int64)
    seen, place = np.unique(codes, return_inverse=True)
    return seen, np.bincount(place, weights).astype(np.int64)
