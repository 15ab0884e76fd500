"""Batches inside tasks, without memory that stays behind.

A Python worker lives longer than its tasks. Arrow's pool and the C library keep what a task has freed, so
workers of several stages would hold the largest batches of all of them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, a function for mapInArrow, that gives freed memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def copied(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Copies of ``rows`` rows at a time: while the next batch is read, nothing holds the one before."""
    batches = iter(batches)
    while (batch := next(batches, None)) is not None:
        count, start = batch.num_rows, 0
        while start < count:
            part = batch.slice(start, rows).take(pa.array(range(min(rows, count - start)), pa.int64()))
            start += rows
            if start >= count:
                batch = None
            yield part
            part = None
        batch = None
        pa.default_memory_pool().release_unused()
