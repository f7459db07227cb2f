"""Long arrays dealt by key: what the entries of a map task share a partition with is one packed row.

A task gathers entries up to a byte budget before it deals them, and there are as many parts as partitions, so
a task sends a row a part and budget, however its rows came in batches.
"""

from __future__ import annotations

import contextlib
import ctypes
import glob
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrymill.runtime import partitions

#: Bytes of entries that a task gathers.
GATHER = 16_000_000
#: What a worker keeps from task to task (see packing); it goes when the worker takes up a task of another kind.
kept: dict = {}


def release() -> None:
    """Give freed memory back to the machine: workers are used again, and what one stage has freed would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def begin() -> None:
    """Drop what the worker has kept for tasks of another kind."""
    if kept:
        kept.clear()
        release()


def one_thread() -> None:
    """Matrix products of this worker in one thread: those of several tasks on a machine would wait for each other."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):  # numpy's names for it have changed
                getattr(library, name)(1)
                break


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``function`` over batches, whose memory goes back when it is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        try:
            yield from function(batches)
        finally:
            release()

    return run


def cuts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each run of equal values."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(sorted_keys)) if len(first) else first


class Dealer:
    """Gathers equally long arrays, the first of which (uint64) holds the keys."""

    def __init__(self, parts: int, names: list[str], most: int = GATHER):
        self.parts, self.names, self.most = parts, names, most
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> bool:
        """Take entries; True if it is time to deal."""
        self.held.append(columns)
        self.size += sum(c.nbytes for c in columns)
        return self.size > self.most

    def gathered(self) -> list[np.ndarray]:
        """All entries so far, which the dealer gives away."""
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held.clear()
        self.size = 0
        return columns

    def packed(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        """A row for each part: ``part`` and the entries of each column as bytes."""
        part = (columns[0] % np.uint64(self.parts)).astype(np.int32)
        by = np.argsort(part)
        part = part[by]
        first, end = cuts(part)
        packed = []
        for c in columns:
            c = c[by]
            packed.append(pa.array([c[i:j].tobytes() for i, j in zip(first, end)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), *packed], names=["part", *self.names])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is left at the end of a task."""
        if self.held:
            yield self.packed(self.gathered())


def to_owners(rows: DataFrame) -> DataFrame:
    """Rows with a ``part`` in the partition of that number, part after part."""
    return rows.repartitionById(partitions(rows.sparkSession), "part").sortWithinPartitions("part")


def by_part(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of each part, joined to arrays; rows come sorted by part."""
    held: list[tuple[bytes, ...]] = []
    now = None
    for b in batches:
        for part, *row in zip(*(b.column(c).to_pylist() for c in ("part", *kinds))):
            if part != now and held:
                yield tuple(np.frombuffer(b"".join(c), t) for c, t in zip(zip(*held), kinds.values()))
                held = []
            now = part
            held.append(tuple(row))
    if held:
        yield tuple(np.frombuffer(b"".join(c), t) for c, t in zip(zip(*held), kinds.values()))
