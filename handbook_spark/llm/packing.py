"""Values packed by bucket: one row per step of a task and bucket instead of one row per value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext


def packed(buckets: np.ndarray, number: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) for each bucket that has values."""
    order = np.argsort(buckets.astype(np.uint16) if number <= 1 << 16 else buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(number + 1))
    columns = [c[order] for c in columns]
    for bucket in range(number):
        a, b = int(bounds[bucket]), int(bounds[bucket + 1])
        if b > a:
            yield bucket, *(c[a:b].tobytes() for c in columns)


def step_key(counter: int) -> int:
    """A number for each step of a task's input: its partition and its place there."""
    return TaskContext.get().partitionId() << 32 | counter
