"""Nearest neighbours by cosine: int8 product tiles, error bounds, exact scores of what survives.

Unit vectors are rounded to int8 with a scale of their own. The product of two rounded vectors differs
from the true cosine by at most what the rounding errors' lengths allow, so a tile gives a lower and an upper bound for
every pair. A pair whose upper bound is below the k-th best lower bound of its query cannot be a result; all others are computed
anew in double precision from the original vectors and pass through a heap per query. Nothing is lost: the result is exact.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components take no part, neither
do rows without id; equal scores go to the smaller id; a query with fewer than k candidates gets them all;
repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm import grid

#: Candidates of one product.
STEP = 4096


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and the length of each rounding error."""
    scale = np.abs(vectors).max(1) / 127.0
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(vectors - codes * scale[:, None], axis=1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of int8 rows. Sums of integers below 2 ** 24 are exact in single precision, beyond in double."""
    kind = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return left.astype(kind) @ right.astype(kind).T


def tile(ids: list, vectors: np.ndarray, other_ids: list[list], others: np.ndarray, k: int) -> tuple[list, list, list]:
    vectors, others = vectors.astype(np.float64), others.astype(np.float64)
    # Largest components first, so that squares neither overflow nor vanish.
    vectors /= np.abs(vectors).max(1, keepdims=True)
    others /= np.abs(others).max(1, keepdims=True)
    length, other_length = np.sqrt((vectors * vectors).sum(1)), np.sqrt((others * others).sum(1))
    codes, scale, error = rounded(vectors / length[:, None])
    other_codes, other_scale, other_error = rounded(others / other_length[:, None])
    slack = 1e-6  # covers the rounding of the bounds themselves
    lone = {rows[0]: j for j, rows in enumerate(other_ids) if len(rows) == 1}
    own = np.array([lone.get(i, -1) for i in ids])
    floor = np.full((len(ids), k), -np.inf)  # the k best lower bounds of each query so far
    heaps: list[list[tuple]] = [[] for _ in ids]
    for begin in range(0, len(others), STEP):
        part = slice(begin, begin + STEP)
        near = products(codes, other_codes[part]).astype(np.float64) * scale[:, None] * other_scale[None, part]
        bound = (1 + error)[:, None] * other_error[None, part] + error[:, None] + slack
        at = np.flatnonzero((own >= begin) & (own < begin + near.shape[1]))
        near[at, own[at] - begin] = -np.inf
        lower = np.concatenate((floor, near - bound), axis=1)
        floor = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:]
        rows, columns = np.nonzero((near + bound >= floor.min(1)[:, None]) & np.isfinite(near))
        columns += begin
        exact = (vectors[rows] * others[columns]).sum(1) / (length[rows] * other_length[columns])
        for row, column, score in zip(rows.tolist(), columns.tolist(), exact.tolist()):
            heap, query = heaps[row], ids[row]
            for other in other_ids[column]:
                if other == query:
                    continue
                entry = (score, _Later(other))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif heap[0] < entry:
                    heapq.heapreplace(heap, entry)
                else:
                    break
    flat = [(ids[row], entry[1].id, entry[0]) for row, heap in enumerate(heaps) for entry in heap]
    return [f[0] for f in flat], [f[1] for f in flat], [f[2] for f in flat]


class _Later:
    """An id in descending order: the larger id is the smaller entry."""

    __slots__ = ("id",)

    def __init__(self, value):
        self.id = value

    def __lt__(self, other):
        return self.id > other.id

    def __eq__(self, other):
        return self.id == other.id


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query among ``rows`` (id, vector)."""
    used = rows.select("id", "vector").filter(
        F.col("id").isNotNull() & grid.usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    return grid.search(used.filter(is_query), grid.candidates(used, k), k, tile, "double")
