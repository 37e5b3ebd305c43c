"""Exact top-k by integer inner product on a bit-sliced index.

A cell of candidates is stored as bitmaps: one for each bit of each quantised attribute. A query's score of all candidates
is the sum of its slices, each taken as often as the query's bits say; slices of one weight are added three at
a time (two logical results: sum and carry), which leaves one bitmap per bit of the score. The best rows are then chosen
from the most significant score bitmap downward. Rows that tie at the boundary and the final scores are
resolved from the integers themselves.

Attributes are shifted to be non-negative; where the query's value is negative the complements of the slices
are added, so that all sums are of non-negative numbers.

Results for odd input: vectors that are null, empty or hold null or non-finite components take no part, neither do
rows without id; equal scores go to the smaller id; a query with fewer than k candidates gets them all; repeated rows count
once; extra columns are ignored. Scores must fit into 64 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm import grid

#: Words of bitmaps that are added at once for a batch of queries.
STEP_WORDS = 1 << 17


class Slices:
    """Bitmaps of a cell: for each attribute and bit, the slice and its complement."""

    def __init__(self, values: np.ndarray):
        self.rows, self.width = values.shape
        low = values.min(0)
        shifted = (values - low).astype(np.uint64)
        self.bits = max(int(shifted.max()).bit_length(), 1)
        self.words = (self.rows + 63) // 64
        maps = np.zeros((self.width, self.bits, 2, self.words), np.uint64)
        for bit in range(self.bits):
            ones = ((shifted >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8).T
            maps[:, bit, 0] = self._packed(ones)
            maps[:, bit, 1] = ~maps[:, bit, 0]
        # The last row of the table is an empty slice for padding.
        self.maps = np.concatenate((maps.reshape(-1, self.words), np.zeros((1, self.words), np.uint64)))
        self.all = self._packed(np.ones((1, self.rows), np.uint8))[0]

    def _packed(self, ones: np.ndarray) -> np.ndarray:
        padded = np.zeros((ones.shape[0], self.words * 64), np.uint8)
        padded[:, : self.rows] = ones
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def places(self, query: np.ndarray) -> list[np.ndarray]:
        """For each weight, the slices that the query adds."""
        found: list[list[np.ndarray]] = []
        size, negative = np.abs(query), (query < 0).astype(np.int64)
        for high in range(int(size.max()).bit_length()):
            columns = np.flatnonzero((size >> high) & 1)
            for low in range(self.bits):
                while len(found) <= high + low:
                    found.append([])
                found[high + low].append((columns * self.bits + low) * 2 + negative[columns])
        return [np.concatenate(x) for x in found]

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the scores of several queries by weight, each (queries, words)."""
        by_query = [self.places(q) for q in queries]
        weights = max(map(len, by_query), default=0)
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        at = 0
        while at < weights or carried:
            lists = [p[at] if at < len(p) else np.zeros(0, np.int64) for p in by_query]
            most = max(map(len, lists))
            table = np.full((len(queries), most), len(self.maps) - 1, np.int64)
            for row, places in enumerate(lists):
                table[row, : len(places)] = places
            stack = np.concatenate([self.maps[table], *carried], axis=1) if most or carried else None
            carried = []
            if stack is None:
                out.append(np.zeros((len(queries), self.words), np.uint64))
                at += 1
                continue
            while stack.shape[1] > 2:
                third = stack.shape[1] // 3
                a, b, c = stack[:, :third], stack[:, third : 2 * third], stack[:, 2 * third : 3 * third]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                stack = np.concatenate((odd ^ c, stack[:, 3 * third :]), axis=1)
            if stack.shape[1] == 2:
                carried.append((stack[:, 0] & stack[:, 1])[:, None])
                stack = (stack[:, 0] ^ stack[:, 1])[:, None]
            out.append(stack[:, 0])
            at += 1
            if at >= weights and all(not c.any() for c in carried):
                break
        return out

    def top(self, sums: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of rows surely among the k best of each query, and of rows that tie for what is left."""
        sure, open_rows = np.zeros_like(allowed), allowed.copy()
        for bitmap in reversed(sums):
            with_bit = open_rows & bitmap
            count = np.bitwise_count(sure | with_bit).sum(1, dtype=np.int64)
            many, few = (count > k)[:, None], (count <= k)[:, None]
            sure = np.where(few, sure | with_bit, sure)
            open_rows = np.where(many, with_bit, open_rows & ~bitmap)
            open_rows[count == k] = 0
        return sure, open_rows

    def listed(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def tile(ids: list, vectors: np.ndarray, other_ids: list[list], others: np.ndarray, k: int) -> tuple[list, list, list]:
    index = Slices(others)
    lone = {rows[0]: j for j, rows in enumerate(other_ids) if len(rows) == 1}
    out: list[tuple] = []
    weight = max(int(np.bitwise_count(np.abs(vectors)).sum(1).max()) * index.bits, 1)
    batch = max(1, STEP_WORDS // (max(1, weight // 8) * index.words))
    for begin in range(0, len(ids), batch):
        part = vectors[begin : begin + batch]
        allowed = np.repeat(index.all[None], len(part), 0)
        for row, query in enumerate(ids[begin : begin + batch]):
            at = lone.get(query)
            if at is not None:
                allowed[row, at // 64] &= ~np.uint64(1 << at % 64)
        sure, tied = index.top(index.sums(part), allowed, k)
        for row, query in enumerate(ids[begin : begin + batch]):
            rows = index.listed(sure[row]).tolist()
            ties = index.listed(tied[row]).tolist()
            if ties:  # all of one score: the smallest ids go first
                ties = heapq.nsmallest(k, ties, key=lambda j: next(i for i in other_ids[j] if i != query))
            rows += ties
            scores = (others[rows] * part[row]).sum(1).tolist()
            found = [(-s, i) for j, s in zip(rows, scores) for i in other_ids[j] if i != query]
            out += [(query, i, -s) for s, i in heapq.nsmallest(k, found)]
    return [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]


def best(rows: DataFrame, is_query: Column, k: int, levels: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows of ``rows`` (id, vector); attributes are floor(levels * x)."""
    used = rows.select("id", "vector").filter(F.col("id").isNotNull() & grid.usable(F.col("vector"))).select(
        "id", F.transform("vector", lambda x: F.floor(F.lit(float(levels)) * x.cast("double"))).alias("vector"))
    return grid.search(used.filter(is_query), grid.candidates(used, k), k, tile, "long")
