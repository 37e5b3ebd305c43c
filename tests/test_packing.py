"""Packing by pointers equals a plain fold, for any sizes and for a document that holds all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from handbook_spark.operators import packing


def folded(sizes, limit: int) -> list[int]:
    """Number of each item's chunk."""
    out, filled, chunk = [], 0, 0
    for at, size in enumerate(sizes):
        if at and filled + size >= limit:
            chunk, filled = chunk + 1, 0
        filled += size
        out.append(chunk)
    return out


def packed(rows, limit: int, block: int) -> list[tuple]:
    return sorted(tuple(r) for r in packing.pack_rows(rows, "k", "p", "t", limit, "|", F.col("s"), block).collect())


@pytest.mark.parametrize("limit, block", [(1, 3), (7, 2), (40, 8), (30, 4096)])
def test_packing_equals_the_fold(spark, limit, block):
    rng = np.random.default_rng(limit)
    documents = {0: rng.integers(0, 9, 300), 1: rng.choice([0, 0, 0, 1, 50, 9000], 200), 2: np.zeros(120, int), 3: [limit], 4: np.full(90, limit - 1), 5: [0]}
    data = [(k, 3 * i + k, f"{k}.{i}", int(s)) for k, sizes in documents.items() for i, s in enumerate(sizes)]
    rows = spark.createDataFrame([*data, (None, 1, "x", 1), (9, None, "x", 1)], "k int, p int, t string, s int").repartition(5)
    want = []
    for k, sizes in documents.items():
        chunks = {}
        for i, c in enumerate(folded(sizes, limit)):
            chunks.setdefault(c, []).append(i)
        want += [(k, c, len(i), int(sum(sizes[j] for j in i)), "|".join(f"{k}.{j}" for j in i)) for c, i in chunks.items()]
    assert packed(rows, limit, block) == sorted(want)


def test_empty_table_and_bad_limit(spark):
    rows = spark.createDataFrame([], "k int, p int, t string, s int")
    assert packed(rows, 5, 8) == []
    with pytest.raises(ValueError):
        packing.pack_rows(rows, "k", "p", "t", 0)


def test_a_million_modules_of_one_document(spark):
    number, limit = 1_000_000, 3000
    rows = spark.range(number, numPartitions=8).select(
        F.lit("hot").alias("k"), F.col("id").alias("p"), F.lit("").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(97)) + 1).alias("s"))
    sizes = np.array([r.s for r in rows.select("s").collect()])
    found = packing.pack_rows(rows, "k", "p", "t", limit, size=F.col("s")).select("chunk_no", "n_modules", "n_tokens").collect()
    chunk = np.array(folded(sizes.tolist(), limit))
    assert sorted(map(tuple, found)) == list(zip(range(chunk[-1] + 1), np.bincount(chunk).tolist(), np.bincount(chunk, sizes).astype(int).tolist()))


def test_no_task_holds_a_document(spark):
    """The widest group of the plan is a block, a cell of sums or a chunk."""
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.lit(1).alias("size")).withColumn("n", F.col("n") + 1)
    nodes = packing.successors(rows, "k", 100, block=1000)
    blocks = packing.chunk_starts(nodes, "k", block=1000).groupBy("k", "_block").count()
    assert {r["count"] for r in blocks.collect()} <= {999, 1000, 1} and nodes.filter("next <> n + 99").count() == 0
