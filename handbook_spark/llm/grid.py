"""A stated set of query vectors against all vectors, in tiles.

Queries fall into groups and candidates into cells, both by hash and of bounded size; a tile is one group with one
cell. A search function sees one tile at a time and returns each query's best rows of it; the best of all tiles are
chosen by a ranked window that Spark limits before its shuffle.

Equal vectors are one candidate that carries its smallest ids. Only so many of them as a result can hold, and one
more for the query's own row, are kept, so copies cost nothing and none that a result needs is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbook_spark.session import materialize

#: Rows of a tile at most, on average, and the least number of cells (so that few candidates still use many cores).
GROUP_QUERIES, CELL_CANDIDATES, LEAST_CELLS = 2048, 16384, 24
#: A vector's copies are cut to the smallest ids within so many parts before they come together.
_SALTS = 16


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, without null or non-finite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Different vectors of ``rows`` (id, vector) with ``ids``, the smallest k + 1 ids of each, ascending."""
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    few = Window.partitionBy("vector", salt).orderBy("id")
    kept = rows.filter("id IS NOT NULL").withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1)
    return kept.groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))


def search(queries: DataFrame, found: DataFrame, k: int, tile: Callable, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best candidates.

    ``queries`` has (id, vector), ``found`` what ``candidates`` returns. ``tile(ids, vectors, candidate_ids,
    candidate_vectors, k)`` gets arrays and returns lists of query ids, candidate ids and scores. Vectors of
    different lengths never meet.
    """
    queries, found = materialize(queries.dropDuplicates(["id", "vector"])), materialize(found)
    groups = max(1, math.ceil(queries.count() / GROUP_QUERIES))
    cells = max(LEAST_CELLS, math.ceil(found.count() / CELL_CANDIDATES))
    left = queries.select(
        F.size("vector").alias("width"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")).alias("cell"), "id", "vector")
    right = found.select(
        F.size("vector").alias("width"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("group"),
        F.pmod(F.xxhash64("vector"), F.lit(cells)).alias("cell"), "ids", "vector")
    id_type = queries.schema["id"].dataType.simpleString()
    schema = f"query_id {id_type}, vec_id {id_type}, score {score_type}"

    def run(queries_part: pa.Table, candidates_part: pa.Table) -> pa.Table:
        ids, others, scores = [], [], []
        if queries_part.num_rows and candidates_part.num_rows:
            ids, others, scores = tile(
                queries_part["id"].to_pylist(), _matrix(queries_part["vector"]),
                candidates_part["ids"].to_pylist(), _matrix(candidates_part["vector"]), k)
        id_arrow = queries_part.schema.field("id").type
        return pa.table({
            "query_id": pa.array(ids, id_arrow), "vec_id": pa.array(others, id_arrow),
            "score": pa.array(scores, pa.int64() if score_type == "long" else pa.float64())})

    keys = ["width", "group", "cell"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
