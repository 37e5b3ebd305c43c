"""Packing of modules that are rows of their own into chunks below a token budget, whatever the size of a document.

A chunk that begins at a module ends before the first module with which the sizes reach the limit, so its successor is a lookup
in the running sums. Successors are found for all modules at once; following them from a document's first module is done in
three steps that never hold a document in one place: inside blocks of positions up to the module that leaves the block, over
the blocks by pointer jumping (each round doubles the steps of a pointer), and inside the blocks again from their entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from handbook_spark.functions.text import token_count
from handbook_spark.operators.numbering import BLOCK, block_of, number_rows_per_key, running_sum
from handbook_spark.operators.sequences import MODULE_BREAK, ordered_join
from handbook_spark.session import materialize

#: Width of a cell of running sums: at most so many different sums, and as many different lookups, are sorted together.
SUMS = 4096


def first_reaching(points: DataFrame, lookups: DataFrame, key: str) -> DataFrame:
    """For each lookup value the first position whose sum reaches it: key, value, at (NULL when none does).

    ``points`` has key, value (a nondecreasing integer sum), at (position); ``lookups`` has key, value. Equal values count once on both sides, so a
    cell of sums holds at most ``SUMS`` of either; a lookup without an answer in its cell takes the first position of the cells behind.
    """
    both = points.groupBy(key, "value").agg(F.min("at").alias("at")).withColumn("is_point", F.lit(1)).unionByName(
        lookups.select(key, "value").distinct().withColumns({"at": F.lit(None).cast("long"), "is_point": F.lit(0)}))
    both = both.withColumn("cell", F.floor(F.col("value") / SUMS))
    inside = Window.partitionBy(key, "cell").orderBy(F.col("value").desc(), F.col("is_point").desc())
    found = both.withColumn("here", F.last("at", ignorenulls=True).over(inside)).filter("is_point = 0")
    behind = Window.partitionBy(key).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy(key, "cell").agg(F.min("at").alias("first")).select(
        key, "cell", F.last("first", ignorenulls=True).over(behind).alias("later"))
    return found.join(cells, [key, "cell"]).select(key, "value", F.coalesce("here", "later").alias("at"))


def successors(sized: DataFrame, key: str, limit: int, block: int = BLOCK) -> DataFrame:
    """``sized`` (key, n from 1, size) with ``next``: where the chunk behind the one that begins at ``n`` would begin."""
    summed = running_sum(sized, [key], ["n"], F.col("size"), "upto", block=block)
    nodes = materialize(summed.withColumn("value", F.col("upto") - F.col("size") + F.lit(limit)))
    points = nodes.select(key, F.col("upto").alias("value"), F.col("n").alias("at"))
    answers = first_reaching(points, nodes, key)
    # A module that reaches the limit alone is a chunk; its sum answers its own lookup.
    return nodes.join(answers, [key, "value"]).select(
        key, "n", "size", F.when(F.col("size") >= limit, F.col("n") + 1).otherwise(F.col("at")).alias("next"))


def _blockwise(rows: DataFrame, key: str, made: str, work, block: int) -> DataFrame:
    """Add a long column that ``work`` makes of each block's columns in the order of ``n``."""
    placed = rows.withColumn("_block", block_of("n", block).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + f", {made} long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        return table.append_column(made, work(table))

    return placed.groupBy(key, "_block").applyInArrow(run, schema)


def _steps(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a block and their successors, 0 where there is none."""
    return table.column("n").to_numpy(), table.column("next").fill_null(0).to_numpy()


def _exits(table: pa.Table) -> pa.Array:
    """Where the chain that begins at a position leaves the block."""
    n, following = _steps(table)
    first, last = n[0], n[-1]
    out = following.copy()
    for at in range(len(n) - 1, -1, -1):  # a successor lies behind, so its exit is known
        if first <= following[at] <= last:
            out[at] = out[following[at] - first]
    return pa.array(out, mask=out == 0)


def _marks(table: pa.Table) -> pa.Array:
    """1 where a chunk begins, following the block's entry."""
    n, following = _steps(table)
    out = np.zeros(len(n), np.int64)
    at = table.column("entry")[0].as_py() or 0
    while n[0] <= at <= n[-1]:
        out[at - n[0]] = 1
        at = following[at - n[0]]
    return pa.array(out)


def chunk_starts(nodes: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``nodes`` (key, n, next) with ``starts``: 1 for the positions that are reached from position 1."""
    left = materialize(_blockwise(nodes, key, "leaves", _exits, block))
    # Only positions at which some chain enters a block can be entries; they and their exits are the pointers.
    entries = left.select(key, F.col("leaves").alias("n")).filter("n IS NOT NULL").union(left.filter("n = 1").select(key, "n")).distinct()
    exits = entries.join(left.select(key, "n", F.col("leaves").alias("to")), [key, "n"])
    # The successor of a last module that reaches the limit alone is no position.
    pointers = materialize(exits.join(left.select(key, F.col("n").alias("to")), [key, "to"], "left_semi").select(key, "n", "to"))
    reached = materialize(left.filter("n = 1").select(key, "n"))
    while pointers.limit(1).count():
        # ``pointers`` lead 2 ** round blocks on: what they reach is as far away as all that is known is wide.
        reached = materialize(reached.union(reached.join(pointers, [key, "n"]).select(key, F.col("to").alias("n"))).distinct())
        onward = pointers.select(F.col(key), F.col("n").alias("to"), F.col("to").alias("beyond"))
        pointers = materialize(pointers.join(onward, [key, "to"]).select(key, "n", F.col("beyond").alias("to")))
    entered = reached.select(key, block_of("n", block).cast("long").alias("_block"), F.col("n").alias("entry"))
    return _blockwise(left.join(entered, [key, "_block"], "left").drop("_block", "leaves"), key, "starts", _marks, block)


def pack_rows(
    rows: DataFrame, key: str, position: str, text: str, limit: int, separator: str = MODULE_BREAK, size: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """Pack modules that are rows of their own, in order of ``position``, into chunks below a token budget.

    A module joins the open chunk while the sum stays strictly below ``limit``; otherwise it opens the next chunk, so a module larger than the
    limit stands alone. Positions are unique within a key; rows without key or position take no part. Texts are joined per chunk,
    which the limit bounds.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    sized = rows.filter(F.col(key).isNotNull() & F.col(position).isNotNull()).select(
        key, position, text, (token_count(F.col(text)) if size is None else size).cast("long").alias("size"))
    numbered = materialize(number_rows_per_key(sized.select(key, position, "size"), [key], [position], "n"))
    marked = chunk_starts(successors(numbered.select(key, "n", "size"), key, limit, block), key, block)
    chunks = running_sum(materialize(marked.select(key, "n", "starts")), [key], ["n"], F.col("starts"), "chunk", block=block)
    of = numbered.join(chunks, [key, "n"]).select(key, position, (F.col("chunk") - 1).cast("int").alias("chunk_no"))
    return sized.join(of, [key, position]).groupBy(key, "chunk_no").agg(
        F.count(F.lit(1)).alias("n_modules"), F.sum("size").alias("n_tokens"), ordered_join([position], text, separator).alias("text"))
