"""Row numbers and sequence scans that stay parallel when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from handbook_spark.session import materialize

BLOCK = 4096


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Whole first row of every key. The rank limit is applied per task before the shuffle, so a
    hot key moves at most one row per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def number_rows(
    df: DataFrame, order: Sequence[str], name: str, start: Column | int = 1, keep_slice: bool = False
) -> DataFrame:
    """Consecutive numbers in the order of ``order`` without a global window.

    Rows are range-partitioned (a hot key is cut at the following order columns), numbered inside
    each slice, and shifted by the sizes of the slices before. The sorted rows are written once,
    so that numbers cannot change when a task is repeated. The offsets have one row per slice and
    are therefore small by construction.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    slice_id = F.shiftright(F.col("_id"), 33)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(slice_id.alias("_slice")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        placed.withColumn("_slice", slice_id)
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_before") + place + first)
        .drop("_before", "_id", *(() if keep_slice else ("_slice",)))
    )


def number_rows_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Numbers from 1 inside every key: the global number minus the key's first one.

    First numbers are joined by key and slice, so the rows of a hot key, which fill many slices, do not meet.
    """
    numbered = number_rows(df, [*keys, *order], "_n", keep_slice=True)
    on = [*keys, "_slice"]
    firsts = numbered.groupBy(*on).agg(F.min("_n").alias("_first"))  # one row per slice and key in it
    starts = firsts.select(*on, F.min("_first").over(Window.partitionBy(*keys)).alias("_start"))
    return numbered.join(starts, on).withColumn(name, F.col("_n") - F.col("_start") + 1).drop("_n", "_start", "_slice")


def block_of(position: str, size: int = BLOCK) -> Column:
    """Block of a unique integer position: holds at most ``size`` rows of a key."""
    return F.floor(F.col(position) / size)


def local_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, position: str | None = None, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """First level of a run scan: (rows with ``_block`` and ``_local`` run number, offsets per block).

    The global number of a run is ``_offset + _local``. A block's first run continues the last run
    of the block before where the values agree.
    """
    position = position or order[0]
    rows = df.withColumn("_block", block_of(position, block))
    window = Window.partitionBy(*keys, "_block").orderBy(*order)
    changed = (F.row_number().over(window) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(window))
    local = rows.withColumn("_changed", changed.cast("int")).withColumn("_local", F.sum("_changed").over(window)).drop("_changed")
    ordering = F.struct(*order)
    totals = local.groupBy(*keys, "_block").agg(
        F.max("_local").alias("_runs"),
        F.min_by(value, ordering).alias("_first"),
        F.max_by(value, ordering).alias("_last"),
    )
    by_block = Window.partitionBy(*keys).orderBy("_block")
    joined = (
        F.lag("_runs").over(by_block).isNotNull() & F.col("_first").eqNullSafe(F.lag("_last").over(by_block))
    ).cast("int")
    offsets = totals.withColumn("_joined", joined).select(
        *keys,
        "_block",
        (F.sum(F.col("_runs") - F.col("_joined")).over(by_block) - F.col("_runs")).alias("_offset"),
    )
    return local, offsets


def run_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run", position: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Number runs of equal consecutive ``value`` per key.

    Two-level scan: runs are counted inside blocks of positions, then block totals are added up. A
    key with very many positions is thus spread over many tasks.
    """
    local, offsets = local_runs(df, keys, order, value, position, block)
    return with_offsets(local, offsets, keys, name).drop("_block")


def local_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, position: str | None = None, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """First level of a running sum: (rows with ``_block`` and ``_local`` sum, offsets per block)."""
    position = position or order[0]
    rows = df.withColumn("_block", block_of(position, block)).withColumn("_value", value)
    window = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    return rows.withColumn("_local", F.sum("_value").over(window)).drop("_value"), offsets


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, position: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Inclusive running sum per key as a two-level scan over blocks of positions."""
    local, offsets = local_sums(df, keys, order, value, position, block)
    return with_offsets(local, offsets, keys, name).drop("_block")


def with_offsets(local: DataFrame, offsets: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Second level of a scan: local numbers shifted by the total of the blocks before."""
    return (
        local.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_local", "_offset")
    )
