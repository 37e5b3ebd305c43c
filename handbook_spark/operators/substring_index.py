"""Candidate rows for case-insensitive substring filters, from bitmaps of three-letter pieces.

Rows are cut into ranges of their order and stored in folders of one bitmap bucket (32 768 rows at most, of one range). For every field and every three
letters that stand side by side in its lower-case text there is one bitmap per bucket, made where the bucket's rows are read. A row that matches a pattern has all pieces of the pattern's literal parts, so the
intersection of their bitmaps holds every match; what is left is tested with the exact filter. Only buckets with a candidate are read. Patterns
without three letters in a row restrict nothing: their rows come from the same stored table, unpruned.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from handbook_spark.session import materialize

GRAM = 3
#: Rows of a bucket, which are the bits of one of Spark's bitmaps, and rows that a range of the order is meant to hold.
BUCKET_BITS, RANGE_ROWS = 15, 20_000
#: Places of pieces that a task holds before it writes their bitmaps; those of a bucket's parts are united when they are read.
HELD_PLACES = 1 << 24
_CELLS, _BITMAPS = "field string, gram string, bucket long, cell binary", "field string, gram string, bucket long, bitmap binary"


def bitmaps(batches: Iterator[pa.RecordBatch], fields: Mapping[str, Sequence[str]]) -> Iterator[pa.RecordBatch]:
    """``_CELLS`` rows of batches (``_bucket``, ``_bit`` and the lower-case texts of ``fields``), one per field, piece and bucket.

    Equal texts of a batch are cut once. A bucket that is longer than what a task holds, or read in parts, has several rows for a piece.
    """
    bucket, numbers, held = None, {name: {} for name in fields}, 0
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {name: [] for name in fields}

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for name, parts in kept.items():
            if parts:
                number, bits = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(number, kind="stable")
                bits = np.split(bits[order], np.cumsum(np.bincount(number, minlength=len(numbers[name])))[:-1])
                cells = []
                for of_piece in bits:
                    flags = np.zeros(1 << BUCKET_BITS, bool)
                    flags[of_piece] = True
                    cells.append(zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1))
                size = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * size), pa.array(list(numbers[name])), pa.array([bucket] * size, pa.int64()), pa.array(cells, pa.binary())],
                    names=["field", "gram", "bucket", "cell"])
            parts.clear()
            numbers[name].clear()
        held = 0

    for batch in batches:
        buckets = batch.column("_bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if buckets[a] != bucket or held > HELD_PLACES:
                yield from flush()
                bucket = int(buckets[a])
            part = batch.slice(a, b - a)
            bit = part.column("_bit").to_numpy()
            for name, columns in fields.items():
                known = numbers[name]
                for column in columns:
                    coded = part.column(column).dictionary_encode()
                    pieces = [[known.setdefault(g, len(known)) for g in {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}]
                              for t in coded.dictionary.to_pylist()]
                    size = np.array([len(p) for p in pieces], np.int64)
                    rows = np.flatnonzero(coded.is_valid().to_numpy(zero_copy_only=False))
                    if not len(rows) or not size.any():
                        continue
                    flat = np.concatenate([np.array(p, np.int32) for p in pieces])
                    value = coded.indices.take(pa.array(rows)).to_numpy().astype(np.int64)
                    times = size[value]
                    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    number = flat[np.repeat((np.cumsum(size) - size)[value], times) + inside]
                    kept[name].append((number, np.repeat(bit[rows], times).astype(np.int32)))
                    held += len(number)
    yield from flush()


def inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, bucket, bitmap of rows with deflated cells."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            whole = pa.array([zlib.decompress(c) for c in part.column("cell").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("gram"), part.column("bucket"), whole], names=["gram", "bucket", "bitmap"])


def pattern_grams(pattern: str) -> list[str]:
    """Three-letter pieces that every text matching a LIKE pattern has: those of its parts between wildcards."""
    parts = re.split(r"[%_]|\\.?", pattern.lower())
    return sorted({part[i : i + GRAM] for part in parts for i in range(len(part) - GRAM + 1)})


def build_index(
    rows: DataFrame, fields: Mapping[str, Sequence[Column]], order: Sequence[str | Column], path: str, size: int | None = None,
    shown: Callable[[DataFrame], DataFrame] = lambda stored: stored,
) -> SubstringIndex:
    """Store ``rows`` and the bitmaps of ``fields`` (name -> texts of which any may match) below ``path``.

    ``rows`` may be short: ``shown`` makes the rows that are searched of the stored ones, row by row, whenever they are read, and keeps their
    place (the last two columns). ``fields`` are expressions over these.

    ``order`` puts rows into their places; rows that are alike in a much searched field should lie together, which leaves fewer buckets to
    read. ``size`` is about how many rows there are: with it, ranges are so many that a range is one bucket, and sorts stay small.
    """
    ranges = [] if size is None else [max(-(-size // RANGE_ROWS), 1)]
    placed = rows.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    made = placed.withColumns({
        "_bucket": F.shiftright("_id", BUCKET_BITS), "_bit": F.col("_id").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")}).drop("_id")
    spark = rows.sparkSession
    with _few_writers(spark):
        made.write.partitionBy("_bucket").parquet(f"{path}/rows")
    index = SubstringIndex(spark, path, rows.schema, shown)
    stored = index.rows()
    named = {name: [f"{name}_{i}" for i in range(len(texts))] for name, texts in fields.items()}
    texts = stored.select("_bucket", "_bit", *[F.lower(t).alias(column) for name, of in fields.items() for t, column in zip(of, named[name])])
    cells = materialize(texts.mapInArrow(lambda batches: bitmaps(batches, named), _CELLS))
    # Cells are shuffled and sorted deflated. A piece has one a bucket, so none is a hot key.
    for name in fields:
        placed = cells.filter(F.col("field") == name).select("gram", "bucket", "cell").repartition("gram").sortWithinPartitions("gram", "bucket")
        placed.mapInArrow(inflated, "gram string, bucket long, bitmap binary").write.parquet(f"{path}/bitmaps/field={name}")
    return index


@contextlib.contextmanager
def _few_writers(spark: SparkSession) -> Iterator[None]:
    """Rows that come in the order of their folders, few folders a task, are written as they come, not sorted once more."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, 8)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_bit", T.IntegerType()), T.StructField("_bucket", T.LongType())])


class SubstringIndex:
    """Stored rows with the bitmaps of their fields; see ``build_index``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, shown: Callable[[DataFrame], DataFrame] = lambda stored: stored):
        self.spark, self.path, self.schema, self.shown = spark, path, schema, shown

    def rows(self) -> DataFrame:
        """All rows with their place."""
        return self.shown(self.spark.read.schema(_stored_schema(self.schema)).parquet(f"{self.path}/rows"))

    def buckets(self, patterns: Mapping[str, str]) -> DataFrame | None:
        """bucket, bitmap of the rows that have all pieces of all patterns; None when the patterns have none."""
        wanted = {field: pattern_grams(pattern) for field, pattern in patterns.items()}
        number = sum(map(len, wanted.values()))
        if not number:
            return None
        is_wanted = F.lit(False)
        for field, pieces in wanted.items():
            if pieces:
                is_wanted = is_wanted | ((F.col("field") == field) & F.col("gram").isin(pieces))
        read = self.spark.read.schema(_BITMAPS).parquet(f"{self.path}/bitmaps").filter(is_wanted)
        whole = read.groupBy("field", "gram", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        both = whole.groupBy("bucket").agg(F.count(F.lit(1)).alias("found"), F.bitmap_and_agg("bitmap").alias("bitmap"))
        return both.filter((F.col("found") == number) & (F.bitmap_count("bitmap") > 0)).select("bucket", "bitmap")

    def candidates(self, patterns: Mapping[str, str]) -> DataFrame:
        """Stored rows that can match all LIKE patterns (field -> pattern), and some that do not."""
        rows, found = self.rows(), self.buckets(patterns)
        names = [c for c in rows.columns if c not in ("_bit", "_bucket")]
        if found is None:
            return rows.select(*names)
        byte = F.substring("bitmap", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))
        is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.col("_bit") % 8) == 1
        return rows.join(found, (F.col("_bucket") == F.col("bucket")) & is_set).select(*names)
