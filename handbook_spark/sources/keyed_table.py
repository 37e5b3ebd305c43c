"""A parquet table with a key that is changed in batches: inserts add files, updates and deletes rewrite the buckets they touch.

Rows lie in folders ``bucket=<hash of the key>/base=<batch>/batch=<batch>``. A batch that inserts writes folders of its own below the bucket's
base; a batch that changes rows writes the whole bucket anew below a base of its own, and the older base is dead. A batch
counts when its ``done`` mark is written, as its last step: readers see all of it or nothing. A batch that was cut off
leaves folders that nobody reads; running it again removes them and starts afresh, and running a finished batch again does nothing.

Key columns may be NULL; NULL is a key value like any other, equal to itself. Batches have ascending numbers, and one writer at a time
is expected. The folder listing has one entry per bucket and batch since the bucket's last rewrite; ``compact`` brings it down to one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from handbook_spark.operators import tables
from handbook_spark.session import materialize, remove_folder

_FOLDER = re.compile(r"bucket=(\d+)/base=(\d+)/batch=(\d+)$")
_MARK = re.compile(r"(\d+)\.(begun|done)$")


class KeyedTable:
    """A stored table with the columns of ``schema`` and at most one row per value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], buckets: int = 64):
        self.spark, self.schema, self.key, self.buckets = spark, schema, list(key), buckets
        self.root = f"{path.rstrip('/')}/buckets={buckets}"
        self._log = f"{path.rstrip('/')}/_batches"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        others = [m for m in self._matches(f"{path.rstrip('/')}/buckets=*", re.compile(r"buckets=(\d+)$")) if m != (str(buckets),)]
        if others:
            raise ValueError(f"the table has {others[0][0]} buckets")

    def _matches(self, pattern: str, parts: re.Pattern) -> list[tuple[str, ...]]:
        found = self._store.globStatus(self._path(pattern))
        return [m.groups() for m in (parts.search(f.getPath().toString()) for f in found or []) if m]

    def _folders(self) -> list[tuple[int, int, int]]:
        return [tuple(map(int, m)) for m in self._matches(f"{self.root}/bucket=*/base=*/batch=*", _FOLDER)]

    def _marks(self, kind: str) -> set[int]:
        return {int(batch) for batch, mark in self._matches(f"{self._log}/*", _MARK) if mark == kind}

    def _mark(self, batch: int, kind: str) -> None:
        self._store.create(self._path(f"{self._log}/{batch}.{kind}"), True).close()

    def _folder(self, bucket: int, base: int, batch: int) -> str:
        return f"{self.root}/bucket={bucket}/base={base}/batch={batch}"

    def _live(self) -> list[tuple[int, int, int]]:
        """Folders of finished batches below each bucket's last base."""
        done = self._marks("done")
        folders = [f for f in self._folders() if f[2] in done]
        base = self._bases(folders)
        return [f for f in folders if f[1] == base[f[0]]]

    @staticmethod
    def _bases(folders: Sequence[tuple[int, int, int]]) -> dict[int, int]:
        base: dict[int, int] = {}
        for bucket, of, _ in folders:
            base[bucket] = max(of, base.get(bucket, 0))
        return base

    def _rows(self, folders: Sequence[tuple[int, int, int]]) -> DataFrame:
        """Rows of some folders with their bucket; an emptied bucket's folder has no files."""
        paths = [p for p in (self._folder(*f) for f in sorted(folders)) if len(self._store.listStatus(self._path(p)))]
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths).select(*schema.names)

    def read(self) -> DataFrame:
        """All rows, as the last finished batch left them."""
        return self._rows(self._live()).select(*self.schema.names)

    def rows_of(self, batch: int) -> DataFrame:
        """Rows that a finished batch added or rewrote, as far as no later batch has rewritten their bucket."""
        return self._rows([f for f in self._live() if f[2] == batch]).select(*self.schema.names)

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in ``keys``; only the buckets of these keys are read."""
        wanted = self._placed(keys.select(*self.key))
        live = self._rows([f for f in self._live() if f[0] in self._buckets_of(wanted)])
        return tables.join_keys(live, wanted.select(*self.key), self.key, "left_semi").select(*self.schema.names)

    def _placed(self, rows: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in self.schema}
        typed = rows.select(*[F.col(c).cast(types[c]).alias(c) for c in rows.columns])
        return typed.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _buckets_of(self, placed: DataFrame) -> set[int]:
        """Buckets that some rows lie in, at most as many as the table has."""
        return {r.bucket for r in placed.select("bucket").distinct().collect()}

    def _commit(self, batch: int, write: Callable[[list[tuple[int, int, int]]], None]) -> bool:
        """Run ``write`` on the live folders as batch number ``batch``; False if that batch is finished already."""
        done = self._marks("done")
        if batch in done:
            return False
        open_ = self._marks("begun") - done - {batch}
        if open_ or any(b > batch for b in done):
            raise ValueError(f"batch {min(open_)} is not finished" if open_ else f"a batch after {batch} is finished")
        for folder in self._folders():
            if folder[2] == batch:
                remove_folder(self.spark, self._folder(*folder))
        self._mark(batch, "begun")
        write(self._live())
        self._mark(batch, "done")
        self._clean()
        return True

    def _clean(self) -> None:
        """Remove folders below dead bases."""
        live = self._bases(self._live())
        for folder in self._folders():
            if folder[1] < live.get(folder[0], 0):
                remove_folder(self.spark, self._folder(*folder))

    def _write(self, rows: DataFrame, batch: int, bases: Mapping[int, int] | None = None) -> None:
        """Write rows (with bucket) as folders of ``batch``, below the given bases or below a base of the batch's own."""
        if bases is None:
            placed = rows.withColumn("base", F.lit(batch))
        else:  # one row per bucket
            below = self.spark.createDataFrame(list(bases.items()) or [(-1, 0)], "bucket int, of int")
            placed = rows.join(F.broadcast(below), "bucket", "left").withColumn("base", F.coalesce("of", F.lit(0))).drop("of")
        placed.withColumn("batch", F.lit(batch)).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "base", "batch").parquet(self.root)

    def insert_new(self, batch: int, rows: DataFrame, order: Sequence[Column]) -> bool:
        """Add the first row of each key that is not stored yet; files of stored rows stay as they are."""

        def write(live: list[tuple[int, int, int]]) -> None:
            placed = self._placed(rows.select(*self.schema.names))
            touched = self._buckets_of(placed)
            stored = self._rows([f for f in live if f[0] in touched])
            self._write(tables.insert_new(stored, placed, self.key, order), batch, self._bases(live))

        return self._commit(batch, write)

    def _replace(self, batch: int, live: list[tuple[int, int, int]], touched: set[int], after: Callable[[DataFrame], DataFrame]) -> None:
        """Write the touched buckets anew."""
        changed = materialize(after(self._rows([f for f in live if f[0] in touched])))
        self._write(changed, batch)
        for bucket in touched - self._buckets_of(changed):
            self._store.mkdirs(self._path(self._folder(bucket, batch, batch)))

    def update(self, batch: int, changes: Mapping[str, Any], conditions: Mapping[str, Any] | Column | str) -> bool:
        """Set columns where the conditions hold. Keys cannot be changed."""
        if set(changes) & set(self.key):
            raise ValueError("key columns cannot be changed")

        def write(live: list[tuple[int, int, int]]) -> None:
            touched = self._buckets_of(self._rows(live).filter(tables.to_delete(conditions)))
            self._replace(batch, live, touched, lambda rows: tables.update(rows, changes, conditions)[0])

        return self._commit(batch, write)

    def update_from(self, batch: int, changes: DataFrame) -> bool:
        """Take the other columns of ``changes`` (one row per key) for the keys that are stored."""

        def write(live: list[tuple[int, int, int]]) -> None:
            placed = self._placed(changes)
            touched = self._buckets_of(placed) & {f[0] for f in live}
            self._replace(batch, live, touched, lambda rows: tables.update_from(rows, placed.drop("bucket"), self.key))

        return self._commit(batch, write)

    def delete(self, batch: int, conditions: Mapping[str, Any] | Column | str) -> bool:
        """Remove the rows for which the conditions hold; a row that is NULL in a tested column stays."""

        def write(live: list[tuple[int, int, int]]) -> None:
            touched = self._buckets_of(self._rows(live).filter(tables.to_delete(conditions)))
            self._replace(batch, live, touched, lambda rows: tables.delete(rows, conditions)[0])

        return self._commit(batch, write)

    def rewrite(self, batch: int, keys: DataFrame, after: Callable[[DataFrame], DataFrame]) -> bool:
        """Write the buckets of some keys anew, as ``after`` makes them of their rows; keys stay unique and in these buckets."""

        def write(live: list[tuple[int, int, int]]) -> None:
            touched = self._buckets_of(self._placed(keys.select(*self.key)))

            def changed(rows: DataFrame) -> DataFrame:
                made = after(rows.select(*self.schema.names))
                return self._placed(made.select(*self.schema.names))

            self._replace(batch, live, touched, changed)

        return self._commit(batch, write)

    def compact(self, batch: int) -> bool:
        """Write each bucket that has several folders as one."""

        def write(live: list[tuple[int, int, int]]) -> None:
            of = [f[0] for f in live]
            self._replace(batch, live, {b for b in of if of.count(b) > 1}, lambda rows: rows)

        return self._commit(batch, write)
