"""Session set-up and scratch storage shared by all operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_scratch: tempfile.TemporaryDirectory | None = None
_scopes: list[list[str]] = []


def build_session(app_name: str = "handbook_spark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect: UTC and adaptive execution.

    Skewed sort-merge joins are split by AQE even where that costs one more shuffle, because a
    single handbook, code or source may hold a large part of all rows.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession) -> str:
    """New unique folder below the shared folder named by ``spark.checkpoint.dir``.

    All folders of an application lie below one folder with its id, which can be dropped when the
    application has ended. Only a local session may fall back to a temporary folder of this machine: on a cluster the
    folder has to be visible to every executor and survive the loss of one.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        if _local_scratch is None:
            _local_scratch = tempfile.TemporaryDirectory(prefix="handbook_spark_")
        base = _local_scratch.name
    path = f"{base.rstrip('/')}/handbook_spark/{spark.conf.get('spark.app.id', 'app')}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder from whatever store it lies in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside the block are removed at its end; read the results before."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            remove_folder(spark, path)


def input_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and modification times of a table's files: changes whenever the table does."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to scratch storage and read it back: cuts lineage and fixes row placement."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

