"""Incremental ingest: each run takes the files that arrived since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from handbook_spark.operators.tables import with_content_hash
from handbook_spark.sources.keyed_table import KeyedTable

RAW_SCHEMA = "mhb_id long, module_code string, content string"
KEY = ("module_code", "content_md5")


def raw_table(spark: SparkSession, path: str) -> KeyedTable:
    """The stored raw modules, unique by code and content hash; a module without content has a NULL hash, which counts as a value."""
    return KeyedTable(spark, path, T.StructType.fromDDL(f"{RAW_SCHEMA}, content_md5 string"), KEY)


def append_batch(table_path: str, batch: DataFrame, number: int) -> None:
    """Append the batch's raw modules whose (code, content hash) is not stored yet, as batch ``number`` of the table.

    A batch that was finished appends nothing when it is run again; one that was cut off starts afresh.
    """
    raw_table(batch.sparkSession, table_path).insert_new(number, with_content_hash(batch, "content"), [F.col("mhb_id")])


def ingest_raw_modules(spark: SparkSession, incoming: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Take all waiting JSON-lines files once and stop; the checkpoint remembers what was taken."""
    return (
        spark.readStream.schema(RAW_SCHEMA).json(incoming)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: append_batch(table_path, batch, number))
        .start()
    )
