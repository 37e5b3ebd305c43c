"""A running job that goes on over bad rows: good rows, quarantine and status as tables, and a retry with every batch.

Each micro-batch takes the new rows and the quarantined ones that have attempts left. Good rows are appended, bad ones are kept with their error and
the number of attempts, and rows that have become good leave the quarantine. The three tables are written one after the other under the
number of the micro-batch: a table that has finished the batch is left alone when the batch is run again, so a run that is killed
between two writes ends in the same tables as one that is not.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from handbook_spark.operators.numbering import first_per_key
from handbook_spark.operators.quality import batch_status, with_error
from handbook_spark.operators.tables import join_keys
from handbook_spark.sources.keyed_table import KeyedTable

_KEPT = "error string, attempts int, batch int"
_STATUS = "batch int, n_good long, n_bad long, status string, is_error boolean"


class CheckedJob:
    """Tables of a job over rows of ``schema`` with a unique ``key``, below one folder.

    ``checks`` gives the named conditions for the rows of a batch; they may change between runs, which is what a retry is for. A row is tried
    ``most_attempts`` times at most and then stays in quarantine. A new row of a quarantined key takes its place and begins anew; a
    key that is stored as good stays as it is.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, key: Sequence[str], checks: Callable[[], Mapping[str, Column]],
        most_attempts: int = 3, buckets: int = 16,
    ):
        self.spark, self.schema, self.key, self.checks, self.most_attempts = spark, schema, list(key), checks, most_attempts
        extra = T.StructType.fromDDL(_KEPT)
        self.good = KeyedTable(spark, f"{folder}/good", schema, key, buckets)
        self.quarantine = KeyedTable(spark, f"{folder}/quarantine", T.StructType([*schema.fields, *extra.fields]), key, buckets)
        self.status = KeyedTable(spark, f"{folder}/status", T.StructType.fromDDL(_STATUS), ["batch"], 1)

    def attempted(self, new: DataFrame, number: int) -> DataFrame:
        """New rows and quarantined ones with attempts left, one per key, with ``_error`` and the number of this attempt."""
        names = self.schema.names
        first = first_per_key(new.select(*names), self.key, [F.col(n) for n in names if n not in self.key] or [F.lit(0)])
        waiting = self.quarantine.read().filter((F.col("attempts") < self.most_attempts) & (F.col("batch") < number))
        again = join_keys(waiting, first.select(*self.key), self.key, "left_anti")
        rows = first.withColumn("attempts", F.lit(0)).unionByName(again.select(*names, "attempts"))
        return with_error(rows, dict(self.checks())).withColumn("attempts", F.col("attempts") + 1)

    def run_batch(self, new: DataFrame, number: int) -> None:
        """Process micro-batch ``number``; safe to repeat, whole or after a cut at any point."""
        tried = self.attempted(new, number)
        bad = tried.filter(F.col("_error").isNotNull()).select(
            *self.schema.names, F.col("_error").alias("error"), "attempts", F.lit(number).alias("batch"))
        self.good.insert_new(number, tried.filter(F.col("_error").isNull()), [F.col(k) for k in self.key])
        self.quarantine.rewrite(number, tried, lambda rows: join_keys(rows, tried.select(*self.key), self.key, "left_anti").unionByName(bad))
        # Counted from what is stored, so that a repeated batch counts alike.
        stored_bad = self.quarantine.rows_of(number).filter(F.col("batch") == number).select(F.lit("bad").alias("_error"))
        stored = self.good.rows_of(number).select(F.lit(None).cast("string").alias("_error")).unionByName(stored_bad)
        self.status.insert_new(number, batch_status(stored).select(F.lit(number).alias("batch"), "*"), [F.col("batch")])

    def start(self, incoming: str, checkpoint: str) -> StreamingQuery:
        """Take all waiting JSON-lines files once and stop; the checkpoint remembers what was taken."""
        return (
            self.spark.readStream.schema(self.schema).json(incoming)
            .writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(self.run_batch)
            .start()
        )
