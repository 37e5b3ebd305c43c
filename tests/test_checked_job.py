"""The running job over bad rows: retries, attempts, and cuts between its writes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

from handbook_spark.sources.keyed_table import KeyedTable
from handbook_spark.streaming.checked import CheckedJob

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.IntegerType())])


class Cut(Exception):
    """Raised before a table's write."""


def new_job(spark, folder, limit=0) -> CheckedJob:
    return CheckedJob(spark, str(folder), SCHEMA, ["id"], lambda: {"missing": F.col("v").isNotNull(), "small": F.col("v") >= limit}, 2, 4)


def tables(job) -> tuple:
    return tuple(sorted((tuple(r) for r in t.read().collect()), key=str) for t in (job.good, job.quarantine, job.status))


BATCHES = [[(1, 5), (2, None), (3, -1), (3, -1), (4, 0), (None, 2)], [(2, 7), (5, -3), (6, 1)], [(7, 1)]]


def test_retries_attempts_and_replacement(spark, tmp_path):
    limits = [0, -2, 0]
    for number, (rows, limit) in enumerate(zip(BATCHES, limits)):
        job = new_job(spark, tmp_path, limit)
        job.run_batch(spark.createDataFrame(rows, SCHEMA), number)
    good, kept, status = tables(job)
    # 3 is good in the second batch, 2 by a new row; 5 has used up its attempts.
    assert good == sorted([(1, 5), (4, 0), (None, 2), (3, -1), (2, 7), (6, 1), (7, 1)], key=str)
    assert kept == [(5, -3, "small", 2, 2)]
    assert status == [(0, 3, 2, "PARTIAL_SUCCESS", True), (1, 3, 1, "PARTIAL_SUCCESS", True), (2, 1, 1, "PARTIAL_SUCCESS", True)]
    job.run_batch(spark.createDataFrame([], SCHEMA), 3)
    assert tables(job)[1] == kept and tables(job)[2][-1] == (3, 0, 0, "FULL_SUCCESS", False)


@pytest.mark.parametrize("cut_at, when", [("quarantine", "before"), ("quarantine", "inside"), ("status", "before")])
def test_a_killed_batch_ends_in_equal_tables(spark, tmp_path, monkeypatch, cut_at, when):
    whole, cut = new_job(spark, tmp_path / "whole"), new_job(spark, tmp_path / "cut")
    for number, rows in enumerate(BATCHES[:2]):
        given = spark.createDataFrame(rows, SCHEMA)
        whole.run_batch(given, number)
        name, stop = ("_commit", Cut) if when == "before" else ("_write", Cut)
        original, target = getattr(KeyedTable, name), getattr(cut, cut_at)

        def fail(self, *args, **kwargs):
            if self is target:
                if when == "inside":
                    original(self, args[0].filter("bucket % 2 = 0"), *args[1:], **kwargs)
                raise stop
            return original(self, *args, **kwargs)

        monkeypatch.setattr(KeyedTable, name, fail)
        with pytest.raises(Cut):
            cut.run_batch(given, number)
        monkeypatch.undo()
        cut.run_batch(given, number)
        assert tables(cut) == tables(whole)
        cut.run_batch(given, number)
        assert tables(cut) == tables(whole)


def test_stream_takes_waiting_files_once(spark, tmp_path):
    job, incoming = new_job(spark, tmp_path / "job"), str(tmp_path / "in")
    for rows in BATCHES[:2]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(incoming)
        assert job.start(incoming, str(tmp_path / "cp")).awaitTermination(180)
    good, kept, status = tables(job)
    assert good == sorted([(1, 5), (4, 0), (None, 2), (2, 7), (6, 1)], key=str)
    assert [r[:4] for r in kept] == [(3, -1, "small", 2), (5, -3, "small", 1)] and [r[0] for r in status] == [0, 1]
