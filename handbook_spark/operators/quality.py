"""Runs that go on over bad rows: quarantine, batch status, retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

FULL_SUCCESS, PARTIAL_SUCCESS, FULL_ERROR = "FULL_SUCCESS", "PARTIAL_SUCCESS", "FULL_ERROR"


def with_error(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Name of the first failing check in ``_error``; NULL for good rows. A check that is NULL fails."""
    error = F.coalesce(
        *[F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)) for name, passed in checks.items()]
    )
    return df.withColumn("_error", error)


def split_bad(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Good rows, quarantined rows with their error)."""
    bad = F.col("_error").isNotNull()
    return checked.filter(~bad).drop("_error"), checked.filter(bad)


def batch_status(checked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Good and bad counts of a run, its status, and whether it counts as an error."""
    bad = F.col("_error").isNotNull()
    counts = (checked.groupBy(*keys) if keys else checked).agg(
        F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad")
    )
    status = (
        F.when(F.col("n_bad") == 0, F.lit(FULL_SUCCESS))
        .when(F.col("n_good") == 0, F.lit(FULL_ERROR))
        .otherwise(F.lit(PARTIAL_SUCCESS))
    )
    return counts.withColumn("status", status).withColumn("is_error", F.col("status") != FULL_SUCCESS)


def retry_input(source: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Rows of the source whose key was recorded as failed."""
    return source.join(errors.select(key).distinct(), key, "left_semi")


def after_retry(good: DataFrame, retried_good: DataFrame) -> DataFrame:
    """Successes of both runs."""
    return good.unionByName(retried_good)
