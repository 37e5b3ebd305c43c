"""Counts, quality figures, distinct values and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from handbook_spark.functions.dates import semester_label
from handbook_spark.functions.text import decode_escapes, subject
from handbook_spark.operators.numbering import block_of, number_rows_per_key


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def versions_per_code(df: DataFrame) -> DataFrame:
    return df.groupBy("module_code").agg(F.count(F.lit(1)).alias("n_versions"))


def extraction_quality(scored: DataFrame) -> DataFrame:
    """Rows in all, valid (every agreement at least 0.5), complete (every agreement 1), percentages."""
    scores = [F.col(c) for c in ("correct_module_code", "correct_ects", "correct_title")]
    lowest = F.least(*scores)
    counts = scored.agg(
        F.count(F.lit(1)).alias("overall"),
        F.count_if(lowest >= 0.5).alias("valid"),
        F.count_if(lowest == 1).alias("complete"),
    )
    return counts.select(
        "*",
        F.round(F.try_divide(F.col("valid") * 100.0, F.col("overall")), 2).alias("valid_pct"),
        F.round(F.try_divide(F.col("complete") * 100.0, F.col("overall")), 2).alias("complete_pct"),
    )


def filter_options(handbooks: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choices of the search form: semesters newest first, subjects in order."""
    versions = (
        handbooks.select("version").filter(F.col("version").isNotNull()).distinct()
        .orderBy(F.col("version").desc())
        .select("version", semester_label(F.col("version"), long=False).alias("label"))
    )
    subjects = (
        raw.select(subject(F.col("module_code")).alias("subject")).distinct().orderBy("subject")
        .select(decode_escapes(F.col("subject")).alias("subject"))
    )
    return versions, subjects


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def roll_up(modules: DataFrame, attributes: Sequence[str], record_size: int) -> DataFrame:
    """Handbook records with ordered modules and the list of their codes.

    A record is one part of a handbook: it covers ``record_size`` positions, and its number (``part``) belongs to
    its key. No record grows without bound, and the shape of the result is the same at every size.
    """
    entry = F.struct("pos", "module_code", *attributes)
    return (
        modules.groupBy("mhb_id", block_of("pos", record_size).alias("part"))
        .agg(F.sort_array(F.collect_list(entry)).alias("modules"))
        .select("mhb_id", "part", "modules", F.col("modules.module_code").alias("module_codes"))
    )


def match_groups(matches: DataFrame) -> DataFrame:
    """Known name -> number of distinct matched names, flagged when it is not one to one."""
    pairs = matches.select("name", "fetched_name").distinct()
    return (
        pairs.groupBy("name")
        .agg(F.count(F.lit(1)).alias("n_matches"), F.min("fetched_name").alias("first_match"))
        .withColumn("ambiguous", F.col("n_matches") > 1)
    )


def smallest_handbook(modules: DataFrame, handbook_ids: Sequence[int] | None = None) -> DataFrame:
    """Handbook with the fewest modules, the smaller id among equals."""
    rows = modules if handbook_ids is None else modules.filter(F.col("mhb_id").isin(*handbook_ids))
    counts = rows.groupBy("mhb_id").agg(F.count(F.lit(1)).alias("n_modules"))
    return counts.orderBy("n_modules", "mhb_id").limit(1)


def transferable_credits(overlap: DataFrame) -> DataFrame:
    return overlap.agg(F.sum("ects").alias("credits"), F.count(F.lit(1)).alias("n_modules"))


def daily_sequence(log: DataFrame, ts: str, entry: Column, tie_breaker: str) -> DataFrame:
    """Entries of every day numbered in time order."""
    rows = log.select(F.to_date(ts).alias("day"), F.col(ts).alias("_ts"), F.col(tie_breaker), entry.alias("command"))
    return number_rows_per_key(rows, ["day"], ["_ts", tie_breaker], "seq").select("day", "seq", "command")
