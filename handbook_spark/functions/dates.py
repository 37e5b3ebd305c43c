"""Semester codes and labels, local time, durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEMESTER = r"([WS])[omint]{3}ersemester (\d{4})"
LOCAL_ZONE = "Europe/Berlin"


def semester_code(text: Column) -> Column:
    """``Wintersemester 2016/2017`` -> 20161, ``Sommersemester 2016`` -> 20160, else NULL."""
    digit = F.when(F.regexp_extract(text, SEMESTER, 1) == "S", F.lit("0")).otherwise(F.lit("1"))
    return F.when(text.rlike(SEMESTER), F.concat(F.regexp_extract(text, SEMESTER, 2), digit).cast("int"))


def semester_label(version: Column, long: bool = True) -> Column:
    """20161 -> ``Wintersemester 2016/2017`` or ``WS 2016/2017``; NULL stays NULL."""
    year = F.floor(version / 10).cast("int")
    words = ("Wintersemester ", "Sommersemester ") if long else ("WS ", "SS ")
    return F.when(
        version % 10 == 1, F.concat(F.lit(words[0]), year.cast("string"), F.lit("/"), (year + 1).cast("string"))
    ).when(version.isNotNull(), F.concat(F.lit(words[1]), year.cast("string")))


def semester_from_label(label: str) -> int:
    """``WS 2024/2025`` -> 20241, ``SS 2024`` -> 20240 (driver-side filter value)."""
    return int(label.split("/")[0][3:]) * 10 + (1 if label.startswith("W") else 0)


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time of a UTC timestamp."""
    return F.from_utc_timestamp(ts, zone)


def session_expiry(ts: Column, days: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC instant of 05:30 local time, ``days`` local days after ``ts``."""
    day = F.date_add(F.to_date(local_time(ts, zone)), days)
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), zone)


def study_semesters(duration: Column) -> Column:
    """``6 Semester`` -> 6, ``40 Monate`` -> 6, anything else NULL."""
    return (
        F.when(F.contains(duration, F.lit("Semester")), F.substring_index(duration, " Semester", 1).try_cast("int"))
        .when(
            F.contains(duration, F.lit("Monate")),
            F.floor(F.substring_index(duration, " Monate", 1).try_cast("int") / 6).cast("int"),
        )
    )
