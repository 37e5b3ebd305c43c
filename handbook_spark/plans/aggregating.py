"""D and L: counts, roll-ups, quality figures, batch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from handbook_spark.corpus import Corpus
from handbook_spark.functions.dates import study_semesters
from handbook_spark.operators import aggregates, joins, quality
from handbook_spark.plans.registry import PART_POSITIONS, query
from handbook_spark.session import scratch_path
from handbook_spark.streaming.checked import CheckedJob


@query("d1_row_count", "SELECT count(*) AS n FROM lineitem")
def d1(c: Corpus) -> DataFrame:
    return aggregates.row_count(c.table("lineitem"))


@query("d2_versions_per_code", "SELECT module_code, count(*) AS n_versions FROM v_ai GROUP BY module_code")
def d2(c: Corpus) -> DataFrame:
    return aggregates.versions_per_code(c.view("v_ai"))


@query("d3_extraction_quality", """
SELECT overall, valid, complete, round(valid * 100.0 / overall, 2) AS valid_pct, round(complete * 100.0 / overall, 2) AS complete_pct
FROM (SELECT count(*) AS overall,
        count(*) FILTER (correct_module_code >= 0.5 AND correct_ects >= 0.5 AND correct_title >= 0.5) AS valid,
        count(*) FILTER (correct_module_code = 1 AND correct_ects = 1 AND correct_title = 1) AS complete FROM v_search)""")
def d3(c: Corpus) -> DataFrame:
    return aggregates.extraction_quality(c.view("v_search"))


@query("d4_version_options", """
SELECT DISTINCT version, CASE WHEN version % 10 = 1 THEN 'WS ' || CAST(version // 10 AS VARCHAR) || '/' || CAST(version // 10 + 1 AS VARCHAR)
  ELSE 'SS ' || CAST(version // 10 AS VARCHAR) END AS label FROM v_mhbs WHERE version IS NOT NULL""")
def d4_versions(c: Corpus) -> DataFrame:
    return aggregates.filter_options(c.view("v_mhbs"), c.view("v_modules_raw"))[0]


@query("d4_subject_options", """
SELECT DISTINCT upper(substr(module_code, 1, strpos(module_code, '-') - 1)) AS subject FROM v_modules_raw""")
def d4_subjects(c: Corpus) -> DataFrame:
    return aggregates.filter_options(c.view("v_mhbs"), c.view("v_modules_raw"))[1]


@query("d5_distinct_pairs", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def d5(c: Corpus) -> DataFrame:
    return aggregates.distinct_rows(c.table("customer"), ["c_nationkey", "c_mktsegment"])


@query("d6_whole_row_dedup", """
SELECT md5(text) AS text_md5, n_lines FROM (SELECT DISTINCT text, lang, len(string_split(text, chr(10))) AS n_lines,
  string_split(text, chr(10)) AS lines FROM documents)""")
def d6(c: Corpus) -> DataFrame:
    rows = c.table("documents").select("text", "lang", F.split("text", "\n").alias("lines"))
    return aggregates.distinct_rows(rows).select(F.md5("text").alias("text_md5"), F.size("lines").alias("n_lines"))


@query("d7_handbook_roll_up", """
SELECT mhb_id, CAST(pos // 10000 AS BIGINT) AS part, count(*) AS n_modules, string_agg(module_code, ',' ORDER BY pos) AS module_codes,
       string_agg(title, '|' ORDER BY pos) AS titles
FROM v_modules GROUP BY mhb_id, pos // 10000""")
def d7(c: Corpus) -> DataFrame:
    return aggregates.roll_up(c.view("v_modules"), ["title", "ects"], PART_POSITIONS).select(
        "mhb_id", "part", F.size("modules").cast("long").alias("n_modules"),
        F.array_join("module_codes", ",").alias("module_codes"), F.array_join("modules.title", "|").alias("titles"),
    )


@query("d8_ambiguous_matches", """
SELECT name, count(DISTINCT fetched_name) AS n_matches, min(fetched_name) AS first_match, count(DISTINCT fetched_name) > 1 AS ambiguous
FROM (SELECT u.id, u.name, f.name AS fetched_name FROM v_unis_db u JOIN v_unis_fetched f
  ON contains(replace(replace(lower(u.name), '—', '-'), '–', '-'), lower(f.name))
  OR contains(lower(f.name), replace(replace(lower(u.name), '—', '-'), '–', '-'))) GROUP BY name""")
def d8(c: Corpus) -> DataFrame:
    return aggregates.match_groups(joins.name_matches(c.view("v_unis_db"), c.view("v_unis_fetched")))


@query("d9_smallest_handbook", """
SELECT mhb_id, count(*) AS n_modules FROM v_modules GROUP BY mhb_id ORDER BY n_modules, mhb_id LIMIT 1""")
def d9(c: Corpus) -> DataFrame:
    return aggregates.smallest_handbook(c.view("v_modules"))


@query("d10_transferable_credits", """
SELECT CAST(sum(ects) AS BIGINT) AS credits, count(*) AS n_modules FROM v_modules WHERE mhb_id = 1
  AND module_code IN (SELECT module_code FROM v_modules WHERE mhb_id = 2)""")
def d10(c: Corpus) -> DataFrame:
    return aggregates.transferable_credits(joins.handbook_overlap(c.view("v_modules"), [1, 2]))


@query("d11_daily_commands", """
SELECT CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS seq, event_type AS command
FROM events""")
def d11(c: Corpus) -> DataFrame:
    return aggregates.daily_sequence(c.table("events"), "ts", F.col("event_type"), "event_id")


def _checked_events(c: Corpus) -> DataFrame:
    number = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return quality.with_error(
        c.table("events").withColumn("k", number),
        {"event failed": F.col("event_type") != "error", "k too small": F.col("k") >= 10},
    )


_CHECKED = """
SELECT *, CASE WHEN event_type = 'error' THEN 'event failed'
  WHEN NOT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 10, false) THEN 'k too small' END AS error FROM events"""


@query("l1_good_rows", f"SELECT event_id, user_id FROM ({_CHECKED}) WHERE error IS NULL")
def l1_good(c: Corpus) -> DataFrame:
    return quality.split_bad(_checked_events(c))[0].select("event_id", "user_id")


@query("l1_quarantined_rows", f"SELECT event_id, error FROM ({_CHECKED}) WHERE error IS NOT NULL")
def l1_bad(c: Corpus) -> DataFrame:
    return quality.split_bad(_checked_events(c))[1].select("event_id", F.col("_error").alias("error"))


@query("l1_listing_quarantine", """
SELECT id, CASE WHEN NOT (duration LIKE '%Semester%' OR duration LIKE '%Monate%') THEN 'no duration' ELSE 'ok' END AS outcome FROM v_listing""")
def l1_listing(c: Corpus) -> DataFrame:
    checked = quality.with_error(c.view("v_listing"), {"no duration": study_semesters(F.col("duration")).isNotNull()})
    return checked.select("id", F.coalesce("_error", F.lit("ok")).alias("outcome"))


@query("l1_sponsored_hits", """
SELECT page_id, CASE WHEN NOT contains(url, 'ref=') AND contains(url, 'utm_source') THEN 'sponsored' WHEN NOT starts_with(url, 'https://') THEN 'no target' END AS error
FROM pages""")
def l1_sponsored(c: Corpus) -> DataFrame:
    url = F.col("url")
    checks = {
        "sponsored": F.contains(url, F.lit("ref=")) | ~F.contains(url, F.lit("utm_source")),
        "no target": url.startswith("https://"),
    }
    return quality.with_error(c.table("pages"), checks).select("page_id", F.col("_error").alias("error"))


@query("l2_batch_status", f"""
SELECT event_type, n_good, n_bad, CASE WHEN n_bad = 0 THEN 'FULL_SUCCESS' WHEN n_good = 0 THEN 'FULL_ERROR' ELSE 'PARTIAL_SUCCESS' END AS status,
       n_bad > 0 AS is_error
FROM (SELECT event_type, count(*) FILTER (error IS NULL) AS n_good, count(*) FILTER (error IS NOT NULL) AS n_bad FROM ({_CHECKED}) GROUP BY event_type)""")
def l2(c: Corpus) -> DataFrame:
    return quality.batch_status(_checked_events(c), ["event_type"])


@query("l3_retry", f"""
SELECT event_id FROM ({_CHECKED}) WHERE error IS NULL OR error = 'k too small'""")
def l3(c: Corpus) -> DataFrame:
    good, bad = quality.split_bad(_checked_events(c))
    again = quality.retry_input(c.table("events"), bad, "event_id")
    # The second run accepts small numbers.
    retried, _ = quality.split_bad(quality.with_error(again, {"event failed": F.col("event_type") != "error"}))
    return quality.after_retry(good.select("event_id"), retried.select("event_id"))


_JOB_SCHEMA = "event_id long, event_type string, k int"
_JOB_ROWS = """
SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"""


def _job(c: Corpus, least: int) -> CheckedJob:
    """The events in two batches: the odd ones with a strict check, then the even ones and the failures with the given one."""
    limits = [10, least]
    job = CheckedJob(c.spark, scratch_path(c.spark), StructType.fromDDL(_JOB_SCHEMA), ["event_id"], lambda: {
        "event failed": F.col("event_type") != "error", "k too small": F.col("k") >= limits[0]}, buckets=8)
    rows = c.table("events").select(
        "event_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    for number, odd in ((1, 1), (2, 0)):
        for _ in range(2):  # each batch is run twice, as after a lost mark
            job.run_batch(rows.filter(F.col("event_id") % 2 == odd), number)
        limits.pop(0)
        limits.append(least)
    return job


@query("l3_job_good_rows", f"SELECT event_id, k FROM ({_JOB_ROWS}) WHERE event_type <> 'error' AND k >= 5")
def l3_job_good(c: Corpus) -> DataFrame:
    return _job(c, 5).good.read().select("event_id", "k")


@query("l3_job_quarantine", f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'event failed' ELSE 'k too small' END AS error, CAST(1 + event_id % 2 AS INT) AS attempts
FROM ({_JOB_ROWS}) WHERE event_type = 'error' OR k IS NULL OR k < 5""")
def l3_job_quarantine(c: Corpus) -> DataFrame:
    return _job(c, 5).quarantine.read().select("event_id", "error", "attempts")


@query("l2_job_status", f"""
SELECT batch, n_good, n_bad, CASE WHEN n_bad = 0 THEN 'FULL_SUCCESS' WHEN n_good = 0 THEN 'FULL_ERROR' ELSE 'PARTIAL_SUCCESS' END AS status, n_bad > 0 AS is_error
FROM (
  SELECT 1 AS batch, count(*) FILTER (event_type <> 'error' AND k >= 10) AS n_good,
    count(*) - count(*) FILTER (event_type <> 'error' AND k >= 10) AS n_bad FROM ({_JOB_ROWS}) WHERE event_id % 2 = 1
  UNION ALL SELECT 2, count(*) FILTER (event_type <> 'error' AND k >= 5), count(*) - count(*) FILTER (event_type <> 'error' AND k >= 5)
  FROM ({_JOB_ROWS}) WHERE event_id % 2 = 0 OR NOT coalesce(event_type <> 'error' AND k >= 10, false))""")
def l2_job(c: Corpus) -> DataFrame:
    return _job(c, 5).status.read()
