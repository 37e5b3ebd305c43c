"""B: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.functions import urls
from handbook_spark.operators import filters
from handbook_spark.plans.registry import query

AS_OF = "2024-01-20 00:00:00"


@query("b1_module_projection", """
SELECT raw_module_id AS id, title, module_code, ects FROM v_ai WHERE lecturer = 'Prof. 7'""")
def b1(c: Corpus) -> DataFrame:
    modules = c.view("v_ai").withColumnRenamed("raw_module_id", "id")
    return filters.module_rows(modules, ["id", "title", "module_code", "ects"], lecturer="Prof. 7")


@query("b2_equality_conditions", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def b2(c: Corpus) -> DataFrame:
    return filters.select_rows(
        c.table("orders"), ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    )


@query("b3_negated_conditions", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'F'""")
def b3(c: Corpus) -> DataFrame:
    return filters.select_rows(
        c.table("orders"), ["o_orderkey", "o_orderstatus"], {"o_orderpriority": "5-LOW"}, {"o_orderstatus": "F"}
    )


@query("b4_where_with_variables", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.0 AND o_orderstatus = 'P'""")
def b4(c: Corpus) -> DataFrame:
    return filters.select_rows(
        c.table("orders"), ["o_orderkey", "o_totalprice"],
        where="o_totalprice > ? AND o_orderstatus = ?", variables=[250000.0, "P"],
    )


@query("b5_parameterised_sql", """
SELECT n.n_name, count(*) AS n_suppliers, round(avg(s.s_acctbal), 6) AS mean_balance
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal >= 500.0 GROUP BY n.n_name""")
def b5(c: Corpus) -> DataFrame:
    return c.sql(
        "SELECT n.n_name, count(*) AS n_suppliers, round(avg(s.s_acctbal), 6) AS mean_balance FROM supplier s"
        " JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal >= :least GROUP BY n.n_name",
        {"least": 500.0},
    )


@query("b6_row_of_maximum", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) LIMIT 1""")
def b6(c: Corpus) -> DataFrame:
    return filters.select_rows(c.table("orders"), ["o_orderkey", "o_custkey"], max_of="o_orderkey")


def _search(c: Corpus, **wanted: str) -> DataFrame:
    return filters.search_modules(c.view("v_search"), wanted).select("raw_module_id", "module_id")


_SEARCH = """
SELECT raw_module_id, module_id FROM v_search WHERE coalesce(module_code, ai_module_code) IS NOT NULL AND """


@query("b7_code_and_title_substring", _SEARCH + """
(module_code ILIKE '%eco-000%' OR (module_code IS NULL AND ai_module_code ILIKE '%eco-000%'))
AND (module_title ILIKE '%RING%' OR ai_title ILIKE '%RING%')""")
def b7(c: Corpus) -> DataFrame:
    return _search(c, module_code="eco-000", title="RING")


@query("b8_numeric_comparison", _SEARCH + """
(module_ects >= 30 OR (module_ects IS NULL AND ai_ects >= 30)) AND weekly_hours <= 3 AND recommended_semester = 2""")
def b8(c: Corpus) -> DataFrame:
    return _search(
        c, ects="30", ects_type=">=", weekly_hours="3", weekly_hours_type="<=", recommended_semester="2"
    )


@query("b9_json_text_and_lecturer", """
SELECT raw_module_id FROM v_search_full WHERE coalesce(module_code, ai_module_code) IS NOT NULL
  AND CAST(to_json(ai_requirements) AS VARCHAR) ILIKE '%modul 2%' AND ai_lecturer ILIKE '%PROF. 1%'""")
def b9(c: Corpus) -> DataFrame:
    return filters.search_modules(
        c.view("v_search_full"), {"requirements": "modul 2", "lecturer": "PROF. 1"}
    ).select("raw_module_id")


@query("b10_semester_filter", _SEARCH + "version = 20191")
def b10(c: Corpus) -> DataFrame:
    return _search(c, version="WS 2019/2020")


@query("b11_subject_prefix", _SEARCH + """
(module_code ILIKE 'sma-%' OR (module_code IS NULL AND ai_module_code ILIKE 'sma-%'))""")
def b11(c: Corpus) -> DataFrame:
    return _search(c, subject="sma")


@query("b12_dynamic_search", _SEARCH + """
(module_title ILIKE '%bolt%' OR ai_title ILIKE '%bolt%') AND (module_ects >= 10 OR (module_ects IS NULL AND ai_ects >= 10))
AND ai_lecturer ILIKE '%prof. 3%'""")
def b12(c: Corpus) -> DataFrame:
    return _search(c, title="bolt", ects="10", ects_type=">=", lecturer="prof. 3", subject=" ")


@query("b13_work_queue", """
SELECT id, web_url, CASE WHEN version IS NULL THEN 'open' ELSE 'done' END AS state FROM v_mhbs""")
def b13(c: Corpus) -> DataFrame:
    state = F.when(F.col("version").isNull(), F.lit("open")).otherwise(F.lit("done"))
    return c.view("v_mhbs").select("id", "web_url", state.alias("state"))


@query("b14_keyword_filter", """
SELECT page_id, (url LIKE '%blog%' OR url LIKE '%spam%') AS any_keyword,
       (lower(url) LIKE '%example.com%' OR lower(url) LIKE '%farm%') AND url LIKE '%html%' AS file_like,
       html LIKE '%</article>%' AS has_marker
FROM pages""")
def b14(c: Corpus) -> DataFrame:
    return c.table("pages").select(
        "page_id",
        urls.has_keyword(F.col("url"), ["blog", "spam"]).alias("any_keyword"),
        urls.is_handbook_file(F.col("url"), ["example.com", "farm"], "html").alias("file_like"),
        F.contains("html", F.lit("</article>")).alias("has_marker"),
    )


@query("b15_url_admissibility", """
SELECT page_id, url LIKE 'https://%' AND url LIKE '%.html' AND url NOT LIKE '%blog%' AND length(url) <= 500 AS admissible
FROM pages""")
def b15(c: Corpus) -> DataFrame:
    return c.table("pages").select(
        "page_id", urls.is_admissible(F.col("url"), "https://", ".html", "blog").alias("admissible")
    )


@query("b16_completeness", """
SELECT raw_module_id FROM v_ai
WHERE coalesce(module_code <> '', true) AND coalesce(title <> '', true) AND coalesce(lecturer <> '', true)
  AND coalesce(contents_txt <> '', true) AND coalesce(len(contents), 0) > 0""")
def b16(c: Corpus) -> DataFrame:
    return filters.complete(c.view("v_ai")).select("raw_module_id")


@query("b17_topic_exclusion", """
SELECT raw_module_id FROM v_ai WHERE len(contents) > 0 AND array_to_string(contents, ', ') NOT ILIKE '%hebamme 3%'""")
def b17(c: Corpus) -> DataFrame:
    return filters.without_topic(c.view("v_ai"), "contents", "hebamme 3").select("raw_module_id")


@query("b18_rows_with_a_code", """
SELECT raw_module_id, coalesce(ai_module_code, module_code) AS code FROM v_search
WHERE coalesce(ai_module_code, module_code) IS NOT NULL""")
def b18(c: Corpus) -> DataFrame:
    return c.view("v_search").filter(filters.has_code()).select(
        "raw_module_id", F.coalesce("ai_module_code", "module_code").alias("code")
    )


@query("b19_validity_window", f"""
SELECT event_id, ts + INTERVAL 3 DAY > TIMESTAMP '{AS_OF}' AS unexpired,
       ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 MINUTE AND event_type <> 'purchase' AS fresh,
       ts >= TIMESTAMP '{AS_OF}' - to_minutes((SELECT CAST(max(n_nationkey) * 60 AS INT) FROM nation)) AND event_type <> 'purchase' AS configured
FROM events""")
def b19(c: Corpus) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    used = F.col("event_type") == "purchase"
    minutes = c.table("nation").agg((F.max("n_nationkey") * 60).alias("minutes")).scalar()
    return c.table("events").select(
        "event_id",
        filters.unexpired(F.col("ts") + F.expr("INTERVAL 3 DAY"), as_of).alias("unexpired"),
        filters.recently_created(F.col("ts"), used, as_of, 90).alias("fresh"),
        filters.recently_created(F.col("ts"), used, as_of, minutes).alias("configured"),
    )
