"""C and G: joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.operators import joins
from handbook_spark.operators.filters import search_modules, substring_patterns
from handbook_spark.plans.registry import query


def joined_extractions(c: Corpus) -> DataFrame:
    return joins.join_extractions(c.view("v_ai_full"), c.view("v_modules_raw"), c.view("v_modules_full"), c.view("v_mhbs"))


@query("c1_extraction_join", """
SELECT s.raw_module_id, s.ai_module_code, s.ai_ects, s.module_id, s.module_code, s.module_title, s.version, r.content AS raw_content
FROM v_search s JOIN v_modules_raw r ON r.id = s.raw_module_id""")
def c1(c: Corpus) -> DataFrame:
    return joined_extractions(c).select(
        "raw_module_id", "ai_module_code", "ai_ects", "module_id", "module_code", "module_title", "version", "raw_content"
    )


def module_search(c: Corpus, **filters: str) -> DataFrame:
    """Flagship search: join, filter, score, merge both sources, most trusted first."""
    found = joins.with_agreements(search_modules(joined_extractions(c), filters))
    return joins.merged_modules(found).orderBy(F.col("confidence_score").desc(), "raw_module_id")


def indexed_search(c: Corpus, **filters: str) -> DataFrame:
    """``module_search`` over stored rows: substring filters read only the buckets of rows that can match."""
    rows = c.search_index().candidates(substring_patterns(filters))
    found = joins.with_agreements(search_modules(rows, filters))
    return joins.merged_modules(found).orderBy(F.col("confidence_score").desc(), "raw_module_id")


@query("c1_module_search", """
SELECT raw_module_id, coalesce(module_code, ai_module_code) AS module_code, coalesce(module_title, ai_title) AS title,
       coalesce(module_ects, ai_ects) AS ects, CAST(correct_module_code AS DOUBLE) AS correct_module_code,
       CAST(correct_ects AS DOUBLE) AS correct_ects, CAST(correct_title AS DOUBLE) AS correct_title,
       round(CAST(correct_module_code + correct_ects + correct_title AS DOUBLE) / 3, 6) AS confidence_score
FROM v_search
WHERE (module_title ILIKE '%gizmo%' OR ai_title ILIKE '%gizmo%')
  AND (module_ects >= 20 OR (module_ects IS NULL AND ai_ects >= 20))""")
def c1_search(c: Corpus) -> DataFrame:
    return module_search(c, title="gizmo", ects="20", ects_type=">=").select(
        "raw_module_id", "module_code", "title", "ects", "correct_module_code", "correct_ects", "correct_title", "confidence_score"
    )


_RECORD = """
SELECT raw_module_id, coalesce(module_code, ai_module_code) AS module_code, coalesce(module_title, ai_title) AS title,
  coalesce(module_ects, ai_ects) AS ects, ai_lecturer AS lecturer, module_content AS complete_content,
  array_to_string(ai_contents, '; ') AS contents, module_goals AS complete_goals, array_to_string(ai_goals, '; ') AS goals,
  array_to_string(ai_requirements, '; ') AS requirements, array_to_string(ai_expense, '; ') AS expense,
  array_to_string(ai_success_requirements, '; ') AS success_requirements, weekly_hours, recommended_semester,
  array_to_string(ai_exams, '; ') AS exams, array_to_string(ai_module_parts, '; ') AS module_parts,
  CAST(module_pages[1] AS VARCHAR) || '; ' || CAST(module_pages[2] AS VARCHAR) AS pages,
  CASE WHEN version IS NULL THEN NULL WHEN version % 10 = 1 THEN 'Wintersemester ' || CAST(version // 10 AS VARCHAR) || '/' || CAST(version // 10 + 1 AS VARCHAR)
       ELSE 'Sommersemester ' || CAST(version // 10 AS VARCHAR) END AS version,
  CAST(correct_module_code AS DOUBLE) AS correct_module_code, CAST(correct_ects AS DOUBLE) AS correct_ects,
  CAST(correct_title AS DOUBLE) AS correct_title,
  round(CAST(correct_module_code + correct_ects + correct_title AS DOUBLE) / 3, 6) AS confidence_score
FROM v_search_full"""


def _joined_lists(rows: DataFrame) -> DataFrame:
    """Lists as texts, for comparison."""
    lists = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    return rows.withColumns({name: F.array_join(name, "; ") for name in lists})


@query("c1_full_record", f"""{_RECORD}
WHERE coalesce(module_code, ai_module_code) IS NOT NULL AND CAST(to_json(ai_requirements) AS VARCHAR) ILIKE '%modul 3%' AND ai_lecturer ILIKE '%prof. 1%'""")
def c1_record(c: Corpus) -> DataFrame:
    return _joined_lists(module_search(c, requirements="modul 3", lecturer="Prof. 1"))


# Each filter of the search alone: its value and the condition that it stands for.
_FILTERS: dict[str, tuple[dict[str, str], str]] = {
    "module_code": ({"module_code": "eco-0000"}, "coalesce(module_code, ai_module_code) ILIKE '%eco-0000%'"),
    "title": ({"title": "bolt"}, "(module_title ILIKE '%bolt%' OR ai_title ILIKE '%bolt%')"),
    "ects": ({"ects": "12", "ects_type": "<="}, "coalesce(module_ects, ai_ects) <= 12"),
    "lecturer": ({"lecturer": "prof. 11"}, "ai_lecturer ILIKE '%prof. 11%'"),
    "requirements": ({"requirements": "modul 2"}, "CAST(to_json(ai_requirements) AS VARCHAR) ILIKE '%modul 2%'"),
    "success_requirements": (
        {"success_requirements": "Bestanden 1"}, "CAST(to_json(ai_success_requirements) AS VARCHAR) ILIKE '%bestanden 1%'"),
    "weekly_hours": ({"weekly_hours": "4"}, "weekly_hours = 4"),
    "recommended_semester": ({"recommended_semester": "6", "recommended_semester_type": ">="}, "recommended_semester >= 6"),
    "exams": ({"exams": "klausur 2"}, "CAST(to_json(ai_exams) AS VARCHAR) ILIKE '%klausur 2%'"),
    "version": ({"version": "WS 2019/2020"}, "version = 20191"),
    "subject": ({"subject": "sma"}, "coalesce(module_code, ai_module_code) ILIKE 'sma-%'"),
}


def _filter_query(name: str, wanted: dict[str, str], condition: str) -> None:
    @query(f"b12_filter_{name}", f"""
SELECT raw_module_id, coalesce(module_code, ai_module_code) AS module_code, round(CAST(correct_module_code + correct_ects + correct_title AS DOUBLE) / 3, 6) AS confidence_score
FROM v_search_full WHERE coalesce(module_code, ai_module_code) IS NOT NULL AND {condition}""")
    def search(c: Corpus) -> DataFrame:
        return indexed_search(c, **wanted).select("raw_module_id", "module_code", "confidence_score")


for _name, (_wanted, _condition) in _FILTERS.items():
    _filter_query(_name, _wanted, _condition)

# Patterns that the index cannot narrow, or only in part: short ones, wildcards, several fields.
_filter_query("short_pattern", {"title": "bo", "lecturer": "1"}, "(module_title ILIKE '%bo%' OR ai_title ILIKE '%bo%') AND ai_lecturer ILIKE '%1%'")
_filter_query("wildcards", {"title": "b_lt%1"}, "(module_title ILIKE '%b_lt%1%' OR ai_title ILIKE '%b_lt%1%')")
_filter_query("several", {"title": "bolt", "lecturer": "prof. 1", "subject": "eco", "exams": "klausur"}, """
(module_title ILIKE '%bolt%' OR ai_title ILIKE '%bolt%') AND ai_lecturer ILIKE '%prof. 1%'
AND coalesce(module_code, ai_module_code) ILIKE 'eco-%' AND CAST(to_json(ai_exams) AS VARCHAR) ILIKE '%klausur%'""")


@query("i43_full_merge", _RECORD)
def i43_full(c: Corpus) -> DataFrame:
    return _joined_lists(joins.merged_modules(c.search_rows(c.search_matches(c.view("v_modules")))))


@query("c2_handbook_universities", """
SELECT h.id, h.title, u.name AS university_name, u.city FROM v_mhbs h
JOIN (SELECT n_nationkey AS id, n_name AS name, 'City ' || CAST(n_nationkey AS VARCHAR) AS city FROM nation) u ON h.university = u.id""")
def c2(c: Corpus) -> DataFrame:
    universities = c.table("nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("City "), F.col("n_nationkey").cast("string")).alias("city"),
    )
    return joins.handbook_universities(c.view("v_mhbs"), universities).select("id", "title", "university_name", "city")


@query("c3_not_yet_extracted", """
SELECT id, module_code FROM v_modules_raw r WHERE NOT EXISTS (SELECT 1 FROM v_ai a WHERE a.raw_module_id = r.id)""")
def c3(c: Corpus) -> DataFrame:
    known = c.view("v_ai").select(F.col("raw_module_id").alias("id"))
    return joins.not_yet_in(c.view("v_modules_raw"), known, ["id"]).select("id", "module_code")


# Links already stored: those of the pages that every third page links to.
_KNOWN_PAGES = "SELECT url FROM pages WHERE page_id IN (SELECT dst FROM v_links WHERE src % 3 = 0)"


@query("c4_new_links", f"""
SELECT DISTINCT url FROM pages WHERE url NOT IN ({_KNOWN_PAGES})""")
def c4(c: Corpus) -> DataFrame:
    known = c.sql(_KNOWN_PAGES)
    return joins.not_yet_in(c.table("pages").select("url").distinct(), known, ["url"])


# Stored and uploaded texts are two halves of the table; copies lie in both.
_STORED = "SELECT doc_id, md5(text) AS content_md5 FROM documents WHERE doc_id % 2 = 0"


@query("c5_content_hash_lookup", f"""
WITH stored AS ({_STORED}), uploaded AS (SELECT DISTINCT md5(text) AS content_md5 FROM documents WHERE doc_id % 4 <> 2)
SELECT 'found' AS state, content_md5, doc_id FROM stored WHERE content_md5 IN (SELECT content_md5 FROM uploaded)
UNION ALL
SELECT 'missing', content_md5, NULL FROM uploaded WHERE content_md5 NOT IN (SELECT content_md5 FROM stored)""")
def c5(c: Corpus) -> DataFrame:
    found, missing = joins.content_matches(
        c.table("documents").filter(F.col("doc_id") % 4 != 2), "text", c.sql(_STORED)
    )
    return found.select(F.lit("found").alias("state"), "content_md5", "doc_id").unionByName(
        missing.select(F.lit("missing").alias("state"), "content_md5", F.lit(None).cast("long").alias("doc_id"))
    )


@query("c6_handbook_overlap", """
SELECT pos, module_code, title, ects FROM v_modules m WHERE mhb_id = 1
  AND module_code IN (SELECT module_code FROM v_modules WHERE mhb_id = 2)
  AND module_code IN (SELECT module_code FROM v_modules WHERE mhb_id = 3)""")
def c6(c: Corpus) -> DataFrame:
    return joins.handbook_overlap(c.view("v_modules"), [1, 2, 3]).select("pos", "module_code", "title", "ects").orderBy("pos")


@query("c7_two_way_overlap", """
SELECT l.module_code, coalesce(l.title, 'k.A.') AS title, coalesce(CAST(l.ects AS VARCHAR), 'k.A.') AS ects
FROM v_modules l WHERE l.mhb_id = 4 AND l.module_code IN (SELECT module_code FROM v_modules WHERE mhb_id = 5)""")
def c7(c: Corpus) -> DataFrame:
    return joins.common_modules(c.view("v_modules"), [4, 5], ["title", "ects"])


@query("c7_n_way_overlap", """
WITH codes AS (SELECT module_code FROM v_modules WHERE mhb_id IN (1, 2, 3) GROUP BY module_code HAVING count(DISTINCT mhb_id) = 3)
SELECT l.module_code, coalesce(l.title, 'k.A.') AS title, coalesce(CAST(l.ects AS VARCHAR), 'k.A.') AS ects
FROM v_modules l WHERE l.mhb_id = 1 AND l.module_code IN (SELECT module_code FROM codes)""")
def c7_many(c: Corpus) -> DataFrame:
    return joins.common_modules(c.view("v_modules"), [1, 2, 3], ["title", "ects"])


@query("c6_same_handbook_pages", """
SELECT module_code, CASE WHEN pos % 3 = 0 THEN CAST(pos % 50 AS VARCHAR) || ' - ' || CAST(pos % 50 + 1 AS VARCHAR)
  ELSE CAST(pos % 50 AS VARCHAR) || ', ' || CAST(pos % 50 + 2 AS VARCHAR) END AS pages FROM v_modules WHERE mhb_id = 6""")
def c6_same(c: Corpus) -> DataFrame:
    first = (F.col("pos") % 50).cast("int")
    second = first + F.when(F.col("pos") % 3 == 0, F.lit(1)).otherwise(F.lit(2))
    modules = c.view("v_modules").withColumn("pages", F.array(second, first, second))
    return joins.compare_handbooks(modules, [6, 6]).select("module_code", "pages")


_NAME_MATCH = """
SELECT u.id, u.name, f.name AS fetched_name FROM v_unis_db u JOIN v_unis_fetched f
  ON contains(replace(replace(lower(u.name), '—', '-'), '–', '-'), replace(replace(lower(f.name), '—', '-'), '–', '-'))
  OR contains(replace(replace(lower(f.name), '—', '-'), '–', '-'), replace(replace(lower(u.name), '—', '-'), '–', '-'))"""


@query("c8_name_match", _NAME_MATCH)
def c8(c: Corpus) -> DataFrame:
    return joins.name_matches(c.view("v_unis_db"), c.view("v_unis_fetched"))


@query("c9_preferred_match", """
SELECT id, website, hs_nr, city_check_successful FROM (
  SELECT u.id, f.website, f.hs_nr, list_contains(string_split(u.city, ', '), f.city) AS city_check_successful,
         row_number() OVER (PARTITION BY u.id ORDER BY list_contains(string_split(u.city, ', '), f.city) DESC, f.hs_nr) AS rn
  FROM v_unis_db u JOIN v_unis_fetched f ON u.name = f.name) WHERE rn = 1""")
def c9(c: Corpus) -> DataFrame:
    return joins.preferred_university(c.view("v_unis_db"), c.view("v_unis_fetched"))


@query("c10_provenance", """
WITH hits AS (
  SELECT a.raw_module_id, r.id FROM v_ai a JOIN v_modules_raw r ON a.module_code = r.module_code
   AND (a.lecturer IS NULL OR list_bool_and(list_transform(string_split(a.lecturer, ', '), lambda t: contains(r.content, t))))
   AND (a.ects IS NULL OR contains(r.content, CAST(a.ects AS VARCHAR))))
SELECT a.raw_module_id, count(h.id) AS n_matches, min(h.id) AS first_raw_id
FROM v_ai a LEFT JOIN hits h ON a.raw_module_id = h.raw_module_id GROUP BY a.raw_module_id""")
def c10(c: Corpus) -> DataFrame:
    return joins.provenance(c.view("v_ai"), c.view("v_modules_raw"))


@query("c11_url_file_lookup", """
WITH known AS (SELECT url, min('file_' || CAST(page_id AS VARCHAR)) AS file_name FROM pages WHERE url LIKE 'https://%' GROUP BY url),
     named AS (SELECT p.url, coalesce(k.file_name, split_part(p.url, '/', -1)) AS name FROM pages p LEFT JOIN known k ON p.url = k.url)
SELECT url, CASE WHEN contains(name, '.pdf') THEN name ELSE name || '.pdf' END AS file_name FROM named""")
def c11(c: Corpus) -> DataFrame:
    pages = c.table("pages")
    known = (
        pages.filter(F.col("url").startswith("https://")).groupBy("url")
        .agg(F.min(F.concat(F.lit("file_"), F.col("page_id").cast("string"))).alias("file_name"))
    )
    return joins.file_names(pages.select("url"), known)


@query("g1_shared_codes", """
SELECT module_code FROM v_modules WHERE mhb_id IN (1, 2, 3) GROUP BY module_code HAVING count(DISTINCT mhb_id) = 3""")
def g1(c: Corpus) -> DataFrame:
    return joins.shared_codes(c.view("v_modules"), [1, 2, 3])


@query("g2_union_of_results", """
SELECT module_code, title FROM (SELECT DISTINCT module_code, title FROM
  (SELECT module_code, title FROM v_ai UNION ALL SELECT module_code, title FROM v_modules) x)""")
def g2(c: Corpus) -> DataFrame:
    parts = [c.view(v).select("module_code", "title") for v in ("v_ai", "v_modules")]
    return joins.combine(parts, distinct=True)


@query("g3_newly_found_links", f"""
SELECT DISTINCT url FROM pages WHERE url LIKE 'http%' AND url NOT IN ({_KNOWN_PAGES})""")
def g3(c: Corpus) -> DataFrame:
    return joins.newly_found(c.table("pages"), c.sql(_KNOWN_PAGES))
