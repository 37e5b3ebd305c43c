"""A1-A11 and I18: readers.

File readers run on files that Spark first writes from the tables to scratch storage, so their
work grows with the data and their rows can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from handbook_spark.corpus import Corpus
from handbook_spark.functions.nested import snake_fields
from handbook_spark.operators import aggregates
from handbook_spark.plans.registry import PART_POSITIONS, query
from handbook_spark.schemas import HANDBOOK_DOCUMENT
from handbook_spark.session import scratch_path
from handbook_spark.sources import readers


@query("a1_table_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def a1(c: Corpus) -> DataFrame:
    return readers.scan(c.spark, f"{c.path}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("a2_handbook_files", """
SELECT university AS id, CAST(sum(length(web_url) + 1) AS BIGINT) AS length FROM v_mhbs
WHERE university IN (SELECT n_nationkey FROM nation) GROUP BY university""")
def a2(c: Corpus) -> DataFrame:
    folder = scratch_path(c.spark)
    c.view("v_mhbs").select("university", "web_url").write.partitionBy("university").text(folder)
    files = readers.list_files(c.spark, folder, "*.txt", r"/university=(\d+)/[^/]*$")
    registry = c.table("nation").select(F.col("n_nationkey").alias("id"))
    return readers.registered_files(files, registry).groupBy("id").agg(F.sum("length").alias("length"))


_XML_ROW = T.StructType().add("_moduleId", "long").add("moduleCode", "string").add("fullTitle", "string").add(
    "creditInfo", T.StructType().add("ectsPoints", "integer")
)

# Tags make up most of the text. A compressed file is read by one task, so no file is long.
_XML_FILES = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}


@query("a3_xml_corpus", """
SELECT id AS module_id, module_code, title AS full_title, ects AS ects_points, true AS has_source FROM v_modules""")
def a3(c: Corpus) -> DataFrame:
    folder = scratch_path(c.spark)
    c.view("v_modules").select(
        F.col("id").alias("_moduleId"), F.col("module_code").alias("moduleCode"), F.col("title").alias("fullTitle"),
        F.struct(F.col("ects").alias("ectsPoints")).alias("creditInfo"),
    ).write.format("xml").option("rootTag", "modules").option("rowTag", "module").options(**_XML_FILES).save(folder)
    records = readers.read_xml(c.spark, folder, "module", _XML_ROW)
    return records.select(
        "module_id", "module_code", "full_title", F.col("credit_info.ects_points").alias("ects_points"),
        F.col("source_path").contains(folder.rsplit("/", 1)[-1]).alias("has_source"),
    )


@query("a4_positioned_xml", """
SELECT p_partkey AS id, 0 AS text_place, 0 AS place, CAST(p_size AS VARCHAR) AS left, '5' AS font, true AS bold, p_name AS text FROM part
UNION ALL SELECT p_partkey, 1, 0, '20', '7', false, p_type FROM part
UNION ALL SELECT p_partkey, 3, 0, '40', '6', false, p_brand FROM part
UNION ALL SELECT p_partkey, 3, 1, '40', '6', true, 'fett' FROM part""")
def a4(c: Corpus) -> DataFrame:
    return readers.positioned_xml_texts(c.view("v_xml_text"), "xml", "id").select(
        "id", "text_place", "place", "left", "font", "bold", "text"
    )


@query("a5_json_documents", "SELECT title AS name, module_code, module_title, ects FROM (SELECT h.title, m.module_code, m.title AS module_title, m.ects FROM v_modules m JOIN v_mhbs h ON h.id = m.mhb_id)")
def a5(c: Corpus) -> DataFrame:
    records = aggregates.roll_up(c.view("v_modules"), ["title", "ects"], PART_POSITIONS)
    names = c.view("v_mhbs").select(F.col("id").alias("mhb_id"), F.col("title").alias("name"))
    folder = scratch_path(c.spark)
    records.join(names, "mhb_id").select("name", "modules").write.json(folder)
    documents = readers.read_json_documents(c.spark, folder, HANDBOOK_DOCUMENT, one_per_file=False)
    return documents.select("name", F.inline("modules")).select(
        "name", "module_code", F.col("title").alias("module_title"), "ects"
    )


@query("a6_listing_payload", """
SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS web_id, CASE WHEN p_partkey % 3 <> 0 THEN 'l' || CAST(p_size AS VARCHAR) END AS logo_url,
       p_type AS degree, p_size AS duration, p_name AS title, p_brand AS university FROM part""")
def a6(c: Corpus) -> DataFrame:
    courses = readers.listing_courses(c.view("v_payload"), "body", "id")
    return courses.select("id", "web_id", "logo_url", "degree", "duration", "title", "university")


@query("a6_event_payload", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def a6_events(c: Corpus) -> DataFrame:
    return c.table("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("a7_university_list", """
SELECT CAST(id AS VARCHAR) AS hs_nr, name, city, 'https://uni' || CAST(id AS VARCHAR) || '.example.edu' AS website FROM v_unis_db""")
def a7(c: Corpus) -> DataFrame:
    folder = scratch_path(c.spark)
    c.view("v_unis_db").select(
        F.col("id").cast("string").alias("Hs-Nr."), F.col("name").alias("Hochschulname"),
        F.col("city").alias("Ort (Hausanschrift)"),
        F.concat(F.lit("https://uni"), F.col("id").cast("string"), F.lit(".example.edu")).alias("Home Page"),
    ).write.option("sep", "\t").option("header", "true").csv(folder)
    return readers.read_university_list(c.spark, folder)


_ROW = r"(?is)<ul(?:\s[^>]*)?>(.*?)</ul>"
_CELL = r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"
_LINK = '(?is)<a\\s[^>]*?href="([^"]*)"'


@query("a8_html_rows", rf"""
SELECT page_id, row_no, trim(regexp_replace(cells[1], '<[^<>]*>', '', 'g')) AS first, trim(regexp_replace(cells[6], '<[^<>]*>', '', 'g')) AS sixth,
  nullif(regexp_extract(cells[1], '{_LINK}', 1), '') AS first_link, nullif(regexp_extract(cells[6], '{_LINK}', 1), '') AS last_link
FROM (SELECT page_id, row_no, regexp_extract_all(row, '{_CELL}', 1) AS cells FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '{_ROW}', 1)) AS row,
         unnest(generate_series(0, len(regexp_extract_all(html, '{_ROW}', 1)) - 1)) AS row_no FROM pages)) WHERE len(cells) = 6""")
def a8(c: Corpus) -> DataFrame:
    headers = ["first", "second", "third", "fourth", "fifth", "sixth"]
    rows = readers.html_rows(c.table("pages"), "html", "page_id", "ul", "li", headers)
    return rows.select("page_id", "row_no", "first", "sixth", "first_link", "last_link")


@query("a9_line_keyword_filter", """
SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents)
WHERE (contains(lower(line), 'mhb') OR contains(lower(line), 'thth')) AND contains(line, 'tion')""")
def a9(c: Corpus) -> DataFrame:
    return readers.lines_with(readers.text_lines(c.table("documents"), "text", "doc_id"), ["mhb", "thth"], "tion")


@query("a10_log_records", """
SELECT event_id AS log_id, 0 AS record_no, 1700000000 + event_id AS epoch, CAST(floor(value) AS INT) AS duration, event_type || chr(10) || '  ' || props AS command FROM events
UNION ALL SELECT event_id, 1, 1700086400 + event_id, 0, 'exit' FROM events""")
def a10(c: Corpus) -> DataFrame:
    return readers.log_records(c.view("v_logs"), "blob", "log_id")


@query("a11_document_pages", """
SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS page_no FROM documents""")
def a11(c: Corpus) -> DataFrame:
    broken = F.replace(F.col("text"), F.lit("\n"), F.lit("\n<!-- Seite (neu) -->\n"))
    documents = c.table("documents").select("doc_id", broken.alias("text"))
    return readers.split_pages(documents, "text", "doc_id", "<!-- Seite (neu) -->")


@query("i18_snake_case_fields", """
SELECT id AS module_id, module_code, title AS main_title, ects AS ects_points FROM v_modules""")
def i18(c: Corpus) -> DataFrame:
    nested = c.view("v_modules").select(
        F.col("id").alias("@moduleId"),
        F.array(F.struct(F.col("module_code").alias("ModuleCode"), F.col("title").alias("mainTitle"))).alias("moduleParts"),
        F.struct(F.col("ects").alias("_ectsPoints")).alias("creditInfo"),
    )
    renamed = snake_fields(nested)
    return renamed.select(
        "module_id", F.get("module_parts", F.lit(0))["module_code"].alias("module_code"),
        F.get("module_parts", F.lit(0))["main_title"].alias("main_title"),
        F.col("credit_info.ects_points").alias("ects_points"),
    )
