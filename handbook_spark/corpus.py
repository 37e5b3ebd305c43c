"""Input tables and the handbook views derived from them.

Every view is plain SQL over the fourteen input tables. Most texts are portable and are run
unchanged by Spark and by the DuckDB check; the few that unnest or build arrays are written
once per dialect.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from handbook_spark.operators import joins, substring_index
from handbook_spark.operators.filters import INDEXED_TEXTS
from handbook_spark.operators.text_index import TextIndex, build_index
from handbook_spark.session import input_state, scratch_path
from handbook_spark.sources.page_streams import scan_pages

T = TypeVar("T")

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

def padded(number: str, width: int) -> str:
    """SQL text of a number with leading zeros; longer numbers keep all their digits."""
    text = f"CAST({number} AS STRING)"
    return f"CASE WHEN length({text}) < {width} THEN lpad({text}, {width}, '0') ELSE {text} END"


PORTABLE_VIEWS: dict[str, str] = {
    "v_mhbs": """
SELECT s_suppkey AS id,
       'https://mhb.example.edu/' || CAST(s_nationkey AS STRING) || '/hb' || CAST(s_suppkey AS STRING) || '.pdf' AS web_url,
       s_name AS title, s_nationkey AS university,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Bachelor of Science' WHEN s_suppkey % 3 = 1 THEN 'Master of Arts' ELSE 'Staatsexamen' END AS degree,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST((2010 + s_suppkey % 15) * 10 + s_suppkey % 2 AS INT) END AS version
FROM supplier""",
    "v_modules": """
SELECT d.l_partkey * 2147483648 + d.l_suppkey AS id,
       upper(substr(p.p_type, 1, 3)) || '-' || @PADDED_PART AS module_code,
       p.p_name || ' ' || CAST(p.p_size AS STRING) AS title,
       CASE WHEN d.l_partkey % 11 = 0 THEN NULL ELSE p.p_size END AS ects,
       d.l_suppkey AS mhb_id, d.l_partkey AS pos
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d JOIN part p ON p.p_partkey = d.l_partkey""".replace(
        "@PADDED_PART", padded("d.l_partkey", 6)),
    "v_modules_raw": """
SELECT id, module_code, mhb_id,
       'Modul ' || module_code || ': ' || title || chr(10) || coalesce(CAST(ects AS STRING), 'k.A.') || ' ECTS/LP'
         || chr(10) || 'Prof. ' || CAST(pos % 40 AS STRING) || chr(10) || 'Inhalte:' || chr(10) || 'Thema ' || CAST(pos % 9 AS STRING) AS content
FROM v_modules""",
    "v_ai_base": """
SELECT id AS raw_module_id,
       CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN lower(module_code) ELSE module_code END AS module_code,
       CASE WHEN id % 5 = 0 THEN NULL WHEN id % 9 = 0 THEN title || '*' ELSE title END AS title,
       CASE WHEN id % 6 = 0 THEN NULL WHEN id % 10 = 1 THEN ects + 1 ELSE ects END AS ects,
       CASE WHEN id % 8 = 0 THEN NULL ELSE 'Prof. ' || CAST(pos % 40 AS STRING) END AS lecturer,
       CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN '' ELSE 'Thema ' || CAST(pos % 9 AS STRING) || ', Hebamme ' || CAST(pos % 4 AS STRING) END AS contents_txt,
       CAST(pos % 6 AS INT) AS weekly_hours, CAST(1 + pos % 8 AS INT) AS recommended_semester
FROM v_modules WHERE id % 4 <> 3""",
    "v_search": """
SELECT ai.raw_module_id, ai.module_code AS ai_module_code, ai.title AS ai_title, ai.ects AS ai_ects, ai.lecturer AS ai_lecturer,
       ai.weekly_hours, ai.recommended_semester, m.id AS module_id, m.module_code, m.title AS module_title, m.ects AS module_ects,
       m.mhb_id, h.version,
       CASE WHEN ai.module_code IS NULL THEN 0.5 WHEN ai.module_code = m.module_code THEN 1.0 ELSE 0.0 END AS correct_module_code,
       CASE WHEN ai.ects IS NULL THEN 0.5 WHEN ai.ects = m.ects THEN 1.0 ELSE 0.0 END AS correct_ects,
       CASE WHEN ai.title IS NULL THEN 0.5 WHEN ai.title = m.title THEN 1.0 ELSE 0.0 END AS correct_title
FROM v_ai_base ai JOIN v_modules_raw r ON ai.raw_module_id = r.id
     JOIN v_modules m ON r.mhb_id = m.mhb_id AND r.module_code = m.module_code
     JOIN v_mhbs h ON m.mhb_id = h.id""",
    "v_unis_db": """
SELECT s.s_suppkey AS id,
       CASE WHEN s.s_suppkey % 4 = 0 THEN n.n_name WHEN s.s_suppkey % 4 = 1 THEN lower(n.n_name) || ' – campus' WHEN s.s_suppkey % 4 = 2 THEN n.n_name ELSE 'University ' || CAST(s.s_suppkey AS STRING) END AS name,
       CASE WHEN s.s_suppkey % 2 = 0 THEN 'City ' || CAST(s.s_nationkey AS STRING) || ', City X' ELSE 'City Y' END AS city
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "v_unis_fetched": """
SELECT n_name AS name, 'City ' || CAST(n_nationkey AS STRING) AS city,
       'https://www.' || lower(n_name) || '.example.edu/' AS website, CAST(n_nationkey + 100 AS STRING) AS hs_nr
FROM nation""",
    "v_titles": """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 5 = 0 THEN p_name || ' (' || CAST(p_size AS STRING) || 'LP)'
            WHEN p_partkey % 5 = 1 THEN p_name || ' (' || CAST(p_size AS STRING) || ' LP)'
            WHEN p_partkey % 5 = 2 THEN p_name || ' ' || CAST(p_size AS STRING) || ' CP'
            WHEN p_partkey % 5 = 3 THEN p_name || ' (old, ' || CAST(p_size AS STRING) || ' LP)'
            ELSE '  ' || p_name || '   ' || p_brand END AS title
FROM part""",
    "v_listing": """
SELECT c_custkey AS id,
       c_name || chr(10) || ' City ' || CAST(c_nationkey AS STRING) || chr(10) || 'Uni ' || CAST(c_nationkey AS STRING) || ' ' || chr(10)
         || CASE WHEN c_custkey % 2 = 0 THEN 'Bachelor of Arts' ELSE 'Master of Science' END AS title,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(6 + c_custkey % 5 AS STRING) || ' Semester'
            WHEN c_custkey % 3 = 1 THEN CAST(20 + c_custkey % 30 AS STRING) || ' Monate' ELSE 'variabel' END AS duration,
       CASE WHEN c_custkey % 2 = 0 THEN 'Vollzeit, Teilzeit' ELSE 'Dual' END AS study_type,
       CASE WHEN c_custkey % 4 = 0 THEN 'Wintersemester ' || CAST(2010 + c_custkey % 14 AS STRING) || '/' || CAST(2011 + c_custkey % 14 AS STRING) || ' - MHB'
            WHEN c_custkey % 4 = 1 THEN 'Sommersemester ' || CAST(2010 + c_custkey % 14 AS STRING) || ' - MHB' ELSE 'ohne Angabe' END AS footer
FROM customer""",
    "v_links": """
SELECT page_id AS src, (page_id * 7 + 13) % (SELECT count(*) FROM pages) AS dst FROM pages
UNION ALL SELECT page_id, (page_id * 7 + 26) % (SELECT count(*) FROM pages) FROM pages
UNION ALL SELECT page_id, (page_id * 3 + 5) % (SELECT count(*) FROM pages) FROM pages""",
    "v_pages_of": """
SELECT DISTINCT l_partkey AS module_id, CAST(l_suppkey % 40 AS INT) AS page FROM lineitem""",
    "v_payload": """
SELECT p_partkey AS id,
       '{"results":{"items":[{"id":"' || CAST(p_partkey AS STRING) || '","headline":"' || p_name || '","subline":"' || p_brand
         || '","logo":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '{"src":{"large":"l' || CAST(p_size AS STRING) || '"}}' END
         || ',"items":[{"text":"' || p_type || '"},{"text":"' || CAST(p_size AS STRING) || ' Semester"}]}]}}' AS body
FROM part""",
    "v_extractions": """
SELECT event_id AS id,
       CASE WHEN event_id % 7 = 0 THEN '{"modules":[{"title":"' || event_type || '","ects":"' || CAST(user_id AS STRING) || '"'
            WHEN event_id % 7 = 1 THEN '{"modules":[{"title":"' || event_type || '","ects":"' || event_type || '"}]}'
            WHEN event_id % 7 = 2 THEN '{"data":{"modules":[{"title":"' || event_type || '","ects":' || CAST(user_id AS STRING) || '}]}}'
            WHEN event_id % 7 = 3 THEN props
            ELSE '{"modules":[{"title":"' || event_type || '","ects":"' || CAST(user_id AS STRING) || '"},{"title":"zweites","ects":null}]}' END AS answer
FROM events""",
    "v_logs": """
SELECT event_id AS log_id, user_id,
       ': ' || CAST(1700000000 + event_id AS STRING) || ':' || CAST(CAST(floor(value) AS INT) AS STRING) || ';' || event_type || chr(10) || '  ' || props
         || chr(10) || ': ' || CAST(1700086400 + event_id AS STRING) || ':0;exit' AS blob
FROM events""",
    "v_programmes": """
SELECT id, 'Studiengang ' || CAST(id AS STRING) AS name,
       CASE WHEN id % 2 = 0 THEN 'Bachelor of Arts' ELSE 'Master of Science' END AS degree,
       CASE WHEN id % 5 = 0 THEN NULL ELSE duration END AS duration,
       CASE WHEN id % 4 = 0 THEN ' Zulassungsfrei ' ELSE 'NC' END AS admission,
       'Deutsch' AS language,
       CASE WHEN id % 7 = 0 THEN NULL ELSE study_type END AS study_type,
       'Wintersemester' AS start_term,
       CASE WHEN id % 3 = 0 THEN NULL ELSE '15.07.' END AS deadline_winter,
       CASE WHEN id % 3 = 0 OR id % 2 = 0 THEN NULL ELSE '15.01.' END AS deadline_summer,
       'C1' AS german_level, 'Inhalt ' || CAST(id % 10 AS STRING) AS content,
       'Forschung, Lehre ' || CAST(id % 3 AS STRING) AS perspectives_txt
FROM v_listing""",
}

_HEADER_CODE = "'SRC-' || " + padded("(CAST(substr(source, 4) AS INT) * 10 + CAST(floor(page_no / 3) AS INT) % 4)", 4)
_SPARK_LINES = (
    "SELECT doc_id, lang, source, page_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS page_no, line"
)
_SPARK_JOIN = "array_join(array({}), chr(10))"
_DUCK_LINES = (
    "SELECT doc_id, lang, source, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS page_no,"
    " unnest(string_split(text, chr(10))) AS line FROM documents"
)


def _page_text(lines: str) -> str:
    return f"""
SELECT doc_id AS handbook_id, CAST(page_no AS INT) AS page_no, {_HEADER_CODE} AS header,
       'Modul ' || {_HEADER_CODE} || chr(10) || line || chr(10) || 'Stand ' || lang || chr(10) || CAST(page_no AS STRING) AS text
FROM ({lines}) t"""


def _md_pages(lines: str) -> str:
    return f"""
SELECT doc_id AS handbook_id, CAST(page_no AS INT) AS page_no,
       CASE WHEN page_no % 4 = 2 THEN chr(10) || '| Modul ' || CAST(page_no AS STRING) || ' |' || chr(10) ELSE '' END || line AS text
FROM ({lines}) t"""


def _shown(x: str, y: str, text: str) -> str:
    return f"'1 0 0 -1 {x} {y} Tm [(' || {text} || ')] TJ'"


def _page_streams(lines: str, join: str) -> str:
    """Page content streams in the layout the page readers understand, built from text lines."""
    backslash = "chr(92)"
    escaped = "line"
    for char, code in (("(", "("), (")", ")"), ("ä", "344"), ("ö", "366"), ("ü", "374"), ("é", "351")):
        escaped = f"replace({escaped}, '{char}', {backslash} || '{code}')"
    exam = f"'Pr' || {backslash} || '374fung'"
    code = _HEADER_CODE
    number = "CAST(page_no AS STRING)"
    cover = [
        "'BT'", _shown("40", "20", "'Modulhandbuch'"), "'/F1 12 Tf'",
        _shown("40", "50", f"'Studium ' || {backslash} || '(' || lang || {backslash} || ')'"), "'ET'", "'Q'", "''",
    ]

    def source_code(n: int) -> str:
        return "'SRC-' || " + padded(f"(CAST(substr(source, 4) AS INT) * 10 + {n})", 4)

    toc = ["'BT'", _shown("40", "20", "'Inhaltsverzeichnis'")]
    for n, y in ((0, "100"), (2, "110.5"), (1, "120"), (2, "130")):
        toc += [
            _shown("40", y, source_code(n) + " || ': Titel'"), _shown("300", y, "'.'"),
            _shown("350", y, source_code(3)), _shown("400", y, f"'{n}'"),
        ]
    toc += [_shown("40", "140", f"'nur Text ' || {number}"), "'ET'", "'Q'", "''"]
    module = [
        "'BT'", "'/F3 10 Tf'", _shown("40", "20", f"'Modul ' || {code}"), _shown("40", "25", f"'Titel ' || {number} || ' Grund-'"),
        _shown("40", "28", "'lagen'"), "'/F2 9 Tf'",
        f"CASE WHEN page_no % 5 = 0 THEN 'n' ELSE {_shown('40', '30', 'CAST(page_no % 5 * 3 AS STRING) || ' + chr(39) + ' ECTS/LP' + chr(39))} END",
        _shown("40", "60", "'Inhalte:'"), _shown("60", "70.5", escaped), _shown("160", "70.5", f"'Teil ' || CAST(page_no % 2 AS STRING)"),
        _shown("60", "80", "'Ende ) -12.5 ( Block'"), "'ET'", "'Q'",
        _shown("40", "200", "'Lernziele/Kompetenzen:'"), _shown("60", "210", "'Ziel ' || lang"), "'ET'", "'Q'",
        _shown("40", "300", "'Modulteile'"),
        _shown("40", "310", "'Modulteil:'"), _shown("60", "320", f"'Vorlesung ' || {number}"),
        _shown("60", "330", "'Lehrformen: '"), _shown("90", "330", f"'Vorlesung, ' || {backslash} || '334bung'"),
        _shown("60", "340", "'Sprache: '"), _shown("90", "340", "lang"),
        _shown("60", "350", "'SWS: '"), _shown("90", "350", "CAST(page_no % 4 AS STRING)"),
        _shown("60", "360", exam), _shown("60", "370", "'Klausur'"), _shown("60", "380", "'benotet'"), "'Q'", "'Q'",
        _shown("40", "410", "'Modulteil:'"), _shown("60", "430", "'Lehrformen: '"), _shown("90", "430", "'Seminar'"),
        _shown("40", "500", f"'G' || {backslash} || '374ltig im Sommer'"), "'ET'", "'Q'",
        _shown("500", "800", number), "'ET'", "'Q'", "''",
    ]
    built = [join.format(", ".join(part)) for part in (cover, toc, module)]
    return f"""
SELECT doc_id AS handbook_id, CAST(page_no AS INT) AS page_no,
       CASE WHEN page_no = 0 THEN {built[0]} WHEN page_no = 1 THEN {built[1]} ELSE {built[2]} END AS stream
FROM ({lines}) t"""


_XML_TEXT = """
SELECT p_partkey AS id,
       '<data><page number="1"><fontspec id="5"/><text top="1" left="' || CAST(p_size AS STRING) || '" font="5"><b>' || p_name
         || '</b></text><text top="2" left="20" font="7"> ' || p_type || ' </text><text top="3" left="30" font="6">  </text>'
         || '<text top="4" left="40" font="6">' || p_brand || '<b>fett</b></text></page></data>' AS xml
FROM part"""



def _arrays(text: str) -> tuple[str, str]:
    """Spark and DuckDB texts; arrays are written ``<a, b>``."""
    return text.replace("<", "array(").replace(">", ")"), text.replace("<", "[").replace(">", "]")


# One text for Spark, one for DuckDB.
DIALECT_VIEWS: dict[str, tuple[str, str]] = {
    "v_ai_full": _arrays("""
SELECT *, CASE WHEN raw_module_id % 3 = 0 THEN NULL ELSE <'Ziel ' || CAST(weekly_hours AS STRING), 'Überblick'> END AS goals,
       CASE WHEN raw_module_id % 5 = 1 THEN NULL ELSE <'keine', 'Modul ' || CAST(recommended_semester AS STRING)> END AS requirements,
       CASE WHEN raw_module_id % 7 = 0 THEN NULL ELSE <'bestanden ' || CAST(weekly_hours % 3 AS STRING)> END AS success_requirements,
       <'Klausur ' || CAST(weekly_hours % 4 AS STRING)> AS exams, <'Stunden: ' || CAST(weekly_hours * 30 AS STRING)> AS expense,
       <'Vorlesung', 'Übung ' || CAST(recommended_semester % 3 AS STRING)> AS module_parts FROM v_ai"""),
    "v_modules_full": _arrays("""
SELECT *, 'Thema ' || CAST(pos % 9 AS STRING) AS content, CASE WHEN pos % 4 = 0 THEN NULL ELSE 'Ziel ' || CAST(pos % 5 AS STRING) END AS goals,
       <CAST(pos % 50 AS INT), CAST(pos % 50 + 1 AS INT)> AS pages FROM v_modules"""),
    "v_search_full": _arrays("""
SELECT ai.raw_module_id, ai.title AS ai_title, ai.module_code AS ai_module_code, ai.ects AS ai_ects, ai.lecturer AS ai_lecturer,
       ai.contents AS ai_contents, ai.goals AS ai_goals, ai.requirements AS ai_requirements, ai.expense AS ai_expense,
       ai.success_requirements AS ai_success_requirements, ai.exams AS ai_exams, ai.module_parts AS ai_module_parts,
       ai.weekly_hours, ai.recommended_semester, m.id AS module_id, m.title AS module_title, m.module_code, m.ects AS module_ects,
       m.content AS module_content, m.goals AS module_goals, m.pages AS module_pages, m.mhb_id, r.content AS raw_content, h.version,
       CASE WHEN ai.module_code IS NULL THEN 0.5 WHEN ai.module_code = m.module_code THEN 1.0 ELSE 0.0 END AS correct_module_code,
       CASE WHEN ai.ects IS NULL THEN 0.5 WHEN ai.ects = m.ects THEN 1.0 ELSE 0.0 END AS correct_ects,
       CASE WHEN ai.title IS NULL THEN 0.5 WHEN ai.title = m.title THEN 1.0 ELSE 0.0 END AS correct_title
FROM v_ai_full ai JOIN v_modules_raw r ON ai.raw_module_id = r.id
     JOIN v_modules_full m ON r.mhb_id = m.mhb_id AND r.module_code = m.module_code
     JOIN v_mhbs h ON m.mhb_id = h.id"""),
    "v_ai": (
        "SELECT *, CASE WHEN contents_txt IS NULL THEN NULL WHEN contents_txt = '' THEN CAST(array() AS array<string>)"
        " ELSE split(contents_txt, ', ') END AS contents FROM v_ai_base",
        "SELECT *, CASE WHEN contents_txt IS NULL THEN NULL WHEN contents_txt = '' THEN CAST([] AS VARCHAR[])"
        " ELSE string_split(contents_txt, ', ') END AS contents FROM v_ai_base",
    ),
    "v_page_text": (_page_text(_SPARK_LINES), _page_text(_DUCK_LINES)),
    "v_md_pages": (_md_pages(_SPARK_LINES), _md_pages(_DUCK_LINES)),
    "v_page_streams": (
        _page_streams(_SPARK_LINES, _SPARK_JOIN),
        _page_streams(_DUCK_LINES, "array_to_string([{}], chr(10))"),
    ),
    "v_facts": (
        "SELECT s_suppkey AS id, array(named_struct('label', ' name: ', 'value', s_name),"
        " named_struct('label', 'nation', 'value', CAST(s_nationkey AS STRING) || ' '),"
        " named_struct('label', 'key:', 'value', CAST(s_suppkey AS STRING))) AS pairs FROM supplier",
        "SELECT s_suppkey AS id, [{'label': ' name: ', 'value': s_name},"
        " {'label': 'nation', 'value': CAST(s_nationkey AS STRING) || ' '},"
        " {'label': 'key:', 'value': CAST(s_suppkey AS STRING)}] AS pairs FROM supplier",
    ),
    "v_xml_text": (_XML_TEXT, _XML_TEXT),
}

VIEWS = (*PORTABLE_VIEWS, *DIALECT_VIEWS)

# Views stored once per application and input folder: the module table is the base of the raw,
# extraction and search views, and costs a shuffle of the largest input each time it is derived.
# They are written in the order by which they are filtered, so that such filters skip row groups,
# and belong to one state of the tables that they come from.
STAGED_VIEWS = {"v_modules": (("mhb_id", "pos"), ("lineitem", "part"))}
# Scanned pages: streams are parsed once, and all page readers share the arrays. The lines that the streams are built from are dealt out by key
# and put in order; streams and arrays, many times as wide, are made behind that and written as they come.
PAGES, DEALT_LINES = "pages_scanned", "v_dealt_lines"
PAGE_TABLES = ("documents",)
_stage_paths: dict[tuple, str] = {}


def _names_in(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_]+\b", sql))


def view_sql(name: str, dialect: str) -> str:
    """Text of a view for ``spark`` or ``duckdb``."""
    if name in PORTABLE_VIEWS:
        return PORTABLE_VIEWS[name]
    return DIALECT_VIEWS[name][0 if dialect == "spark" else 1]


def view_dependencies(sql: str, dialect: str) -> list[str]:
    """Views that ``sql`` refers to, each after the views it is built from."""
    ordered: list[str] = []
    for name in VIEWS:
        if name in _names_in(sql):
            for needed in (*view_dependencies(view_sql(name, dialect), dialect), name):
                if needed not in ordered:
                    ordered.append(needed)
    return ordered


def with_views(sql: str) -> str:
    """DuckDB text of ``sql`` preceded by the views it uses as common table expressions."""
    parts = [f"{name} AS ({view_sql(name, 'duckdb')})" for name in view_dependencies(sql, "duckdb")]
    body = sql.strip()
    opening = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if not parts:
        return body
    if opening:
        return f"WITH RECURSIVE {', '.join(parts)}, {body[opening.end():]}"
    return f"WITH {', '.join(parts)} {body}"


class Corpus:
    """The input tables under one folder and the views over them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str, args=None) -> DataFrame:
        """Run ``text`` with the tables and views it names registered as temporary views."""
        for name in view_dependencies(text, "spark"):
            rows = self._staged(name) if name in STAGED_VIEWS else self._derived(name)
            rows.createOrReplaceTempView(name)
        self._register_tables(text)
        return self.spark.sql(text, args) if args is not None else self.spark.sql(text)

    def pages(self) -> DataFrame:
        """Scanned pages of all handbooks: shown texts with their places, one row per page."""
        return self._staged(PAGES)

    def _derived(self, name: str) -> DataFrame:
        if name == PAGES:
            self._register_tables(_SPARK_LINES)
            place = ["doc_id", "page_no"]  # what the key is called in the lines
            self.spark.sql(_SPARK_LINES).repartition(*place).sortWithinPartitions(*place).createOrReplaceTempView(DEALT_LINES)
            return scan_pages(self.spark.sql(_page_streams(f"SELECT * FROM {DEALT_LINES}", _SPARK_JOIN)))
        text = view_sql(name, "spark")
        self._register_tables(text)
        return self.spark.sql(text)

    def _staged(self, name: str) -> DataFrame:
        """Stored rows of a view, written on first use."""
        order, tables = STAGED_VIEWS.get(name, ((), PAGE_TABLES))

        def write(path: str) -> None:
            rows = self._derived(name)
            placed = rows if name == PAGES else rows.repartitionByRange(*order).sortWithinPartitions(*order)
            placed.write.parquet(path)

        return self._stored(name, tables, write, self.spark.read.parquet)

    def text_index(self) -> TextIndex:
        """Inverted index of the documents' texts, written on first use."""
        return self._stored(
            "text_index", ("documents",), lambda path: build_index(self.table("documents"), "doc_id", "text", path),
            lambda path: TextIndex(self.spark, path, "doc_id"))

    def search_index(self) -> substring_index.SubstringIndex:
        """Joined extraction rows in the order of their titles with bitmaps for substring filters, written on first use.

        Matches are stored; the texts and lists of ``v_search_full`` are made of them when they are read.
        """
        modules = self.view("v_modules")
        schema = StructType([*modules.schema, *[StructField(of, modules.schema) for of in ("a", "r")], self.view("v_mhbs").schema["version"]])

        def write(path: str) -> None:
            fields = {name: texts() for name, texts in INDEXED_TEXTS.items()}
            order = [F.col("title"), F.when(F.col("a").isNull(), F.col("id")).otherwise(F.col("a.id")), F.col("id")]
            substring_index.build_index(
                self.search_matches(modules), fields, order, path, self._extracted(modules).count(), self.search_rows)

        return self._stored(
            "search_index", ("lineitem", "part", "supplier"), write,
            lambda path: substring_index.SubstringIndex(self.spark, path, schema, self.search_rows))

    def search_matches(self, modules: DataFrame) -> DataFrame:
        """What ``v_search_full`` joins over ``modules``, before its texts and lists are made: a few short columns to shuffle."""
        handbooks = self.view("v_mhbs").select(F.col("id").alias("_handbook"), "version")
        found = joins.matched_modules(modules, self._extracted)
        return found.join(handbooks, F.col("mhb_id") == F.col("_handbook")).drop("_handbook")

    def search_rows(self, matches: DataFrame) -> DataFrame:
        """Rows of ``v_search_full`` from its matches, row by row; other columns of ``matches`` stay behind them."""
        names = self.view("v_modules").columns
        more = [c for c in matches.columns if c not in (*names, "a", "r", "version")]

        def partner(of: str) -> list[Column]:
            return [F.when(F.col(of).isNull(), F.col(n)).otherwise(F.col(f"{of}.{n}")).alias(f"{of}__{n}") for n in names]

        rows = matches.select(*[F.col(n).alias(f"m__{n}") for n in names], *partner("a"), *partner("r"), F.col("version").alias("h__version"), *more)
        rows = self._over(rows, "a", "ai", "v_ai_base", "v_ai", "v_ai_full")
        rows = self._over(rows, "r", "r", "v_modules_raw")
        rows = self._over(rows, "m", "m", "v_modules_full")
        rows.createOrReplaceTempView("v_matched")
        listed = re.sub(r"\b(ai|r|m|h)\.", r"\1__", view_sql("v_search_full", "spark").split("\nFROM ")[0])
        listed = re.sub(r"\b((?:ai|r|m|h)__(\w+))(?=,|$)(?! AS)", r"\1 AS \2", listed)
        return self.spark.sql(", ".join([listed, *more]) + " FROM v_matched")

    def _extracted(self, modules: DataFrame) -> DataFrame:
        """Those of ``modules`` that ``v_ai_base`` has a row for."""
        rows = modules.select("*", *[F.col(n).alias(f"a__{n}") for n in modules.columns])
        return self._over(rows, "a", "a", "v_ai_base").select(*modules.columns)

    def _over(self, rows: DataFrame, prefix: str, made: str, *views: str) -> DataFrame:
        """``rows`` with the columns of a module, named with ``prefix__``, replaced by those that ``views``, one upon the other, make of it."""
        ours = [c for c in rows.columns if c.startswith(f"{prefix}__")]
        kept = {c: f"kept__{c}" for c in rows.columns if c not in ours}
        source = "v_modules"
        rows = rows.select(*[F.col(c).alias(c.removeprefix(f"{prefix}__")) for c in ours], *[F.col(c).alias(k) for c, k in kept.items()])
        for view in views:
            rows.createOrReplaceTempView(source)
            text = view_sql(view, "spark").strip()
            rows = self.spark.sql(text if text.startswith("SELECT *") else text.replace("SELECT ", f"SELECT {', '.join(kept.values())}, ", 1))
            source = view
        return rows.select(*[F.col(k).alias(c) for c, k in kept.items()],
                           *[F.col(c).alias(f"{made}__{c}") for c in rows.columns if c not in kept.values()])

    def _stored(self, name: str, tables: tuple[str, ...], write: Callable[[str], object], read: Callable[[str], T]) -> T:
        """What ``read`` makes of a scratch folder that ``write`` filled, once per application and state of the input tables."""
        state = tuple(input_state(self.spark, f"{self.path}/{t}.parquet") for t in tables)
        key = (self.spark.sparkContext.applicationId, name, state)
        if key in _stage_paths:
            try:
                return read(_stage_paths[key])
            except AnalysisException:  # the scratch folder was cleared meanwhile
                del _stage_paths[key]
        path = scratch_path(self.spark)
        write(path)
        _stage_paths[key] = path
        return read(path)

    def _register_tables(self, text: str) -> None:
        names = _names_in(text)
        for name in TABLES:
            if name in names:
                self.table(name).createOrReplaceTempView(name)
