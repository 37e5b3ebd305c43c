"""A12-A17: exports and bulk append."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.functions.nested import json_columns
from handbook_spark.operators import tables
from handbook_spark.plans.registry import query
from handbook_spark.session import scratch_path
from handbook_spark.sources import exports
from handbook_spark.sources.keyed_table import KeyedTable

COLUMNS = ["module_code", "title", "ects", "pages"]
_MODULES = """SELECT m.mhb_id, h.title AS name, m.pos, m.module_code, m.title, m.ects, m.pos % 7 AS p FROM v_modules m JOIN v_mhbs h ON h.id = m.mhb_id"""
_NAMES = "SELECT DISTINCT m.mhb_id, h.title AS name FROM v_modules m JOIN v_mhbs h ON h.id = m.mhb_id"


def _modules(c: Corpus) -> DataFrame:
    rows = c.sql(_MODULES)
    return rows.select(
        "mhb_id", "name", "pos", "module_code", "title", "ects", F.array(F.col("p"), F.col("p") + 1).alias("pages")
    )


def _frame(section: int, line: str) -> str:
    return f"SELECT mhb_id, {section} AS section, CAST(0 AS BIGINT) AS pos, {line} AS line FROM ({_NAMES}) n"


_LF = "chr(10)"
_JSON_ROWS = f"""SELECT mhb_id, 1, pos, CASE WHEN pos > min(pos) OVER (PARTITION BY mhb_id) THEN ', ' ELSE '' END ||
  CAST(to_json({{'module_code': module_code, 'title': title, 'ects': ects, 'pages': [p, p + 1]}}) AS VARCHAR) FROM ({_MODULES})"""
_JSON = f"""
{_frame(0, "'{\"name\": \"' || name || '\", \"modules\": ['")} UNION ALL {_JSON_ROWS} UNION ALL {_frame(2, "']}'")}"""


@query("a12_json_export", _JSON)
def a12(c: Corpus) -> DataFrame:
    return exports.json_lines(_modules(c), COLUMNS)


@query("a12_json_export_by_code", f"""
{_frame(0, "'{\"name\": \"' || name || '\", \"modules\": {'")} UNION ALL
SELECT mhb_id, 1, pos, CASE WHEN pos > min(pos) OVER (PARTITION BY mhb_id) THEN ', ' ELSE '' END || '"' || module_code || '": ' ||
  CAST(to_json({{'title': title, 'ects': ects}}) AS VARCHAR) FROM ({_MODULES}) UNION ALL {_frame(2, "'}}'")}""")
def a12_by_code(c: Corpus) -> DataFrame:
    return exports.json_lines(_modules(c), ["module_code", "title", "ects"], ordered=False, module_code_key=True)


@query("a12_written_documents", f"SELECT mhb_id, line AS value FROM ({_JSON})")
def a12_written(c: Corpus) -> DataFrame:
    folder = scratch_path(c.spark)
    exports.write_export(exports.json_lines(_modules(c), COLUMNS), folder)
    return c.spark.read.schema("value string, mhb_id long").text(folder).select("mhb_id", "value")


_PAGES = "CAST(p AS VARCHAR) || ', ' || CAST(p + 1 AS VARCHAR)"


@query("a13_csv_export", f"""
{_frame(0, f"chr(65279) || name || {_LF} || 'module_code;title;ects;pages'")} UNION ALL
SELECT mhb_id, 1, pos, module_code || ';' || title || ';' || coalesce(CAST(ects AS VARCHAR), '') || ';' || {_PAGES} FROM ({_MODULES})""")
def a13(c: Corpus) -> DataFrame:
    return exports.csv_lines(_modules(c), COLUMNS)


@query("a14_text_export", f"""
{_frame(0, f"name || {_LF} || 'module_code' || chr(9) || 'title' || chr(9) || 'ects'")} UNION ALL
SELECT mhb_id, 1, pos, module_code || chr(9) || title || chr(9) || coalesce(CAST(ects AS VARCHAR), 'None') FROM ({_MODULES})""")
def a14(c: Corpus) -> DataFrame:
    return exports.txt_lines(_modules(c), ["module_code", "title", "ects"], "\t")


def _heads(columns: list[str]) -> str:
    return f" || {_LF} || ".join(f"'<th>{name}</th>'" for name in columns)


def _opening(columns: list[str], border: str) -> str:
    return (
        f"'<table {border}>' || {_LF} || '<thead>' || {_LF} || '<tr>' || {_LF} || {_heads(columns)} || {_LF} || '</tr>' || {_LF}"
        f" || '</thead>' || {_LF} || '<tbody>'"
    )


def _rows(cells: list[str]) -> str:
    inner = f" || {_LF} || ".join(f"'<td>' || coalesce(replace({cell}, {_LF}, '<br>'), 'None') || '</td>'" for cell in cells)
    return f"SELECT mhb_id, 1, pos, '<tr>' || {inner} || '</tr>' FROM ({_MODULES})"


@query("a15_markdown_table", f"""
{_frame(0, f"'# ' || name || {_LF} || {_opening(COLUMNS, '')}")} UNION ALL
{_rows(['module_code', 'title', 'CAST(ects AS VARCHAR)', _PAGES])} UNION ALL {_frame(2, f"'</tbody>' || {_LF} || '</table>'")}""")
def a15_md(c: Corpus) -> DataFrame:
    return exports.md_lines(_modules(c), COLUMNS)


_HTML = f"""
{_frame(0, f"'<!DOCTYPE html>' || {_LF} || '<html>' || {_LF} || '<head>' || {_LF} || '<title>' || name || '</title>' || {_LF} || '</head>' || {_LF} || '<body>' || {_LF} || '<h1>' || name || '</h1>' || {_LF} || " + _opening(['module_code', 'ects'], 'border="1"'))} UNION ALL
{_rows(['module_code', 'CAST(ects AS VARCHAR)'])} UNION ALL
{_frame(2, f"'</tbody>' || {_LF} || '</table>' || {_LF} || '</body></html>'")}"""


@query("a15_html_table", _HTML)
def a15_html(c: Corpus) -> DataFrame:
    return exports.html_lines(_modules(c), ["module_code", "ects"], borders=True)


@query("a16_export_front_door", _HTML)
def a16(c: Corpus) -> DataFrame:
    return exports.export_lines(_modules(c), "html", ["ects", "module_code"], borders=True)


_STORED = "SELECT module_code, content, md5(content) AS content_md5, id FROM v_modules_raw WHERE mhb_id IN (SELECT id FROM v_mhbs WHERE version IS NULL)"
_KEY = ["module_code", "content_md5"]


@query("a17_bulk_append", f"""
SELECT given, inserted, given - inserted AS skipped FROM (SELECT (SELECT count(*) FROM v_modules_raw) AS given, count(*) AS inserted FROM (
  SELECT DISTINCT module_code, md5(content) AS content_md5 FROM v_modules_raw EXCEPT SELECT module_code, content_md5 FROM ({_STORED})))""")
def a17(c: Corpus) -> DataFrame:
    stored = c.sql(_STORED)
    table = KeyedTable(c.spark, scratch_path(c.spark), stored.schema, _KEY)
    table.insert_new(1, stored, [F.col("id")])
    rows = tables.with_content_hash(c.view("v_modules_raw"), "content")
    return exports.append_raw_modules(table, 2, rows, [F.col("id")])


_APPENDED = f"""
SELECT module_code, content_md5, min(id) AS id FROM ({_STORED}) GROUP BY module_code, content_md5
UNION ALL SELECT r.module_code, md5(r.content), min(r.id) FROM v_modules_raw r WHERE NOT EXISTS (
  SELECT 1 FROM ({_STORED}) s WHERE s.module_code = r.module_code AND s.content_md5 = md5(r.content)) GROUP BY r.module_code, md5(r.content)"""


@query("a17_repeated_batches", _APPENDED)
def a17_repeated(c: Corpus) -> DataFrame:
    """The table after two batches of which each was run twice."""
    stored = c.sql(_STORED)
    table = KeyedTable(c.spark, scratch_path(c.spark), stored.schema, _KEY)
    rows = tables.with_content_hash(c.view("v_modules_raw"), "content")
    for batch, given in ((1, stored), (1, stored), (2, rows), (2, rows)):
        table.insert_new(batch, given, [F.col("id")])
    return table.read().select("module_code", "content_md5", "id")


@query("i40_stored_json", """
SELECT mhb_id, pos, module_code, CAST(to_json([p, p + 1]) AS VARCHAR) AS pages FROM (SELECT mhb_id, pos, module_code, pos % 7 AS p FROM v_modules)""")
def i40(c: Corpus) -> DataFrame:
    return json_columns(_modules(c).select("mhb_id", "pos", "module_code", "pages"))
