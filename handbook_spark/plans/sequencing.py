"""E: windows and sequences over modules, pages and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.operators import packing, pages, sequences
from handbook_spark.plans.dialect import duck_decode
from handbook_spark.plans.registry import query

MARKER = "\n| Modul"
PACK_LIMIT = 400


@query("e1_best_version", """
SELECT raw_module_id, module_code, version FROM (SELECT *, row_number() OVER (PARTITION BY module_code
  ORDER BY correct_module_code DESC, correct_ects DESC, correct_title DESC, version DESC NULLS FIRST, raw_module_id) AS rn
  FROM v_search) WHERE rn = 1""")
def e1(c: Corpus) -> DataFrame:
    return sequences.best_versions(c.view("v_search"), "raw_module_id").select("raw_module_id", "module_code", "version")


@query("e2_module_texts", """
WITH flagged AS (
  SELECT *, string_split(text, chr(10)) AS lines,
         CASE WHEN lag(header) OVER w IS NOT DISTINCT FROM header THEN 0 ELSE 1 END AS opens
  FROM v_page_text WINDOW w AS (PARTITION BY handbook_id ORDER BY page_no)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY handbook_id ORDER BY page_no) AS run FROM flagged)
SELECT handbook_id, min(page_no) AS first_page, header AS module_code,
       'Modul ' || header || string_agg(array_to_string(lines[2:len(lines) - 2], chr(10)), chr(10) ORDER BY page_no) AS content
FROM runs GROUP BY handbook_id, run, header""")
def e2(c: Corpus) -> DataFrame:
    return sequences.module_texts(c.view("v_page_text"))


@query("e3_page_ranges", """
WITH numbered AS (SELECT module_id, page, page - row_number() OVER (PARTITION BY module_id ORDER BY page) AS island
                  FROM (SELECT DISTINCT module_id, page FROM v_pages_of)),
ranges AS (SELECT module_id, min(page) AS lo, max(page) AS hi FROM numbered GROUP BY module_id, island)
SELECT module_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE CAST(lo AS VARCHAR) || ' - ' || CAST(hi AS VARCHAR) END, ', ' ORDER BY lo) AS pages
FROM ranges GROUP BY module_id""")
def e3(c: Corpus) -> DataFrame:
    return sequences.page_ranges(c.view("v_pages_of"), ["module_id"], "page")


_SOURCE_LINES = """
SELECT source, md5(line) AS line_md5, doc_id, line_no FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents)"""


@query("e4_first_occurrences", f"""
SELECT source, line_md5, doc_id, CAST(line_no AS BIGINT) AS line_no FROM (SELECT *, row_number() OVER (
  PARTITION BY source, line_md5 ORDER BY doc_id, line_no) AS nth FROM ({_SOURCE_LINES})) WHERE nth = 1""")
def e4(c: Corpus) -> DataFrame:
    lines = c.table("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    placed = lines.select(
        "source", F.md5("line").alias("line_md5"), F.struct("doc_id", F.col("line_no").cast("long").alias("line_no")).alias("pos")
    )
    return sequences.first_occurrences(placed, ["source"], "line_md5", "pos").select("source", "line_md5", "pos.*")


@query("e5_module_segments", r"""
WITH segments AS (SELECT *, sum(CASE WHEN contains(substr(text, 1, 15), chr(10) || '| Modul') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY handbook_id ORDER BY page_no) AS segment FROM v_md_pages)
SELECT * FROM (SELECT handbook_id, CAST(segment AS BIGINT) AS segment, min(page_no) AS first_page, count(*) AS n_pages,
  string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page_no) AS content
  FROM segments GROUP BY handbook_id, segment) WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> ''""")
def e5(c: Corpus) -> DataFrame:
    return sequences.segment_modules(c.view("v_md_pages"), MARKER)


@query("e6_toc_and_body", """
SELECT handbook_id, page_no, CASE WHEN page_no = 0 THEN 'cover' WHEN page_no >= first_marked THEN 'body' ELSE 'toc' END AS region
FROM (SELECT *, min(page_no) FILTER (page_no >= 2 AND contains(substr(text, 1, 15), chr(10) || '| Modul')) OVER (PARTITION BY handbook_id) AS first_marked
      FROM v_md_pages)""")
def e6(c: Corpus) -> DataFrame:
    return sequences.table_of_contents(c.view("v_md_pages"), MARKER).select("handbook_id", "page_no", "region")


_FRAGMENTS = r"""
SELECT handbook_id, page_no, unnest(generate_series(0, len(ys) - 1)) AS place, CAST(unnest(ys) AS DOUBLE) AS y, unnest(texts) AS txt FROM (
  SELECT handbook_id, page_no,
    regexp_extract_all(stream, '1 0 0 -1 (\d+(?:\.\d+)?) (\d+(?:\.\d+)?) Tm\s?\[\(([^\n\r]*?)\)', 2) AS ys,
    regexp_extract_all(stream, '1 0 0 -1 (\d+(?:\.\d+)?) (\d+(?:\.\d+)?) Tm\s?\[\(([^\n\r]*?)\)', 3) AS texts
  FROM v_page_streams WHERE contains(stream, 'Inhaltsverzeichnis'))"""


@query("e7_toc_codes", rf"""
WITH fragments AS (SELECT *, nullif(regexp_extract(txt, '^([A-ZÄÖÜ]{{2,}}-\d{{3,}})', 1), '') AS code FROM ({_FRAGMENTS}) WHERE txt <> '.'),
flagged AS (SELECT *, CASE WHEN lag(y) OVER w IS NOT DISTINCT FROM y THEN 0 ELSE 1 END AS opens FROM fragments
            WINDOW w AS (PARTITION BY handbook_id ORDER BY page_no, place)),
lines AS (SELECT *, sum(opens) OVER (PARTITION BY handbook_id ORDER BY page_no, place) AS line FROM flagged),
firsts AS (SELECT *, row_number() OVER (PARTITION BY handbook_id, line ORDER BY page_no, place) AS rn FROM lines WHERE code IS NOT NULL),
codes AS (SELECT *, row_number() OVER (PARTITION BY handbook_id, code ORDER BY page_no, place) AS nth FROM firsts WHERE rn = 1)
SELECT handbook_id, code AS module_code, page_no, place FROM codes WHERE nth = 1""")
def e7(c: Corpus) -> DataFrame:
    return pages.toc_codes(c.pages())


def section_sql(heading: str) -> str:
    """Section text per page in DuckDB."""
    line = r"(?m)^1 0 0 -1 (\d+(?:\.\d+)?) (\d+(?:\.\d+)?) Tm \[\(([^\n]*?)\)\] TJ"
    return rf"""
SELECT handbook_id, page_no, module_code,
  array_to_string(list_transform(texts, lambda t, i: CASE WHEN i = 1 THEN t WHEN CAST(ys[i] AS DOUBLE) = CAST(ys[i - 1] AS DOUBLE) THEN ' ' || t ELSE chr(10) || t END), '') AS text
FROM (SELECT handbook_id, page_no, module_code, regexp_extract_all(block, '{line}', 2) AS ys, regexp_extract_all(block, '{line}', 3) AS texts
  FROM (SELECT handbook_id, page_no, regexp_extract(stream, 'Tm \[\(Modul ([A-ZÄÖÜ]{{2,}}-\d{{3,}})', 1) AS module_code,
               regexp_extract(stream, '(?s) Tm \[\({heading}\)\] TJ(.*?)\nET\nQ', 1) AS block FROM v_page_streams)
  WHERE module_code <> '' AND block <> '')"""


@query("e8_module_sections", f"""
WITH sections AS ({section_sql('Inhalte:')}),
once AS (SELECT handbook_id, module_code, text, min(page_no) AS page_no FROM sections GROUP BY handbook_id, module_code, text)
SELECT handbook_id, module_code, {duck_decode("string_agg(text, chr(10) ORDER BY page_no)")} AS text FROM once GROUP BY handbook_id, module_code""")
def e8(c: Corpus) -> DataFrame:
    return pages.module_sections(c.pages(), "Inhalte:")


@query("e9_token_packing", rf"""
WITH RECURSIVE items AS (
  SELECT doc_id, unnest(generate_series(1, len(ls))) AS place, unnest(ls) AS item FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
sized AS (SELECT *, len(regexp_extract_all(item, '[\p{{L}}\p{{N}}_]+|\S')) AS size FROM items),
fold AS (
  SELECT doc_id, place, size AS filled, 0 AS chunk_no FROM sized WHERE place = 1
  UNION ALL
  SELECT s.doc_id, s.place, CASE WHEN f.filled + s.size < {PACK_LIMIT} THEN f.filled + s.size ELSE s.size END,
         CASE WHEN f.filled + s.size < {PACK_LIMIT} THEN f.chunk_no ELSE f.chunk_no + 1 END
  FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.place = f.place + 1)
SELECT f.doc_id, f.chunk_no, count(*) AS n_modules, CAST(sum(s.size) AS BIGINT) AS n_tokens,
  md5(string_agg(regexp_replace(s.item, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) || '--- NEUES MODUL ---' || chr(10) || chr(10) ORDER BY s.place)) AS text_md5
FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.place = f.place GROUP BY f.doc_id, f.chunk_no""")
def e9(c: Corpus) -> DataFrame:
    packed = sequences.pack_modules(c.table("documents"), "doc_id", F.split("text", "\n"), PACK_LIMIT)
    return packed.select("doc_id", "chunk_no", "n_modules", "n_tokens", F.md5("text").alias("text_md5"))


_SEGMENTS = r"""
SELECT * FROM (SELECT handbook_id, CAST(segment AS BIGINT) AS segment,
  string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page_no) AS content
  FROM (SELECT *, sum(CASE WHEN contains(substr(text, 1, 15), chr(10) || '| Modul') THEN 1 ELSE 0 END)
        OVER (PARTITION BY handbook_id ORDER BY page_no) AS segment FROM v_md_pages)
  GROUP BY handbook_id, segment) WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> ''"""


@query("e9_packed_modules", rf"""
WITH RECURSIVE segments AS ({_SEGMENTS}),
sized AS (SELECT handbook_id, content, row_number() OVER (PARTITION BY handbook_id ORDER BY segment) AS place,
  len(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+|\S')) AS size FROM segments),
fold AS (
  SELECT handbook_id, place, size AS filled, 0 AS chunk_no FROM sized WHERE place = 1
  UNION ALL
  SELECT s.handbook_id, s.place, CASE WHEN f.filled + s.size < {PACK_LIMIT} THEN f.filled + s.size ELSE s.size END,
         CASE WHEN f.filled + s.size < {PACK_LIMIT} OR f.place = 0 THEN f.chunk_no ELSE f.chunk_no + 1 END
  FROM fold f JOIN sized s ON s.handbook_id = f.handbook_id AND s.place = f.place + 1)
SELECT f.handbook_id, f.chunk_no, count(*) AS n_modules, CAST(sum(s.size) AS BIGINT) AS n_tokens,
  md5(string_agg(s.content, chr(10) || chr(10) || '--- NEUES MODUL ---' || chr(10) || chr(10) ORDER BY s.place)) AS text_md5
FROM fold f JOIN sized s ON s.handbook_id = f.handbook_id AND s.place = f.place GROUP BY f.handbook_id, f.chunk_no""")
def e9_packed(c: Corpus) -> DataFrame:
    modules = sequences.segment_modules(c.view("v_md_pages"), MARKER)
    packed = packing.pack_rows(modules, "handbook_id", "segment", "content", PACK_LIMIT)
    return packed.select("handbook_id", "chunk_no", "n_modules", "n_tokens", F.md5("text").alias("text_md5"))
