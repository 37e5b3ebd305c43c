"""I: scalar, text, date and nested expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.functions import dates, nested, scoring, text, urls
from handbook_spark.operators import aggregates, pages, retrieval, sequences
from handbook_spark.plans.dialect import duck_decode
from handbook_spark.plans.ranking import _COSINE, example_vector
from handbook_spark.plans.registry import PART_POSITIONS, query
from handbook_spark.plans.sequencing import section_sql
from handbook_spark.sources import readers

_SHOWN = r" Tm \[\(([^\n\r]*?)\)\] TJ"


@query("i1_module_code", r"""
SELECT id, nullif(regexp_extract(content, '[A-ZÄÖÜ]{2,}-\d{3,}'), '') AS code,
       nullif(regexp_extract(lower(content), '[A-ZÄÖÜ]{2,}-\d{3,}'), '') AS no_code FROM v_modules_raw""")
def i1(c: Corpus) -> DataFrame:
    return c.view("v_modules_raw").select(
        "id", text.module_code(F.col("content")).alias("code"), text.module_code(F.lower("content")).alias("no_code")
    )


@query("i2_subject", """
SELECT raw_module_id, CASE WHEN contains(module_code, '-') THEN upper(split_part(module_code, '-', 1)) END AS subject,
       CASE WHEN contains(title, '-') THEN upper(split_part(title, '-', 1)) END AS none FROM v_ai""")
def i2(c: Corpus) -> DataFrame:
    return c.view("v_ai").select(
        "raw_module_id", text.subject(F.col("module_code")).alias("subject"), text.subject(F.col("title")).alias("none")
    )


_SHOWN_SQL = f"array_to_string(regexp_extract_all(stream, '{_SHOWN}', 1), chr(10))"


@query("i3_shown_text", f"SELECT handbook_id, page_no, {_SHOWN_SQL} AS shown FROM v_page_streams")
def i3(c: Corpus) -> DataFrame:
    return c.pages().select("handbook_id", "page_no", pages.page_text(F.col("fragments")).alias("shown"))


_REPAIRED = duck_decode(
    rf"regexp_replace(replace({_SHOWN_SQL}, '-' || chr(10), ''), '\s\)\s*-?\d+(?:\.\d+)?\s*\(\s*', ' ', 'g')"
)


@query("i4_text_repair", f"SELECT handbook_id, page_no, {_REPAIRED} AS repaired FROM v_page_streams")
def i4(c: Corpus) -> DataFrame:
    return c.pages().select(
        "handbook_id", "page_no", text.repair_text(pages.page_text(F.col("fragments"))).alias("repaired")
    )


@query("i5_title_clean_up", r"""
SELECT id, trim(regexp_replace(CASE
  WHEN regexp_matches(title, '\\?\(\d+LP\\?\)') THEN regexp_replace(title, '\\?\(\d+LP\\?\)', ' ')
  WHEN regexp_matches(title, ' \\?\(\d+ LP\\?\)') THEN regexp_replace(title, ' \\?\(\d+ LP\\?\)', ' ')
  WHEN regexp_matches(title, ' \d+ CP$') THEN regexp_replace(title, ' \d+ CP$', ' ')
  WHEN regexp_matches(title, '[;,] \d+ LP\\?\)') THEN regexp_replace(title, '[;,] \d+ LP(\\?\))', '\1')
  ELSE title END, '\s+', ' ', 'g')) AS title FROM v_titles""")
def i5(c: Corpus) -> DataFrame:
    return c.view("v_titles").select("id", text.clean_title(F.col("title")).alias("title"))


@query("i5_title_lines", r"""
SELECT doc_id, md5(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = len(ls) THEN x
  WHEN x LIKE '%-' AND regexp_matches(ls[i + 1], '^\p{Ll}') THEN substr(x, 1, len(x) - 1) ELSE x || ' ' END), '')) AS joined_md5
FROM (SELECT doc_id, string_split(replace(text, ', ', '-' || chr(10)), chr(10)) AS ls FROM documents)""")
def i5_lines(c: Corpus) -> DataFrame:
    lines = F.split(F.replace(F.col("text"), F.lit(", "), F.lit("-\n")), "\n")
    rows = c.table("documents").select("doc_id", lines.alias("ls"))
    return rows.select("doc_id", F.md5(text.join_title_lines(F.col("ls"))).alias("joined_md5"))


@query("i6_credits", r"""
SELECT handbook_id, page_no, TRY_CAST(regexp_extract(stream, ' Tm \[\((\d+) ECTS/LP\)\] TJ', 1) AS INT) AS ects FROM v_page_streams""")
def i6(c: Corpus) -> DataFrame:
    return c.pages().select("handbook_id", "page_no", pages.credits(F.col("fragments")).alias("ects"))


@query("i7_section_text", section_sql("Lernziele/Kompetenzen:"))
def i7(c: Corpus) -> DataFrame:
    return pages.page_sections(c.pages(), "Lernziele/Kompetenzen:")


def _label(label: str) -> str:
    return duck_decode(rf"nullif(regexp_extract(part, '(?s) Tm \[\({label}: \)\] TJ.*?{_SHOWN}', 1), '')")


_NAME = rf"nullif(regexp_extract(part, '{_SHOWN}', 1), '')"
_EXAM = (
    rf"nullif(array_to_string(regexp_extract_all(regexp_extract(part, '(?s) Tm \[\(Pr\\374fung\)\] TJ\n(.*?)\nQ\nQ\n', 1), '{_SHOWN}', 1), chr(10)), '')"
)
_PART_ROWS = rf"""
SELECT handbook_id, page_no, part_no,
  {duck_decode(f"CASE WHEN NOT starts_with({_NAME}, 'Lehrformen:') THEN {_NAME} END")} AS name,
  {_label('Lehrformen')} AS type_of_study, {_label('Sprache')} AS language, {_label('SWS')} AS weekly_hours,
  {duck_decode(_EXAM)} AS exam
FROM (SELECT handbook_id, page_no, unnest(generate_series(0, len(parts) - 1)) AS part_no, substr(unnest(parts), 3) AS part
  FROM (SELECT handbook_id, page_no, string_split(regexp_extract(stream, '(?s) Tm \[\(Modulteile\)\] TJ(.*?) Tm \[\(G\\374ltig ', 1), ' Tm [(Modulteil:') AS parts
        FROM v_page_streams WHERE contains(stream, ' Tm [(Modulteil:')))
WHERE part_no > 0"""


@query("i8_module_parts", _PART_ROWS)
def i8(c: Corpus) -> DataFrame:
    return pages.module_part_rows(c.pages())


@query("i8_module_exam", f"""
SELECT handbook_id, page_no, count(*) AS n_parts, coalesce(string_agg(exam, chr(10) ORDER BY part_no), '') AS module_exam
FROM ({_PART_ROWS}) GROUP BY handbook_id, page_no""")
def i8_exam(c: Corpus) -> DataFrame:
    parts = pages.module_parts(c.pages())
    return parts.select("handbook_id", "page_no", F.size("module_parts").alias("n_parts"), "module_exam")


@query("i9_handbook_title", r"""
SELECT handbook_id, replace(nullif(regexp_extract(stream, 'Modulhandbuch[^\n]*\n[^\n]*\n[^\n]*?\[\(([^\n]*?)\)\] TJ', 1), ''), chr(92), '') AS title
FROM (SELECT *, row_number() OVER (PARTITION BY handbook_id ORDER BY page_no) AS rn FROM v_page_streams WHERE contains(stream, 'Modulhandbuch'))
WHERE rn = 1""")
def i9(c: Corpus) -> DataFrame:
    return pages.handbook_titles(c.pages())


@query("i10_module_pages", r"""
WITH pages AS (SELECT DISTINCT handbook_id, regexp_extract(stream, 'Tm \[\(Modul ([A-ZÄÖÜ]{2,}-\d{3,})', 1) AS module_code,
    CAST(list_last(regexp_extract_all(stream, ' Tm \[\((\d+)\)\] TJ\nET\nQ\n', 1)) AS INT) AS page FROM v_page_streams),
numbered AS (SELECT *, page - row_number() OVER (PARTITION BY handbook_id, module_code ORDER BY page) AS island FROM pages WHERE module_code <> ''),
ranges AS (SELECT handbook_id, module_code, min(page) AS lo, max(page) AS hi FROM numbered GROUP BY handbook_id, module_code, island)
SELECT handbook_id, module_code, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE CAST(lo AS VARCHAR) || ' - ' || CAST(hi AS VARCHAR) END, ', ' ORDER BY lo) AS pages
FROM ranges GROUP BY handbook_id, module_code""")
def i10(c: Corpus) -> DataFrame:
    return sequences.page_ranges(
        pages.module_pages(c.pages()), ["handbook_id", "module_code"], "printed_page"
    )


@query("i11_listing_title", """
SELECT id, trim(split_part(title, chr(10), 1)) AS name, trim(split_part(title, chr(10), 2)) AS city,
       trim(split_part(title, chr(10), 3)) AS university, trim(split_part(title, chr(10), 4)) AS degree FROM v_listing""")
def i11(c: Corpus) -> DataFrame:
    lines = F.split("title", "\n")
    names = ("name", "city", "university", "degree")
    return c.view("v_listing").select("id", *[F.trim(F.get(lines, F.lit(i))).alias(n) for i, n in enumerate(names)])


_SITES = "SELECT n_nationkey AS university, 'www.' || lower(n_name) || '.example.edu' AS website FROM nation WHERE n_name <> 'NATION_3'"


@query("i12_search_string", f"""
SELECT h.id, CASE WHEN h.version IS NULL THEN 'vorhanden' ELSE rtrim('site:' || coalesce(u.website, '') || ' filetype:pdf modulhandbuch ' || h.title || ' ' ||
  CASE WHEN degree ILIKE '%bachelor%' THEN 'Bachelor' WHEN degree ILIKE '%master%' THEN 'Master' ELSE '' END) END AS search_string
FROM v_mhbs h LEFT JOIN ({_SITES}) u ON u.university = h.university""")
def i12(c: Corpus) -> DataFrame:
    rows = c.view("v_mhbs").join(c.sql(_SITES), "university", "left")
    present = F.when(F.col("version").isNull(), F.lit("vorhanden"))
    built = text.search_string(F.col("website"), F.col("title"), F.col("degree"), present)
    return rows.select("id", built.alias("search_string"))


@query("i13_bare_host", r"""
SELECT page_id, split_part(regexp_replace(regexp_replace(url, '^https://www\.', ''), '^http://', ''), '/', 1) AS host FROM pages""")
def i13(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", urls.bare_host(F.col("url")).alias("host"))


_HREFS = (
    "/a/b", "c.html", "?q=1", "#top", "mailto:a@b.de", "//cdn.example.com/z", "https://abs.example.org/p#frag", " /x#y ",
    "ftp://example.com/f",
)
_HREF_VALUES = ", ".join(f"({n}, '{href}')" for n, href in enumerate(_HREFS))


@query("i14_href_normalisation", rf"""
WITH bases AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+:') AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
resolved AS (SELECT page_id, n, CASE n WHEN 0 THEN origin || href WHEN 1 THEN origin || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || href
    WHEN 2 THEN origin || path || href WHEN 5 THEN scheme || href WHEN 6 THEN 'https://abs.example.org/p' WHEN 7 THEN origin || '/x' END AS link
  FROM bases, (VALUES {_HREF_VALUES}) h(n, href))
SELECT page_id, n, CASE WHEN contains(link, 'example.') THEN link END AS link FROM resolved""")
def i14(c: Corpus) -> DataFrame:
    rows = c.table("pages").select("page_id", "url", F.posexplode(F.array(*map(F.lit, _HREFS))).alias("n", "href"))
    return rows.select(
        "page_id", "n", urls.normalize_href(F.col("url"), F.col("href"), F.lit("example.")).alias("link")
    )


@query("i15_registered_domain", r"""
SELECT page_id, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '[^.]+\.[^.]+$') AS domain FROM pages""")
def i15(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", urls.registered_domain(F.col("url")).alias("domain"))


@query("i16_query_urls", """
SELECT c_custkey, 'https://search.example.com/search?q=' || replace(c_name || ' x', ' ', '+') || '+' || replace(c_mktsegment, ' ', '+') || '+website' AS search_url,
       url_encode('Universität ' || c_name || ' Modulhandbuch filetype:pdf') AS encoded, 'Universität ' || c_name || ' Modulhandbuch' AS decoded
FROM customer""")
def i16(c: Corpus) -> DataFrame:
    name = F.col("c_name")
    plain = F.concat(F.lit("Universität "), name, F.lit(" Modulhandbuch"))
    return c.table("customer").select(
        "c_custkey",
        urls.query_url(
            "https://search.example.com/search?q=", [F.concat(name, F.lit(" x")), F.col("c_mktsegment")], "website"
        ).alias("search_url"),
        urls.percent_encode(F.concat(plain, F.lit(" filetype:pdf"))).alias("encoded"),
        urls.percent_decode(urls.percent_encode(plain)).alias("decoded"),
    )


@query("i17_whitespace_squeeze", r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5,
  md5(array_to_string(list_transform(string_split(text, '.'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), '|')) AS sentences_md5
FROM documents""")
def i17(c: Corpus) -> DataFrame:
    rows = c.table("documents").select("doc_id", "text", F.struct(F.split("text", r"\.").alias("sentences")).alias("n"))
    clean = nested.clean_spaces(rows)
    return clean.select(
        "doc_id", F.md5("text").alias("text_md5"), F.md5(F.array_join("n.sentences", "|")).alias("sentences_md5")
    )


@query("i19_html_to_text", r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html), '(?s)<!--.*?-->', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'),
  '(?i)<br\s*/?>', chr(10), 'g'), '<[A-Za-z][^<>]*></[A-Za-z][^<>]*>', '--NONE--', 'g'), '<[A-Za-z][^<>]*/>', '--NONE--', 'g'), '<[^<>]*>', '', 'g') AS text
FROM pages""")
def i19(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("i20_null_marks", """
SELECT CAST(raw_module_id AS VARCHAR) AS raw_module_id, coalesce(title, '-') AS title, coalesce(CAST(ects AS VARCHAR), '-') AS ects,
  coalesce(array_to_string(contents, ', '), '-') AS contents, coalesce(lecturer, '-') || '/' || coalesce(CAST(ects AS VARCHAR), '-') AS inner_text FROM v_ai""")
def i20(c: Corpus) -> DataFrame:
    rows = c.view("v_ai").select("raw_module_id", "title", "ects", "contents", F.struct("lecturer", "ects").alias("n"))
    marked = nested.fill_none(rows, "-")
    return marked.select(
        "raw_module_id", "title", "ects", F.array_join("contents", ", ").alias("contents"),
        F.concat_ws("/", "n.lecturer", "n.ects").alias("inner_text"),
    )


@query("i21_download_name", """
SELECT page_id, translate(split_part(url, '/', -2), '+ ', '__') || '__' || replace('"datei ' || CAST(page_id AS VARCHAR) || '.pdf"', '"', '') AS file_name FROM pages""")
def i21(c: Corpus) -> DataFrame:
    header = F.concat(F.lit('"datei '), F.col("page_id").cast("string"), F.lit('.pdf"'))
    return c.table("pages").select("page_id", urls.download_name(F.col("url"), header).alias("file_name"))


@query("i22_labels", """
SELECT raw_module_id, module_code AS "Modulcode", title AS "Titel", ects AS "ECTS", lecturer AS "Dozent" FROM v_ai""")
def i22(c: Corpus) -> DataFrame:
    rows = c.view("v_ai").select("raw_module_id", "module_code", "title", "ects", "lecturer")
    return rows.withColumnsRenamed(text.LABELS)


def _duck_pairs(columns: dict[str, str], separator: str) -> str:
    return f" || {separator} || ".join(f"'{k}: ' || coalesce(CAST({v} AS VARCHAR), 'None')" for k, v in columns.items())


_DOCUMENT = {"module_code": "module_code", "title": "title", "ects": "ects", "lecturer": "lecturer"}


@query("i23_document_text", f"""
SELECT raw_module_id, {_duck_pairs(_DOCUMENT, "chr(10) || chr(10)")} AS document FROM v_ai""")
def i23(c: Corpus) -> DataFrame:
    return c.view("v_ai").select("raw_module_id", text.key_value_text(list(_DOCUMENT)).alias("document"))


_RULE = "\n---------------------------------------------\n"


@query("i23_context", f"""
SELECT string_agg('lang: ' || d.lang || chr(10) || 'source: ' || d.source, chr(10) || '---------------------------------------------' || chr(10) ORDER BY h.rank) AS context
FROM (SELECT vec_id, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS rank FROM embeddings) h
JOIN documents d ON d.doc_id = h.vec_id WHERE h.rank <= 15""")
def i23_context(c: Corpus) -> DataFrame:
    hits = retrieval.nearest(c.table("embeddings"), "embedding", "vec_id", example_vector(c), 15)
    ranked = retrieval.rank_hits(hits, "score", "vec_id").select(F.col("vec_id").alias("doc_id"), "rank")
    rows = c.table("documents").join(F.broadcast(ranked), "doc_id").select(
        "rank", text.key_value_text(["lang", "source"], "\n").alias("entry")
    )
    # At most k entries reach this aggregate.
    ordered = F.sort_array(F.collect_list(F.struct("rank", "entry")))
    return rows.agg(F.array_join(F.transform(ordered, lambda e: e["entry"]), _RULE).alias("context"))


def _programmes(c: Corpus) -> tuple[DataFrame, dict]:
    rows = c.view("v_programmes").withColumn("perspectives", F.split("perspectives_txt", ", "))
    return rows, {name: F.col(name) for name in rows.columns}


_DEADLINE = """nullif(concat_ws(' / ', 'Wintersemester: ' || deadline_winter, 'Sommersemester: ' || deadline_summer), '')"""


@query("i24_programme_card", f"""
SELECT id, concat_ws(chr(10), 'Studiengang: ' || name, 'Abschluss: ' || degree, 'Regelstudienzeit: ' || duration, 'Zulassungsmodus: ' || admission,
  'Unterrichtssprache: ' || language, 'Studienform: ' || study_type, 'Studienbeginn: ' || start_term,
  'Bewerbungsfrist: ' || CASE WHEN lower(trim(admission)) <> 'zulassungsfrei' THEN {_DEADLINE} END,
  'Deutschkenntnisse: ' || german_level, 'Inhalt: ' || content, 'Perspektiven: ' || perspectives_txt) AS card FROM v_programmes""")
def i24(c: Corpus) -> DataFrame:
    rows, columns = _programmes(c)
    return rows.select("id", text.programme_card(columns).alias("card"))


@query("i25_metadata_map", f"""
SELECT id, concat_ws(',', 'Studiengang', 'Abschluss', 'Zulassungsmodus', 'Unterrichtssprache', 'Studienbeginn', 'Deutschkenntnisse', 'Inhalt', 'Perspektiven',
  CASE WHEN duration IS NOT NULL THEN 'Regelstudienzeit' END, CASE WHEN study_type IS NOT NULL THEN 'Studienform' END,
  CASE WHEN lower(trim(admission)) <> 'zulassungsfrei' AND {_DEADLINE} IS NOT NULL THEN 'Bewerbungsfrist' END) AS keys,
  CASE WHEN lower(trim(admission)) <> 'zulassungsfrei' THEN {_DEADLINE} END AS deadline FROM v_programmes""")
def i25(c: Corpus) -> DataFrame:
    rows, columns = _programmes(c)
    return rows.select("id", text.programme_metadata(columns).alias("m")).select(
        "id", F.array_join(F.map_keys("m"), ",").alias("keys"),
        F.try_element_at("m", F.lit("Bewerbungsfrist")).alias("deadline"),
    )


@query("i26_semester_code", r"""
SELECT id, TRY_CAST(regexp_extract(footer, '[WS][omint]{3}ersemester (\d{4})', 1) || CASE WHEN footer LIKE 'Sommer%' THEN '0' ELSE '1' END AS INT)
  * CASE WHEN footer = 'ohne Angabe' THEN NULL ELSE 1 END AS code FROM v_listing""")
def i26(c: Corpus) -> DataFrame:
    return c.view("v_listing").select("id", dates.semester_code(F.col("footer")).alias("code"))


@query("i27_semester_label", """
SELECT id, CASE WHEN version % 10 = 1 THEN 'Wintersemester ' || CAST(version // 10 AS VARCHAR) || '/' || CAST(version // 10 + 1 AS VARCHAR)
    WHEN version IS NOT NULL THEN 'Sommersemester ' || CAST(version // 10 AS VARCHAR) END AS long_label,
  CASE WHEN version % 10 = 1 THEN 'WS ' || CAST(version // 10 AS VARCHAR) || '/' || CAST(version // 10 + 1 AS VARCHAR)
    WHEN version IS NOT NULL THEN 'SS ' || CAST(version // 10 AS VARCHAR) END AS short_label FROM v_mhbs""")
def i27(c: Corpus) -> DataFrame:
    version = F.col("version")
    return c.view("v_mhbs").select(
        "id", dates.semester_label(version).alias("long_label"), dates.semester_label(version, long=False).alias("short_label")
    )


# The events lie in January, when local time is one hour ahead of UTC.
@query("i28_local_time", """
SELECT event_id, ts + INTERVAL 1 HOUR AS local_ts,
  CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS TIMESTAMP) + to_days(CAST(user_id % 30 AS INT)) + INTERVAL 330 MINUTE - INTERVAL 1 HOUR AS expires FROM events""")
def i28(c: Corpus) -> DataFrame:
    days = (F.col("user_id") % 30).cast("int")
    return c.table("events").select(
        "event_id", dates.local_time(F.col("ts")).alias("local_ts"), dates.session_expiry(F.col("ts"), days).alias("expires")
    )


@query("i29_epoch_seconds", """
SELECT log_id, record_no, make_timestamp(epoch * 1000000) AS ts, CAST(make_timestamp(epoch * 1000000) AS DATE) AS day FROM (
  SELECT event_id AS log_id, 0 AS record_no, 1700000000 + event_id AS epoch FROM events UNION ALL SELECT event_id, 1, 1700086400 + event_id FROM events)""")
def i29(c: Corpus) -> DataFrame:
    records = readers.log_records(c.view("v_logs"), "blob", "log_id")
    ts = F.timestamp_seconds("epoch")
    return records.select("log_id", "record_no", ts.alias("ts"), F.to_date(ts).alias("day"))


@query("i30_study_length", """
SELECT id, CASE WHEN duration LIKE '%Semester%' THEN TRY_CAST(split_part(duration, ' ', 1) AS INT)
  WHEN duration LIKE '%Monate%' THEN TRY_CAST(split_part(duration, ' ', 1) AS INT) // 6 END AS semesters FROM v_listing""")
def i30(c: Corpus) -> DataFrame:
    return c.view("v_listing").select("id", dates.study_semesters(F.col("duration")).alias("semesters"))


def _scores() -> list:
    return [
        scoring.agreement(F.col("ai_module_code"), F.col("module_code")),
        scoring.agreement(F.col("ai_ects"), F.col("module_ects")),
        scoring.agreement(F.col("ai_title"), F.col("module_title")),
    ]


@query("i31_field_agreement", """
SELECT raw_module_id, CAST(correct_module_code AS DOUBLE) AS code_score, CAST(correct_ects AS DOUBLE) AS ects_score,
  CAST(correct_title AS DOUBLE) AS title_score, round(CAST(correct_module_code + correct_ects + correct_title AS DOUBLE) / 3, 6) AS confidence_score FROM v_search""")
def i31(c: Corpus) -> DataFrame:
    code, ects, title = _scores()
    return c.view("v_search").select(
        "raw_module_id", code.alias("code_score"), ects.alias("ects_score"), title.alias("title_score"),
        F.round(scoring.confidence(code, ects, title), 6).alias("confidence_score"),
    )


@query("i32_retrieval_score", """
SELECT raw_module_id, round(CAST(trunc(correct_module_code) + trunc(correct_ects) + trunc(correct_title) AS DOUBLE) / 3, 6) AS score FROM v_search""")
def i32(c: Corpus) -> DataFrame:
    return c.view("v_search").select("raw_module_id", F.round(scoring.retrieval_score(*_scores()), 6).alias("score"))


@query("i33_code_credibility", """
SELECT raw_module_id, CASE WHEN ai_module_code IS NULL THEN 0 WHEN ai_module_code = module_code THEN 1 ELSE -1 END AS credibility,
  coalesce(ai_module_code, module_code) AS filled_code FROM v_search""")
def i33(c: Corpus) -> DataFrame:
    return c.view("v_search").select(
        "raw_module_id", scoring.code_credibility(F.col("ai_module_code"), F.col("module_code")).alias("credibility"),
        F.coalesce("ai_module_code", "module_code").alias("filled_code"),
    )


@query("i38_split_and_join", """
SELECT id, len(string_split(study_type, ', ')) AS n_types, array_to_string(string_split(study_type, ', '), '/') AS joined FROM v_listing""")
def i38(c: Corpus) -> DataFrame:
    types = F.split("study_type", ", ")
    return c.view("v_listing").select("id", F.size(types).alias("n_types"), F.array_join(types, "/").alias("joined"))


@query("i39_extraction_validation", """
SELECT event_id AS id, event_id % 7 NOT IN (0, 1, 3) AS valid,
  CASE event_id % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'ects is not a number' WHEN 3 THEN 'no modules' END AS error,
  CASE WHEN event_id % 7 = 2 THEN 1 WHEN event_id % 7 > 3 THEN 2 END AS n_modules,
  CASE WHEN event_id % 7 = 2 OR event_id % 7 > 3 THEN event_type END AS first_title,
  CASE WHEN event_id % 7 = 2 OR event_id % 7 > 3 THEN CAST(user_id AS INT) END AS first_ects FROM events""")
def i39(c: Corpus) -> DataFrame:
    checked = readers.validate_extraction(c.view("v_extractions"), "answer")
    first = F.get("modules", F.lit(0))
    return checked.select(
        "id", "valid", "error", F.when(F.col("valid"), F.size("modules")).alias("n_modules"),
        first["title"].alias("first_title"), first["ects"].alias("first_ects"),
    )


@query("i40_json_text", """
SELECT raw_module_id, CAST(to_json(contents) AS VARCHAR) AS contents, title FROM v_ai""")
def i40(c: Corpus) -> DataFrame:
    return nested.json_columns(c.view("v_ai").select("raw_module_id", "contents", "title"))


@query("i41_facts_map", """
SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation, CAST(s_suppkey AS VARCHAR) AS key, 'key,name,nation,source' AS keys FROM supplier""")
def i41(c: Corpus) -> DataFrame:
    facts = nested.labelled_map(F.col("pairs"))
    merged = F.map_concat(facts, F.create_map(F.lit("source"), F.lit("box")))
    return c.view("v_facts").select("id", merged.alias("m")).select(
        "id", F.col("m")["name"].alias("name"), F.col("m")["nation"].alias("nation"), F.col("m")["key"].alias("key"),
        F.array_join(F.sort_array(F.map_keys("m")), ",").alias("keys"),
    )


@query("i42_flatten_handbooks", "SELECT mhb_id, pos, module_code, title, ects FROM v_modules")
def i42(c: Corpus) -> DataFrame:
    handbooks = aggregates.roll_up(c.view("v_modules"), ["title", "ects"], PART_POSITIONS)
    return handbooks.select("mhb_id", F.inline("modules"))


@query("i43_two_source_merge", """
SELECT raw_module_id, coalesce(module_code, ai_module_code) AS module_code, coalesce(module_title, ai_title) AS title,
  coalesce(module_ects, ai_ects) AS ects FROM v_search""")
def i43(c: Corpus) -> DataFrame:
    pairs = {"module_code": "ai_module_code", "module_title": "ai_title", "module_ects": "ai_ects"}
    names = ("module_code", "title", "ects")
    return c.view("v_search").select(
        "raw_module_id", *[F.coalesce(a, b).alias(n) for (a, b), n in zip(pairs.items(), names)]
    )



_JOINED_TITLE = (
    r"array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = len(ls) THEN x"
    r" WHEN x LIKE '%-' AND regexp_matches(ls[i + 1], '^\p{Ll}') THEN substr(x, 1, len(x) - 1) ELSE x || ' ' END), '')"
)


@query("i44_module_record", rf"""
WITH marked AS (SELECT *, regexp_extract(stream, 'Tm \[\(Modul ([A-ZÄÖÜ]{{2,}}-\d{{3,}})', 1) AS module_code FROM v_page_streams),
first_pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY handbook_id, module_code ORDER BY page_no) AS rn FROM marked WHERE module_code <> '') WHERE rn = 1),
titles AS (SELECT handbook_id, page_no, module_code, {_JOINED_TITLE} AS title, ects FROM (SELECT handbook_id, page_no, module_code,
  regexp_extract_all(regexp_extract(stream, '(?s)/F3 10 Tf\n[^\n]*Tm \[\(Modul [A-ZÄÖÜ]+-\d+(.*?)\n/F2 9 Tf', 1), '\[\(([^\n]*?)\)\] TJ', 1) AS ls,
  TRY_CAST(regexp_extract(stream, ' Tm \[\((\d+) ECTS/LP\)\] TJ', 1) AS INT) AS ects FROM first_pages)),
contents AS (SELECT handbook_id, module_code, string_agg(text, chr(10) ORDER BY page_no) AS text FROM (
  SELECT handbook_id, module_code, text, min(page_no) AS page_no FROM ({section_sql('Inhalte:')}) GROUP BY ALL) GROUP BY handbook_id, module_code),
goals AS (SELECT handbook_id, module_code, string_agg(text, chr(10) ORDER BY page_no) AS text FROM (
  SELECT handbook_id, module_code, text, min(page_no) AS page_no FROM ({section_sql('Lernziele/Kompetenzen:')}) GROUP BY ALL) GROUP BY handbook_id, module_code),
parts AS (SELECT handbook_id, page_no, count(*) AS n_parts, coalesce(string_agg(exam, chr(10) ORDER BY part_no), '') AS module_exam FROM ({_PART_ROWS}) GROUP BY handbook_id, page_no),
printed AS (SELECT DISTINCT handbook_id, module_code, CAST(list_last(regexp_extract_all(stream, ' Tm \[\((\d+)\)\] TJ\nET\nQ\n', 1)) AS INT) AS page FROM marked WHERE module_code <> ''),
islands AS (SELECT *, page - row_number() OVER (PARTITION BY handbook_id, module_code ORDER BY page) AS island FROM printed),
ranges AS (SELECT handbook_id, module_code, min(page) AS lo, max(page) AS hi FROM islands GROUP BY handbook_id, module_code, island),
page_lists AS (SELECT handbook_id, module_code, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE CAST(lo AS VARCHAR) || ' - ' || CAST(hi AS VARCHAR) END, ', ' ORDER BY lo) AS pages FROM ranges GROUP BY handbook_id, module_code)
SELECT t.handbook_id, t.module_code, t.title, t.ects, {duck_decode('c.text')} AS content, {duck_decode('g.text')} AS goals,
  p.n_parts, p.module_exam, l.pages
FROM titles t JOIN page_lists l ON l.handbook_id = t.handbook_id AND l.module_code = t.module_code
LEFT JOIN contents c ON c.handbook_id = t.handbook_id AND c.module_code = t.module_code
LEFT JOIN goals g ON g.handbook_id = t.handbook_id AND g.module_code = t.module_code
LEFT JOIN parts p ON p.handbook_id = t.handbook_id AND p.page_no = t.page_no""")
def i44(c: Corpus) -> DataFrame:
    return pages.module_records(c.pages()).select(
        "handbook_id", "module_code", "title", "ects", "content", "goals",
        F.size("module_parts").cast("long").alias("n_parts"), "module_exam", "pages",
    )
