"""Text expressions: module codes, page-stream text, titles, credits and document templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from handbook_spark.functions.nested import let

# Fixed patterns of module codes and of kerning in shown texts.
MODULE_CODE = r"[A-ZÄÖÜ]{2,}-\d{3,}"
KERNING = r"\s\)\s*-?\d+(?:\.\d+)?\s*\(\s*"

# Fixed labels of a module record, in source order.
LABELS: dict[str, str] = {
    "module_code": "Modulcode",
    "title": "Titel",
    "ects": "ECTS",
    "complete_content": "Vollständiger Inhalt",
    "summarized_content": "Zusammenfassung des Inhalts",
    "goals": "Ziele",
    "summarized_goals": "Zusammenfassung der Ziele",
    "requirements": "Anforderungen",
    "recommended_semester": "Empfohlenes Semester",
    "module_parts": "Modulteile",
    "weekly_hours": "Wöchentliche Stunden",
    "expense": "Kosten",
    "exams": "Prüfungen",
    "success_requirements": "Erfolgsvoraussetzungen",
    "lecturer": "Dozent",
    "version": "Version",
    "module_group": "Modulgruppe",
}

_C1_CODES = [n for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")]
_C1_FROM = "".join(chr(n) for n in _C1_CODES)
_C1_TO = bytes(_C1_CODES).decode("cp1252")
_ESCAPED_BACKSLASH = "\ue000"


def extract_or_null(text: Column, pattern: str, group: int = 0) -> Column:
    """``regexp_extract`` with NULL instead of the empty string when nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def module_code(text: Column) -> Column:
    """First module code in a text, NULL when there is none."""
    return extract_or_null(text, MODULE_CODE)


def subject(code: Column) -> Column:
    """Upper-cased part before the first hyphen, NULL for codes without one."""
    return F.when(F.contains(code, F.lit("-")), F.upper(F.substring_index(code, "-", 1)))


def decode_escapes(text: Column) -> Column:
    """Replace ``\\ddd`` octal escapes by their Windows-1252 characters and drop other backslashes."""

    def decoded(piece: Column, index: Column) -> Column:
        octal = F.conv(F.substring(piece, 1, 3), 8, 10).cast("int")
        return F.when(
            (index > 0) & piece.rlike("^[0-3][0-7]{2}"), F.concat(F.chr(octal), F.substr(piece, F.lit(4)))
        ).otherwise(piece)

    def unescaped(whole: Column) -> Column:
        pieces = F.split(F.replace(whole, F.lit("\\\\"), F.lit(_ESCAPED_BACKSLASH)), r"\\")
        joined = F.replace(F.array_join(F.transform(pieces, decoded), ""), F.lit(_ESCAPED_BACKSLASH), F.lit(""))
        return F.when(F.contains(whole, F.lit("\\")), joined).otherwise(whole)

    return F.translate(let(text, unescaped), _C1_FROM, _C1_TO)


def repair_text(text: Column) -> Column:
    """Join words broken at line ends, drop kerning artefacts, decode escapes."""
    joined = F.replace(text, F.lit("-\n"), F.lit(""))
    return decode_escapes(F.regexp_replace(joined, KERNING, " "))


def join_title_lines(lines: Column) -> Column:
    """Join the lines of a title; a hyphen before a lower-case continuation is dropped."""

    def joined(parts: Column) -> Column:
        def with_gap(line: Column, index: Column) -> Column:
            following = F.get(parts, index + 1)
            return (
                F.when(following.isNull(), line)
                .when(line.endswith("-") & following.rlike(r"^\p{Ll}"), F.substr(line, F.lit(1), F.length(line) - 1))
                .otherwise(F.concat(line, F.lit(" ")))
            )

        return F.array_join(F.transform(parts, with_gap), "")

    return let(lines, joined)


def clean_title(title: Column) -> Column:
    """Remove the credit note from a title and squeeze whitespace; the first matching note form wins.

    Parentheses may be escaped with a backslash as in page streams.
    """
    forms = (
        (r"(?s)^(.*?)\\?\(\d+LP\\?\)", "$1 "),
        (r"(?s)^(.*?) \\?\(\d+ LP\\?\)", "$1 "),
        (r"(?s)^(.*?) \d+ CP$", "$1 "),
        (r"(?s)^(.*?)( \\?\()\d+ LP[;,] ", "$1$2"),
        (r"(?s)^(.*?)[;,] \d+ LP(\\?\))", "$1$2"),
        (r"(?s)^(.*?) \d+ LP(\\?\))", "$1$2"),
    )
    cleaned = None
    for pattern, keep in forms:
        step = F.regexp_replace(title, pattern, keep)
        cleaned = F.when(title.rlike(pattern), step) if cleaned is None else cleaned.when(title.rlike(pattern), step)
    return decode_escapes(squeeze(cleaned.otherwise(title)))


def squeeze(text: Column) -> Column:
    """Every whitespace run to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def key_value_text(columns: Mapping[str, Column] | Sequence[str], separator: str = "\n\n") -> Column:
    """``key: value`` lines in the given order; a missing value reads ``None``."""
    if not isinstance(columns, Mapping):
        columns = {name: F.col(name) for name in columns}
    return F.concat_ws(
        separator,
        *[F.concat(F.lit(f"{key}: "), F.coalesce(value.cast("string"), F.lit("None"))) for key, value in columns.items()],
    )


def deadline_text(winter: Column, summer: Column) -> Column:
    """Application deadlines joined by `` / ``; NULL when neither is set."""
    text = F.concat_ws(
        " / ",
        F.when(winter != "", F.concat(F.lit("Wintersemester: "), winter)),
        F.when(summer != "", F.concat(F.lit("Sommersemester: "), summer)),
    )
    return F.nullif(text, F.lit(""))


def is_restricted(admission: Column) -> Column:
    return F.lower(F.trim(admission)) != "zulassungsfrei"


def programme_card(row: Mapping[str, Column]) -> Column:
    """Information card of a programme: fixed lines, optional lines only when present."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    deadlines = F.when(is_restricted(row["admission"]), deadline_text(row["deadline_winter"], row["deadline_summer"]))
    return F.concat_ws(
        "\n",
        line("Studiengang", row["name"]),
        line("Abschluss", row["degree"]),
        line("Regelstudienzeit", row["duration"]),
        line("Zulassungsmodus", row["admission"]),
        line("Unterrichtssprache", row["language"]),
        line("Studienform", row["study_type"]),
        line("Studienbeginn", row["start_term"]),
        line("Bewerbungsfrist", deadlines),
        line("Deutschkenntnisse", row["german_level"]),
        line("Inhalt", row["content"]),
        line("Perspektiven", F.array_join(row["perspectives"], ", ")),
    )


def programme_metadata(row: Mapping[str, Column]) -> Column:
    """Metadata map of a programme; optional keys only when present."""
    entries = {
        "Studiengang": row["name"],
        "Abschluss": row["degree"],
        "Zulassungsmodus": row["admission"],
        "Unterrichtssprache": row["language"],
        "Studienbeginn": row["start_term"],
        "Deutschkenntnisse": row["german_level"],
        "Inhalt": row["content"],
        "Perspektiven": F.array_join(row["perspectives"], ", "),
        "Regelstudienzeit": row["duration"],
        "Studienform": row["study_type"],
        "Bewerbungsfrist": F.when(
            is_restricted(row["admission"]), deadline_text(row["deadline_winter"], row["deadline_summer"])
        ),
    }
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values()))
    return F.map_filter(full, lambda _, value: value.isNotNull())


def search_string(website: Column, name: Column, degree: Column, present: Column) -> Column:
    """Web search text of a programme, kept when already set."""
    level = F.when(degree.ilike("%bachelor%"), F.lit("Bachelor")).when(degree.ilike("%master%"), F.lit("Master"))
    built = F.rtrim(
        F.concat(
            F.lit("site:"), F.coalesce(website, F.lit("")), F.lit(" filetype:pdf modulhandbuch "),
            F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(level, F.lit("")),
        )
    )
    return F.coalesce(present, built)


def html_to_text(html: Column) -> Column:
    """Body text of a page: line breaks kept, style dropped, empty elements marked ``--NONE--``."""
    body = F.coalesce(extract_or_null(html, r"(?is)<body[^>]*>(.*)</body>", 1), html)
    steps = (
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"<[A-Za-z][^<>]*></[A-Za-z][^<>]*>", "--NONE--"),
        (r"<[A-Za-z][^<>]*/>", "--NONE--"),
        (r"<[^<>]*>", ""),
    )
    for pattern, replacement in steps:
        body = F.regexp_replace(body, pattern, replacement)
    return body


def token_count(text: Column) -> Column:
    """Size of a text in words and single marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|\S"), F.lit(0)))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")
