"""Readers of scanned pages: shown text, sections, titles, parts and module records.

``pages`` is a table with one row per page as ``sources.page_streams.scan_pages`` makes it: handbook_id, page_no, the module code of the
header, the printed page number, and arrays of fragments and of the places where fonts, boxes, blocks and exam lists change. A page's fragments lie in its
row, so what belongs to one page is put together without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from handbook_spark.functions.nested import let
from handbook_spark.functions.text import MODULE_CODE, clean_title, decode_escapes, extract_or_null, join_title_lines
from handbook_spark.operators.numbering import first_per_key, run_numbers
from handbook_spark.operators.sequences import first_occurrences, ordered_join, pages_text
from handbook_spark.sources.page_streams import KEYWORDS

# Fixed marks of the page streams.
HEADER_FONT, TRANSLATION_FONT = "/F3 10", "/F2 9 Tf"
PART_LABELS = {"type_of_study": "Lehrformen: ", "language": "Sprache: ", "weekly_hours": "SWS: "}
PARTS, PART, VALIDITY, EXAM = "Modulteile", "Modulteil:", "G\\374ltig ", "Pr\\374fung"
CREDITS, CONTENTS_WORD, TITLE_WORD = " ECTS/LP", *KEYWORDS
#: Characters behind a module header in which the described system looks for the title; a fixed value that must be the same.
TITLE_WINDOW = 700


def shown(fragments: Column) -> Column:
    return F.filter(fragments, lambda f: f["shown"])


def texts(fragments: Column) -> Column:
    return F.transform(fragments, lambda f: f["text"])


def page_text(fragments: Column) -> Column:
    """Texts that a page shows, one a line."""
    return F.array_join(texts(shown(fragments)), "\n")


def _first(entries: Column) -> Column:
    return F.get(entries, F.lit(0))


def _first_after(lines: Column, line: Column) -> Column:
    """First of ascending line numbers behind ``line``."""
    return _first(F.filter(lines, lambda at: at > line))


def _between(fragments: Column, after: Column, before: Column) -> Column:
    return F.filter(fragments, lambda f: (f["line"] > after) & (f["line"] < before))


def section_text(heading: str, fragments: Column | None = None, blocks: Column | None = None) -> Column:
    """Text below a heading up to the end of its block, NULL when the page has no such heading.

    Fragments of equal height are joined by blanks, lines by newlines.
    """
    fragments = F.col("fragments") if fragments is None else fragments
    blocks = F.col("blocks") if blocks is None else blocks

    def lines(inside: Column) -> Column:
        pieces = F.transform(
            inside,
            lambda f, i: F.concat(
                F.when(i == 0, F.lit("")).when(F.get(inside, i - 1)["y"] == f["y"], F.lit(" ")).otherwise(F.lit("\n")), f["text"]),
        )
        return F.array_join(pieces, "")

    def below(line: Column) -> Column:
        return let(_first_after(blocks, line), lambda end: F.when(
            end > line + 1, let(F.filter(fragments, lambda f: f["leads"] & (f["line"] > line) & (f["line"] < end)), lines)))

    return let(_first(F.filter(fragments, lambda f: f["shown"] & (f["text"] == heading)))["line"], below)


def has_word(word: str) -> Column:
    """Whether a keyword of the scanner occurs in the page's stream."""
    return F.exists("marks", lambda m: m["word"] == word)


def handbook_title(fragments: Column, marks: Column) -> Column:
    """Text that a cover page shows two lines below the title keyword."""
    keywords = F.transform(F.filter(marks, lambda m: m["word"] == TITLE_WORD), lambda m: m["line"])
    found = let(keywords, lambda lines: _first(F.filter(fragments, lambda f: F.array_contains(lines, f["line"] - 2)))["text"])
    return F.replace(F.nullif(found, F.lit("")), F.lit("\\"), F.lit(""))


def handbook_titles(pages: DataFrame) -> DataFrame:
    """Title of every handbook, from its first page with the title keyword."""
    covers = pages.filter(has_word(TITLE_WORD)).select(
        "handbook_id", "page_no", handbook_title(F.col("fragments"), F.col("marks")).alias("title"))
    return first_per_key(covers, ["handbook_id"], [F.col("page_no")]).select("handbook_id", "title")


def page_sections(pages: DataFrame, heading: str) -> DataFrame:
    """Section text of every page that has a module header and the heading."""
    section = pages.filter(F.col("code").isNotNull()).select(
        "handbook_id", "page_no", F.struct(F.col("code").alias("module_code"), section_text(heading).alias("text")).alias("s"))
    # Tested after the generator, so that the text is put together once.
    return section.select("handbook_id", "page_no", F.inline(F.filter(F.array("s"), lambda s: s["text"].isNotNull())))


def module_sections(pages: DataFrame, heading: str) -> DataFrame:
    """Section text of every module: page texts in page order, equal ones once, joined by newlines and decoded."""
    once = first_occurrences(page_sections(pages, heading), ["handbook_id", "module_code"], "text", "page_no")
    return once.groupBy("handbook_id", "module_code").agg(decode_escapes(ordered_join(["page_no"], "text", "\n")).alias("text"))


def module_pages(pages: DataFrame) -> DataFrame:
    """Printed page number of every page that carries a module header."""
    return pages.filter(F.col("code").isNotNull()).select(
        "handbook_id", "page_no", F.col("code").alias("module_code"), F.col("footer").try_cast("int").alias("printed_page"))


def toc_codes(pages: DataFrame) -> DataFrame:
    """Module codes of the table of contents, each once with its first place.

    Consecutive fragments of equal height form a line, also across pages; the first fragment of a
    line that starts with a code gives the line's code.
    """
    placed = F.filter("fragments", lambda f: f["x"].isNotNull())
    fragments = (
        pages.filter(has_word(CONTENTS_WORD)).select("handbook_id", "page_no", F.posexplode(placed).alias("place", "f"))
        .select("handbook_id", "page_no", "place", F.col("f.y").alias("y"), F.substring_index("f.text", ")", 1).alias("text"))
        .filter(F.col("text") != ".")
        .select("handbook_id", "page_no", "place", "y", extract_or_null(F.col("text"), f"^({MODULE_CODE})", 1).alias("module_code"))
    )
    lines = run_numbers(fragments, ["handbook_id"], ["page_no", "place"], "y", name="line")
    codes = (
        lines.filter(F.col("module_code").isNotNull()).groupBy("handbook_id", "line")
        .agg(F.min(F.struct("page_no", "place", "module_code")).alias("first")).select("handbook_id", "first.*")
    )
    return (
        codes.groupBy("handbook_id", "module_code").agg(F.min(F.struct("page_no", "place")).alias("first"))
        .select("handbook_id", "module_code", "first.page_no", "first.place")
    )


def credits(fragments: Column) -> Column:
    """First ``N ECTS/LP`` of some fragments, NULL when there is none."""
    numbers = F.transform(
        F.filter(fragments, lambda f: f["shown"] & f["text"].endswith(CREDITS)), lambda f: F.substring_index(f["text"], CREDITS, 1))
    return _first(F.filter(numbers, lambda t: (t != "") & (F.translate(t, "0123456789", "") == ""))).try_cast("int")


def title_header(fragments: Column) -> Column:
    """The module header that is set in the title font; NULL when the page has none."""
    return _first(F.filter(fragments, lambda f: f["fresh"] & f["code"].isNotNull() & F.contains(f["font"], F.lit(HEADER_FONT))))


def raw_title(header: Column, fragments: Column, fonts: Column, boxes: Column) -> Column:
    """Title behind a module header, with credit notes.

    It ends where the translated title's font begins, else with the box; without either the text after the
    colon is taken. Gray texts (alternatives) are left out and hyphenated lines are joined.
    """
    begin = header["at"] + F.length(F.lit("Modul ")) + F.length(header["code"])
    rest = F.substr(header["text"], F.length(F.lit("Modul ")) + F.length(header["code"]) + 1)

    def cut(marks: Column, size: int) -> Column:
        return _first(F.filter(marks, lambda m: (m["line"] > header["line"]) & (m["at"] + size <= begin + TITLE_WINDOW)))["line"]

    def behind(end: Column) -> Column:
        return F.filter(fragments, lambda f: (f["line"] > header["line"]) & (f["line"] < end) & (f["gray_line"] <= header["line"]))

    end = F.coalesce(cut(F.filter(fonts, lambda m: m["font"].startswith(TRANSLATION_FONT)), len(TRANSLATION_FONT)), cut(boxes, 2))
    joined = let(end, lambda e: F.when(e.isNotNull(), let(
        F.filter(F.concat(F.array(rest), texts(behind(e))), lambda t: t != ""), join_title_lines)))
    told = F.concat(F.array(rest), texts(F.filter(fragments, lambda f: (f["line"] > header["line"]) & f["shown"] & (
        f["at"] + F.length(f["text"]) + 5 <= begin + TITLE_WINDOW))))
    plain = _first(F.transform(F.filter(told, lambda t: F.contains(t, F.lit(": "))), lambda t: F.substr(t, F.position(F.lit(": "), t) + 2)))
    return F.coalesce(F.nullif(joined, F.lit("")), plain)


def finished_title(raw: Column) -> Column:
    """A raw title without the colon before it and without credit notes."""
    return clean_title(F.regexp_replace(raw, r"^\s*:\s*", ""))


def page_parts(fragments: Column, rules: Column) -> Column:
    """Parts of the module on a page: name, teaching form, language, weekly hours, first exam, with escapes; NULL without a list of parts."""

    def fields(inside: Column, end: Column) -> Column:
        def named(label: str) -> Column:
            after = let(_first(F.filter(inside, lambda f: f["text"] == label))["line"], lambda at: _first(
                F.filter(inside, lambda f: f["line"] > at))["text"])
            return F.nullif(after, F.lit(""))

        def listed(line: Column) -> Column:
            stop = _first(F.filter(rules, lambda r: (r > line + 1) & (r + 2 <= end)))
            return let(stop, lambda s: F.array_join(texts(_between(inside, line, s)), "\n"))

        def told_name(name: Column) -> Column:
            return F.when(~name.startswith("Lehrformen:"), name)

        exam = let(_first(F.filter(inside, lambda f: f["text"] == EXAM))["line"], listed)
        return F.struct(
            let(F.nullif(_first(inside)["text"], F.lit("")), told_name).alias("name"),
            *[named(label).alias(column) for column, label in PART_LABELS.items()],
            F.nullif(exam, F.lit("")).alias("exam"),
        )

    def cut(told: Column, begin: Column, end: Column) -> Column:
        marks = F.transform(_between(F.filter(told, lambda f: f["text"].startswith(PART)), begin, end), lambda f: f["line"])

        def one(lines: Column) -> Column:
            def part(line: Column, i: Column) -> Column:
                return let(F.coalesce(F.get(lines, i + 1), end), lambda stop: let(
                    _between(told, line, stop), lambda inside: fields(inside, stop)))

            return F.transform(lines, part)

        return let(marks, one)

    def ended(told: Column, begin: Column) -> Column:
        end = _first(F.filter(told, lambda f: (f["line"] > begin) & f["text"].startswith(VALIDITY)))["line"]
        return F.when(begin.isNotNull(), let(end, lambda e: F.when(e.isNotNull(), cut(told, begin, e))))

    return let(shown(fragments), lambda told: let(
        _first(F.filter(told, lambda f: f["text"] == PARTS))["line"], lambda begin: ended(told, begin)))


PART_FIELDS = ("name", *PART_LABELS, "exam")


def decoded_parts(parts: Column) -> Column:
    """Parts without escapes."""
    return F.transform(parts, lambda p: F.struct(*[decode_escapes(p[f]).alias(f) for f in PART_FIELDS]))


def module_part_rows(pages: DataFrame) -> DataFrame:
    """Parts of the modules on each page, one row each."""
    marked = pages.filter(F.exists("fragments", lambda f: f["shown"] & f["text"].startswith(PART)))
    parts = marked.select("handbook_id", "page_no", F.posexplode(page_parts(F.col("fragments"), F.col("rules"))).alias("place", "part"))
    return parts.select(
        "handbook_id", "page_no", (F.col("place") + 1).alias("part_no"), *[decode_escapes(F.col(f"part.{f}")).alias(f) for f in PART_FIELDS])


def module_parts(pages: DataFrame) -> DataFrame:
    """Parts of each page as an array, and the exam texts joined by newlines."""
    marked = pages.filter(F.exists("fragments", lambda f: f["shown"] & f["text"].startswith(PART)))
    listed = marked.select("handbook_id", "page_no", decoded_parts(page_parts(F.col("fragments"), F.col("rules"))).alias("module_parts"))
    return listed.filter(F.size("module_parts") > 0).withColumn("module_exam", exams_text(F.col("module_parts")))


def exams_text(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, lambda p: p["exam"]), lambda e: e.isNotNull()), "\n")


def module_records(pages: DataFrame) -> DataFrame:
    """One row per handbook and module code: title, ects, content, goals, module_parts, module_exam, pages.

    Title and credits come from the first page that has a title, parts from the first page with parts; content
    and goals are the page texts in page order, equal ones once. Each page is cut down to what the record needs, and only these pieces are
    shuffled.
    """

    def titled(header: Column) -> Column:
        later = F.filter("fragments", lambda f: f["line"] > header["line"])
        return F.when(header.isNotNull(), F.struct(
            raw_title(header, F.col("fragments"), F.col("fonts"), F.col("boxes")).alias("title"), credits(later).alias("ects")))

    pieces = pages.filter(F.col("code").isNotNull()).select(
        "handbook_id", F.col("code").alias("module_code"),
        F.struct(
            F.col("page_no"), let(title_header(F.col("fragments")), titled).alias("head"),
            section_text("Inhalte:").alias("content"), section_text("Lernziele/Kompetenzen:").alias("goals"),
            page_parts(F.col("fragments"), F.col("rules")).alias("parts"), F.col("footer").try_cast("int").alias("page"),
        ).alias("piece"),
    )
    whole = pieces.groupBy("handbook_id", "module_code").agg(F.sort_array(F.collect_list("piece")).alias("pages"))
    head = _first(F.filter("pages", lambda p: p["head"]["title"].isNotNull()))["head"]
    parts = F.col("module_parts")

    def once(field: str) -> Column:
        found = F.array_distinct(F.filter(F.transform("pages", lambda p: p[field]), lambda t: t.isNotNull()))
        return F.when(F.size(found) > 0, decode_escapes(F.array_join(found, "\n")))

    first_parts = _first(F.filter("pages", lambda p: F.size(p["parts"]) > 0))["parts"]
    return whole.withColumn("module_parts", decoded_parts(first_parts)).select(
        "handbook_id", "module_code", finished_title(head["title"]).alias("title"), head["ects"].alias("ects"),
        once("content").alias("content"), once("goals").alias("goals"), "module_parts",
        exams_text(parts).alias("module_exam"),
        pages_text(F.filter(F.transform("pages", lambda p: p["page"]), lambda n: n.isNotNull())).alias("pages"),
    )
