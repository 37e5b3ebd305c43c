from __future__ import annotations

from pyspark.sql import functions as F

from handbook_spark.functions.nested import let, snake_fields
from handbook_spark.operators import joins, pages
from handbook_spark.sources.page_streams import scan_pages

import pytest


def shown(text: str) -> str:
    return f"1 0 0 -1 40 20 Tm [({text})] TJ"


def page(*lines: str, code: str = "INF-0001", footer: int = 3) -> str:
    return "\n".join(["BT", "/F3 10 Tf", shown(f"Modul {code}: Daten-"), *lines, "ET", "Q", shown(str(footer)), "ET", "Q", ""])


def titles(spark, *streams: str) -> list:
    scanned = scan_pages(spark.createDataFrame([(i, s) for i, s in enumerate(streams)], "i int, stream string"))
    raw = let(pages.title_header(F.col("fragments")), lambda h: pages.raw_title(h, F.col("fragments"), F.col("fonts"), F.col("boxes")))
    return [r.t for r in scanned.select("i", pages.finished_title(raw).alias("t")).orderBy("i").collect()]


def test_titles_of_pages(spark):
    assert titles(
        spark,
        page(shown("banken \\(6 LP\\)"), "/F2 9 Tf", shown("Databases")),  # up to the translation, note removed
        page(shown("banken")),  # up to the end of the box
        page("0.5 g", shown("ALT"), "0 0 1 rg", shown("banken"), "/F2 9 Tf"),  # gray text left out
        shown("Modul INF-0001: ohne Schrift"),  # header in another font
        "/F3 10 Tf\n" + shown("Modul INF-0001: Netze"),  # neither mark: the text after the colon
    ) == ["Datenbanken", "Datenbanken", "Datenbanken", None, "Netze"]


def test_record_over_pages(spark):
    section = "\n".join([shown("Inhalte:"), "1 0 0 -1 40 30 Tm [(Gr\\374ndung)] TJ", "ET", "Q"])
    rows = [
        (1, 5, shown("Modul INF-0001: nur Kopf") + "\n" + section),
        (1, 6, page(shown("banken"), "/F2 9 Tf", shown("8 ECTS/LP"), section, footer=7)),
        (1, 7, page(shown("banken"), "/F2 9 Tf", section, footer=8)),
        (1, 8, "Modul ohne Kopf"),
    ]
    found = pages.module_records(scan_pages(spark.createDataFrame(rows, "handbook_id int, page_no int, stream string"))).collect()
    assert [(r.handbook_id, r.module_code, r.title, r.ects, r.content, r.goals, r.pages) for r in found] == [
        (1, "INF-0001", "Datenbanken", 8, "Gründung", None, "7 - 8")]


def test_registered_domains(spark):
    urls = ["https://www.ox.ac.uk/a", "http://data.gov.uk/x", "https://gov.uk", "http://10.0.0.1/x", "https://a.b.example.com.br", "http://localhost"]
    suffixes = spark.createDataFrame([("uk",), ("ac.uk",), ("gov.uk",), ("com.br",), ("com",)], "suffix string")
    df = spark.createDataFrame([(u,) for u in urls + urls], "url string")
    assert {r.url: r.domain for r in joins.registered_domains(df, suffixes).collect()} == {
        urls[0]: "ox.ac.uk", urls[1]: "data.gov.uk", urls[2]: "https://gov.uk", urls[3]: urls[3], urls[4]: "example.com.br", urls[5]: urls[5]}


def test_field_names_must_stay_different(spark):
    df = spark.createDataFrame([(1, 2)], "`@id` int, id int")
    with pytest.raises(ValueError, match="id"):
        snake_fields(df)
    assert snake_fields(spark.createDataFrame([(1, 2)], "a__b int, __x int")).columns == ["a__b", "_x"]
