"""The page scanner and its readers against regular expressions over the raw stream."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from handbook_spark import corpus
from handbook_spark.operators import pages
from handbook_spark.sources import page_streams

SF_DIR = "/root/testdata/sf0.001"
SHOWN = r" Tm \[\(([^\n\r]*?)\)\] TJ"
POSITIONED = r"1 0 0 -1 (\d+(?:\.\d+)?) (\d+(?:\.\d+)?) Tm\s?\[\(([^\n\r]*?)\)"
LINE = r"(?m)^1 0 0 -1 (\d+(?:\.\d+)?) (\d+(?:\.\d+)?) Tm \[\(([^\n]*?)\)\] TJ"


def random_stream(rng: random.Random) -> str:
    texts = ["Inhalte:", "Ziel", "Modul INF-0001: Netze", "Modul x", "12", "8 ECTS/LP", "x ECTS/LP", "a) -2 (b", "ü", "Teil \\(1\\)", "", "x\ry", "."]
    lines = []
    for _ in range(rng.randint(0, 25)):
        text, y = rng.choice(texts), rng.choice(["10", "10.5", "20"])
        lines.append(rng.choice([
            f"1 0 0 -1 40 {y} Tm [({text})] TJ", f"1 0 0 -1 40 {y} Tm [({text})] TJ", f"1 0 0 -1 40 {y} Tm [({text})] TJ",
            f"q 1 0 0 -1 4 {y} Tm[({text})", f"1 0 0 1 4 {y} Tm [({text})] TJ", f"1 0 0 -1 40 {y} Tm [({text})] TJ Q",
            "ET\nQ", "ET", "Q", "Q\nQ", "/F3 10 Tf", "/F2 9 Tf", "0.5 g", "0 0 1 rg", "BT", "", "Modulhandbuch"]))
    return "\n".join(lines)


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(3)
    texts = [random_stream(rng) for _ in range(1500)] + ["", "\n", "ET\nQ\n"]
    return texts, page_streams.scan_pages(spark.createDataFrame(
        [(i, 0, t) for i, t in enumerate(texts)] + [(len(texts), 0, None)], "handbook_id int, page_no int, stream string").repartition(3)).persist()


def by_page(frame, column) -> dict:
    return {r.handbook_id: r[column] for r in frame.collect()}


def test_shown_texts(streams):
    texts, scanned = streams
    found = by_page(scanned.select("handbook_id", pages.page_text(F.col("fragments")).alias("t")), "t")
    assert found == {i: "\n".join(re.findall(SHOWN, t)) for i, t in enumerate(texts)} | {len(texts): ""}


def test_positioned_fragments(streams):
    texts, scanned = streams
    placed = F.filter("fragments", lambda f: f["x"].isNotNull() & ~F.contains(F.substring_index(f["text"], ")", 1), F.lit("\r")))
    found = by_page(scanned.select("handbook_id", F.transform(
        placed, lambda f: F.struct(f["x"], f["y"], F.substring_index(f["text"], ")", 1))).alias("t")), "t")
    for i, text in enumerate(texts):
        assert [tuple(f) for f in found[i]] == [(float(x), float(y), t) for x, y, t in re.findall(POSITIONED, text)]


def test_headers_footers_and_credits(streams):
    texts, scanned = streams
    rows = {r.handbook_id: r for r in scanned.select("handbook_id", "code", "footer", pages.credits(F.col("fragments")).alias("ects")).collect()}
    for i, text in enumerate(texts):
        head, ects = re.search(r"Tm \[\(Modul ([A-ZÄÖÜ]{2,}-\d{3,})", text), re.search(r" Tm \[\((\d+) ECTS/LP\)\] TJ", text)
        foot = re.findall(r" Tm \[\((\d+)\)\] TJ\nET\nQ\n", text)
        assert rows[i].code == (head and head[1]) and rows[i].footer == (foot[-1] if foot else None)
        assert rows[i].ects == (int(ects[1]) if ects else None)


def test_sections(streams):
    texts, scanned = streams
    found = by_page(scanned.select("handbook_id", pages.section_text("Inhalte:").alias("t")), "t")
    for i, text in enumerate(texts):
        text = re.sub(r"(\)\] TJ)([^\n])", r"\1\n\2", text)
        block = re.search(r"(?s) Tm \[\(Inhalte:\)\] TJ(.*?)\nET\nQ", text)
        if not block or not block[1]:
            assert found[i] is None
            continue
        want, last = "", None
        for _, y, t in re.findall(LINE, block[1]):
            want += ("" if last is None else " " if float(y) == last else "\n") + t
            last = float(y)
        if "\r" not in want:
            assert found[i] == want, text


def test_places_of_marks():
    stream = "Modulhandbuch\n/F1 12 Tf\n1 0 0 -1 4 5 Tm [(Titel)] TJ\nET\nQ\nQ\n\nä Inhaltsverzeichnis"
    code, footer, fragments, fonts, boxes, blocks, rules, marks = (c.to_pylist()[0] for c in page_streams.scan(pa.array([stream])))
    assert (code, footer, blocks, rules) == (None, None, [3], [4])
    assert boxes == [{"line": 3, "at": stream.index("ET\n")}]
    assert fonts == [{"line": 1, "at": stream.index("/F1"), "font": "/F1 12 Tf"}]
    assert marks == [{"line": 0, "word": "Modulhandbuch"}, {"line": 7, "word": "Inhaltsverzeichnis"}]
    assert (fragments[0]["line"], fragments[0]["at"], fragments[0]["fresh"]) == (2, stream.index("Titel"), True)


def test_two_texts_in_one_line(spark):
    stream = "1 0 0 -1 4 5 Tm [(eins)] TJ 1 0 0 -1 4 6 Tm [(zwei)] TJ"
    scanned = page_streams.scan_pages(spark.createDataFrame([(1, stream, "x")], "id int, stream string, fonts_of string"))
    assert scanned.select(pages.page_text(F.col("fragments")).alias("t"), "fonts_of").first() == ("eins\nzwei", "x")


@pytest.mark.parametrize("name", ["i3_shown_text", "i4_text_repair", "i6_credits", "i7_section_text", "i8_module_parts", "i8_module_exam",
                                  "i9_handbook_title", "i10_module_pages", "e7_toc_codes", "e8_module_sections", "i44_module_record"])
def test_page_readers_share_the_scanned_pages(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "stream" not in plan and "regexp_extract_all" not in plan
    assert len(re.findall(r"regexp_extract|regexp_replace\([^)]*stream", plan)) <= 1


def test_readers_prune_the_arrays_that_they_do_not_need(spark):
    plan = entry.queries()["i10_module_pages"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "fragments" not in plan
    plan = entry.queries()["i3_shown_text"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "fonts" not in plan and "blocks" not in plan


def test_lines_are_dealt_out_before_streams_are_built(spark, tmp_path):
    """The shuffle and the sort carry lines of the documents, not the streams and arrays made from them; rows are the same."""
    rows = [(1, "a\nb (c)", "de", "src1"), (1, "a\nb (c)", "de", "src1"), (2, None, "en", "src2"), (3, "", None, "src3"), (None, "x\ny\nz", "fr", "src4")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    c = corpus.Corpus(spark, str(tmp_path))
    plan = c._derived(corpus.PAGES)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("MapInArrow") < plan.index("Sort [doc_id") < plan.index("Exchange hashpartitioning(doc_id")
    assert "stream" not in plan[plan.index("Sort [doc_id"):]
    want = page_streams.scan_pages(c.view("v_page_streams"))
    order = ["handbook_id", "page_no"]
    assert c.pages().orderBy(order).collect() == want.orderBy(order).collect() and c.pages().count() == 8
