"""Readers, exports, bulk append and incremental ingest on files in a temporary folder."""

from __future__ import annotations

import csv
import gzip
import io
import json

import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
from handbook_spark import session
from handbook_spark.corpus import Corpus
from handbook_spark.operators import tables
from handbook_spark.plans import scanning
from handbook_spark.sources import exports, readers
from handbook_spark.sources.keyed_table import KeyedTable
from handbook_spark.streaming.ingest import RAW_SCHEMA, append_batch, ingest_raw_modules, raw_table


def test_list_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("12.pdf", "sub/7.pdf", "9.txt"):
        (tmp_path / name).write_bytes(b"x" * 5)
    files = readers.list_files(spark, str(tmp_path))
    assert sorted((r.file_id, r.length) for r in files.collect()) == [("12", 5), ("7", 5)]
    assert "content" not in files.columns
    registry = spark.createDataFrame([(7, "a"), (8, "b")], "id int, t string")
    assert [(r.id, r.t) for r in readers.registered_files(files, registry).collect()] == [(7, "a")]


def test_read_xml(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.xml").write_text(
        '<root><module moduleId="5"><moduleTitle>Karten</moduleTitle><examInfo><examType>Klausur</examType></examInfo></module></root>'
    )
    schema = T.StructType().add("_moduleId", "long").add("moduleTitle", "string").add("examInfo", T.StructType().add("examType", "string"))
    row = readers.read_xml(spark, str(tmp_path), "module", schema).first()
    assert (row.module_id, row.module_title, row.exam_info.exam_type) == (5, "Karten", "Klausur")
    assert row.source_path.endswith("deep/a.xml")


def test_xml_corpus_is_stored_compressed_and_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(scanning._XML_FILES, "maxRecordsPerFile", 40)
    monkeypatch.setattr(scanning, "scratch_path", lambda spark: str(tmp_path / "corpus"))
    pairs = [(p, s) for p in range(100) for s in range(10)]
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(p, ["bolt", 'a<b & "c"', "Straße\nzwei", None, "</module>"][p % 5], ["LARGE", None][p % 7 == 0], None if p % 9 == 0 else p) for p in range(100)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = entry.queries()["a3_xml_corpus"](spark, str(tmp_path)).collect()
    modules = Corpus(spark, str(tmp_path)).view("v_modules").collect()
    assert len(modules) == 1000
    assert sorted(found, key=str) == sorted([(m.id, m.module_code, m.title, m.ects, True) for m in modules], key=str)
    files = list((tmp_path / "corpus").glob("part-*"))
    assert len(files) >= 25
    assert sum(f.stat().st_size for f in files) < sum(len(gzip.decompress(f.read_bytes())) for f in files) / 2


def test_positioned_xml(spark):
    xml = (
        '<data><page number="2"><fontspec id="5"/><text left="10" font="5"><b>fett</b></text><text left="20" font="6">LMZ-</text>'
        '<text left="30" font="6"> </text><text left="40" font="7"><a href="x" left="41">Link<b>tief</b></a></text></page>'
        '<page number="3"><text left="1" font="2">neu</text></page></data>'
    )
    got = readers.positioned_xml_texts(spark.createDataFrame([(1, xml)], "id int, x string"), "x", "id")
    rows = [(r.left, r.font, r.bold, r.text) for r in got.orderBy("page_place", "text_place", "place").collect()]
    assert rows == [
        ("10", "5", True, "fett"), ("20", "6", False, "LMZ-"), ("41", "7", False, "Link"), ("41", "7", True, "tief"),
        ("1", "2", False, "neu"),
    ]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "A", "modules": [{"pos": 1, "module_code": "X"}]}, {"name": "B"}], indent=2))
    schema = T.StructType().add("name", "string").add("modules", T.ArrayType(T.StructType().add("pos", "long").add("module_code", "string")))
    rows = readers.read_json_documents(spark, str(tmp_path), schema).orderBy("name").collect()
    assert [(r.name, len(r.modules or [])) for r in rows] == [("A", 1), ("B", 0)]


def test_listing_courses(spark):
    item = {
        "id": 7, "institutionTypeId": 2, "link": {"url": "/k/7"}, "logo": {"src": {"large": "l.png"}}, "headline": "Geo", "subline": "Uni X",
        "items": [{"text": "BA"}, {"text": "40 Monate"}, {"text": "Köln"}, {"text": "Vollzeit, dual"}],
    }
    bodies = [json.dumps({"results": {"items": [item, {**item, "id": 8, "logo": None, "items": [{"text": "MA"}]}]}}), '{"results":{"items":[]}}', "defekt"]
    df = spark.createDataFrame(list(enumerate(bodies)), "key int, body string")
    first, second = readers.listing_courses(df, "body", "key", "x.de").orderBy("web_id").collect()
    assert first.asDict() == {
        "key": 0, "web_id": "7", "type_of_institution": "2", "source_url": "x.de/k/7", "logo_url": "l.png", "degree": "BA", "duration": 6,
        "city": "Köln", "study_type": ["Vollzeit", "dual"], "title": "Geo", "university": "Uni X", "source": "x.de",
    }
    assert (second.logo_url, second.degree, second.duration, second.city, second.study_type) == (None, "MA", None, None, None)


def test_university_list(spark, tmp_path):
    (tmp_path / "u.tsv").write_text('Hs-Nr.\tHochschulname\tHome Page\tNeu\n1\tUni "X"\thttps://x.de\t\n\n2\tHS – Y\t\tz\n', encoding="utf-8")
    got = readers.read_university_list(spark, str(tmp_path / "u.tsv")).orderBy("hs_nr").collect()
    assert [r.asDict() for r in got] == [
        {"hs_nr": "1", "name": 'Uni "X"', "website": "https://x.de", "Neu": None},
        {"hs_nr": "2", "name": "HS – Y", "website": None, "Neu": "z"},
    ]


def test_html_rows(spark):
    html = "<table><tr><th>a</th></tr><tr><td><a href='#'>x</a> <a href=\"/p\">Geo </a></td><td class='c'>de</td></tr><tr><td>zu</td></tr></table>"
    got = readers.html_rows(spark.createDataFrame([(1, html)], "id int, h string"), "h", "id", "tr", "td", ["name", "language"])
    assert [(r.name, r.language, r.first_link, r.last_link) for r in got.collect()] == [("x Geo", "de", "/p", None)]


def test_log_records_and_pages(spark):
    blob = ": 10:1;ls -l\n  weiter; mit\n: 20:0;exit \n"
    got = readers.log_records(spark.createDataFrame([(1, blob)], "id int, b string"), "b", "id").collect()
    assert [(r.epoch, r.duration, r.command) for r in got] == [(10, 1, "ls -l\n  weiter; mit"), (20, 0, "exit")]
    pages = readers.split_pages(spark.createDataFrame([(1, "a\n[*]\nb [*] c\n[*]\n")], "id int, t string"), "t", "id", "[*]")
    assert [(r.page_no, r.text) for r in pages.collect()] == [(0, "a"), (1, "b [*] c"), (2, "")]


def test_validate_extraction(spark):
    answers = [
        '{"modules":[{"title":"A","ects":"6","exams":[{"exam_type":"Klausur","duration":90}],"expense":120}]}',
        '{"data":{"modules":[{"ects":5,"expense":[{"activity":"V","hours":30}]}]}}',
        '{"modules":[{"ects":"sechs"}]}', '{"modules":[{"weekly_hours":"x"}]}', "{}", "kein json", '{"modules":[', None,
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "id int, a string")
    got = readers.validate_extraction(df, "a").orderBy("id").collect()
    assert [r.error for r in got] == [
        None, None, "ects is not a number", "weekly_hours is not a number", "no modules", "malformed", "malformed", "malformed",
    ]
    assert (got[0].modules[0].ects, got[0].modules[0].exams[0].duration, got[1].modules[0].ects) == (6, "90", 5)
    kinds = readers.validate_extraction(df, "a").filter("valid").select(
        F.try_variant_get(F.col("modules")[0]["expense"], "$", "int").alias("total"),
        F.try_variant_get(F.col("modules")[0]["expense"], "$[0].hours", "int").alias("part"), "id",
    ).orderBy("id").collect()
    assert [(r.total, r.part) for r in kinds] == [(120, None), (None, 30)]


@pytest.fixture()
def modules(spark):
    return spark.createDataFrame([
        (1, "Geo", 2, "B-2", 'mit "Zitat"; neu', 6, [3, 4]), (1, "Geo", 1, "A-1", "zwei\nZeilen", None, [1]), (2, "Mathe", 1, "C-3", "ü", 9, []),
    ], "mhb_id long, name string, pos long, module_code string, title string, ects int, pages array<int>")


def document(lines, handbook=1):
    ordered = lines.filter(F.col("mhb_id") == handbook).orderBy("section", "pos").collect()
    return "\n".join(r.line for r in ordered)


def test_json_export(modules):
    got = json.loads(document(exports.export_lines(modules, "json")))
    assert got == {"name": "Geo", "modules": [
        {"module_code": "A-1", "title": "zwei\nZeilen", "ects": None, "pages": [1]},
        {"module_code": "B-2", "title": 'mit "Zitat"; neu', "ects": 6, "pages": [3, 4]},
    ]}
    keyed = json.loads(document(exports.json_lines(modules, ["module_code", "ects"], ordered=False, module_code_key=True)))
    assert keyed == {"name": "Geo", "modules": {"A-1": {"ects": None}, "B-2": {"ects": 6}}}
    with pytest.raises(ValueError):
        exports.json_lines(modules, ["ects"], ordered=True, module_code_key=True)


@pytest.mark.parametrize("delimiter", [";", ",", "\t"])
def test_csv_export_reads_back(modules, delimiter):
    got = document(exports.export_lines(modules, "csv", delimiter=delimiter))
    assert got[0] == "﻿"
    name, body = got[1:].split("\n", 1)
    assert name == "Geo"
    assert list(csv.reader(io.StringIO(body), delimiter=delimiter)) == [
        ["module_code", "title", "ects", "pages"], ["A-1", "zwei\nZeilen", "", "1"], ["B-2", 'mit "Zitat"; neu', "6", "3, 4"],
    ]


def test_table_exports(modules):
    md = document(exports.export_lines(modules, "md", ["ects", "title"]))
    assert md == (
        "# Geo\n<table >\n<thead>\n<tr>\n<th>title</th>\n<th>ects</th>\n</tr>\n</thead>\n<tbody>\n<tr><td>zwei<br>Zeilen</td>\n<td>None</td></tr>\n"
        '<tr><td>mit "Zitat"; neu</td>\n<td>6</td></tr>\n</tbody>\n</table>'
    )
    html = document(exports.export_lines(modules, "html", ["ects"], borders=True), 2)
    assert html.startswith("<!DOCTYPE html>\n<html>\n<head>\n<title>Mathe</title>") and '<table border="1">' in html
    assert document(exports.export_lines(modules, "txt", ["ects"]), 2) == "Mathe\nects\n9"


@pytest.mark.parametrize("options", [
    {"file_type": "json", "delimiter": ";"}, {"file_type": "md", "borders": True}, {"file_type": "doc"}, {"file_type": "csv", "delimiter": "|"},
])
def test_export_rules(modules, options):
    with pytest.raises(ValueError):
        exports.export_lines(modules, **options)


def test_pdf_export_is_refused(modules):
    with pytest.raises(NotImplementedError):
        exports.export_lines(modules, "pdf")


def test_overlap_name():
    assert exports.overlap_name(["Geo A", "Geo B"], ["a", "b"], "html") == "Geo A<br>Geo B"
    assert exports.overlap_name(["Geo A", "Geo B"], ["a", "b"], "csv") == "a, b"


def test_write_export(spark, modules, tmp_path):
    exports.write_export(exports.export_lines(modules, "html"), str(tmp_path / "out"))
    folder = tmp_path / "out" / "mhb_id=1"
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert text.rstrip("\n") == document(exports.export_lines(modules, "html"))


def test_bulk_append(spark, tmp_path):
    rows = tables.with_content_hash(spark.createDataFrame(
        [("A", "x"), ("A", "y"), ("B", "x"), ("B", "x"), (None, "x"), ("A", None), ("A", None)], "module_code string, content string"), "content")
    table = KeyedTable(spark, str(tmp_path / "raw"), rows.schema, ["module_code", "content_md5"], 4)
    table.insert_new(1, rows.limit(1), [F.col("content")])
    for _ in range(2):
        counts = exports.append_raw_modules(table, 2, rows, [F.col("content")]).first()
        assert counts.asDict() == {"given": 7, "inserted": 4, "skipped": 3}
        assert table.read().count() == 5


def test_incremental_ingest(spark, tmp_path):
    incoming, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), "mhb_id long, module_code string, content string").write.mode("append").json(incoming)
        assert ingest_raw_modules(spark, incoming, table, checkpoint).awaitTermination(120)
        return sorted((r.mhb_id, r.module_code, r.content) for r in spark.read.parquet(table).collect())

    assert arrive((1, "A", "x"), (2, "A", "x"), (1, "B", "y")) == [(1, "A", "x"), (1, "B", "y")]
    assert arrive((3, "A", "x"), (3, "A", "z")) == [(1, "A", "x"), (1, "B", "y"), (3, "A", "z")]
    arrived = spark.createDataFrame([(4, "C", None), (5, "C", None)], RAW_SCHEMA)
    for _ in range(2):
        append_batch(table, arrived, 2)  # a module without content is stored once, however often the batch runs
    append_batch(table, arrived, 3)
    assert raw_table(spark, table).read().filter("module_code = 'C'").count() == 1


def test_scratch_needs_a_shared_folder(spark, monkeypatch, tmp_path):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Fake:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError):
        session.scratch_path(Fake(spark_master="spark://host:7077"))
    shared = session.scratch_path(Fake(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs:///cp/"))
    assert shared.startswith("hdfs:///cp/handbook_spark/app/")
