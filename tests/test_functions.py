"""Column functions on small values, compared with plain Python where it has the same function."""

from __future__ import annotations

import datetime as dt
from urllib.parse import quote, urldefrag, urljoin, urlparse

import pytest
from pyspark.sql import functions as F, types as T

from handbook_spark.functions import dates, nested, scoring, text, urls, vectors


def column(spark, values, function, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_codes_and_subjects(spark):
    values = ["Modul GEO-0042: x", "A-1", "ÄÖ-123 und MA-999", None]
    assert column(spark, values, text.module_code) == ["GEO-0042", None, "ÄÖ-123", None]
    assert column(spark, ["geo-1", "ohne", None], text.subject) == ["GEO", None, None]


def test_decode_escapes(spark):
    values = [r"Pr\374fung \(neu\)", r"a\\374b", "100\\% \\", r"\226 Euro \200", "frei", r"\12", None]
    assert column(spark, values, text.decode_escapes) == ["Prüfung (neu)", "a374b", "100% ", "– Euro €", "frei", "12", None]


def test_repair_text(spark):
    assert column(spark, ["Grund-\nlagen der T ) -12.5 ( heorie ) 3 ( x"], text.repair_text) == ["Grundlagen der T heorie x"]


@pytest.mark.parametrize("raw, clean", [
    ("Geographie (6LP)", "Geographie"), (r"Geographie \(6LP\) 2", "Geographie 2"), ("Geographie (6 LP) II", "Geographie II"),
    ("Mathe 6 CP", "Mathe"), ("Mathe 6 CP b", "Mathe 6 CP b"), ("Bio (6 LP; alt)", "Bio (alt)"),
    ("Bio (alt, 6 LP)", "Bio (alt)"), ("Bio (alt; 6 LP)", "Bio (alt)"), ("Bio (alt 6 LP)", "Bio (alt)"),
    ("  viel \n Platz ", "viel Platz"), ("x (6LP) y (8LP)", "x y (8LP)"),
])
def test_clean_title(spark, raw, clean):
    assert column(spark, [raw], text.clean_title) == [clean]


def test_title_lines(spark):
    lines = [["Grund-", "lagen", "der Wirtschafts-", "Informatik"], ["eins"], []]
    joined = column(spark, lines, text.join_title_lines, "array<string>")
    assert joined == ["Grundlagen der Wirtschafts- Informatik", "eins", ""]


def test_html_to_text(spark):
    html = "<html><body><style>p{}</style><p>a<br/>b</p><i></i><x/><!-- weg --><b>c <u>d</u></b></body></html>"
    assert column(spark, [html, "nur <b>Text</b>"], text.html_to_text) == ["a\nb--NONE----NONE--c d", "nur Text"]


def test_normalize_href_matches_urljoin(spark):
    bases = ["https://www.a.de/x/y.html?q=1#f", "http://a.de", "https://a.de/x/", "https://a.de/x/y/z?k"]
    hrefs = [
        "", " ", "#top", "/p", "p", "p/q?x=1#y", "../p", "../../p", "../../../../p", "./p", ".", "..", "?k=2", "//b.de/z",
        "https://c.de/d#e", "JavaScript:void(0)", "mailto:x@a.de", "tel:1", "data:x", "ftp://a.de/x", "a/./b/../c", "/a/../b/.",
    ]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for row in df.withColumn("o", urls.normalize_href(F.col("b"), F.col("h"), F.lit("a.de"))).collect():
        href = row.h.strip()
        wanted = None
        if href and not href.startswith("#") and not href.lower().startswith(urls.SKIPPED_SCHEMES):
            full = urljoin(row.b, urldefrag(href)[0])
            if urlparse(full).scheme in ("http", "https") and "a.de" in full:
                wanted = full
        assert row.o == wanted, (row.b, row.h)


def test_domains_and_names(spark):
    values = ["https://www.geo.uni-x.de/a", "http://x.ac.uk/", "https://a.b.ac.uk:80/z", "http://10.0.0.1/", "http://localhost/", "kein url"]
    assert column(spark, values, urls.registered_domain) == [
        "uni-x.de", "x.ac.uk", "b.ac.uk", "http://10.0.0.1/", "http://localhost/", "kein url",
    ]
    assert column(spark, ["https://www.a.de/b", "http://a.de/b", "https://a.de/"], urls.bare_host) == ["a.de", "a.de", "https:"]
    words = ["a b/ä", "100%+x"]
    assert column(spark, words, urls.percent_encode) == [quote(w, safe="") for w in words]
    assert column(spark, [quote(w, safe="") for w in words], urls.percent_decode) == words


def test_admissible(spark):
    good = "https://m.x.de/a.pdf"
    values = [good, good + "x", "http://m.x.de/a.pdf", "https://m.x.de/redirect/a.pdf", "https://m.x.de/" + "a" * 500 + ".pdf"]
    assert column(spark, values, lambda u: urls.is_admissible(u, "https://m.x.de/")) == [True, False, False, False, False]
    assert column(spark, ["/mhb/1", "/MHB/1"], urls.has_keyword) == [True, False]
    assert column(spark, ["/MHB/1.pdf", "/mhb/1.PDF"], urls.is_handbook_file) == [True, False]


def test_semesters(spark):
    values = ["Stand Wintersemester 2016/2017 neu", "Sommersemester 2018)", "ohne", None]
    assert column(spark, values, dates.semester_code) == [20161, 20180, None, None]
    assert column(spark, [20161, 20180, None], dates.semester_label, "int") == ["Wintersemester 2016/2017", "Sommersemester 2018", None]
    assert dates.semester_from_label("WS 2024/2025") == 20241 and dates.semester_from_label("SS 2024") == 20240
    assert column(spark, ["6 Semester", "40 Monate", "x Monate", "variabel"], dates.study_semesters) == [6, 6, None, None]


def test_session_expiry_follows_daylight_saving(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 30, 12, 0), 1), (dt.datetime(2024, 1, 1, 23, 30), 2)], "ts timestamp, d int")
    raw = df.select(F.date_format(dates.session_expiry(F.col("ts"), F.col("d")), "yyyy-MM-dd HH:mm").alias("e")).collect()
    # 05:30 is 03:30 UTC in summer; 23:30 UTC is already the next local day in winter.
    assert [r.e for r in raw] == ["2024-03-31 03:30", "2024-01-04 04:30"]


def test_scores(spark):
    df = spark.createDataFrame([(None, "a"), ("a", "a"), ("a", None), ("b", "a")], "m string, r string")
    scored = df.select(scoring.agreement(F.col("m"), F.col("r")).alias("a"), scoring.code_credibility(F.col("m"), F.col("r")).alias("c"))
    assert [(r.a, r.c) for r in scored.collect()] == [(0.5, 0), (1.0, 1), (0.0, -1), (0.0, -1)]
    means = df.limit(1).select(
        scoring.confidence(F.lit(0.5), F.lit(1.0), F.lit(0.0)).alias("c"), scoring.retrieval_score(F.lit(0.5), F.lit(1.0), F.lit(1.0)).alias("r")
    ).first()
    assert means.c == 0.5 and abs(means.r - 2 / 3) < 1e-9


def test_nested_walks(spark):
    df = spark.sql("SELECT ' a  b ' AS s, array(' x ', NULL) AS l, named_struct('k', ' y\\n z ', 'n', CAST(NULL AS INT)) AS t, map('m', ' v ') AS d")
    clean = nested.clean_spaces(df).first()
    assert (clean.s, clean.l, clean.t.k, clean.d) == ("a b", ["x", None], "y z", {"m": "v"})
    marked = nested.fill_none(df, "k.A.").first()
    assert (marked.l, marked.t.n) == ([" x ", "k.A."], "k.A.")
    assert nested.snake_case("@moduleCode") == "module_code" and nested.snake_case("HTMLText2Go") == "html_text2_go"
    inner = T.StructType().add("innerField", "string").add("_attrName", "string")
    frame = spark.createDataFrame([([("a", "b")],)], T.StructType().add("outerList", T.ArrayType(inner)))
    assert nested.snake_fields(frame).schema.simpleString() == "struct<outer_list:array<struct<inner_field:string,attr_name:string>>>"


def test_labelled_map_keeps_last(spark):
    df = spark.sql("SELECT array(named_struct('label', ' a: ', 'value', ' 1 '), named_struct('label', 'a', 'value', '2'), named_struct('label', 'b', 'value', NULL)) AS p")
    assert df.select(nested.labelled_map(F.col("p")).alias("m")).first().m == {"a": "2", "b": None}


def test_programme_texts(spark):
    base = dict(
        name="Geo", degree="BA", duration=None, admission="NC", language="Deutsch", study_type=None, start_term="WS",
        deadline_winter="15.07.", deadline_summer=None, german_level="C1", content="x", perspectives=["a", "b"],
    )
    schema = "name string, degree string, duration string, admission string, language string, study_type string, start_term string, deadline_winter string, deadline_summer string, german_level string, content string, perspectives array<string>"
    rows = [base, {**base, "admission": " Zulassungsfrei ", "duration": "6 Semester"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    columns = {n: F.col(n) for n in df.columns}
    first, second = [r.c for r in df.select(text.programme_card(columns).alias("c")).collect()]
    assert "Bewerbungsfrist: Wintersemester: 15.07.\n" in first and "Regelstudienzeit" not in first and "Studienform" not in first
    assert "Bewerbungsfrist" not in second and "Regelstudienzeit: 6 Semester\n" in second and second.endswith("Perspektiven: a, b")
    maps = [r.m for r in df.select(text.programme_metadata(columns).alias("m")).collect()]
    assert maps[0]["Bewerbungsfrist"] == "Wintersemester: 15.07." and "Bewerbungsfrist" not in maps[1]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.l2_normalize(F.col("a")).alias("u"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[0].c == pytest.approx(0.96)
    assert rows[1].u == [0.0, 0.0] and rows[1].c is None
