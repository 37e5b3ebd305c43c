"""Sequence operators against plain Python on small data, hot keys included."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from handbook_spark.functions.text import token_count
from handbook_spark.operators import numbering, packing, pages, sequences
from handbook_spark.sources.page_streams import scan_pages


def test_run_numbers_across_blocks(spark):
    rng = random.Random(1)
    values = {h: [rng.choice("ab") if rng.random() < 0.3 else "c" for _ in range(n)] for h, n in ((1, 300), (2, 1), (3, 17))}
    rows = [(h, i, v) for h, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "h int, i int, v string")
    got = {(r.h, r.i): r.run for r in numbering.run_numbers(df, ["h"], ["i"], "v", block=8).collect()}
    for h, vs in values.items():
        run = 0
        for _, group in itertools.groupby(enumerate(vs), key=lambda p: p[1]):
            run += 1
            assert all(got[h, i] == run for i, _ in group)


def test_run_numbers_with_nulls_and_gaps(spark):
    rows = [(1, 0, None), (1, 9, None), (1, 20, "x"), (1, 21, None), (1, 400, None)]
    df = spark.createDataFrame(rows, "h int, i int, v string")
    got = [r.run for r in numbering.run_numbers(df, ["h"], ["i"], "v", block=8).orderBy("i").collect()]
    assert got == [1, 1, 2, 3, 3]


def test_running_sum_across_blocks(spark):
    rows = [(h, i, i % 3) for h in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "h int, i int, v int")
    got = {(r.h, r.i): r.s for r in numbering.running_sum(df, ["h"], ["i"], F.col("v"), "s", block=7).collect()}
    assert all(got[h, i] == sum(k % 3 for k in range(i + 1)) for h in (1, 2) for i in range(100))


def test_number_rows(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = [(r.k, r.v, r.n) for r in numbering.number_rows(df, ["k", "v"], "n").collect()]
    assert sorted(got, key=lambda r: r[2]) == [(*r, n) for n, r in enumerate(sorted(rows), start=1)]
    per_key = numbering.number_rows_per_key(df, ["k"], ["v"], "n").collect()
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        wanted = [(v, n) for n, (_, v) in enumerate(group, start=1)]
        assert sorted((r.v, r.n) for r in per_key if r.k == key) == wanted


def test_number_rows_of_nothing(spark):
    assert numbering.number_rows(spark.createDataFrame([], "k string"), ["k"], "n").count() == 0


def test_page_ranges(spark):
    pages = [3, 5, 4, 9, 4, 4095, 4096, 4097, 8192]
    df = spark.createDataFrame([(1, p) for p in pages] + [(2, 7), (2, None)], "m int, p int")
    got = {r.m: r.pages for r in sequences.page_ranges(df, ["m"], "p").collect()}
    assert got == {1: "3 - 5, 9, 4095 - 4097, 8192", 2: "7"}


def test_module_texts(spark):
    pages = [
        (1, 0, "A-100", "Modul A-100\neins\nFuß\n1"), (1, 1, "A-100", "Modul A-100\nzwei\ndrei\nFuß\n2"),
        (1, 2, "B-200", "Modul B-200\nx\nFuß\n3"), (1, 5, "A-100", "Modul A-100\nwieder\nFuß\n4"), (1, 6, "C-1", "Modul C-1"),
    ]
    df = spark.createDataFrame(pages, "handbook_id int, page_no int, header string, text string")
    for block in (1, 2, 4096):
        got = [(r.first_page, r.module_code, r.content) for r in sequences.module_texts(df, block).orderBy("first_page").collect()]
        assert got == [
            (0, "A-100", "Modul A-100eins\nzwei\ndrei"), (2, "B-200", "Modul B-200x"), (5, "A-100", "Modul A-100wieder"),
            (6, "C-1", "Modul C-1"),
        ]


def test_segments_and_contents(spark):
    marker = "\n| Modul"
    texts = ["Deckblatt", "Inhalt", "noch Inhalt", f"{marker} 1 |\n", " weiter ", f"  {marker} 2 |", "   "]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "handbook_id int, page_no int, text string")
    regions = [r.region for r in sequences.table_of_contents(df, marker).orderBy("page_no").collect()]
    assert regions == ["cover", "toc", "toc", "body", "body", "body", "body"]
    for block in (1, 3, 4096):
        segments = sequences.segment_modules(df, marker, block).orderBy("first_page").collect()
        assert [(r.first_page, r.n_pages, r.content) for r in segments] == [
            (0, 3, "Deckblatt\n\nInhalt\n\nnoch Inhalt"), (3, 2, "| Modul 1 |\n\nweiter"), (5, 2, "| Modul 2 |\n\n"),
        ]


def test_toc_lines_join_across_pages(spark):
    def page(*fragments):
        return "Inhaltsverzeichnis\n" + "\n".join(f"1 0 0 -1 {x} {y} Tm [({t})] TJ" for x, y, t in fragments)

    rows = [
        (1, 0, page((1, 10, "GEO-100: a"), (2, 10, "GEO-999"), (3, 20, "."), (1, 30, "x"), (2, 30.5, "MA-0042"))),
        # The first line has the height of the last line of the page before, so it is the same line.
        (1, 1, page((1, 30.5, "ABC-123"), (1, 40, "GEO-100"), (1, 50, "ÄÖ-777"))),
        (1, 2, "1 0 0 -1 1 10 Tm [(NOT-100)] TJ"),
    ]
    df = spark.createDataFrame(rows, "handbook_id int, page_no int, stream string")
    got = [r.module_code for r in pages.toc_codes(scan_pages(df)).orderBy("page_no", "place").collect()]
    assert got == ["GEO-100", "MA-0042", "ÄÖ-777"]


def test_sections_join_pages_and_drop_copies(spark):
    def page(body, n):
        return (
            "1 0 0 -1 40 20 Tm [(Modul GEO-100)] TJ\n1 0 0 -1 40 60 Tm [(Inhalte:)] TJ\n" + body + f"\nET\nQ\n1 0 0 -1 5 8 Tm [({n})] TJ\nET\nQ\n"
        )

    first = "1 0 0 -1 60 70 Tm [(Erster)] TJ\n1 0 0 -1 90 70 Tm [(Satz)] TJ\n/F1 9 Tf\n1 0 0 -1 60 80 Tm [(Zweiter)] TJ"
    rows = [(1, 0, page(first, 3)), (1, 1, page(first, 4)), (1, 2, page("1 0 0 -1 60 70 Tm [(Neu)] TJ", 5)), (1, 3, "leer")]
    df = spark.createDataFrame(rows, "handbook_id int, page_no int, stream string")
    got = pages.module_sections(scan_pages(df), "Inhalte:").collect()
    assert [(r.module_code, r.text) for r in got] == [("GEO-100", "Erster Satz\nZweiter\nNeu")]
    printed = pages.module_pages(scan_pages(df)).orderBy("page_no").collect()
    assert [(r.module_code, r.printed_page) for r in printed] == [("GEO-100", 3), ("GEO-100", 4), ("GEO-100", 5)]


def test_packing_matches_a_plain_loop(spark):
    rng = random.Random(7)
    docs = [(d, [" ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 3, 9, 30]))) for _ in range(rng.randint(0, 25))]) for d in range(40)]
    df = spark.createDataFrame(docs, "d int, items array<string>")
    sizes = {r.d: r.s for r in df.select("d", F.transform("items", token_count).alias("s")).collect()}
    got = sequences.pack_modules(df, "d", F.col("items"), 20).collect()
    for d, items in docs:
        chunks, current, filled = [], [], 0
        for size in sizes[d]:
            if filled + size < 20:
                current.append(size)
                filled += size
            else:
                chunks.append(current)
                current, filled = [size], size
        chunks = [c for c in [*chunks, current] if c]
        mine = sorted((r.chunk_no, r.n_modules, r.n_tokens) for r in got if r.d == d)
        assert mine == [(i, len(c), sum(c)) for i, c in enumerate(chunks)]


def test_rows_pack_like_the_items_of_a_document(spark):
    rng = random.Random(12)
    documents = [(d, [" ".join(["w"] * rng.randint(1, 30)) for _ in range(n)]) for d, n in ((1, 1), (2, 9000), (3, 40))]
    items = spark.createDataFrame(documents, "d int, items array<string>")
    rows = spark.createDataFrame([(d, i, t) for d, texts in documents for i, t in enumerate(texts)], "d int, pos int, t string").repartition(7)
    fields = ("d", "chunk_no", "n_modules", "n_tokens", "text")
    want = sorted(tuple(r[f] for f in fields) for r in sequences.pack_modules(items, "d", F.col("items"), 50).collect())
    assert sorted(tuple(r[f] for f in fields) for r in packing.pack_rows(rows, "d", "pos", "t", 50).collect()) == want


def test_long_modules_come_in_pieces(spark):
    pages = [(1, i, "A", f"Modul A\nz{i}\nStand\n{i}") for i in range(100)]
    df = spark.createDataFrame(pages, "handbook_id int, page_no int, header string, text string").repartition(5)
    pieces = sequences.module_text_pieces(df, block=8).orderBy("first_page").collect()
    assert {r.run for r in pieces} == {1} and max(len(r.body.split("\n")) for r in pieces) <= 8
    assert "\n".join(r.body for r in pieces) == "\n".join(f"z{i}" for i in range(100))
    segments = sequences.segment_pieces(df, "|", block=8).collect()
    assert max(r.n_pages for r in segments) <= 8 and sum(r.n_pages for r in segments) == 100 and {r.segment for r in segments} == {0}
