"""Substring filters through the bitmaps of three-letter pieces: equal to a plain scan, reading only buckets with candidates."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from handbook_spark.corpus import Corpus
from handbook_spark.operators import substring_index
from tests.test_text_index import scans

TEXTS = ["Straße ins Nichts", "STRASSE", "a%b_c", "Übung Überblick", "abcabcabc", "ab", "", None, "abx bcx", "Ein  Bolzen"]
PATTERNS = ["%stra%", "%ÜBERB%", "%ab%", "%abcab%", "%a%b_c%", "%bc_b%", "%a\\%b%", "%%", "%bolz%", "ein%", "%nichts", "%xyz%", "%abx%bcx%", "%bcx%abx%"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three buckets; a word stands in a few rows of the last one only."""
    rows = spark.range(80_000).select(
        F.col("id"), F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (F.col("id") % len(TEXTS) + 1).cast("int")).alias("a"),
        F.when(F.col("id") % 25_001 == 25_000, F.lit("selten")).alias("b"), F.when(F.col("id") > 79_990, F.lit("ganz hinten")).alias("c"))
    return rows, substring_index.build_index(
        rows, {"text": [F.col("a"), F.col("b")], "end": [F.col("c")]}, ["id"], str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_candidates_hold_every_match(stored, pattern):
    rows, index = stored
    exact = F.col("a").ilike(pattern) | F.col("b").ilike(pattern)
    small = F.col("id") < 400
    assert index.candidates({"text": pattern}).filter(small & exact).orderBy("id").collect() == rows.filter(small & exact).orderBy("id").collect()


def test_pieces_of_patterns():
    assert substring_index.pattern_grams("%Bolt 1%") == ["bol", "lt ", "olt", "t 1"]
    assert substring_index.pattern_grams("ab%cd_ef") == [] and substring_index.pattern_grams("%abc\\%def%") == ["abc", "def"]


def test_only_buckets_with_candidates_are_read(stored):
    _, index = stored
    all_files = sum(s.metrics().apply("numFiles").value() for s in scans(index.rows()))
    found = index.candidates({"text": "%selten%"}).filter(F.col("b").ilike("%selten%"))
    assert sorted(r.id for r in found.collect()) == [25_000, 50_001, 75_002]
    last = index.candidates({"end": "%ganz hinten%"}).filter(F.col("c").ilike("%ganz hinten%"))
    read = [s for s in scans(last) if "_bit#" in s.output().toString()]
    assert len(read) == 1 and "dynamicpruning" in read[0].toString()
    assert last.count() == 9 and 0 < read[0].metrics().apply("numFiles").value() < all_files
    both = index.candidates({"text": "%selten%", "end": "%ganz hinten%"})
    assert both.count() == 0


def test_bitmaps_of_other_pieces_are_not_read(stored):
    plan = stored[1].buckets({"end": "%ganz%"})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*field", plan) and "In(gram, [" in plan


def test_patterns_without_pieces_read_the_same_rows(spark, stored):
    assert stored[1].buckets({"text": "%ab%"}) is None
    assert stored[1].candidates({"text": "%ab%"}).count() == 80_000


def test_empty_table(spark, tmp_path):
    index = substring_index.build_index(spark.createDataFrame([], "id long, a string"), {"text": [F.col("a")]}, ["id"], str(tmp_path / "i"))
    assert index.candidates({"text": "%abc%"}).collect() == index.candidates({"text": "%a%"}).collect() == []


def test_title_search_reads_the_index(spark):
    plan = entry.queries()["b12_filter_title"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [bol,olt])" in plan and "dynamicpruningexpression(_bucket" in plan
    assert "lineitem.parquet" not in plan and "part.parquet" not in plan


def test_bitmaps_are_made_from_batches(spark, tmp_path, monkeypatch):
    """One deflated bitmap per field, piece and bucket, from texts that are cut once; parts of a bucket are united when they are read."""
    texts = [t and t.lower() for t in TEXTS]

    def batch(bucket: int, begin: int, end: int) -> pa.RecordBatch:
        bits = range(begin, end)
        return pa.RecordBatch.from_pydict({
            "_bucket": pa.array([bucket] * len(bits), pa.int64()), "_bit": pa.array(bits, pa.int32()),
            "a": pa.array([texts[b % len(texts)] for b in bits], pa.string()), "b": pa.array([None if b % 3 else "selten" for b in bits], pa.string())})

    batches = [batch(0, 0, 70), batch(0, 70, 71), batch(5, 0, 0), pa.Table.from_batches([batch(5, 0, 3), batch(9, 0, 30)]).combine_chunks().to_batches()[0]]
    want = {(bucket, g, bit) for bucket, n in ((0, 71), (5, 3), (9, 30)) for bit in range(n)
            for t in (texts[bit % len(texts)], None if bit % 3 else "selten") if t for g in (t[i : i + 3] for i in range(len(t) - 2))}
    for held, parts in ((1 << 24, 1), (0, 2)):
        monkeypatch.setattr(substring_index, "HELD_PLACES", held)
        made = pa.Table.from_batches(substring_index.bitmaps(iter(batches), {"text": ["a", "b"]})).to_pylist()
        found = [(r["bucket"], r["gram"], int(bit)) for r in made
                 for bit in np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r["cell"]), np.uint8), bitorder="little"))]
        assert set(found) == want and len(found) == len(want)
        assert max(Counter((r["bucket"], r["gram"]) for r in made).values()) == parts
    whole = list(substring_index.inflated(iter(pa.Table.from_pylist(made).select(["gram", "bucket", "cell"]).to_batches())))
    spark.createDataFrame(pa.Table.from_batches(whole).to_pandas()).write.parquet(str(tmp_path / "bitmaps" / "field=text"))
    index = substring_index.SubstringIndex(spark, str(tmp_path), spark.range(0).schema)
    read = index.buckets({"text": "%selten%"}).select("bucket", F.bitmap_count("bitmap").alias("n"))
    assert sorted(read.collect()) == [(0, 24), (5, 1), (9, 10)]


def test_ranges_hold_one_bucket_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_index, "RANGE_ROWS", 1000)
    rows = spark.range(10_000).select("id", F.concat(F.lit("text "), F.col("id") % 7).alias("a"))
    index = substring_index.build_index(rows, {"text": [F.col("a")]}, ["a", "id"], str(tmp_path / "i"), rows.count())
    assert 8 <= index.rows().select("_bucket").distinct().count() <= 10
    assert index.rows().groupBy("_bucket", "_bit").count().filter("count > 1").count() == 0
    assert sorted(r.id for r in index.candidates({"text": "%T 3%"}).collect()) == [i for i in range(10_000) if i % 7 == 3]


def test_short_matches_make_the_rows_of_the_joined_view(spark, tmp_path):
    """Repeated keys, nulls and ids that two modules share are joined; rows that can only match themselves are not."""
    big = 1 << 31
    pairs = [(p, s) for p in range(40) for s in (1, 2, 5, 6)] + [(3, 1), (1, big + 5), (2, big + 6), (None, 1), (2, None), (50, 9), (51, 1)]
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(p, f"bolt {p % 3}", ["LARGE", "SM", None, "A-B"][p % 4], p % 9) for p in range(52)]
    parts += [(4, "bolt 1", "LARGE", 4), (6, "nut", "LARGE", None), (7, None, "LARGE", 7), (None, "nut", "SMALL", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    handbooks = [(1, "a", 3), (2, None, 4), (5, "c", 5), (5, "d", 6), (6, "e", None), (7, "f", 7), (None, "g", 8), (big + 5, "h", 9)]
    spark.createDataFrame(handbooks, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "pages.parquet"))  # a column of the view has a table's name
    corpus = Corpus(spark, str(tmp_path))
    want = Counter(map(str, corpus.view("v_search_full").collect()))
    modules = corpus.view("v_modules")
    matches = corpus.search_matches(modules)
    assert matches.columns == [*modules.columns, "a", "r", "version"]  # what is shuffled into its order
    joined = matches.filter("a IS NOT NULL")
    assert 0 < joined.count() < matches.count() / 2
    assert {r.pos for r in joined.collect()} <= {1, 2, 3, 4, 6, 7}
    assert Counter(map(str, corpus.search_rows(matches).collect())) == want and len(want) > 50
    index = corpus.search_index()
    assert Counter(map(str, index.candidates({}).collect())) == want
    stored = spark.read.parquet(f"{index.path}/rows")
    assert "raw_content" not in stored.columns and "title" in stored.columns


def test_rows_in_order_are_not_sorted_again_for_their_folders(spark, tmp_path):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    rows = spark.range(70_000).select("id", F.concat(F.lit("text "), F.col("id") % 7).alias("a"))
    short = rows.select("id")
    index = substring_index.build_index(
        short, {"text": [F.col("a")]}, ["id"], str(tmp_path / "i"), 20_000, lambda stored: stored.select(
            "id", F.concat(F.lit("text "), F.col("id") % 7).alias("a"), "_bit", "_bucket"))
    assert spark.conf.get(key) == before
    assert index.rows().select("_bucket").distinct().count() == 3
    assert sorted(r.id for r in index.candidates({"text": "%T 3%"}).collect()) == [i for i in range(70_000) if i % 7 == 3]
    for folder in (tmp_path / "i" / "rows").glob("_bucket=*"):
        ids = [r.id for r in spark.read.parquet(str(folder)).collect()]
        assert ids == sorted(ids)
