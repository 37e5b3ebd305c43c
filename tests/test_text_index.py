"""Keyword ranking from the stored index: equal to scores of all texts, and reading no more than the query's words."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from handbook_spark.operators import retrieval, text_index


def corpus(rng: random.Random, number: int) -> list[tuple]:
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i * 37, " ".join(rng.choices(vocabulary, [1 / (1 + n) for n in range(60)], k=rng.randint(0, 25)))) for i in range(number)]
    return rows + [(10**12, "selten w0 w1"), (10**12 + 1, None), (10**12 + 2, "  "), (-5, "w3 w3 w3 selten")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = corpus(random.Random(2), 1500)
    texts = spark.createDataFrame(rows, "id long, t string").repartition(4).persist()
    return texts, text_index.build_index(texts, "id", "t", str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("query, k", [("w0", 1), ("w5 w17", 7), ("selten", 7), ("w0 w0 w59 selten fehlt", 2000), ("w1 w2 w3 w4 w5 w6", 3), ("fehlt", 7), ("", 7)])
def test_top_k_equals_scores_of_all_texts(spark, stored, query, k):
    texts, index = stored
    texts = texts.na.fill("", ["t"])  # the index takes a null text as an empty one
    rows = retrieval.bm25(texts, "id", "t", query).withColumn("score", F.round("score", 9)).collect() if query.split() else [
        r for r in texts.select("id", F.lit(0.0).alias("score")).collect()]
    want = sorted(((r.id, r.score) for r in rows), key=lambda r: (-r[1], r[0]))[:k]
    found = [(r.id, r.score) for r in index.top_k(query, k).collect()]
    assert [r[0] for r in found] == [r[0] for r in want]
    assert [r[1] for r in found] == pytest.approx([r[1] for r in want], abs=1e-8)


def scans(frame) -> list:
    """Scan nodes of a plan that has run."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, found = plan.collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getSimpleName() else leaf
        inner = leaf.collectLeaves()
        found += [x for x in (inner.apply(j) for j in range(inner.size())) if "FileSourceScan" in x.getClass().getSimpleName()]
    return found


def test_a_query_reads_the_postings_of_its_words_only(spark, stored):
    _, index = stored
    whole = sum(s.metrics().apply("filesSize").value() for s in scans(spark.read.parquet(f"{index.path}/postings")))
    read = scans(index.postings(["w40", "selten"]))
    assert len(read) == 1 and read[0].metrics().apply("filesSize").value() < whole / 8
    text = read[0].toString() + str(read[0].metadata())
    assert "In(term, [" in text and re.search(r"bucket#\d+ IN", text)
    plan = index.top_k("w40 selten", 3)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Location: \w+ ?(?:\(\d+ paths\))?\[file:[^\]]*?/(\w+)\]", plan)) == {"postings"}


def test_heads_of_postings_are_read_without_the_arrays(spark, stored):
    plan = stored[1].bounds("w1 w2")._jdf.queryExecution().executedPlan().toString()
    assert all("tf" not in schema and "length" not in schema for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan))


def test_blocks_below_the_bound_are_left_out(spark, tmp_path, monkeypatch):
    rows = [(i, "gut gut gut gut" if i < 5 else "gut " + "lang " * 50) for i in range(40_000)]
    texts = spark.createDataFrame(rows + [(10**7 + i, "anders") for i in range(60_000)], "id long, t string").repartition(4)
    index = text_index.build_index(texts, "id", "t", str(tmp_path / "index"))
    scored, score = [], text_index.TextIndex._scores
    monkeypatch.setattr(text_index.TextIndex, "_scores", lambda self, p, w: scored.append(p.select("block").distinct().count()) or score(self, p, w))
    assert [r.id for r in index.top_k("gut", 3).collect()] == [0, 1, 2]
    assert scored == [3, 1]  # of ten blocks, three are tried and one is left


def test_rows_of_a_common_word_are_bounded(spark, tmp_path):
    texts = spark.range(20_000).select("id", F.lit("alle").alias("t"))
    index = text_index.build_index(texts, "id", "t", str(tmp_path / "index"))
    rows = index.postings(["alle"]).select("block", "n", F.size("at").alias("size")).collect()
    assert len(rows) == 5 and all(r.n == r.size <= text_index.BLOCK_DOCS for r in rows)


def test_empty_table(spark, tmp_path):
    texts = spark.createDataFrame([], "id long, t string")
    assert text_index.build_index(texts, "id", "t", str(tmp_path / "index")).top_k("x", 3).collect() == []


def test_parts_of_postings_are_merged_over_batches():
    """Entries of one term and block come together whatever batches they lie in; a document that comes twice is one entry."""
    texts = [(0, 1, "a b a"), (0, 0, "a"), (1, 5, "b b"), (0, 1, "c a b"), (0, 1, "a b a"), (0, 2, None), (0, 3, "")]
    lists = [pa.RecordBatch.from_pydict({
        "block": pa.array([t[0] for t in part], pa.int64()), "at": pa.array([t[1] for t in part], pa.int32()),
        "tokens": pa.array([t[2] and t[2].split() for t in part], pa.list_(pa.string()))}) for part in (texts[:3], texts[3:5], texts[5:])]
    lists[2] = lists[2].set_column(2, "tokens", pa.array([None, []], pa.list_(pa.string())))
    parts = pa.Table.from_batches(text_index.counted(iter(lists)))
    assert sum(parts["words"].to_pylist()) == 12
    parts = parts.append_column("bucket", pa.array([3] * len(parts), pa.int32())).sort_by([("term", "ascending"), ("block", "ascending")])
    for size in (1, 2, 100):
        rows = pa.Table.from_batches(text_index.merged(iter(parts.combine_chunks().to_batches(max_chunksize=size)), 2.5)).to_pylist()
        assert [(r["term"], r["block"], r["n"], r["at"], r["tf"], r["length"]) for r in rows] == [
            ("a", 0, 2, [0, 1], [1, 5], [1, 3]), ("b", 0, 1, [1], [3], [3]), ("b", 1, 1, [5], [2], [2]), ("c", 0, 1, [1], [1], [3])]
        assert rows[2]["most"] == pytest.approx(2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / 2.5)))
