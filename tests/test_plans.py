"""Properties of the physical plans that decide how the queries scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name, most", [
    ("b13_work_queue", 1), ("h5_delete_where", 1), ("i44_module_record", 1), ("c6_handbook_overlap", 2), ("e8_module_sections", 1),
])
def test_tables_are_scanned_at_most(spark, name, most):
    assert plan(spark, name).split("== Initial Plan ==")[0].count("FileScan parquet") <= most


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[0] in "eij" and "sql" not in n])
def test_texts_are_not_dealt_out_to_spread_them(spark, name):
    assert "REPARTITION_BY_NUM" not in plan(spark, name)


@pytest.mark.parametrize("name", ["e1_best_version", "h2_insert_on_conflict_skip", "c9_preferred_match"])
def test_first_per_key_prunes_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit .*Final.*WindowGroupLimit .*Partial", text, re.DOTALL)


@pytest.mark.parametrize("name, columns", [
    ("a1_table_scan", {"l_orderkey", "l_linenumber", "l_quantity"}),
    ("d1_row_count", set()),
    ("i37_token_count", {"doc_id", "text"}),
    ("d5_distinct_pairs", {"c_nationkey", "c_mktsegment"}),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*?)>\n?", plan(spark, name))
    assert read and all({part.split(":")[0] for part in schema.split(",") if part} == columns for schema in read)


@pytest.mark.parametrize("name, pushed", [
    ("b2_equality_conditions", "EqualTo(o_orderstatus,F)"), ("b4_where_with_variables", "GreaterThan(o_totalprice,250000.0)"),
    ("b3_negated_conditions", "Not(EqualT"), ("b5_parameterised_sql", "GreaterThanOrEqual(s_acctbal,500.0)"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


@pytest.mark.parametrize("name", ["f3_limit_after_dedup", "f4_cosine_top_k", "f5_bm25_top_k", "d9_smallest_handbook", "b6_row_of_maximum"])
def test_top_k_is_taken_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)
