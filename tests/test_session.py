from __future__ import annotations

import os

from handbook_spark.corpus import Corpus
from handbook_spark.operators.numbering import number_rows
from handbook_spark.session import materialize, scratch_path, scratch_scope


def folders(spark) -> set[str]:
    base = os.path.dirname(scratch_path(spark)).removeprefix("file:")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_scratch_folders_go_with_their_scope(spark):
    before = folders(spark)
    with scratch_scope(spark):
        rows = number_rows(materialize(spark.range(100)), ["id"], "n")
        assert rows.filter("n = id + 1").count() == 100
        assert len(folders(spark) - before) == 2
    assert folders(spark) == before


def test_stored_modules_follow_their_tables(spark, tmp_path):
    source = Corpus(spark, "/root/testdata/sf0.001")
    for name, most in (("lineitem", 50), ("lineitem", 500), ("part", None)):
        table = source.table(name)
        (table.limit(most) if most else table).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        if name == "lineitem" and most == 50:
            source.table("part").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
            few = Corpus(spark, str(tmp_path)).view("v_modules").count()
    assert few < Corpus(spark, str(tmp_path)).view("v_modules").count()


def test_long_keys_stay_apart(spark, tmp_path):
    """Part keys beyond a million and supplier keys beyond a hundred thousand keep codes and ids unique."""
    keys = [(p, s) for p in (1, 123456, 1234561, 1234567, 1234569) for s in (5, 100005, 200005)]
    spark.createDataFrame(keys, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "STANDARD", "x", 1) for p in {p for p, _ in keys}], "p_partkey long, p_type string, p_name string, p_size int").write.parquet(
        f"{tmp_path}/part.parquet")
    rows = Corpus(spark, str(tmp_path)).view("v_modules").collect()
    assert len({r.id for r in rows}) == len(rows) == len(keys)
    assert len({r.module_code for r in rows}) == 5 and {r.module_code for r in rows} >= {"STA-000001", "STA-1234567"}
