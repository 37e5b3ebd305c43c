"""A stored table under repeated, cut-off and small batches, and null-safe keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F, types as T

from handbook_spark.operators import tables
from handbook_spark.sources.keyed_table import KeyedTable

SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("city", T.StringType()), T.StructField("n", T.IntegerType())])
KEY = ["name", "city"]
FIRST = [("A", "X", 1), ("B", None, 2), (None, "Y", 3), (None, None, 4)] + [(f"u{i}", None if i % 3 else "Z", i) for i in range(60)]


class Cut(Exception):
    """Raised half-way through a write."""


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def new_table(spark, path) -> KeyedTable:
    table = KeyedTable(spark, str(path), SCHEMA, KEY, buckets=8)
    assert table.insert_new(1, frame(spark, FIRST), [F.col("n")])
    return table


def state(table) -> list[tuple]:
    return sorted((tuple(r) for r in table.read().collect()), key=str)


CHANGES = {
    "insert": lambda t, b: t.insert_new(b, frame(t.spark, [("B", None, 9), ("C", "X", 5), ("C", "X", 6), (None, None, 7), ("D", None, 8)]
                                              + [(f"v{i}", "Z", i) for i in range(40)]), [F.col("n")]),
    "update": lambda t, b: t.update(b, {"n": F.col("n") + 100}, "n % 2 = 0"),
    "update_from": lambda t, b: t.update_from(b, frame(t.spark, [(None, "Y", 33), ("u3", "Z", None), ("missing", "Z", 1)] + [
        (f"u{i}", "Z", -i) for i in range(6, 60, 3)])),
    "delete": lambda t, b: t.delete(b, "n > 30 OR name IS NULL"),
}


def plainly(kind: str) -> list[tuple]:
    rows = {r[:2]: r[2] for r in FIRST}
    if kind == "insert":
        for name, city, n in [("B", None, 9), ("C", "X", 5), ("C", "X", 6), (None, None, 7), ("D", None, 8)] + [(f"v{i}", "Z", i) for i in range(40)]:
            rows.setdefault((name, city), n)
    elif kind == "update":
        rows = {k: n + 100 if n % 2 == 0 else n for k, n in rows.items()}
    elif kind == "update_from":
        rows |= {(None, "Y"): 33, ("u3", "Z"): None} | {(f"u{i}", "Z"): -i for i in range(6, 60, 3)}
    else:
        rows = {k: n for k, n in rows.items() if not (n > 30 or k[0] is None)}
    return sorted(((*k, n) for k, n in rows.items()), key=str)


@pytest.mark.parametrize("kind", CHANGES)
def test_a_repeated_batch_changes_nothing(spark, tmp_path, kind):
    table = new_table(spark, tmp_path / "t")
    assert CHANGES[kind](table, 2) and state(table) == plainly(kind)
    assert not CHANGES[kind](table, 2) and state(table) == plainly(kind)


@pytest.mark.parametrize("kind", CHANGES)
def test_a_batch_that_was_cut_off_is_invisible_and_starts_afresh(spark, tmp_path, kind, monkeypatch):
    table = new_table(spark, tmp_path / "t")
    before, write = state(table), KeyedTable._write

    def half(self, rows, batch, bases=None):
        write(self, rows.filter("bucket % 2 = 0"), batch, bases)
        raise Cut

    monkeypatch.setattr(KeyedTable, "_write", half)
    with pytest.raises(Cut):
        CHANGES[kind](table, 2)
    monkeypatch.undo()
    again = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, KEY, buckets=8)
    assert state(again) == before
    with pytest.raises(ValueError, match="not finished"):
        again.delete(3, "n = 1")
    assert CHANGES[kind](again, 2) and state(again) == plainly(kind)


def test_a_cut_between_mark_and_cleaning_is_harmless(spark, tmp_path, monkeypatch):
    table = new_table(spark, tmp_path / "t")
    monkeypatch.setattr(KeyedTable, "_clean", lambda self: (_ for _ in ()).throw(Cut()))
    with pytest.raises(Cut):
        CHANGES["update"](table, 2)
    monkeypatch.undo()
    assert state(table) == plainly("update")
    assert not CHANGES["update"](table, 2)
    assert table.delete(3, "n = 1") and ("A", "X", 1) not in state(table)
    bases = {}
    for bucket, base, _ in table._folders():
        bases.setdefault(bucket, set()).add(base)
    assert all(len(b) == 1 for b in bases.values())


def test_a_change_of_one_key_writes_one_bucket(spark, tmp_path):
    table = new_table(spark, tmp_path / "t")

    def files() -> set[str]:
        return {str(p) for p in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    table.update(2, {"n": 0}, {"name": "A"})
    gone, made = before - files(), files() - before
    assert len({f.split("bucket=")[1].split("/")[0] for f in gone | made}) == 1
    before = files()
    table.insert_new(3, frame(spark, [("new", None, 1)]), [F.col("n")])
    assert before < files() and len(files() - before) == 1  # nothing is rewritten
    table.update_from(4, frame(spark, [("A", "X", 5)]))
    assert [tuple(r) for r in table.read_keys(frame(spark, [("A", "X", 0), ("new", None, 0), ("none", None, 0)])).orderBy("name").collect()] == [
        ("A", "X", 5), ("new", None, 1)]


def test_emptied_buckets_and_compacting(spark, tmp_path):
    table = new_table(spark, tmp_path / "t")
    assert table.delete(2, "true") and state(table) == []
    assert table.insert_new(3, frame(spark, FIRST[:3]), [F.col("n")]) and table.insert_new(4, frame(spark, FIRST[:20]), [F.col("n")])
    assert state(table) == sorted(FIRST[:20], key=str)
    assert table.compact(5) and state(table) == sorted(FIRST[:20], key=str)
    assert len({f[0] for f in table._live()}) == len(table._live())
    assert table.delete(6, "n IS NULL") and table.insert_new(7, frame(spark, []), [F.col("n")])
    assert state(table) == sorted(FIRST[:20], key=str)


def test_what_a_table_refuses(spark, tmp_path):
    table = new_table(spark, tmp_path / "t")
    with pytest.raises(ValueError, match="after 0"):
        table.delete(0, "true")
    with pytest.raises(ValueError, match="key"):
        table.update(2, {"city": "x"}, "true")
    with pytest.raises(ValueError, match="8 buckets"):
        KeyedTable(spark, str(tmp_path / "t"), SCHEMA, KEY, buckets=4)


def test_random_batches_equal_a_dictionary(spark, tmp_path):
    rng, rows = random.Random(4), {}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, KEY, buckets=5)
    for batch in range(1, 9):
        given = {(rng.choice("abcdefgh"), rng.choice(["x", None])): rng.randint(0, 9) for _ in range(6)}
        values = frame(spark, [(*k, n) for k, n in given.items()])
        kind = rng.choice(["insert", "from", "delete"])
        if kind == "insert":
            table.insert_new(batch, values, [F.col("n")])
            rows = given | rows
        elif kind == "from":
            table.update_from(batch, values)
            rows = {k: given.get(k, n) for k, n in rows.items()}
        else:
            table.delete(batch, {"n": batch})
            rows = {k: n for k, n in rows.items() if n != batch}
        assert state(table) == sorted(((*k, n) for k, n in rows.items()), key=str)


def test_get_or_create_with_null_keys(spark):
    dimension = spark.createDataFrame([(3, "A", "X")], "id long, name string, city string")
    facts = spark.createDataFrame([(1, "A", "X"), (2, "B", None), (3, "C", "Y"), (4, "B", None), (5, None, None)], "fid int, name string, city string")
    full, linked = tables.get_or_create(dimension, facts, KEY)
    assert sorted((tuple(r) for r in full.collect()), key=str) == [(3, "A", "X"), (4, None, None), (5, "B", None), (6, "C", "Y")]
    assert sorted(tuple(r) for r in linked.select("fid", "dimension_id").collect()) == [(1, 3), (2, 5), (3, 6), (4, 5), (5, 4)]
    again, linked_again = tables.get_or_create(full, facts, KEY)
    assert again.count() == 4 and sorted(map(tuple, linked_again.collect())) == sorted(map(tuple, linked.collect()))
    twice = dimension.union(spark.createDataFrame([(7, "A", "X")], dimension.schema))
    assert {(r.fid, r.dimension_id) for r in tables.get_or_create(twice, facts.filter("fid = 1"), KEY)[1].collect()} == {(1, 3)}


def test_raw_texts_without_content_are_stored_once(spark):
    stored = spark.createDataFrame([], "id long, module_code string, content string, content_md5 string")
    relation = spark.createDataFrame([], "mhb_id long, modules_raw_id long")
    rows = spark.createDataFrame([(1, "A", None), (2, "A", None), (1, None, "x"), (None, "A", "x")], "mhb_id long, module_code string, content string")
    texts, links = tables.store_raw_modules(stored, relation, rows)
    texts2, links2 = tables.store_raw_modules(texts.select(*stored.columns), links, rows)
    assert texts.count() == texts2.count() == 3
    assert links.count() == links2.count() == 4
