"""H: table mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.operators import tables
from handbook_spark.plans.registry import query
from handbook_spark.session import scratch_path
from handbook_spark.sources.keyed_table import KeyedTable


@query("h1_insert_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
UNION ALL SELECT max(o_orderkey) + 1, 7, 'N' FROM orders UNION ALL SELECT max(o_orderkey) + 2, 8, NULL FROM orders""")
def h1(c: Corpus) -> DataFrame:
    table = c.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    after, _ = tables.insert(table, [{"o_custkey": 7, "o_orderstatus": "N"}, {"o_custkey": 8}], "o_orderkey")
    return after


# Stored texts: those of handbooks without a version; incoming: all. Some texts have no content and some no code.
_RAW_TEXTS = """SELECT *, md5(content) AS content_md5 FROM (SELECT id, mhb_id, CASE WHEN id % 29 = 0 THEN NULL ELSE module_code END AS module_code,
  CASE WHEN id % 13 = 0 THEN NULL ELSE content END AS content FROM v_modules_raw)"""
_STORED = f"SELECT r.id, r.module_code, r.content, r.content_md5 FROM ({_RAW_TEXTS}) r JOIN v_mhbs h ON h.id = r.mhb_id WHERE h.version IS NULL"
_INCOMING = f"SELECT id, mhb_id, module_code, content, content_md5 FROM ({_RAW_TEXTS})"


def _first_stored(c: Corpus) -> DataFrame:
    return tables.first_per_key(c.sql(_STORED), ["module_code", "content_md5"], [F.col("id")])


_FIRST_STORED = f"SELECT module_code, content_md5, min(id) AS id FROM ({_STORED}) GROUP BY module_code, content_md5"


@query("h2_insert_on_conflict_skip", f"""
WITH stored AS ({_FIRST_STORED}), incoming AS (SELECT module_code, content_md5, min(id) AS id FROM ({_INCOMING}) GROUP BY module_code, content_md5)
SELECT * FROM stored UNION ALL SELECT i.* FROM incoming i WHERE NOT EXISTS
  (SELECT 1 FROM stored s WHERE s.module_code IS NOT DISTINCT FROM i.module_code AND s.content_md5 IS NOT DISTINCT FROM i.content_md5)""")
def h2(c: Corpus) -> DataFrame:
    columns = ["module_code", "content_md5", "id"]
    return tables.insert_or_skip(
        _first_stored(c).select(columns), c.sql(_INCOMING).select(columns), ["module_code", "content_md5"], [F.col("id")]
    )


@query("h3_update_where", """
SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal,
       CASE WHEN s_nationkey = 3 THEN 'geschlossen' ELSE s_name END AS s_name FROM supplier""")
def h3(c: Corpus) -> DataFrame:
    after, _ = tables.update(c.table("supplier"), {"s_acctbal": 0.0, "s_name": "geschlossen"}, {"s_nationkey": 3})
    return after.select("s_suppkey", "s_acctbal", "s_name")


@query("h3_updated_rows", """
SELECT s_suppkey, round(s_acctbal * 2, 6) AS s_acctbal FROM supplier WHERE s_acctbal < 1000 AND s_nationkey <> 3""")
def h3_changed(c: Corpus) -> DataFrame:
    _, changed = tables.update(
        c.table("supplier"), {"s_acctbal": F.col("s_acctbal") * 2}, "s_acctbal < 1000 AND s_nationkey <> 3"
    )
    return changed.select("s_suppkey", F.round("s_acctbal", 6).alias("s_acctbal"))


_CHANGES = "SELECT l_suppkey AS s_suppkey, max(l_extendedprice) AS s_acctbal FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50 GROUP BY l_suppkey HAVING max(l_tax) > 0.05"


@query("h4_update_from_values", f"""
SELECT s.s_suppkey, s.s_name, coalesce(n.s_acctbal, s.s_acctbal) AS s_acctbal FROM supplier s LEFT JOIN ({_CHANGES}) n ON n.s_suppkey = s.s_suppkey""")
def h4(c: Corpus) -> DataFrame:
    return tables.update_from(c.table("supplier"), c.sql(_CHANGES), "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


def _stored_table(c: Corpus, rows: DataFrame, key: list[str]) -> KeyedTable:
    table = KeyedTable(c.spark, scratch_path(c.spark), rows.schema, key, buckets=16)
    table.insert_new(1, rows, [F.col(k) for k in key])
    return table


@query("h3_written_update", """
SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal,
       CASE WHEN s_nationkey = 3 THEN 'geschlossen' ELSE s_name END AS s_name FROM supplier""")
def h3_written(c: Corpus) -> DataFrame:
    """The stored table after the update; only buckets that hold an updated row are written anew."""
    table = _stored_table(c, c.table("supplier"), ["s_suppkey"])
    table.update(2, {"s_acctbal": 0.0, "s_name": "geschlossen"}, {"s_nationkey": 3})
    return table.read().select("s_suppkey", "s_acctbal", "s_name")


@query("h4_written_values", f"""
SELECT s.s_suppkey, s.s_name, coalesce(n.s_acctbal, s.s_acctbal) AS s_acctbal FROM supplier s LEFT JOIN ({_CHANGES}) n ON n.s_suppkey = s.s_suppkey""")
def h4_written(c: Corpus) -> DataFrame:
    table = _stored_table(c, c.table("supplier"), ["s_suppkey"])
    table.update_from(2, c.sql(_CHANGES))
    return table.read().select("s_suppkey", "s_name", "s_acctbal")


@query("h5_written_delete", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')""")
def h5_written(c: Corpus) -> DataFrame:
    """The stored table after the delete and a repeated run of it."""
    orders = c.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    table = _stored_table(c, orders, ["o_orderkey"])
    for _ in range(2):
        table.delete(2, {"o_orderstatus": "F", "o_orderpriority": "5-LOW"})
    return table.read().select("o_orderkey", "o_custkey")


@query("h5_delete_where", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'removed' ELSE 'kept' END AS outcome FROM orders""")
def h5(c: Corpus) -> DataFrame:
    goes = tables.to_delete({"o_orderstatus": "F", "o_orderpriority": "5-LOW"})
    return c.table("orders").select("o_orderkey", F.when(goes, F.lit("removed")).otherwise(F.lit("kept")).alias("outcome"))


# Universities and facts of two sources; the city of some is not known.
_DIMENSION = """SELECT min(id) AS id, name, city, source FROM (
  SELECT id, name, CASE WHEN id % 5 = 0 THEN NULL ELSE city END AS city, CASE WHEN id % 2 = 0 THEN 'listing' ELSE 'registry' END AS source FROM v_unis_db)
GROUP BY name, city, source"""
_FACTS = """SELECT c.c_custkey, n.n_name AS name, CASE WHEN c.c_custkey % 7 = 0 THEN NULL
  ELSE 'City ' || CAST(c.c_nationkey AS STRING) || CASE WHEN c.c_mktsegment = 'BUILDING' THEN ', City X' ELSE '' END END AS city,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE 'listing' END AS source
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""
_KEY = ["name", "city", "source"]


def _same(left: str, right: str, key: list[str]) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in key)


_CREATED = f"""
dimension AS ({_DIMENSION}), facts AS ({_FACTS}),
fresh AS (SELECT DISTINCT name, city, source FROM facts f WHERE NOT EXISTS (SELECT 1 FROM dimension d WHERE {_same('d', 'f', _KEY)})),
full_dimension AS (SELECT id, name, city, source FROM dimension UNION ALL SELECT (SELECT max(id) FROM dimension)
  + row_number() OVER (ORDER BY name NULLS FIRST, city NULLS FIRST, source NULLS FIRST), name, city, source FROM fresh)"""


@query("h6_get_or_create_dimension", f"WITH {_CREATED.strip()} SELECT id, name, city, source FROM full_dimension")
def h6_dimension(c: Corpus) -> DataFrame:
    return tables.get_or_create(c.sql(_DIMENSION), c.sql(_FACTS), _KEY)[0]


@query("h6_linked_facts", f"""
WITH {_CREATED.strip()} SELECT f.c_custkey, d.id AS dimension_id FROM facts f JOIN full_dimension d ON {_same('d', 'f', _KEY)}""")
def h6_facts(c: Corpus) -> DataFrame:
    return tables.get_or_create(c.sql(_DIMENSION), c.sql(_FACTS), _KEY)[1]


@query("h6_second_run", f"WITH {_CREATED.strip()} SELECT id, name, city, source FROM full_dimension")
def h6_second(c: Corpus) -> DataFrame:
    """The facts once more, on the dimension that the first run left: no row is added."""
    facts = c.sql(_FACTS)
    return tables.get_or_create(tables.get_or_create(c.sql(_DIMENSION), facts, _KEY)[0], facts, _KEY)[0]


_RAW = f"""
stored AS ({_FIRST_STORED}), incoming AS ({_INCOMING}),
fresh AS (SELECT DISTINCT module_code, content_md5 FROM incoming i WHERE NOT EXISTS
  (SELECT 1 FROM stored s WHERE {_same('s', 'i', ['module_code', 'content_md5'])})),
full_raw AS (SELECT id, module_code, content_md5 FROM stored UNION ALL
  SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY module_code NULLS FIRST, content_md5 NULLS FIRST), module_code, content_md5 FROM fresh)"""


def _stored_raw(c: Corpus) -> tuple[DataFrame, DataFrame]:
    relation = c.sql("SELECT s_suppkey AS mhb_id, s_suppkey AS modules_raw_id FROM supplier")
    return tables.store_raw_modules(
        _first_stored(c), relation, c.sql(_INCOMING).select("mhb_id", "module_code", "content")
    )


@query("h7_stored_texts", f"WITH {_RAW.strip()} SELECT id, module_code, content_md5 FROM full_raw")
def h7_texts(c: Corpus) -> DataFrame:
    return _stored_raw(c)[0].select("id", "module_code", "content_md5")


@query("h7_handbook_relation", f"""
WITH {_RAW.strip()} SELECT s_suppkey AS mhb_id, s_suppkey AS modules_raw_id FROM supplier
UNION SELECT i.mhb_id, r.id FROM incoming i JOIN full_raw r ON {_same('r', 'i', ['module_code', 'content_md5'])}""")
def h7_relation(c: Corpus) -> DataFrame:
    return _stored_raw(c)[1]


@query("h8_content_hash", "SELECT doc_id, md5(text) AS content_md5 FROM documents")
def h8(c: Corpus) -> DataFrame:
    return tables.with_content_hash(c.table("documents"), "text").select("doc_id", "content_md5")
