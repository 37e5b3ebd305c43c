"""Table mutations as transforms from one table state to the next.

Keys are compared null-safe: a NULL in a key column is a value like any other, equal to itself, so a repeated write finds its rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from handbook_spark.operators.filters import equals_all
from handbook_spark.operators.numbering import first_per_key, number_rows


def next_id(table: DataFrame, column: str) -> Column:
    """First free id of a table, as a scalar subquery."""
    return table.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next")).scalar()


def insert(
    table: DataFrame, values: Sequence[Mapping[str, Any]] | Sequence[Sequence[Any]], id_column: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Append caller-given rows; returns (new table, inserted rows).

    Rows are maps (missing columns become NULL) or full value lists. With ``id_column`` ids left
    out continue after the largest one.
    """
    names = table.columns
    rows = [tuple(v.get(n) for n in names) if isinstance(v, Mapping) else tuple(v) for v in values]
    unknown = {k for v in values if isinstance(v, Mapping) for k in v} - set(names)
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in table.schema], T.StructField("_nth", T.IntegerType())])
    new = table.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    if id_column:
        assigned = (next_id(table, id_column) + F.col("_nth")).cast(dict(table.dtypes)[id_column])
        new = new.withColumn(id_column, F.coalesce(F.col(id_column), assigned))
    new = new.select(*names)
    return table.unionByName(new), new


def join_keys(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Null-safe equi join on ``key``: all columns of ``left``, and those of ``right`` but for its key."""
    own = {k: f"__key_{n}" for n, k in enumerate(key)}
    right = right.withColumnsRenamed(own)
    same = F.lit(True)
    for k, name in own.items():
        same = same & left[k].eqNullSafe(right[name])
    return left.join(right, same, how).drop(*own.values())


def insert_new(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows to append so that every key stays unique: the first row of each key not yet stored."""
    return join_keys(first_per_key(rows, key, order), table.select(*key), key, "left_anti")


def insert_or_skip(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return table.unionByName(insert_new(table, rows, key, order))


def _condition(conditions: Mapping[str, Any] | Column | str) -> Column:
    """Equalities, a column, or SQL text; a condition that is NULL does not hold."""
    if isinstance(conditions, Mapping):
        conditions = equals_all(conditions)
    elif isinstance(conditions, str):
        conditions = F.expr(conditions)
    return F.coalesce(conditions, F.lit(False))


def update(
    table: DataFrame, changes: Mapping[str, Any], conditions: Mapping[str, Any] | Column | str
) -> tuple[DataFrame, DataFrame]:
    """Set columns to values or expressions where the conditions hold; returns (new table, changed rows)."""
    unknown = set(changes) - set(table.columns)
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    hit = _condition(conditions)

    def value(field: T.StructField) -> Column:
        if field.name not in changes:
            return F.col(field.name)
        new = changes[field.name]
        return (new if isinstance(new, Column) else F.lit(new)).cast(field.dataType).alias(field.name)

    after = [F.when(hit, value(f)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in table.schema]
    return table.select(*after), table.filter(hit).select(*[value(f) for f in table.schema])


def update_from(table: DataFrame, changes: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Take the columns of ``changes`` for the keys it names (one row per key)."""
    key = [key] if isinstance(key, str) else list(key)
    columns = [c for c in changes.columns if c not in key]
    new = changes.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = join_keys(table, new, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{f.name}").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in columns else F.col(f.name)
            for f in table.schema
        ]
    )


def delete(table: DataFrame, conditions: Mapping[str, Any] | Column | str) -> tuple[DataFrame, DataFrame]:
    """(Rows kept, rows removed); a row that is NULL in a tested column is kept."""
    hit = to_delete(conditions)
    return table.filter(~hit), table.filter(hit)


def to_delete(conditions: Mapping[str, Any] | Column | str) -> Column:
    """Whether a row goes, for one pass over a table that is to give both parts."""
    return _condition(conditions)


def get_or_create(
    dimension: DataFrame, facts: DataFrame, key: Sequence[str], attributes: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Dimension with the missing keys added, and the facts with the dimension id instead of key and attributes.

    New ids continue after the largest one in key order. A key is one value per dimension row, NULL included; facts of a
    key that the dimension holds more than once go to its smallest id, so each fact keeps exactly one link and a second run adds no row.
    """
    wanted = facts.select(*key, *attributes)
    order = [F.col(a) for a in attributes] or [F.col(key[0])]
    missing = join_keys(first_per_key(wanted, key, order), dimension.select(*key), key, "left_anti")
    numbered = number_rows(missing, key, "_n", start=0)
    created = numbered.withColumn("id", next_id(dimension, "id") + F.col("_n")).drop("_n")
    full = dimension.unionByName(created, allowMissingColumns=True)
    ids = full.groupBy(*key).agg(F.min("id").alias("dimension_id"))
    return full, join_keys(facts, ids, key, "inner").drop(*key, *attributes)


def store_raw_modules(
    stored: DataFrame, relation: DataFrame, rows: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Store new raw texts once per (code, content hash) and link every handbook to its texts.

    ``rows`` has ``mhb_id, module_code, content``; ``stored`` has ``id, module_code, content,
    content_md5``; ``relation`` has unique ``mhb_id, modules_raw_id``. Texts without content or code are stored once as well.
    """
    hashed = with_content_hash(rows, "content")
    key = ["module_code", "content_md5"]
    texts = insert_new(stored, hashed.select(*key, "content"), key, [F.col("content")])
    numbered = number_rows(texts, key, "_n", start=0)
    created = numbered.withColumn("id", next_id(stored, "id") + F.col("_n")).drop("_n")
    full = stored.unionByName(created)
    ids = full.groupBy(*key).agg(F.min("id").alias("modules_raw_id"))
    pairs = join_keys(hashed, ids, key, "inner").select("mhb_id", "modules_raw_id")
    fresh = join_keys(pairs.distinct(), relation, ["mhb_id", "modules_raw_id"], "left_anti")
    return full, relation.unionByName(fresh)


def with_content_hash(df: DataFrame, content: str, name: str = "content_md5") -> DataFrame:
    return df.withColumn(name, F.md5(content))
