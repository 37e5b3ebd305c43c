"""Walks over nested column types: string clean-up, NULL marks, field renaming, JSON text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_strings(value: Column, dtype: T.DataType, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to every string inside ``value``; other leaves stay as they are."""
    if isinstance(dtype, T.StringType):
        return change(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: map_strings(item, dtype.elementType, change))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: map_strings(item, dtype.valueType, change))
    if isinstance(dtype, T.StructType):
        fields = [map_strings(value.getField(f.name), f.dataType, change).alias(f.name) for f in dtype]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def fill_nulls(value: Column, dtype: T.DataType, mark: str) -> Column:
    """Turn every leaf into text and every NULL leaf into ``mark``, at any depth."""
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: fill_nulls(item, dtype.elementType, mark))
        missing = F.lit(mark) if _is_leaf(dtype.elementType) else fill_nulls(F.lit(None).cast(dtype.elementType), dtype.elementType, mark)
        return F.coalesce(items, F.array(missing))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: fill_nulls(item, dtype.valueType, mark))
    if isinstance(dtype, T.StructType):
        return F.struct(*[fill_nulls(value.getField(f.name), f.dataType, mark).alias(f.name) for f in dtype])
    return F.coalesce(value.cast("string"), F.lit(mark))


def _is_leaf(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def clean_spaces(df: DataFrame) -> DataFrame:
    """Squeeze whitespace in every string of every column."""
    from handbook_spark.functions.text import squeeze

    return df.select(*[map_strings(F.col(f.name), f.dataType, squeeze).alias(f.name) for f in df.schema])


def fill_none(df: DataFrame, mark: str = "-") -> DataFrame:
    """Show every missing value as ``mark``."""
    return df.select(*[fill_nulls(F.col(f.name), f.dataType, mark).alias(f.name) for f in df.schema])


def snake_case(name: str, attribute_prefixes: str = "@_") -> str:
    """Field name without one attribute prefix, words separated by underscores; underscores of the name stay."""
    bare = name[1:] if len(name) > 1 and name[0] in attribute_prefixes else name
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[^_])(?=[A-Z][a-z])", "_", bare).lower()


def _snake_names(names: list[str]) -> list[str]:
    found = [snake_case(n) for n in names]
    clashing = sorted({n for n in found if found.count(n) > 1})
    if clashing:
        raise ValueError(f"fields fall on one name: {', '.join(clashing)}")
    return found


def snake_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        names = _snake_names(dtype.names)
        return T.StructType([T.StructField(n, snake_type(f.dataType), f.nullable) for n, f in zip(names, dtype)])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(snake_type(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, snake_type(dtype.valueType), dtype.valueContainsNull)
    return dtype


def snake_fields(df: DataFrame) -> DataFrame:
    """Rename all fields, nested ones included, to snake case; a cast, so no data moves."""
    names = _snake_names(df.columns)
    return df.select(*[F.col(f"`{f.name}`").cast(snake_type(f.dataType)).alias(n) for n, f in zip(names, df.schema)])


def labelled_map(pairs: Column) -> Column:
    """Map of label/value pairs, texts trimmed and a closing colon of the label dropped.

    As with dictionary assignment the last value of a repeated label is kept.
    """
    cleaned = F.transform(
        pairs,
        lambda p: F.struct(
            F.regexp_replace(F.trim(p["label"]), ":$", "").alias("key"), F.trim(p["value"]).alias("value")
        ),
    )

    def last_of_each(entries: Column) -> Column:
        return F.filter(
            entries,
            lambda p, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == p["key"]),
        )

    return F.map_from_entries(let(cleaned, last_of_each))


def json_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, other columns unchanged."""
    return df.select(
        *[
            F.col(f.name) if _is_leaf(f.dataType) else F.to_json(F.col(f.name)).alias(f.name)
            for f in df.schema
        ]
    )
