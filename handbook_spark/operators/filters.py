"""Projections, predicates and the dynamic module search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from handbook_spark.functions.dates import semester_from_label

# Fixed names that callers may ask for.
MODULE_COLUMNS = (
    "id", "title", "module_code", "ects", "lecturer", "contents", "goals", "requirements", "expense",
    "success_requirements", "weekly_hours", "exams", "module_parts",
)
MODULE_SEARCH_KEYS = ("id", "title", "module_code", "ects", "lecturer")
COMPARISONS = ("=", "<=", ">=")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals_all(conditions: Mapping[str, Any]) -> Column:
    """AND of equalities; a NULL on either side never matches."""
    return all_of([F.col(name) == F.lit(value) for name, value in conditions.items()])


def differs_all(conditions: Mapping[str, Any]) -> Column:
    """AND of inequalities; rows that are NULL in a tested column drop out."""
    return all_of([F.col(name) != F.lit(value) for name, value in conditions.items()])


def select_rows(
    df: DataFrame,
    columns: Sequence[str] = ("*",),
    conditions: Mapping[str, Any] | None = None,
    negated_conditions: Mapping[str, Any] | None = None,
    max_of: str | None = None,
    where: str | None = None,
    variables: Sequence[Any] = (),
    order_by: tuple[str, str] | None = None,
) -> DataFrame:
    """Table read with named columns and one kind of condition.

    ``where`` is SQL with ``?`` markers bound to ``variables`` and excludes the two condition
    maps; ``max_of`` keeps one row holding the largest value and is ignored when there are
    conditions, as ``where`` is when there is ``max_of``.
    """
    if where and (conditions is not None or negated_conditions is not None):
        raise ValueError("where excludes conditions and negated_conditions")
    rows = df
    if conditions or negated_conditions:
        rows = rows.filter(equals_all(conditions or {}) & differs_all(negated_conditions or {}))
    elif max_of:
        rows = row_of_maximum(rows, max_of)
    elif where:
        if where.count("?") != len(variables):
            raise ValueError("number of markers must match the number of variables")
        rows = df.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {where}", args=list(variables) or None, rows=rows)
    if order_by:
        rows = order_rows(rows, *order_by)
    return rows.select(*columns)


def order_rows(df: DataFrame, column: str, direction: str = "ASC") -> DataFrame:
    """Sort by one column; NULLs last when ascending and first when descending."""
    if direction not in ("ASC", "DESC"):
        raise ValueError("direction is ASC or DESC")
    key = F.col(column)
    return df.orderBy(key.asc_nulls_last() if direction == "ASC" else key.desc_nulls_first())


def row_of_maximum(df: DataFrame, column: str) -> DataFrame:
    """One row among those holding the largest value of ``column``."""
    return df.filter(F.col(column).isNotNull()).orderBy(F.col(column).desc()).limit(1)


def module_rows(df: DataFrame, columns: Sequence[str] = (), **search: Any) -> DataFrame:
    """Extracted modules: allowed columns only (none named = all), equality search on allowed keys."""
    unknown = [c for c in columns if c not in MODULE_COLUMNS]
    if unknown:
        raise ValueError(f"columns not allowed: {', '.join(unknown)}")
    unknown = [k for k in search if k not in MODULE_SEARCH_KEYS]
    if unknown:
        raise ValueError(f"search keys not allowed: {', '.join(unknown)}")
    return df.filter(equals_all(search)).select(*(columns or MODULE_COLUMNS))


def like_text(value: str) -> str:
    """Pattern for a case-insensitive substring match."""
    return f"%{value}%"


def compare(column: Column, operator: str, value: Any) -> Column:
    if operator not in COMPARISONS:
        raise ValueError(f"comparison must be one of {', '.join(COMPARISONS)}")
    return {"=": column == value, "<=": column <= value, ">=": column >= value}[operator]


def code_matches(code: Column, model_code: Column, pattern: str) -> Column:
    """Pattern on the regex code; the model's code counts only where the regex gave none."""
    return F.coalesce(code, model_code).ilike(pattern)


def title_matches(title: Column, model_title: Column, pattern: str) -> Column:
    return title.ilike(pattern) | model_title.ilike(pattern)


def credits_match(ects: Column, model_ects: Column, operator: str, value: int) -> Column:
    return compare(F.coalesce(ects, model_ects), operator, value)


def json_text_matches(value: Column, pattern: str) -> Column:
    """Pattern on the JSON text of a nested column."""
    return F.to_json(value).ilike(pattern)


def _number(value: str) -> int:
    return int(value.strip())


# Filter name -> predicate over the joined search rows, given the text value and the comparison.
SEARCH_FILTERS: dict[str, Callable[[str, str], Column]] = {
    "module_code": lambda v, _: code_matches(F.col("module_code"), F.col("ai_module_code"), like_text(v)),
    "title": lambda v, _: title_matches(F.col("module_title"), F.col("ai_title"), like_text(v)),
    "ects": lambda v, op: credits_match(F.col("module_ects"), F.col("ai_ects"), op, _number(v)),
    "lecturer": lambda v, _: F.col("ai_lecturer").ilike(like_text(v)),
    "requirements": lambda v, _: json_text_matches(F.col("ai_requirements"), like_text(v)),
    "success_requirements": lambda v, _: json_text_matches(F.col("ai_success_requirements"), like_text(v)),
    "weekly_hours": lambda v, op: compare(F.col("weekly_hours"), op, _number(v)),
    "recommended_semester": lambda v, op: compare(F.col("recommended_semester"), op, _number(v)),
    "exams": lambda v, _: json_text_matches(F.col("ai_exams"), like_text(v)),
    "version": lambda v, _: F.col("version") == semester_from_label(v),
    "subject": lambda v, _: code_matches(F.col("module_code"), F.col("ai_module_code"), f"{v}-%"),
}
# Substring filter name -> the texts of which any may hold the value, and the pattern that it makes.
INDEXED_TEXTS: dict[str, Callable[[], list[Column]]] = {
    "module_code": lambda: [F.coalesce(F.col("module_code"), F.col("ai_module_code"))],
    "title": lambda: [F.col("module_title"), F.col("ai_title")],
    "lecturer": lambda: [F.col("ai_lecturer")],
    "requirements": lambda: [F.to_json("ai_requirements")],
    "success_requirements": lambda: [F.to_json("ai_success_requirements")],
    "exams": lambda: [F.to_json("ai_exams")],
}


def substring_patterns(filters: Mapping[str, str | None]) -> dict[str, str]:
    """LIKE patterns of the non-blank substring filters by indexed field; a subject is the beginning of a code."""
    present = {k: v for k, v in filters.items() if v is not None and v.strip() != ""}
    found = {k: like_text(v) for k, v in present.items() if k in INDEXED_TEXTS}
    if "subject" in present:
        found["module_code"] = f"{present['subject']}-%" + found.get("module_code", "")
    return found


COMPARISON_KEYS = {f"{name}_type": name for name in ("ects", "weekly_hours", "recommended_semester")}


def search_predicate(filters: Mapping[str, str | None]) -> Column:
    """AND of all non-blank filters.

    Unknown names, no filter at all or an unknown comparison raise. A numeric filter without its
    ``*_type`` entry means equality.
    """
    unknown = [k for k in filters if k not in SEARCH_FILTERS and k not in COMPARISON_KEYS]
    if unknown:
        raise ValueError(f"not allowed as filter: {', '.join(unknown)}")
    present = {k: v for k, v in filters.items() if v is not None and v.strip() != ""}
    if not any(k in SEARCH_FILTERS for k in present):
        raise ValueError("every filter is blank: name at least one")
    operators = {COMPARISON_KEYS[k]: v for k, v in present.items() if k in COMPARISON_KEYS}
    wrong = [v for v in operators.values() if v not in COMPARISONS]
    if wrong:
        raise ValueError(f"comparison must be one of {', '.join(COMPARISONS)}")
    return all_of(
        [SEARCH_FILTERS[k](v, operators.get(k, "=")) for k, v in present.items() if k in SEARCH_FILTERS]
    )


def search_modules(joined: DataFrame, filters: Mapping[str, str | None]) -> DataFrame:
    """Search rows that satisfy all filters and have a code from at least one source."""
    return joined.filter(search_predicate(filters)).filter(has_code())


def has_code() -> Column:
    return F.coalesce(F.col("module_code"), F.col("ai_module_code")).isNotNull()


def complete(df: DataFrame) -> DataFrame:
    """Rows without an empty text, and without a missing or empty array."""
    conditions = []
    for field in df.schema:
        if field.dataType.typeName() == "array":
            conditions.append(F.coalesce(F.size(F.col(field.name)), F.lit(0)) > 0)
        elif field.dataType.typeName() == "string":
            conditions.append(F.coalesce(F.col(field.name) != "", F.lit(True)))
    return df.filter(all_of(conditions))


def without_topic(df: DataFrame, column: str, topic: str) -> DataFrame:
    """Drop rows whose joined array mentions the topic; missing and empty arrays drop as well."""
    items = F.col(column)
    return df.filter((F.size(items) > 0) & ~F.array_join(items, ", ").ilike(like_text(topic)))


def unexpired(expires: Column, as_of: Column) -> Column:
    return expires > as_of


def recently_created(created: Column, used: Column, as_of: Column, minutes: Column | int) -> Column:
    """Created at most ``minutes`` before ``as_of`` and not used yet."""
    span = F.lit(minutes) if isinstance(minutes, int) else minutes
    return (created >= as_of - F.make_dt_interval(mins=span.cast("int"))) & ~used
