"""Exports of module lists: JSON, CSV, text, Markdown and HTML.

An export is built as ordered lines (``mhb_id, section, pos, line``): section 0 is the opening,
1 the modules, 2 the closing. Lines are ordinary rows, so a handbook of any size is rendered in
parallel; the writer sorts them by range and splits a very large handbook over several part files
whose concatenation is the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from handbook_spark.sources.keyed_table import KeyedTable
from handbook_spark.session import materialize

FILE_TYPES = ("json", "csv", "txt", "md", "html")
DELIMITERS = (";", "\t", ",")
BYTE_ORDER_MARK = "﻿"


def text_cells(modules: DataFrame, columns: Sequence[str]) -> DataFrame:
    """List cells joined by commas, other cells as they are."""
    types = {f.name: f.dataType for f in modules.schema}
    return modules.select(
        "mhb_id", "name", "pos",
        *[
            F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ", ", "None").alias(f"c_{c}")
            if isinstance(types[c], T.ArrayType) else F.col(c).cast("string").alias(f"c_{c}")
            for c in columns
        ],
    )


def _document(rows: DataFrame, line: Column, opening: Column, closing: Column | None = None) -> DataFrame:
    """Lines of every handbook: the opening, one line per module, the closing.

    The first and the last module of a handbook (by ``pos``, unique in a handbook) bring the opening and the closing
    along; their places come from a grouped minimum and maximum of ``pos`` alone.
    """
    bounds = rows.groupBy("mhb_id").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))

    def entry(section: int, pos: Column, text: Column) -> Column:
        return F.array(F.struct(F.lit(section).alias("section"), pos.cast("long").alias("pos"), text.alias("line")))

    none = F.array().cast("array<struct<section: int, pos: bigint, line: string>>")
    lines = F.concat(
        F.when(F.col("pos") == F.col("_first"), entry(0, F.lit(0), opening)).otherwise(none),
        entry(1, F.col("pos"), line),
        F.when(F.col("pos") == F.col("_last"), entry(2, F.lit(0), closing)).otherwise(none) if closing is not None else none,
    )
    return rows.join(bounds, "mhb_id").select("mhb_id", F.inline(lines))


def json_lines(modules: DataFrame, columns: Sequence[str], ordered: bool = True, module_code_key: bool = False) -> DataFrame:
    """``{"name": …, "modules": […]}``, or modules keyed by their code."""
    if ordered and module_code_key:
        raise ValueError("modules keyed by their code have no order: choose one of the two")
    entry = F.to_json(F.struct(*[c for c in columns if not (module_code_key and c == "module_code")]),
                      {"ignoreNullFields": "false"})
    if module_code_key:
        entry = F.concat(_json_text(F.col("module_code")), F.lit(": "), entry)
    comma = F.when(F.col("pos") > F.col("_first"), F.lit(", ")).otherwise(F.lit(""))
    opening, closing = ("{", "}") if module_code_key else ("[", "]")
    return _document(
        modules, F.concat(comma, entry),
        F.concat(F.lit('{"name": '), _json_text(F.col("name")), F.lit(f', "modules": {opening}')), F.lit(closing + "}"),
    )


def _json_text(value: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.coalesce(F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))


def csv_cell(value: Column, delimiter: str) -> Column:
    """Cell quoted only when it holds the delimiter, a quote or a line break; NULL is empty."""
    text = F.coalesce(value, F.lit(""))
    special = text.rlike('["\r\n' + ("\\t" if delimiter == "\t" else delimiter) + "]")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(modules: DataFrame, columns: Sequence[str], delimiter: str = ";", with_name: bool = True) -> DataFrame:
    """Optional name line, header line, one line per module; starts with a byte order mark."""
    header = delimiter.join(columns)
    name = F.concat(F.col("name"), F.lit("\n")) if with_name else F.lit("")
    cells = text_cells(modules, columns)
    return _document(
        cells, F.concat_ws(delimiter, *[csv_cell(F.col(f"c_{c}"), delimiter) for c in columns]),
        F.concat(F.lit(BYTE_ORDER_MARK), name, F.lit(header)),
    )


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def txt_lines(modules: DataFrame, columns: Sequence[str], delimiter: str = ";", with_name: bool = True) -> DataFrame:
    """Optional name line, header line, one delimited line per module."""
    header = F.lit(delimiter.join(columns))
    cells = text_cells(modules, columns)
    return _document(
        cells, F.concat_ws(delimiter, *[_shown(F.col(f"c_{c}")) for c in columns]),
        F.concat(F.col("name"), F.lit("\n"), header) if with_name else header,
    )


def _table_opening(columns: Sequence[str], borders: bool) -> str:
    heads = "\n".join(f"<th>{c}</th>" for c in columns)
    border = 'border="1"' if borders else ""
    return f"<table {border}>\n<thead>\n<tr>\n{heads}\n</tr>\n</thead>\n<tbody>"


def _table(modules: DataFrame, columns: Sequence[str], opening: Column, closing: str) -> DataFrame:
    cells = text_cells(modules, columns)
    cell = [
        F.concat(F.lit("<td>"), F.replace(_shown(F.col(f"c_{c}")), F.lit("\n"), F.lit("<br>")), F.lit("</td>"))
        for c in columns
    ]
    return _document(cells, F.concat(F.lit("<tr>"), F.concat_ws("\n", *cell), F.lit("</tr>")), opening, F.lit(closing))


def md_lines(modules: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Title line and an HTML table."""
    opening = F.concat(F.lit("# "), F.col("name"), F.lit("\n" + _table_opening(columns, False)))
    return _table(modules, columns, opening, "</tbody>\n</table>")


def html_lines(modules: DataFrame, columns: Sequence[str], borders: bool = False) -> DataFrame:
    """Page shell with title, heading and the table."""
    opening = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head>\n<title>"), F.col("name"), F.lit("</title>\n</head>\n<body>\n<h1>"),
        F.col("name"), F.lit("</h1>\n" + _table_opening(columns, borders)),
    )
    return _table(modules, columns, opening, "</tbody>\n</table>\n</body></html>")


def export_lines(
    modules: DataFrame, file_type: str, information: Sequence[str] | None = None, delimiter: str | None = None,
    borders: bool = False, ordered: bool = True,
) -> DataFrame:
    """Export of every handbook (``mhb_id, name, pos`` and attributes) as ordered lines.

    ``information`` selects columns and keeps their order in the source. A delimiter goes with csv
    and txt only, borders with html only.
    """
    if file_type == "pdf":
        raise NotImplementedError("pdf is not supported")
    if file_type not in FILE_TYPES:
        raise ValueError(f"file type must be one of {', '.join(FILE_TYPES)}")
    if delimiter is not None and file_type not in ("csv", "txt"):
        raise ValueError("delimiter goes with csv and txt only")
    if delimiter is not None and delimiter not in DELIMITERS:
        raise ValueError("delimiter must be ; , or tab")
    if borders and file_type != "html":
        raise ValueError("borders go with html only")
    columns = [
        c for c in modules.columns
        if c not in ("mhb_id", "name", "pos") and (information is None or c in information)
    ]
    if file_type == "json":
        return json_lines(modules, columns, ordered=ordered)
    if file_type == "csv":
        return csv_lines(modules, columns, delimiter or ";")
    if file_type == "txt":
        return txt_lines(modules, columns, delimiter or ";")
    return md_lines(modules, columns) if file_type == "md" else html_lines(modules, columns, borders)


def overlap_name(titles: Sequence[str], names: Sequence[str], file_type: str) -> str:
    """Name of the export of an overlap: the titles in Markdown and HTML, else the handbook names."""
    return "<br>".join(titles) if file_type in ("md", "html") else ", ".join(names)


def write_export(lines: DataFrame, path: str) -> None:
    """One folder of text files per handbook, lines in document order over its part files."""
    order = ["mhb_id", "section", "pos"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("mhb_id", F.col("line").alias("value")).write.partitionBy("mhb_id").text(path)


def append_raw_modules(table: KeyedTable, batch: int, rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Append rows with new keys as batch number ``batch``; returns counts of given, inserted and skipped rows.

    The counts are those of the stored batch, so a repeated batch, which appends nothing, returns the same ones.
    """
    table.insert_new(batch, rows, order)
    given = rows.agg(F.count(F.lit(1)).alias("given"))
    inserted = table.rows_of(batch).agg(F.count(F.lit(1)).alias("inserted"))
    return given.select("given", inserted.scalar().alias("inserted")).withColumn("skipped", F.col("given") - F.col("inserted"))
