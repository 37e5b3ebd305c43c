"""Readers of files and of texts stored in columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from handbook_spark.functions.dates import study_semesters
from handbook_spark.functions.nested import snake_fields
from handbook_spark.functions.text import extract_or_null, html_to_text
from handbook_spark.schemas import HANDBOOK_PAYLOAD, LISTING, NUMERIC_FIELDS, POSITIONED_XML, UNIVERSITY_COLUMNS


def scan(spark: SparkSession, path: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """Parquet table with named columns only."""
    return spark.read.parquet(path).select(*columns)


def list_files(spark: SparkSession, path: str, glob: str = "*.pdf", stem: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Files below ``path`` with the id taken from their path; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    return files.select(F.regexp_extract("path", stem, 1).alias("file_id"), "path", "length")


def registered_files(files: DataFrame, registry: DataFrame, id_column: str = "id") -> DataFrame:
    """Registry rows whose file exists, with its path and length."""
    listed = files.withColumn(id_column, F.col("file_id").try_cast(dict(registry.dtypes)[id_column]))
    return registry.join(listed.select(id_column, "path", "length"), id_column)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    """XML records of all files below ``path``: snake-case fields and the file they come from."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("recursiveFileLookup", "true")
    records = (reader.schema(schema) if schema is not None else reader).load(path)
    return snake_fields(records.select("*", F.col("_metadata.file_path").alias("source_path")))


def clean_markup(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Markup columns as plain text."""
    return df.withColumns({c: html_to_text(F.col(c)) for c in columns})


def positioned_xml_texts(df: DataFrame, xml: str, key: str) -> DataFrame:
    """Non-blank text nodes with position, font and weight; nested nodes inherit missing attributes.

    A text node comes before the ``b`` and ``a`` nodes inside it; nodes of one tag keep their order.
    """
    def row(node: Column, outer: Column | None, bold: bool) -> Column:
        def attribute(name: str) -> Column:
            return node[name] if outer is None else F.coalesce(node[name], outer[name])

        return F.struct(
            attribute("_left").alias("left"), attribute("_font").alias("font"), F.lit(bold).alias("bold"),
            F.trim(node["_VALUE"]).alias("text"),
        )

    def children(node: Column, tag: str, outer: Column, deep: bool) -> Column:
        def rows_of(child: Column) -> Column:
            inherited = F.struct(
                F.coalesce(child["_left"], outer["_left"]).alias("_left"),
                F.coalesce(child["_font"], outer["_font"]).alias("_font"),
            )
            own = F.array(row(child, outer, tag == "b"))
            if not deep:
                return own
            return F.concat(own, children(child, "b", inherited, False), children(child, "a", inherited, False))

        return F.coalesce(F.flatten(F.transform(node[tag], rows_of)), F.array().cast(
            "array<struct<left:string,font:string,bold:boolean,text:string>>"))

    parsed = df.select(key, F.from_xml(F.col(xml), POSITIONED_XML.simpleString()).alias("d"))
    nodes = parsed.select(key, F.posexplode("d.page").alias("page_place", "p")).select(
        key, "page_place", F.posexplode("p.text").alias("text_place", "t")
    )
    node = F.col("t")
    rows = F.concat(F.array(row(node, None, False)), children(node, "b", node, True), children(node, "a", node, True))
    kept = F.filter(rows, lambda r: F.coalesce(r["text"], F.lit("")) != "")
    return nodes.select(key, "page_place", "text_place", F.posexplode(kept).alias("place", "r")).select(
        key, "page_place", "text_place", "place", "r.*"
    )


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType, one_per_file: bool = True) -> DataFrame:
    """JSON documents with a declared schema; a file holds one document (or array) or one per line."""
    return spark.read.schema(schema).option("multiLine", str(one_per_file).lower()).json(path)


def listing_courses(df: DataFrame, body: str, key: str, source: str = "") -> DataFrame:
    """Course rows of a nested listing answer; sub-items are told apart by their place."""
    items = df.select(key, F.explode(F.from_json(F.col(body), LISTING)["results"]["items"]).alias("i"))

    def part(place: int) -> Column:
        return F.get(F.col("i.items"), F.lit(place))["text"]

    return items.select(
        key,
        F.col("i.id").alias("web_id"),
        F.col("i.institutionTypeId").alias("type_of_institution"),
        F.concat(F.lit(source), F.col("i.link.url")).alias("source_url"),
        F.col("i.logo.src.large").alias("logo_url"),
        part(0).alias("degree"),
        study_semesters(part(1)).alias("duration"),
        part(2).alias("city"),
        F.split(part(3), ", ").alias("study_type"),
        F.col("i.headline").alias("title"),
        F.col("i.subline").alias("university"),
        F.lit(source).alias("source"),
    )


def read_university_list(spark: SparkSession, path: str, names: Mapping[str, str] = UNIVERSITY_COLUMNS) -> DataFrame:
    """Tab-separated list with a header line; known headers get short names, blank lines drop."""
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    return rows.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in rows.columns])


def html_rows(pages: DataFrame, html: str, key: str, row_tag: str, cell_tag: str, headers: Sequence[str]) -> DataFrame:
    """Table or list rows as named columns; rows with another number of cells drop.

    ``first_link`` and ``last_link`` are the links of the first and last cell.
    """
    row_pattern = rf"(?is)<{row_tag}(?:\s[^>]*)?>(.*?)</{row_tag}>"
    cell_pattern = rf"(?is)<{cell_tag}(?:\s[^>]*)?>(.*?)</{cell_tag}>"
    link_pattern = r'(?is)<a\s[^>]*?href="([^"]*)"'
    rows = pages.select(
        key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(row_pattern), F.lit(1))).alias("row_no", "_row")
    )
    cells = rows.withColumn("_cells", F.regexp_extract_all(F.col("_row"), F.lit(cell_pattern), F.lit(1)))

    def plain(cell: Column) -> Column:
        return F.trim(F.regexp_replace(cell, r"<[^<>]*>", ""))

    return cells.filter(F.size("_cells") == len(headers)).select(
        key, "row_no",
        *[plain(F.get("_cells", F.lit(i))).alias(name) for i, name in enumerate(headers)],
        extract_or_null(F.get("_cells", F.lit(0)), link_pattern, 1).alias("first_link"),
        extract_or_null(F.element_at("_cells", -1), link_pattern, 1).alias("last_link"),
    )


def text_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """Lines of a text column with their place."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def lines_with(lines: DataFrame, any_of: Sequence[str], also: str) -> DataFrame:
    """Lines holding any of the words in any case and ``also`` as written."""
    word = F.lit(False)
    for keyword in any_of:
        word = word | F.contains(F.lower("line"), F.lit(keyword))
    return lines.filter(word & F.contains("line", F.lit(also)))


def log_records(df: DataFrame, blob: str, key: str) -> DataFrame:
    """Records ``: epoch:duration;command`` of a log text; a record ends where the next one starts."""
    pattern = r"(?s)^: (\d+):(\d+);(.*)$"
    records = df.select(key, F.posexplode(F.split(blob, r"(?=\n: \d+:\d+;)")).alias("record_no", "_record"))
    record = F.regexp_replace(F.col("_record"), r"^\s+|\s+$", "")
    return (
        records.withColumn("_record", record)
        .filter(F.col("_record") != "")
        .select(
            key, "record_no",
            F.regexp_extract("_record", pattern, 1).try_cast("long").alias("epoch"),
            F.regexp_extract("_record", pattern, 2).try_cast("int").alias("duration"),
            F.regexp_replace(F.regexp_extract("_record", pattern, 3), r"^\s+|\s+$", "").alias("command"),
        )
    )


def split_pages(df: DataFrame, text: str, key: str, page_break: str) -> DataFrame:
    """Pages of a document whose pages are divided by a placeholder line."""
    # The placeholder is quoted, so it is matched as written.
    return df.select(key, F.posexplode(F.split(text, rf"\n\Q{page_break}\E\n")).alias("page_no", "text"))


def validate_extraction(df: DataFrame, answer: str) -> DataFrame:
    """Check extraction answers against the module schema.

    Accepts a bare payload or one wrapped in ``data``. Adds ``valid``, ``error`` and ``modules``;
    an answer is invalid when it is no JSON of that shape, has no modules, or a numeric field holds
    something else. Numbers given as text are accepted.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("_p", F.from_json(F.col(answer), HANDBOOK_PAYLOAD, options))
    modules = F.coalesce("_p.modules", "_p.data.modules")

    def not_numeric(name: str) -> Column:
        return F.exists(modules, lambda m: m[name].isNotNull() & m[name].try_cast("int").isNull())

    error = (
        F.when(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), F.lit("malformed"))
        .when(modules.isNull(), F.lit("no modules"))
    )
    for name in NUMERIC_FIELDS:
        error = error.when(not_numeric(name), F.lit(f"{name} is not a number"))
    typed = F.transform(
        modules, lambda m: m.withField("ects", m["ects"].try_cast("int"))
        .withField("weekly_hours", m["weekly_hours"].try_cast("int"))
        .withField("recommended_semester", m["recommended_semester"].try_cast("int")),
    )
    checked = parsed.withColumn("error", error)
    return (
        checked.withColumn("valid", F.col("error").isNull())
        .withColumn("modules", F.when(F.col("error").isNull(), typed))
        .drop("_p")
    )
