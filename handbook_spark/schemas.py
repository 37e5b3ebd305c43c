"""Declared schemas of nested inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Numeric fields are read as text and cast afterwards, so that a wrong value can be reported.
EXAM = T.StructType().add("exam_type", "string").add("info", "string").add("duration", "string")
MODULE_INFO = (
    T.StructType()
    .add("title", "string")
    .add("module_code", "string")
    .add("ects", "string")
    .add("lecturer", "string")
    .add("contents", T.ArrayType(T.StringType()))
    .add("goals", T.ArrayType(T.StringType()))
    .add("requirements", T.ArrayType(T.StringType()))
    .add("expense", "variant")
    .add("success_requirements", T.ArrayType(T.StringType()))
    .add("weekly_hours", "string")
    .add("recommended_semester", "string")
    .add("exams", T.ArrayType(EXAM))
    .add("module_parts", "variant")
    .add("module_group", "string")
)
NUMERIC_FIELDS = ("ects", "weekly_hours", "recommended_semester")
HANDBOOK_PAYLOAD = (
    T.StructType()
    .add("modules", T.ArrayType(MODULE_INFO))
    .add("data", T.StructType().add("modules", T.ArrayType(MODULE_INFO)))
    .add("_corrupt", "string")
)

LISTING = T.StructType().add(
    "results",
    T.StructType().add(
        "items",
        T.ArrayType(
            T.StructType()
            .add("id", "string")
            .add("institutionTypeId", "string")
            .add("link", T.StructType().add("url", "string"))
            .add("headline", "string")
            .add("subline", "string")
            .add("logo", T.StructType().add("src", T.StructType().add("large", "string")))
            .add("items", T.ArrayType(T.StructType().add("text", "string")))
        ),
    ),
)

HANDBOOK_DOCUMENT = (
    T.StructType()
    .add("name", "string")
    .add(
        "modules",
        T.ArrayType(T.StructType().add("pos", "long").add("module_code", "string").add("title", "string").add("ects", "integer")),
    )
)

_TEXT_LEAF = T.StructType().add("_VALUE", "string").add("_left", "string").add("_font", "string")
_TEXT_INNER = T.StructType(_TEXT_LEAF.fields + [
    T.StructField("b", T.ArrayType(_TEXT_LEAF)), T.StructField("a", T.ArrayType(_TEXT_LEAF)),
])
POSITIONED_XML = T.StructType().add(
    "page",
    T.ArrayType(
        T.StructType().add("_number", "string").add(
            "text",
            T.ArrayType(
                T.StructType(_TEXT_LEAF.fields + [
                    T.StructField("b", T.ArrayType(_TEXT_INNER)), T.StructField("a", T.ArrayType(_TEXT_INNER)),
                ])
            ),
        )
    ),
)

# Fixed header names of the university list and their short names.
UNIVERSITY_COLUMNS = {
    "Hs-Nr.": "hs_nr",
    "Hochschulkurzname": "short_name",
    "Hochschulname": "name",
    "Adressname der Hochschule": "address_name",
    "Hochschultyp": "type",
    "Trägerschaft": "holder_type",
    "Bundesland": "state",
    "Anzahl Studierende": "students",
    "Gründungsjahr": "founded",
    "Promotionsrecht": "doctoral_rights",
    "Habilationsrecht": "habilitation_rights",
    "Straße": "street",
    "Postleitzahl (Hausanschrift)": "postal_code",
    "Ort (Hausanschrift)": "city",
    "Telefonvorwahl": "phone_area_code",
    "Telefon": "phone_number",
    "Fax": "fax_number",
    "Home Page": "website",
    "Mitglied HRK": "hrk_member",
}
