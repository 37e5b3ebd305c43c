"""DuckDB texts that several checks share."""

from __future__ import annotations


def duck_decode(value: str) -> str:
    """DuckDB text of the escape decoding."""
    octal = "TRY_CAST(substr(p, 1, 1) AS INT) * 64 + TRY_CAST(substr(p, 2, 1) AS INT) * 8 + TRY_CAST(substr(p, 3, 1) AS INT)"
    return (
        f"replace(array_to_string(list_transform(string_split(replace({value}, chr(92) || chr(92), chr(57344)), chr(92)),"
        f" lambda p, i: CASE WHEN i > 1 AND regexp_matches(p, '^[0-3][0-7]{{2}}') THEN chr({octal}) || substr(p, 4) ELSE p END), ''), chr(57344), '')"
    )
