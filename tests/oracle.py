"""Compare a Spark result with the DuckDB result of its check SQL, ignoring row order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from handbook_spark.corpus import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = Counter(tuple(plain(row[n]) for n in names) for row in df.collect())
    return names, rows


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    header = [d[0] for d in cursor.description]
    names = sorted(header)
    order = [header.index(n) for n in names]
    return names, Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of what differs."""
    left_names, left = spark_rows(df)
    right_names, right = duck_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if left != right:
        return (
            f"{sum(left.values())} rows vs {sum(right.values())}; only spark "
            f"{str(list((left - right).items())[:3])[:600]}; only duckdb {str(list((right - left).items())[:3])[:600]}"
        )
    return None


def main(argv: list[str]) -> None:
    import __spark_entry__ as entry
    from handbook_spark.session import build_session

    sf_dir = argv[0]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if argv[1:] and not any(name.startswith(prefix) for prefix in argv[1:]):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                problem = difference(df, con, oracle[name])
                note = "ok"
            else:
                problem = None
                note = f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else note:10s} {name:34s} {time.time() - start:6.2f}s  {(problem or '')[:1500]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
