"""Run registered queries beside their SQL twins and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
import pandas as pd

from workload import ORACLES, QUERIES
from workload.base import TABLES


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, Counter(tuple(plain(v) for v in row) for row in pdf[columns].itertuples(index=False, name=None))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    pdf = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - started
    if name not in ORACLES:
        return len(pdf) > 0, f"{len(pdf)} rows, no SQL, {took:.2f}s"
    want = con.execute(ORACLES[name]).df()
    got_columns, got = rows_of(pdf)
    want_columns, wanted = rows_of(want)
    note = f"{len(pdf)} rows, {took:.2f}s"
    if got_columns != want_columns:
        return False, f"{note} columns {got_columns} != {want_columns}"
    if got != wanted:
        return False, (
            f"{note} vs {len(want)}; only spark {list((got - wanted).items())[:3]}; "
            f"only sql {list((wanted - got).items())[:3]}"
        )
    return len(pdf) > 0, note


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or list(QUERIES):
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # a broken query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
