"""Compares every query with its SQL: ``python -m contract.check [sf_dir] [query ...]``.

The evidence tables are built once here and shared by all queries.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def local_session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("testimony")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[str]:
    cols = sorted(frame.columns)
    return sorted("\1".join(canon(v) for v in row) for row in frame[cols].itertuples(index=False, name=None))


def digest(rows: list[str]) -> str:
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:12]


def compare(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty where both agree, else what differs."""
    want = con.execute(sql).df()
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    a, b = rows_of(got), rows_of(want)
    if digest(a) == digest(b):
        return "" if a else "both empty"
    left, right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} against {len(b)}; cols {sorted(got.columns)}; only Spark {[x.replace(chr(1), ' | ') for x in left]}; only SQL {[x.replace(chr(1), ' | ') for x in right]}"


def main(argv: list[str]) -> int:
    from contract.oracle import ORACLE
    from contract.lift import Lift
    from contract.queries import OVER_LIFT

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(OVER_LIFT)
    spark, con, bad = local_session(), duck(sf_dir), 0
    lift = Lift(spark, sf_dir)
    for name in names:
        start = time.time()
        try:
            df = OVER_LIFT[name](lift)
            result = compare(df, con, ORACLE[name]) if name in ORACLE else f"no SQL; {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:400]!r}"
        bad += bool(result)
        print(f"{name:26s} {time.time() - start:6.1f}s {result or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} to look at")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
