"""Runs registered queries beside their DuckDB text and reports differences.

    python tests/comparing.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.registry import ORACLE, QUERIES  # noqa: E402
from workload.views import TABLES  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(frame.columns)
    return sorted(tuple(map(_cell, row)) for row in frame[names].itertuples(index=False))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {name: str(frame[name].dtype) for name in sorted(frame.columns)}


def difference(spark, connection, folder: str, name: str) -> str | None:
    """What is wrong with a query, None if nothing."""
    mine = QUERIES[name](spark, folder).toPandas()
    if name not in ORACLE:
        return None if len(mine) else "no rows"
    other = connection.execute(ORACLE[name]).df()
    if kinds(mine) != kinds(other):
        left, right = kinds(mine), kinds(other)
        return f"types {sorted(set(left.items()) ^ set(right.items()))}"
    if len(mine) != len(other):
        return f"{len(mine)} rows, not {len(other)}"
    for left, right in zip(rows(mine), rows(other), strict=True):
        if left != right:
            return f"row {str(left)[:700]}\n   not {str(right)[:700]}"
    return None if len(mine) else "no rows"


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    given = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, connection = session(), duck(given)
    bad = 0
    for query in sys.argv[2:] or QUERIES:
        begun = time.time()
        try:
            found = difference(spark, connection, given, query)
        except Exception as problem:
            found = f"{type(problem).__name__} {str(problem)[:900]}"
        bad += found is not None
        print(f"{query:22s} {time.time() - begun:6.2f}s {'ok' if found is None else found}", flush=True)
    print(f"{bad} differ")
