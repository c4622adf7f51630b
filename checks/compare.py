"""Run queries and their SQL twins side by side and report differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import oracle_queries
from checks.queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if (Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name, missing values as None."""
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(map(tuple, df.itertuples(index=False)), key=lambda r: tuple(str(v) for v in r))


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """First difference between a Spark and a SQL result, or None."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    a, b = rows_of(left), rows_of(right)
    if a != b:
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return f"rows {len(a)} / {len(b)}; spark only {list(only_a)[:2]}; sql only {list(only_b)[:2]}"
    return None


# DuckDB names of the Spark types the queries give out.
TYPE_NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def type_difference(df: DataFrame, twin: duckdb.DuckDBPyRelation) -> str | None:
    """Columns whose types differ, or None."""
    left = {name: TYPE_NAMES.get(kind, kind) for name, kind in df.dtypes}
    right = dict(zip(twin.columns, map(str, twin.types)))
    apart = {c: (left[c], right.get(c)) for c in left if left[c] != right.get(c)}
    return f"types {apart}" if apart else None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = all_queries(), oracle_queries()
    wanted = argv[1:] or list(queries)
    spark, con, failures = session(), connect(sf_dir), 0
    for name in wanted:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = df.toPandas()
            took = time.time() - began
            twin = con.sql(oracles[name])
            problem = type_difference(df, twin) or difference(got, twin.df())
        except Exception as error:
            took, got, problem = time.time() - began, [], f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{name:14s} {took:6.2f}s {len(got):7d} rows  {problem or 'equal'}", flush=True)
    print(f"{len(wanted) - failures} of {len(wanted)} equal")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
