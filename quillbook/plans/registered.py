"""The registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the DuckDB SQL of the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: rows of a task, where their number is known.
TASK_ROWS = 200_000


def spread(df: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """df dealt by its key to some tasks for each core: narrow rows come in few splits, and what is printed of them is long.
    With their number, `rows`, there are as many tasks as keep one from growing with the input."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS), key)
