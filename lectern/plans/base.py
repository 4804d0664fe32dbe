"""What all modules of queries share: the tables of a directory, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Data:
    """Tables of a directory by name."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Data], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(Data(spark, d))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
