"""Named queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatscape.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of one scale folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, others: str = "", doubles: str = "", sql: str | None = None, dp: int = 6):
    """Register a query returning ``others`` as they are and ``doubles`` rounded.

    The SQL is wrapped in the same selection, so both sides round alike.
    """
    plain, real = others.split(), doubles.split()

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            df = fn(Tables(spark, folder))
            return df.select(*plain, *[(F.round(F.col(c).cast("double"), dp) + F.lit(0.0)).alias(c) for c in real])

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            cols = [*[f'"{c}"' for c in plain], *[f'round(CAST("{c}" AS DOUBLE), {dp}) + 0.0 AS "{c}"' for c in real]]
            SQL[name] = f"SELECT {', '.join(cols)} FROM (\n{sql.strip()}\n) AS result"
        return fn
    return register
