"""Registration of queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL for DuckDB where SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The frame stream in events: order within a user, and the JSON counter as ticks.
ORDER = ["ts", "event_id"]
BY_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def with_k(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
