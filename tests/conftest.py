"""A session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that compares alike whatever engine it comes from."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def answers(sql: str, sf_dir: str, columns: list[str]):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(columns)
    return [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]


@pytest.fixture(scope="session")
def same_as_sql(spark):
    def check(query, sql: str, sf_dir: str = SMALL) -> None:
        df = query(spark, sf_dir)
        rows = df.collect()
        assert ordered(rows) == ordered(answers(sql, sf_dir, df.columns))

    return check
