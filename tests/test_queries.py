"""Every query of the catalogue against its SQL; those without SQL run and give rows."""

from __future__ import annotations

import pytest

from ordina.plans import ORACLES, QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).take(1)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).take(1)


def test_filter_stays_above_split(spark):
    """Pieces are split before they are filtered: pushed below, the filter would change the split."""
    from ordina.operators.sampling import split_groups

    rows = spark.range(50).selectExpr("concat('p', id) as piece")
    whole = {r.piece: r.is_test for r in split_groups(rows, group="piece", seed="s").collect()}
    some = split_groups(rows, group="piece", seed="s").where("piece like 'p1%'").collect()
    assert len(some) == 11 and all(whole[r.piece] == r.is_test for r in some)
    assert sum(whole.values()) == 5


def test_pushed_filters(spark):
    plan = QUERIES["pushed_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan


def test_drawn_pages_come_in_small_frames():
    """A batch of suppliers is a few kB, its pages are GBs: a column of bytes ends at 2 GB."""
    import pandas as pd

    from ordina.plans.join_queries import draw_pages

    frames = list(draw_pages(iter([pd.DataFrame({"s_suppkey": range(a, b)}) for a, b in ((0, 100), (100, 101), (101, 101))])))
    assert [page for f in frames for page in f["page"]] == list(range(101))
    assert max(sum(map(len, f["gray"])) for f in frames) <= 8 << 20


def test_a_voice_that_ends_long_before_the_other(same_as_sql, tmp_path):
    """The rest behind it is cut at bars to the piece's end, so its length can be written."""
    import duckdb

    notes = "select user_id, 2 * n + user_id * 1000 + track as event_id from (values (2, 0, 9), (2, 1, 90), (3, 0, 400), (3, 1, 8), (4, 0, 60), (4, 1, 7), (5, 0, 60), (10, 1, 60), (11, 0, 60), (11, 1, 9)) v(user_id, track, size), range(size) r(n)"
    duckdb.execute(f"copy (select user_id, event_id, '{{\"k\": ' || event_id % 9 || '}}' as props from ({notes})) to '{tmp_path}/events.parquet' (format parquet)")
    same_as_sql(QUERIES["piece_rejection"], ORACLES["piece_rejection"], str(tmp_path))
