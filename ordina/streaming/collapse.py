"""An extension beyond batch: collapse and windowed counts over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def collapse_stream(events: DataFrame, *, key: str, order: str, symbol: str, blank: str) -> DataFrame:
    """Streaming collapse: ``key, order, symbol`` of events that are no blank and no repeat of the one before them.

    The state of a key is its last symbol. Events of a micro-batch are ordered; a batch must not hold events from
    before an earlier one.
    """
    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {symbol} string"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        before = rows[symbol].shift(1)
        before.iloc[0] = state.get[0] if state.exists else None
        state.update((rows[symbol].iloc[-1],))
        kept = rows[(rows[symbol] != blank) & (rows[symbol] != before)]
        yield kept[[key, order, symbol]]

    return events.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, *, time: str, symbol: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and symbol with a watermark; times without a zone are taken as UTC."""
    stamped = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return stamped.groupBy(F.window("_time", window), symbol).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
