"""Sequence operators: windows over an explicit order within a key.

All take ``keys`` (the partition) and ``order`` (a total order within it). Spark shuffles once by the keys; chained
operators on the same keys reuse that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(keys: Sequence[str], order: Sequence) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys: Sequence[str], order: Sequence, last: int = Window.currentRow) -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, last)


def collapse(df: DataFrame, *, keys: Sequence[str], order: Sequence, symbol: str, blank) -> DataFrame:
    """Drop blanks and adjacent repeats; repeats with a blank between them stay."""
    before = F.lag(symbol).over(over(keys, order))
    return df.withColumn("_before", before).where((F.col(symbol) != blank) & (F.col("_before").isNull() | (F.col("_before") != F.col(symbol)))).drop("_before")


def collapse_symbol(df: DataFrame, *, keys: Sequence[str], order: Sequence, symbol: str, value) -> DataFrame:
    """Drop adjacent repeats of one symbol only."""
    before = F.lag(symbol).over(over(keys, order))
    again = (F.col(symbol) == value) & F.coalesce(F.col("_before") == value, F.lit(False))
    return df.withColumn("_before", before).where(~again).drop("_before")


def run_id(df: DataFrame, *, keys: Sequence[str], order: Sequence, by: Sequence[str], name: str = "run") -> DataFrame:
    """Number the maximal runs of rows with equal ``by`` (gaps and islands), from 1."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(over(keys, order)))
    first = F.row_number().over(over(keys, order)) == 1
    return df.withColumn("_new", (first | ~same).cast("int")).withColumn(name, F.sum("_new").over(running(keys, order)).cast("long")).drop("_new")


def islands(df: DataFrame, *, keys: Sequence[str], order: Sequence, by: str) -> DataFrame:
    """One row a run: keys, ``run``, the symbol, its length."""
    return run_id(df, keys=keys, order=order, by=[by]).groupBy(*keys, "run", by).agg(F.count("*").alias("length"))


def longest_run(df: DataFrame, *, keys: Sequence[str], order: Sequence, by: str) -> DataFrame:
    """Length of the longest run of each symbol."""
    return islands(df, keys=keys, order=order, by=by).groupBy(*keys, by).agg(F.max("length").alias("longest"))


def decode_spans(df: DataFrame, *, keys: Sequence[str], order: Sequence, symbol: str, blank, weight: str) -> DataFrame:
    """Runs of a symbol other than ``blank`` with first and last frame (from 0) and mean weight, rounded half to even."""
    frames = df.withColumn("_frame", F.row_number().over(over(keys, order)) - 1)
    runs = run_id(frames, keys=keys, order=order, by=[symbol])
    return (
        runs.where(F.col(symbol) != blank)
        .groupBy(*keys, "run", symbol)
        .agg(F.min("_frame").cast("long").alias("f0"), F.max("_frame").cast("long").alias("f1"), F.bround(F.avg(weight), 4).alias("confidence"))
    )


def segment(df: DataFrame, *, keys: Sequence[str], order: Sequence, symbol: str, separator, name: str = "record") -> DataFrame:
    """Rows between separators, numbered from 0 by the separators before them; the separators go, and empty records with them."""
    count = F.sum((F.col(symbol) == separator).cast("int")).over(running(keys, order))
    return df.withColumn(name, count.cast("long")).where(F.col(symbol) != separator)


def bar_sums(df: DataFrame, *, keys: Sequence[str], order: Sequence, symbol: str, barline, ticks: Column, is_note: Column) -> DataFrame:
    """Whole and notes-only ticks of each bar; bars of nothing are dropped, an open last bar is kept."""
    bars = segment(df, keys=keys, order=order, symbol=symbol, separator=barline, name="bar")
    sums = bars.groupBy(*keys, "bar").agg(F.sum(ticks).cast("long").alias("total"), F.sum(F.when(is_note, ticks).otherwise(0)).cast("long").alias("notes"))
    return sums.where("total <> 0")


def running_offset(df: DataFrame, *, keys: Sequence[str], order: Sequence, size: str, name: str = "offset") -> DataFrame:
    """Sum of all sizes before a row."""
    return df.withColumn(name, F.coalesce(F.sum(size).over(running(keys, order, -1)), F.lit(0)).cast("long"))


def running_best(df: DataFrame, *, keys: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """The smallest value so far, and whether a row is strictly better than all before it."""
    before = F.min(value).over(running(keys, order, -1))
    return df.withColumns({"best": F.min(value).over(running(keys, order)), "improved": before.isNull() | (F.col(value) < before)})


def first_non_null(df: DataFrame, *, keys: Sequence[str], order: Sequence, columns: Sequence[str]) -> DataFrame:
    """For each key the first value of each column that is not null, in the order given."""
    ranked = df.withColumn("_n", F.row_number().over(over(keys, order)))
    return ranked.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in columns])


def assemble_measures(df: DataFrame, *, keys: Sequence[str], order: Sequence, symbol: str, barline, opener: str) -> DataFrame:
    """Group what stands between barlines into measures that keep what opened them.

    A measure is opened by its first content row and closed by a barline; a barline without an open measure is
    dropped. Returns keys, ``measure`` (from 0), ``events``, ``opened_by`` (the first row's ``opener``), ``closed``.
    """
    is_bar = F.col(symbol) == barline
    before = F.coalesce(F.sum(is_bar.cast("int")).over(running(keys, order, -1)), F.lit(0))
    rows = df.withColumns({"_closed": before, "_at": F.row_number().over(over(keys, order))})
    found = rows.groupBy(*keys, "_closed").agg(
        F.count_if(~is_bar).alias("events"), F.min_by(opener, F.when(~is_bar, F.col("_at"))).alias("opened_by"), F.max(is_bar).alias("closed")
    )
    number = F.row_number().over(over(keys, ["_closed"])) - 1
    return found.where("events > 0").withColumn("measure", number.cast("long")).drop("_closed")


def edge_marks(df: DataFrame, *, keys: Sequence[str], order: Sequence, name: str = "mark") -> DataFrame:
    """``[`` on the first of several rows of a key, ``]`` on the last, ``_`` between; nothing on a single row."""
    n, size = F.row_number().over(over(keys, order)), F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(size == 1, "").when(n == 1, "[").when(n == size, "]").otherwise("_"))


def beam_marks(df: DataFrame, *, keys: Sequence[str], order: Sequence, group: Sequence[str], beamable: Column) -> DataFrame:
    """``L`` on the first and ``J`` on the last row of each run of two or more beamable rows of one group."""
    marked = df.withColumn("_beamable", F.coalesce(beamable, F.lit(False)))
    runs = run_id(marked, keys=keys, order=order, by=[*group, "_beamable"], name="_run")
    n, size = F.row_number().over(over([*keys, "_run"], order)), F.count("*").over(Window.partitionBy(*keys, "_run"))
    mark = F.when(~F.col("_beamable") | (size < 2), "").when(n == 1, "L").when(n == size, "J").otherwise("")
    return runs.withColumn("beam", mark).drop("_run", "_beamable")


def fill_gaps(df: DataFrame, *, keys: Sequence[str], start: str, end: str, origin: int, until: int) -> DataFrame:
    """Intervals with the rests between them: keys, start, end, ``is_rest``.

    Rests fill from ``origin`` to the first interval, between intervals and up to ``until``; intervals before
    ``origin`` are skipped. The intervals of a key must not overlap.
    """
    kept = df.where(F.col(start) >= origin).select(*keys, start, end)
    before = F.coalesce(F.lag(end).over(over(keys, [start])), F.lit(origin))
    last = kept.groupBy(*keys).agg(F.max(end).alias(start)).where(F.col(start) < until).select(*keys, start, F.lit(until).cast("long").alias(end))
    rests = kept.withColumn("_before", before.cast("long")).where(F.col(start) > F.col("_before")).select(*keys, F.col("_before").alias(start), F.col(start).alias(end))
    return kept.withColumn("is_rest", F.lit(False)).unionByName(rests.unionByName(last).withColumn("is_rest", F.lit(True)))


def line_ranges(df: DataFrame, *, keys: Sequence[str], order: Sequence, start: str, end_of_all: str) -> DataFrame:
    """Each row's range: its start to the row before the next start, or to the end."""
    following = F.lead(start).over(over(keys, order))
    return df.withColumn("end", F.coalesce(following - 1, F.col(end_of_all)))


def first_of_group(df: DataFrame, *, keys: Sequence[str], order: Sequence, name: str = "is_first") -> DataFrame:
    return df.withColumn(name, F.row_number().over(over(keys, order)) == 1)


def top_rows_mean(df: DataFrame, *, keys: Sequence[str], rank_by: Sequence, value: str, n: int) -> DataFrame:
    """Mean of a value over the ``n`` rows that come first; 0 for a key without rows that count."""
    top = df.withColumn("_n", F.row_number().over(over(keys, rank_by))).where(F.col("_n") <= n)
    return top.groupBy(*keys).agg(F.avg(value).alias("top_mean"))
