"""Joins: as-of, range, positional, cyclic, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import number_rows
from .sequence import over, running


def asof_strict(df: DataFrame, *, keys: Sequence[str], order: Sequence, states: dict[str, Column]) -> DataFrame:
    """For each row the last value of each state expression in rows strictly before it (null values do not count)."""
    before = running(keys, order, -1)
    return df.withColumns({name: F.last(value, ignorenulls=True).over(before) for name, value in states.items()})


def asof_inclusive(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """For each left row the value of the last right row at or before its time, or null.

    Both sides are stacked and carried forward by one window, so no row is compared with more than its neighbour. Right
    rows come first at equal times; of right rows at one time the largest value counts.
    """
    lefts = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    rights = right.select(F.lit(None).alias("_row"), *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    carried = F.last("_v", ignorenulls=True).over(running(keys, ["_t", "_side", "_v"]))
    return lefts.unionByName(rights).withColumn(name, carried).where("_side = 1").select("_row.*", name)


def zip_rows(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_order: Sequence, right_order: Sequence) -> tuple[DataFrame, DataFrame]:
    """Pair the n-th rows of each key; keys with unequal numbers of rows are rejected as a whole.

    Returns the pairs (with ``n``, from 1) and the rejected keys with both counts.
    """
    l = left.withColumns({"n": F.row_number().over(over(keys, left_order)), "_l": F.count("*").over(Window.partitionBy(*keys))})
    r = right.withColumns({"n": F.row_number().over(over(keys, right_order)), "_r": F.count("*").over(Window.partitionBy(*keys))})
    counts = l.groupBy(*keys).agg(F.max("_l").alias("n_left")).join(r.groupBy(*keys).agg(F.max("_r").alias("n_right")), list(keys), "full").na.fill(0, ["n_left", "n_right"])
    pairs = l.join(r, [*keys, "n"]).where("_l = _r").drop("_l", "_r")
    return pairs, counts.where("n_left <> n_right")


def split_at(df: DataFrame, bounds: DataFrame, *, keys: Sequence[str], start: str, end: str, bound: str, width: int, number: str = "piece") -> DataFrame:
    """Cut intervals at the bounds strictly inside them: all columns, with the ``number`` of the piece from 0.

    A range join on cells of ``width``: an interval meets the bounds of the cells that it touches, so an interval is
    compared with near bounds only. Choose the width near the usual length.
    """
    rows = df.withColumn("_id", F.struct(*df.columns))
    cells = rows.select("_id", *keys, start, end, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_cell"))
    cuts = bounds.select(*keys, F.col(bound).alias("_cut")).distinct().withColumn("_cell", F.floor(F.col("_cut") / width))
    inner = cells.join(cuts, [*keys, "_cell"]).where((F.col("_cut") > F.col(start)) & (F.col("_cut") < F.col(end))).groupBy("_id").agg(F.array_sort(F.collect_set("_cut")).alias("_cuts"))
    joined = rows.join(inner, "_id", "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast(f"array<{dict(df.dtypes)[start]}>")))
    edges = F.concat(F.array(F.col(start)), F.col("_cuts"), F.array(F.col(end)))
    rest = [c for c in df.columns if c not in (start, end)]
    return joined.withColumn("_edges", edges).select(*rest, "_edges", F.posexplode(F.slice("_edges", 1, F.size("_edges") - 1)).alias(number, start)).withColumn(end, F.get("_edges", F.col(number) + 1)).drop("_edges")


def align_by_time(df: DataFrame, *, keys: Sequence[str], time: str, spine: str, token: str, order: str, spines: Sequence, fill: str = ".") -> DataFrame:
    """One row a time with a column for each spine; the last token of a time counts, missing ones are ``fill``."""
    wide = df.groupBy(*keys, time).pivot(spine, list(spines)).agg(F.max_by(token, order))
    some = F.coalesce(*[F.col(f"`{s}`") for s in spines])
    return wide.where(some.isNotNull()).na.fill(fill, [str(s) for s in spines])


def cyclic_lookup(df: DataFrame, dim: DataFrame, *, keys: Sequence[str], order: Sequence, dim_order: Sequence, dim_value: str, name: str) -> DataFrame:
    """The k-th row of each key gets value k mod n of an ordered list of n values."""
    values = number_rows(dim.select(F.struct(*dim.columns).alias("_d")).select("_d.*"), order=dim_order, name="_i")
    n = values.count()
    if not n:
        return df.withColumn(name, F.lit(None).cast(dict(dim.dtypes)[dim_value]))
    numbered = df.withColumn("_i", F.pmod(F.row_number().over(over(keys, order)) - 1, F.lit(n)) + 1)
    return numbered.join(values.select("_i", F.col(dim_value).alias(name)), "_i").drop("_i")


def left_with_reason(left: DataFrame, right: DataFrame, *, on: Sequence[str], reason: str) -> DataFrame:
    """Left rows with ``reason`` where the right side has no match, and null where it has."""
    hit = right.select(*on).distinct().withColumn("_hit", F.lit(True))
    return left.join(hit, list(on), "left").withColumn("reason", F.when(F.col("_hit").isNull(), F.lit(reason))).drop("_hit")


def parity(left: DataFrame, right: DataFrame, *, keys: Sequence[str], voice: str, bar: str) -> DataFrame:
    """The first way in which the bars of two readings of a piece differ, for each key: null where they agree.

    Both have ``total`` and ``notes`` by key, voice and bar. Bars of no length are left out on either side and the others
    are matched by their place in the voice. Voices must be the same, then each voice's number of bars, then bar by bar
    the notes; totals may be larger on the left, but not above the longest bar of the voice on the right. Voices come
    in order, and a voice's number of bars before its bars.
    """
    by = [*keys, voice]
    sides = left.select(*by).distinct().withColumn("_l", F.lit(True)).join(right.select(*by).distinct().withColumn("_r", F.lit(True)), by, "full")

    def placed(df: DataFrame, side: str) -> DataFrame:
        n = F.row_number().over(over(by, [bar]))
        return df.where("total <> 0").select(*by, n.alias("_n"), F.col("total").alias(f"_{side}t"), F.col("notes").alias(f"_{side}n"))

    l, r = placed(left, "l"), placed(right, "r")
    counts = l.groupBy(*by).agg(F.count("*").alias("_lc")).join(r.groupBy(*by).agg(F.count("*").alias("_rc"), F.max("_rt").alias("_cap")), by, "full").na.fill(0, ["_lc", "_rc"])
    bars = l.join(r, [*by, "_n"]).join(counts, by)
    grown = (F.col("_lt") > F.col("_rt")) & (F.col("_lt") <= F.col("_cap"))
    first = [
        (sides, 0, F.lit(0), F.when(F.col("_l").isNull() | F.col("_r").isNull(), "voices")),
        (counts, 1, F.lit(0), F.when(F.col("_lc") != F.col("_rc"), "bar count")),
        (bars, 1, F.col("_n"), F.when(F.col("_ln") != F.col("_rn"), "notes").when((F.col("_lt") != F.col("_rt")) & ~grown, "total")),
    ]
    out = None
    for df, rank, n, why in first:
        part = df.select(*keys, F.struct(F.lit(rank).alias("rank"), F.col(voice).alias("voice"), n.cast("int").alias("n")).alias("_at"), why.alias("_why"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(F.min_by("_why", F.when(F.col("_why").isNotNull(), F.col("_at"))).alias("violation"))


def same_sequences(left: DataFrame, right: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Whether the ordered values of each key are the same on both sides, null values being equal; keys of either side."""

    def rows(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, F.row_number().over(over(keys, order)).alias("_n"), F.struct(*value).alias(side))

    both = rows(left, "_l").join(rows(right, "_r"), [*keys, "_n"], "full")
    return both.groupBy(*keys).agg(F.min(F.coalesce(F.col("_l").eqNullSafe(F.col("_r")), F.lit(False))).alias("same"))


def overlaps(df: DataFrame, *, keys: Sequence[str], start: str, end: str, tie: Sequence[str]) -> DataFrame:
    """Keys in which an interval begins before the one before it ends, with how often."""
    following = F.lead(start).over(over(keys, [start, *tie]))
    return df.withColumn("_hit", following < F.col(end)).groupBy(*keys).agg(F.count_if("_hit").alias("n_overlaps")).withColumn("rejected", F.col("n_overlaps") > 0)


def neighbour_limits(df: DataFrame, *, keys: Sequence[str], order: Sequence, top: str, bottom: str) -> DataFrame:
    """Half the gap to the neighbours above and below; null at the ends."""
    w = over(keys, order)
    return df.withColumns({"up_limit": (F.col(top) - F.lag(bottom).over(w)) / 2, "down_limit": (F.lead(top).over(w) - F.col(bottom)) / 2})


def connected_gaps(staves: DataFrame, ink: DataFrame, *, page: str = "page", share: float = 0.8) -> DataFrame:
    """Whether each staff is joined to the one above: some column is inked in ``share`` of the rows between them.

    ``staves`` has page, ``staff`` (from 0), ``top``, ``bottom``; ``ink`` has page, ``y``, ``x`` of the inked pixels. The gap
    between two staves is their rows; ink rows meet it by page and row, not by range.
    """
    w = over([page], ["staff"])
    gaps = staves.select(page, "staff", (F.lag("bottom").over(w) + 1).alias("y0"), (F.col("top") - 1).alias("y1"))
    rows = gaps.where("y1 > y0").select(page, "staff", (F.col("y1") - F.col("y0") + 1).alias("height"), F.explode(F.sequence("y0", "y1")).alias("y"))
    columns = rows.join(ink, [page, "y"]).groupBy(page, "staff", "height", "x").agg(F.count("*").alias("n"))
    joined = columns.where(F.col("n") >= share * F.col("height")).select(page, "staff").distinct().withColumn("joined", F.lit(True))
    return gaps.join(joined, [page, "staff"], "left").select(page, "staff", F.coalesce("joined", F.lit(False)).alias("joined"))
