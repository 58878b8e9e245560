"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import number_rows
from .common import materialise, word_count


def targets(sizes: DataFrame, *, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``_source, source_size, target`` (words to take) of sources ``_source, n``, however many there are.

    The sources, in order, weigh ``weights`` repeating and share ``share`` times all sizes. None gets more than ``cap``
    times its own size; what is above is shared again by weight among the rest until none is above: the level is
    raised by one aggregate a round, until no further source is cut off.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_i") - 1, F.lit(len(weights))).cast("int"))
    found = materialise(number_rows(sizes, order=["_source"], name="_i").select("_source", "n", weight.alias("_weight")), "mix-sources")
    whole = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    level, cut = -1.0, -1
    while True:
        over = F.col("_weight") * F.lit(level) >= F.lit(float(cap)) * F.col("n")
        got = found.agg(
            F.count_if(over).alias("cut"), F.sum(F.when(over, F.lit(float(cap)) * F.col("n")).otherwise(0.0)).alias("given"), F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))).alias("load")
        ).first()
        if got.cut == cut or not got.load:
            break
        cut, level = got.cut, (share * whole - got.given) / got.load
    level = level if got.load else float("inf")
    goal = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.col("_weight") * F.lit(level), F.lit(float(cap)) * F.col("n")))
    return found.select("_source", F.col("n").alias("source_size"), goal.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    keep: Sequence[str] = (),
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    key_digits: int = 3,
) -> DataFrame:
    """Decide how many words the mix takes from each document.

    Returns one row per row of ``docs``: id, ``keep`` columns, ``size``, ``source_size``, ``target`` (of its source)
    and ``taken``. Documents of a source stand in the order of md5(seed:id): whole epochs come first, then documents
    until the source's budget (its target rounded down) is used up; the document at the cut gives a part.

    The order is dealt into 16 ** ``key_digits`` ranges of the hash key, so a source that holds a third of all rows
    is spread over as many tasks: sums by (source, range) are pre-aggregated, their prefix sums give each range its
    offset, and only the rows of one range are sorted together.

    Null text: size 0. Null source: a source of its own, last. Null id: hashed as ``null``. Rows that repeat each
    take their own share of the order. An empty table gives an empty result. Other columns are ignored.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("_source"),
        size.alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_key"),
        F.struct(*[F.col(c) for c in keep]).alias("_kept") if keep else F.lit(None).cast("int").alias("_kept"),
    ).withColumn("_range", F.substring("_key", 1, key_digits))

    sums = materialise(rows.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum")), "mix-sums")
    plan = targets(sums.groupBy("_source").agg(F.sum("_sum").cast("long").alias("n")), weights=weights, share=share, cap=cap)
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(plan, "_source").drop("_sum")

    # The rest of the ordering only matters where ids repeat.
    order = ["_key", "_id", "_size", *([F.xxhash64("_kept")] if keep else [])]
    within = Window.partitionBy("_source", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    budget, whole = F.floor("target"), F.greatest("source_size", F.lit(1))
    epochs = F.floor(budget / whole)
    start = F.col("_offset") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    return (
        rows.join(offsets, ["_source", "_range"])
        .withColumn("_start", start)
        .withColumn("_part", F.greatest(F.lit(0), F.least("_size", budget - epochs * F.col("source_size") - F.col("_start"))))
        .select(
            F.col("_id").alias(id_col),
            *[F.col(f"_kept.{c}").alias(c) for c in keep],
            F.col("_size").alias("size"),
            "source_size",
            "target",
            (epochs * F.col("_size") + F.col("_part")).cast("long").alias("taken"),
        )
    )
