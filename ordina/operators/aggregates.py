"""Aggregates with the tie and rounding rules that results depend on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict names, fixed values; and the share of systems from which one size counts as the usual one.
EMPTY, CLOSED, MIXED, SUSPECT, STEADY = "leer", "closed score", "wechselndes Satzbild", "verdaechtig", "konsistent"
MIN_MAJORITY = 0.6
#: Staves of a closed score, and the white share and run length up to which a page counts as a scan: fixed values.
CLOSED_STAVES, SCAN_WHITE_MAX, SCAN_RUN_MAX = 2, 0.875318, 0.385546


def mode(df: DataFrame, *, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Most frequent value of each key as ``mode`` with its ``share``; of equally frequent ones the ``smaller`` or ``larger``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    pick = F.max(F.struct("_n", F.col(value).alias("v"))) if tie == "larger" else F.max(F.struct("_n", (-F.col(value)).alias("v")))
    best = counts.groupBy(*keys).agg(pick.alias("_best"), F.sum("_n").alias("_all"))
    found = F.col("_best.v") if tie == "larger" else -F.col("_best.v")
    return best.select(*keys, found.alias("mode"), (F.col("_best._n") / F.col("_all")).alias("share"))


def upper_median(value: str) -> Column:
    """Element n // 2 (from 0) of the sorted values: the larger of the two in the middle. Values are counted, not gathered."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)")


def median_or_zero(value: str | Column) -> Column:
    """The interpolated median, 0.0 without values."""
    return F.coalesce(F.median(value), F.lit(0.0))


def percentiles(value: str, points: Sequence[float]) -> list[Column]:
    """Exact interpolated percentiles; null without values."""
    return [F.percentile(value, p).cast("double").alias(f"p{round(100 * p)}") for p in points]


def consistency(df: DataFrame, *, keys: Sequence[str], index: str, size: str, pieces: DataFrame | None = None) -> DataFrame:
    """Whether the systems of a piece have one size: modal size, share, verdict and the suspect systems.

    A size of exactly two that is the usual one is a closed score; without a usual one (:data:`MIN_MAJORITY`) the layout
    is mixed; otherwise systems of fewer than the usual number are suspect, and larger ones never. Only pieces with a
    usual number have suspects. Of ``pieces``, if given, those without a system are empty: null size, share 0.
    """
    usual = mode(df, keys=keys, value=size, tie="larger")
    few = F.col(size) < F.col("mode")
    entry = F.struct(F.col(index).alias("system"), (F.col("mode") - F.col(size)).alias("missing"))
    found = df.join(usual, list(keys)).groupBy(*keys, "mode", "share").agg(F.array_sort(F.collect_list(F.when(few, entry))).alias("_few"))
    if pieces is not None:
        found = pieces.select(*keys).distinct().join(found, list(keys), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    known = F.col("share") >= MIN_MAJORITY
    verdict = (
        F.when(F.col("mode").isNull(), EMPTY).when(known & (F.col("mode") == CLOSED_STAVES), CLOSED).when(~known, MIXED).when(F.size("_few") > 0, SUSPECT).otherwise(STEADY)
    )
    out = found.withColumn("verdict", verdict)
    return out.withColumn("suspects", F.when(F.col("verdict") == SUSPECT, F.col("_few")).otherwise(F.slice("_few", 1, 0))).drop("_few")


def top_n(df: DataFrame, *, value: str, n: int, first_seen: str | None = None) -> DataFrame:
    """The ``n`` most frequent values; of equally frequent ones the first seen, or else the smallest."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), *([F.min(first_seen).alias("_first")] if first_seen else []))
    return counts.orderBy(F.desc("n"), "_first" if first_seen else value).limit(n).select(value, "n")


def bounding_box(df: DataFrame, *, keys: Sequence[str], x: str, y: str, w: str, h: str) -> DataFrame:
    """Union of boxes: smallest corner and the extent to the farthest one."""
    return df.groupBy(*keys).agg(
        F.min(x).alias("x"), F.min(y).alias("y"), (F.max(F.col(x) + F.col(w)) - F.min(x)).alias("w"), (F.max(F.col(y) + F.col(h)) - F.min(y)).alias("h")
    )


def strata(df: DataFrame, *, stratum: str, value: str, digits: int = 6) -> DataFrame:
    """Macro mean by stratum and over all (``all``)."""
    rolled = df.rollup(stratum).agg(F.grouping(stratum).alias("_all"), F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"))
    return rolled.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(stratum)).alias("stratum"), "n", "mean")


def set_digest(df: DataFrame, *, keys: Sequence[str], name: str) -> DataFrame:
    """SHA-256 of the sorted names joined by line ends."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(name)), "\n"), 256).alias("digest"))


def crosstab(df: DataFrame, *, a: str, b: str) -> DataFrame:
    """Counts by ``v{a}->F{b}``."""
    return df.groupBy(F.format_string("v%d->F%d", a, b).alias("pair")).agg(F.count("*").alias("n"))


def position_matches(a: str, b: str) -> Column:
    """Number of places at which two arrays hold the same; the longer one's rest does not count."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("long")


def scan_decision(pages: DataFrame, systems: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Verdict on each score: ``white, run, modal_staves, scan_suspected, reason, rejected``.

    ``pages`` has ``white_frac`` and ``run_frac``, ``systems`` has ``staves``. Medians over the pages tell a scan, of which
    is only warned. No system at all rejects, and so does a usual number of two staves (ties: fewer), unless the
    score looks like a scan.
    """
    scan = pages.groupBy(*keys).agg(median_or_zero("white_frac").alias("white"), median_or_zero("run_frac").alias("run"))
    usual = mode(systems, keys=keys, value="staves", tie="smaller").select(*keys, F.col("mode").alias("modal_staves"))
    both = scan.join(usual, list(keys), "left").na.fill(0, ["modal_staves"])
    suspected = (F.col("white") <= SCAN_WHITE_MAX) | (F.col("run") <= SCAN_RUN_MAX)
    reason = F.when(F.col("modal_staves") == 0, "no-staves-found").when(~suspected & (F.col("modal_staves") == CLOSED_STAVES), "closed-score-suspected")
    return both.withColumns({"scan_suspected": suspected, "reason": reason}).withColumn("rejected", F.col("reason").isNotNull())
