"""Quality gates: ordered rejection reasons, counted and never silent; preconditions that stop a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds, null if none does. Checks that are null do not hold."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def with_reason(df: DataFrame, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    return df.withColumn("reject_reason", first_reason(checks))


def normal_reason(reason: Column, most: int | None = None) -> Column:
    """A reason without what follows `` -- ``, and at most ``most`` characters of it."""
    short = F.substring_index(reason, " -- ", 1)
    return F.left(short, F.lit(most)) if most else short


def reason_counts(df: DataFrame) -> DataFrame:
    return df.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


def funnel(df: DataFrame) -> DataFrame:
    """How many rows were examined, accepted and rejected."""
    ok = F.col("reject_reason").isNull()
    return df.agg(F.count("*").alias("examined"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def contiguous(df: DataFrame, *, keys: Sequence[str], number: str) -> DataFrame:
    """Whether the numbers of each key are 0 to n - 1, each once."""
    n = F.count("*")
    return df.groupBy(*keys).agg(((F.min(number) == 0) & (F.max(number) == n - 1) & (F.count_distinct(number) == n)).alias("contiguous"))


def require(df: DataFrame, test: Column, message: str) -> None:
    """Stop unless the one-row aggregate ``test`` holds over ``df``."""
    if not df.agg(test.alias("ok")).first().ok:
        raise ValueError(message)


def require_fresh(source: DataFrame, expected: int, *, allow_partial: bool = False) -> None:
    """Stop if derived data were made from another number of rows than the source has."""
    if not allow_partial:
        require(source, F.count("*") == expected, f"derived data hold {expected} rows, the source another number")


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether both sides hold the same distinct rows, and how many are on one side only."""
    a, b = left.subtract(right).agg(F.count("*").alias("only_left")), right.subtract(left).agg(F.count("*").alias("only_right"))
    return a.join(b).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def build_reasons() -> Column:
    """Why the lines of a piece cannot be built, by the first check that fails.

    Columns: ``text``, ``spine_types``, ``n_multirests``, ``n_systems``, ``n_detected`` (systems), and by system the arrays
    ``pages``, ``detected_pages``, ``staves``, ``detected_staves``, ``fields`` (sorted), and ``kern_fields`` (sorted).
    """
    n = F.size("spine_types")

    def differs(a: str, b: str) -> Column:
        return F.exists(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)

    return first_reason([
        (F.contains("text", F.lit("*^")) | F.contains("text", F.lit("*v")), "spine split"),
        (~n.between(2, 8), "spine count"),
        (F.exists("spine_types", lambda t: t != "**kern"), "other spines"),
        (F.col("n_multirests") > 0, "multirest"),
        (F.col("n_systems") == 0, "no systems"),
        (F.col("n_detected") != F.col("n_systems"), "system count"),
        (differs("detected_pages", "pages"), "system on another page"),
        (differs("detected_staves", "staves"), "staff count"),
        (F.exists("fields", lambda f: ~f.eqNullSafe(F.col("kern_fields"))), "fields"),
    ])
