"""Deterministic sampling, splitting and batching: functions of keys and seeds, never of row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise


def hash_fraction(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of sha256(seed:key)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def bernoulli(df: DataFrame, *, key: str, seed: str, share: float) -> DataFrame:
    """Rows whose key draws a number below ``share``."""
    return df.where(hash_fraction(F.col(key).cast("string"), seed) < share)


def categorical(key: Column, seed: str, options: Sequence) -> Column:
    """One of the options by key."""
    at = F.floor(hash_fraction(key.cast("string"), seed) * len(options)).cast("int")
    return F.get(F.array(*map(F.lit, options)), at)


def number_rows(df: DataFrame, *, order: Sequence, name: str) -> DataFrame:
    """``df`` with the number of each row in a total order, from 1; ties are numbered in any way.

    Rows are sorted by range and written once, so that all that follows sees the same ranges; a count a task gives each
    range its first number. No task holds more than its range.
    """
    at = F.monotonically_increasing_id()  # the task in the upper bits, the row within it in the lower 33
    table = materialise(df.orderBy(*order).withColumn("_at", at), "numbered").withColumn("_task", F.shiftright("_at", 33))
    counts = table.groupBy("_task").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    first = counts.select("_task", before.alias("_before"))
    return table.join(first, "_task").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_task", "_before")


def epoch_size(lines: DataFrame, *, first: Column, ratio: float) -> DataFrame:
    """One row: lines of the first source and of the others, and of an epoch that takes ``ratio`` times as many of the
    others as there are of the first, or all of them where that is not less."""
    pools = lines.agg(F.count_if(first).alias("n_first"), F.count_if(~first).alias("n_other"))
    want = F.bround(F.col("n_first") * F.lit(ratio), 0)
    return pools.withColumn("epoch", (F.col("n_first") + F.least(want, F.col("n_other"))).cast("long"))


def named_split(lines: DataFrame, names: DataFrame, *, key: str = "piece") -> DataFrame:
    """The lines of the named pieces; refused if a piece has no line."""
    missing = names.select(key).distinct().join(lines.select(key).distinct(), key, "left_anti")
    some = [r[0] for r in missing.orderBy(key).limit(3).collect()]
    if some:
        raise ValueError(f"{missing.count()} pieces are missing, e.g. {some}")
    return lines.join(names.select(key).distinct(), key, "left_semi")


def option_key(options: str | Column) -> Column:
    """The identity of a map of options, whatever the order of its entries."""
    return F.to_json(F.array_sort(F.map_entries(options)))


def rank_by_hash(df: DataFrame, *, key: str, seed: str, name: str = "rank") -> DataFrame:
    """Number rows in hash order, from 1.

    One number over all rows needs one order. Rows are dealt into ranges of the hash; ranges are numbered by prefix
    sums of their counts, so rows of one range are all that is sorted together.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_range", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 rows at most
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    return hashed.join(counts.select("_range", before.alias("_before")), "_range").withColumn(name, (F.col("_before") + within).cast("long")).drop("_h", "_range", "_before")


def sample_exact(df: DataFrame, *, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows that come first in hash order: each task keeps its own first ``n`` only."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def split_groups(df: DataFrame, *, group: str, seed: str, share: float = 0.1) -> DataFrame:
    """``is_test`` for all rows of a share of the groups: max(1, the share rounded half to even) of them."""
    groups = rank_by_hash(df.select(group).distinct(), key=group, seed=seed, name="_rank")
    total = groups.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(share), 0)).alias("_tests"))
    tests = groups.join(F.broadcast(total)).select(group, (F.col("_rank") <= F.col("_tests")).alias("is_test"))
    return df.join(tests, group)


def ratio_mix(first: DataFrame, second: DataFrame, *, key: str, seed: str, ratio: float) -> DataFrame:
    """All of ``first`` and round(size * ratio) of ``second`` in hash order, or all of it where that is less."""
    want = first.agg(F.bround(F.count("*") * F.lit(ratio), 0).alias("_want"))
    ranked = rank_by_hash(second, key=key, seed=seed, name="_rank").join(F.broadcast(want))
    return first.unionByName(ranked.where("_rank <= _want").drop("_rank", "_want"))


def shard(df: DataFrame, *, order: Sequence[str], k: int, n: int, limit: int | None = None) -> DataFrame:
    """Of the first ``limit`` rows in order each n-th, from the k-th (from 0): limit first, then stride."""
    kept = df.orderBy(*order).limit(limit) if limit is not None else df
    return number_rows(kept, order=order, name="_n").where(F.pmod(F.col("_n") - 1, F.lit(n)) == k).drop("_n")


def evenly_spaced(df: DataFrame, *, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows at equal distances in order, the first and the last among them."""
    rows = number_rows(df, order=order, name="_n")
    n = rows.count()
    return rows.where((F.col("_n") - 1).isin([i * (n - 1) // max(1, k - 1) for i in range(k)])).drop("_n")


def buckets(df: DataFrame, *, order: Sequence[str], size: int, name: str = "batch") -> DataFrame:
    """Number batches of ``size`` rows in order."""
    return number_rows(df, order=order, name=name).withColumn(name, F.floor((F.col(name) - 1) / size).cast("long"))


def stable_key(path: Column, prefix: str = "pdmx_") -> Column:
    """A short name from the content of a path."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.encode(path, "UTF-8")), 1, 10))


def natural_key(name: Column) -> Column:
    """Sort key by the numbers in a name, so that s99 comes before s100."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def dedup_first(df: DataFrame, *, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def vocabulary(df: DataFrame, *, tokens: str) -> DataFrame:
    """Sorted distinct tokens with their ids from 1. The result is a dictionary: small beside its corpus."""
    distinct = df.select(F.explode(tokens).alias("token")).distinct()
    return number_rows(distinct, order=["token"], name="id").select("token", "id")


def encode(df: DataFrame, vocab: DataFrame, *, token: str, default: int = 1) -> DataFrame:
    """Ids of tokens, and whether the vocabulary has them (``known``); those that it lacks get ``default``."""
    found = df.join(vocab.select(F.col("token").alias(token), "id"), token, "left")
    return found.withColumns({"known": F.col("id").isNotNull(), "id": F.coalesce("id", F.lit(default))})


def take_accepted(df: DataFrame, *, key: str, seed: str, accepted: Column, n: int) -> DataFrame:
    """The first ``n`` accepted rows in hash order, as if rows were examined one by one."""
    return sample_exact(df.where(accepted), key=key, seed=seed, n=n)
