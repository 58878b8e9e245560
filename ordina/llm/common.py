"""What the training-data operators share: intermediate tables in the shared folder, link components, literals."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, materialise, new_table, shared_dir  # noqa: F401

#: A word: a maximal run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, so that every engine folds the same letters."""
    return F.translate(col, _UPPER, _UPPER.lower())


def word_count(col: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as tell it from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def literals(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    """A list of the driver's strings as a column, from one literal in the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(list(values))), "array<string>")).alias(name))


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph.

    ``edges`` has two long columns ``a`` and ``b``; loops and repeats are allowed. Returns ``node, root`` for every
    node that has an edge to another one and is not itself a root. Alternates large-star and small-star
    contractions, each a pre-aggregated minimum by node and a join that adaptive execution may split, so that a node
    with a third of all edges is no bottleneck; every round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    for _ in range(max_rounds):
        # A forest of stars: nothing that points to a root is pointed to, and each points once.
        state = edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
        if state.n <= 1 and not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        old = edges
        edges = materialise(_small_star(_large_star(edges)), "links")
        discard(old)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that together name a text; equal texts are one class in what follows."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


#: Hashes a 64-bit word of a prefilter, and least and most words: it follows the number of hashes up to 64 MB, whatever
#: the corpus. What it lets through by mistake, more of it beyond some 50 million hashes, is dropped by the exact steps
#: that follow.
PER_WORD, LEAST_WORDS, MOST_WORDS = 4, 1 << 14, 1 << 23
#: The bits of a hash lie in the word that its lowest bits number; these shifts give the slices that number the bits.
_SHIFTS = (34, 40, 46, 52, 58)


class HashFilter:
    """A blocked Bloom filter of 64-bit hashes that are already mixed: slices of a hash number its word and bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be among those that the filter was made of."""
        bits = np.zeros(len(hashes), np.uint64)
        for shift in _SHIFTS:
            bits |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        return self.words[(hashes & np.uint64(len(self.words) - 1)).astype(np.int64)] & bits == bits


def bits_of(v: Column, shifts: Sequence[int] = _SHIFTS) -> Column:
    """The bits that a 64-bit hash sets in its word of a filter, one for each slice of the hash."""
    out = F.lit(0).cast("long")
    for shift in shifts:
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(v, shift).bitwiseAND(F.lit(63)).cast("int")))
    return out


def hash_filter(hashes: DataFrame) -> HashFilter:
    """A filter of the long column ``v``; its words are put together by Spark, one row a hash before they are."""
    kept = materialise(hashes.select("v"), "hashes")
    n = max(1, kept.count())
    words = 1 << min(MOST_WORDS.bit_length() - 1, max(LEAST_WORDS.bit_length() - 1, (n // PER_WORD).bit_length()))
    found = kept.groupBy(F.col("v").bitwiseAND(F.lit(words - 1)).cast("int").alias("word")).agg(F.bit_or(bits_of(F.col("v"))).alias("set")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    discard(kept)
    return HashFilter(out)
