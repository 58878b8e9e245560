"""URL rules by Bloom filter cascades: exact membership over the corpus's own keys, without joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, literals, materialise

#: A cascade is part of the plan that every task gets. It takes a few bits for each listed key, whatever the corpus. Lists
#: whose first level would take more are joined instead, with the same results.
MAX_BITS = 1 << 24


class TooLarge(ValueError):
    """A list whose cascade would pass :data:`MAX_BITS`."""


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions, ``probes`` hashes, the set positions as 64-bit words."""

    number: int
    bits: int
    probes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.bits)) for i in range(self.probes)]

    def contains(self, key: Column) -> Column:
        """Whether the filter holds ``key``, or takes it for one that it holds."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in self.positions(key):
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            out = out & (F.getbit(word, (at % 64).cast("int")) == 1)
        return out


def _level(number: int, keys: DataFrame, n: int, rate: float) -> Level:
    """The Bloom filter of ``n`` distinct keys at a rate of false positives."""
    bits = 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    if bits > MAX_BITS:
        raise TooLarge(f"the filter of {n} keys takes {bits} bits; the bound is {MAX_BITS}")
    empty = Level(number, bits, max(1, math.ceil(-math.log2(rate))), ())
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    found = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("set")).collect()  # bits / 64 at most
    words = [0] * (bits // 64)
    for r in found:
        words[r.word] = r.set
    return Level(number, bits, empty.probes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    """Levels 1, 3, 5, ... hold listed keys, levels 2, 4, ... the others that the level before takes for listed."""

    levels: tuple[Level, ...]

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def contains(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for keys of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.contains(key), out).otherwise(F.lit(level.number % 2 == 0))
        return out if self.levels else F.lit(False)


def build_cascade(listed: DataFrame, universe: DataFrame, *, max_levels: int = 64) -> Cascade:
    """A cascade that tells the keys of ``listed`` from all other keys of ``universe`` (each a column ``key``).

    The first level's rate is that of the smallest whole (the share of listed keys in the universe), so the second
    level holds about as many keys as are listed and the size follows the list, not the corpus. One pass over the
    universe finds the first level's false positives; later levels look only at those and at the list. Null keys
    are never listed. An empty list gives a cascade that holds nothing.
    """
    listed = materialise(listed.where("key is not null").select("key").distinct(), "listed")
    universe = universe.where("key is not null").select("key")
    n = listed.count()
    if not n:
        return Cascade(())
    whole = universe.agg(F.approx_count_distinct("key").alias("n")).first().n
    levels = [_level(1, listed, n, min(0.5, math.sqrt(0.5) * n / max(whole, 1)))]
    wrong = universe.where(levels[0].contains(F.col("key"))).distinct().join(listed, "key", "left_anti")
    inside, outside = listed, materialise(wrong, "taken-for-listed")
    while len(levels) < max_levels:
        odd = len(levels) % 2 == 1  # the next level encodes keys that are not listed
        m = (outside if odd else inside).count()
        if not m:
            discard(outside, listed)
            return Cascade(tuple(levels))
        levels.append(_level(len(levels) + 1, outside if odd else inside, m, 0.5))
        test = levels[-1].contains(F.col("key"))
        inside, outside = (inside.where(test), outside) if odd else (inside, outside.where(test))
    raise RuntimeError(f"the cascade did not end in {max_levels} levels")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (up to ``? #``); both empty without one."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_keys(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """All keys by which one of ``rules`` (host then path) can fit: the host and its parents with the path's prefixes.

    Only as many labels and only those prefix lengths that the rules have, so a host of thousands of labels or a long
    path makes no more keys.
    """
    split = [(r[: r.find("/")], r[r.find("/") :]) if "/" in r else (r, "") for r in rules]
    labels = max(h.count(".") + 1 for h, _ in split)
    names = F.split(host, r"\.")
    size = F.size(names)
    keys = []
    for depth in range(1, labels + 1):
        tail = F.when(size >= depth, F.array_join(F.slice(names, F.greatest(size - depth + 1, F.lit(1)), F.lit(depth)), "."))
        for n in sorted({len(p) for _, p in split}):
            start = F.substr(path, F.lit(1), F.lit(n)) if n else F.lit("")
            keys.append(F.when((size >= depth) & (F.length(path) >= n), F.concat(tail, start)))
    return F.array_compact(F.array(*keys))


def judge_urls(
    pages: DataFrame,
    *,
    allow: Sequence[str],
    block: Sequence[str],
    blocked_hosts: Sequence[str] = (),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict on every URL: id, ``host``, ``path``, ``rule``, ``verdict``.

    A rule is a host followed by the start of a path; it fits that host and its subdomains. The longest rule wins. Where
    none fits, a host that is listed in ``blocked_hosts``, or under one that is, is blocked and all others allowed.
    Three cascades (allowed, blocked, blocked hosts) over the keys of all URLs answer by themselves; no join is made
    unless a list is so long that its cascade would pass ``MAX_BITS``: then the keys of all three are joined with the lists.

    A null URL or one without ``://`` has an empty host and path, which no rule fits. Rows that repeat are judged each;
    a null id stays null; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rules = [*allow, *block]
    keys = rule_keys(F.col("host"), F.col("path"), rules) if rules else F.array().cast("array<string>")
    parents = rule_keys(F.col("host"), F.lit(""), blocked_hosts) if blocked_hosts else F.array().cast("array<string>")

    def cascade(listed: Sequence[str], keys: Column) -> Cascade:
        return build_cascade(literals(spark, listed, "key"), rows.select(F.explode(keys).alias("key"))) if listed else Cascade(())

    try:
        allowed, blocked, bad = cascade(allow, keys), cascade(block, keys), cascade(blocked_hosts, parents)
    except TooLarge:
        return _judge_by_join(rows, id_col, keys, parents, allow, block, blocked_hosts)
    hit = F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), allowed.contains(k).alias("allow"), blocked.contains(k).alias("block")))
    best = F.array_max(F.filter(hit, lambda x: x["allow"] | x["block"]))
    return _verdicts(rows.withColumns({"_best": best, "_bad": F.exists(parents, lambda k: bad.contains(k))}), id_col)


def _verdicts(judged: DataFrame, id_col: str) -> DataFrame:
    verdict = F.when(F.coalesce(F.col("_best.allow"), ~F.col("_bad")), "allow").otherwise("block")
    return judged.select(id_col, "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"))


def _judge_by_join(rows: DataFrame, id_col: str, keys: Column, parents: Column, allow: Sequence[str], block: Sequence[str], hosts: Sequence[str]) -> DataFrame:
    """The verdicts by joins of the distinct hosts' and paths' keys with the lists, of whatever length."""
    spark = rows.sparkSession
    listed = literals(spark, allow, "key").select("key", F.lit("allow").alias("kind")).union(literals(spark, block, "key").select("key", F.lit("block"))).union(literals(spark, hosts, "key").select("key", F.lit("host")))
    kinds = listed.groupBy("key").agg(F.max(F.col("kind") == "allow").alias("allow"), F.max(F.col("kind") == "block").alias("block"), F.max(F.col("kind") == "host").alias("bad"))
    asked = F.concat(F.transform(keys, lambda k: F.struct(F.lit(False).alias("parent"), k.alias("key"))), F.transform(parents, lambda k: F.struct(F.lit(True).alias("parent"), k.alias("key"))))
    places = rows.select("host", "path").distinct()
    met = places.select("host", "path", F.inline(asked)).join(kinds, "key")
    rule = F.when(~F.col("parent") & (F.col("allow") | F.col("block")), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "allow", "block"))
    found = met.groupBy("host", "path").agg(F.max(rule).alias("_best"), F.max(F.col("parent") & F.col("bad")).alias("_bad"))
    return _verdicts(rows.join(found, ["host", "path"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False))), id_col)
