"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import kernels as K
from .common import components, discard, free_name, hash_filter, materialise, text_key

#: Shingles and words whose counts order the prefixes, and slots of the tables of them that all tasks get (10 MB). The
#: sizes are fixed whatever the corpus, and any order gives the same result: it only tells how many candidates arise.
HEAVY, WORDS = 1 << 17, 1 << 16
HEAVY_SLOTS, WORD_SLOTS = 1 << 22, 1 << 20
#: Shingles a range of the suffix filter, at most and on average.
PER_RANGE = 16
#: 64-bit words that tell, a bit each, in which of as many ranges a set has an odd number of shingles.
ODD = 8
#: Texts that are verified against one copy of a pivot's text.
PER_PIVOT = 1024
#: Bytes of text that a task hashes at once, shingles that it counts together, and keys of texts that it remembers.
SLICE, RUN, SEEN = 1 << 20, 1 << 22, 1 << 18


class Order:
    """How frequent a shingle is, in 16ths of powers of two: as counted, or else as expected from its words."""

    def __init__(self, heavy: pa.Table, words: pa.Table, total: int):
        self.words = self._table(words, WORD_SLOTS, 0)
        self.heavy = self._table(heavy, HEAVY_SLOTS, -32768)
        self.total = round(16 * np.log2(max(total, 1)))

    @staticmethod
    def _table(counts: pa.Table, slots: int, empty: int) -> np.ndarray:
        out = np.full(slots, empty, np.int16)
        at = counts.column("v").to_numpy().view(np.uint64) >> np.uint64(65 - slots.bit_length())
        np.maximum.at(out, at, np.round(16 * np.log2(counts.column("n").to_numpy())).astype(np.int16))
        return out

    def expected(self, tokens: np.ndarray, width: int) -> np.ndarray:
        """For each run of ``width`` words the logarithm of how often chance alone makes it."""
        each = self.words[tokens >> np.uint64(65 - WORD_SLOTS.bit_length())].astype(np.int32)
        total = np.concatenate([[0], np.cumsum(each)])
        return total[width:] - total[:-width] - (width - 1) * self.total

    def counted(self, v: np.ndarray) -> np.ndarray:
        return self.heavy[v >> np.uint64(65 - HEAVY_SLOTS.bit_length())].astype(np.int32)


class Shingles:
    """The distinct shingles of each row of a string column, by row and hash."""

    def __init__(self, column: pa.Array, width: int, order: Order | None = None):
        data, offsets = K.text_bytes(column)
        starts, ends, first = K.words(data, offsets)
        self.tokens = tokens = K.word_hashes(data, starts, ends, lower=True)
        n = np.diff(first)
        full = K.rolling(tokens, width, seed=6)
        at = np.flatnonzero(K.room(first)[: len(full)] >= width)
        rows, values = [np.repeat(np.arange(len(n)), np.maximum(n - width + 1, 0))], [full[at]]
        for short in range(1, width):  # a text of fewer words is one shingle
            some = np.flatnonzero(n == short)
            if len(some):
                rows.append(some)
                values.append(K.rolling(tokens, short, seed=6 + short)[first[some]])
        row, v = np.concatenate(rows), np.concatenate(values)
        by = self._sorted(row, v, len(n))
        row, v = row[by], v[by]
        new = np.ones(len(v), bool)
        new[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
        self.row, self.v = row[new], v[new]
        self.first = np.searchsorted(self.row, np.arange(len(n) + 1))
        self.size = np.diff(self.first)
        if order is not None:
            rank = np.zeros(len(by), np.int32)
            rank[: len(at)] = order.expected(tokens, width)[at] if len(at) else 0
            self.rank = np.maximum(rank[by][new], order.counted(self.v))

    @staticmethod
    def _sorted(row: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        """Order by row and value; one sort of a joint key where it tells all values apart."""
        bits = max(1, int(n).bit_length())
        key = (row.astype(np.uint64) << np.uint64(64 - bits)) | (v >> np.uint64(bits))
        by = np.argsort(key)
        same = np.flatnonzero(key[by][1:] == key[by][:-1])
        return by if (v[by[same]] == v[by[same + 1]]).all() else np.lexsort((v, row))

    def prefixes(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the shingles in prefixes, rarest first within a row, and their places in the row's order."""
        bits = max(1, len(self.size).bit_length())
        rank = np.clip(self.rank + (1 << 14), 0, (1 << 15) - 1).astype(np.uint64)
        # A stable sort of shingles that are in order of their hash: equal ranks stay in that order.
        order = np.argsort((self.row.astype(np.uint64) << np.uint64(15)) | rank, kind="stable") if bits < 49 else np.lexsort((rank, self.row))
        place = np.arange(len(order)) - self.first[self.row]
        # Of two sets that link, each holds num/den of the other: as many shingles may be left out of the prefix, less one.
        length = self.size - -(-num * self.size // den) + 1
        keep = place < length[self.row]
        return order[keep], place[keep]

    def ranges(self) -> list[bytes]:
        """For each row how many shingles fall into each of 2**k equal ranges of the hash, a byte each.

        No bytes where a count does not fit one (adversarial hashes only): such a set passes the suffix filter.
        """
        out = []
        for size, a, b in zip(self.size.tolist(), self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            bits = max(0, -(-size // PER_RANGE) - 1).bit_length()
            count = np.bincount((self.v[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([size])
            out.append(count.astype(np.uint8).tobytes() if count.max() < 256 else b"")
        return out


    def odd(self) -> np.ndarray:
        """For each row ``ODD`` words: in which of 64 * ``ODD`` ranges of the hash an odd number of its shingles lies."""
        out, some = np.zeros((len(self.size), ODD), np.uint64), np.flatnonzero(self.size)
        at = self.v >> np.uint64(64 - (64 * ODD).bit_length() + 1)
        word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
        for i in range(ODD if len(some) else 0):
            out[some, i] = np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), self.first[some])
        return out


def most_common(a: bytes, b: bytes) -> int:
    """Most shingles that two sets with these counts by range can share: in each range the smaller count."""
    if not a or not b:
        return 1 << 62
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(x) < len(y):
        y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.minimum(x, y).sum())


def least_overlap(a, b, num: int, den: int):
    """Least number of common shingles with which sets of these sizes link: more than which is less than the ratio."""
    return -(-(a + b) * num // (num + den))


def size_bands(num: int, den: int, most: int = 1 << 31) -> list[int]:
    """Least sizes of bands: a set links only with sets of its own band and the two beside it."""
    out = [1]
    while out[-1] < most and len(out) < 4096:
        out.append(out[-1] * den // num + 1)
    return out


def _found(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``_id, k1, k2, n_shingles`` of all rows, and ``k1, k2, root`` of the texts that link with others."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    num, den = percent, 100
    kind = dict(docs.dtypes)[id_col]
    bands = size_bands(num, den)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), *text_key(text), text.alias("_text"))

    def repeated_in(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Values that occur ``least`` times or more, and how often. Empties the list and sorts in place: memory is short."""
        v = np.concatenate(held)
        held.clear()
        v.sort()
        room = max(0, len(v) - least + 1)
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])[:room] & (v[least - 1 :][:room] == v[:room]))
        values = v[starts]
        return values, np.searchsorted(v, values, "right") - starts

    def local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What occurs in several different texts of a run of rows: shingles (kind 0) and words (1); 2 has the words' number."""
        shingles: list[np.ndarray] = []
        words: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            total = sum(map(len, words))
            for kind, held, least in ((0, shingles, 2), (1, words, 8)):
                v, c = repeated_in(held, least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), kind, np.int32)), pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["kind", "v", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["kind", "v", "n"])

        for batch in batches:
            column = batch.column(2).filter(pa.array(_first_seen(batch, seen)))
            for a, b in K.slices(column, SLICE):
                s = Shingles(column.slice(a, b - a), width)
                shingles.append(s.v)
                words.append(s.tokens)
                n += len(s.v)
                if n > RUN or len(seen) > SEEN:
                    yield from out()
                    n = 0
                    seen.clear()
        if shingles:
            yield from out()

    counts = keyed.select("k1", "k2", "_text").mapInArrow(K.frugal(local_counts), "kind int, v long, n long").groupBy("kind", "v").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where("kind > 0 or n >= 4"), "join-counts")
    top = [counts.where(f"kind = {k}").orderBy(F.desc("n"), "v").limit(most).select("v", "n").toArrow() for k, most in ((0, HEAVY), (1, WORDS), (2, 1))]
    discard(counts)
    order = spark.sparkContext.broadcast(Order(top[0], top[1], sum(top[2].column("n").to_pylist())))

    def emit_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, column = batch.column(0).to_numpy(), batch.column(1)
            for a, b in K.slices(column, SLICE):
                s = Shingles(column.slice(a, b - a), width, order.value)
                at, _ = s.prefixes(num, den)
                yield pa.RecordBatch.from_arrays([pa.array(s.v[at].view(np.int64)), pa.array(k1[a:b][s.row[at]])], names=["v", "k1"])

    prefix = keyed.select("k1", "_text").mapInArrow(K.frugal(emit_prefixes), "v long, k1 long")
    shared = prefix.groupBy("v").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b")
    repeated = spark.sparkContext.broadcast(hash_filter(shared))

    def sized_and_partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes of all sets; of texts that may have a partner the prefix shingles that may be shared, once a run of rows."""
        names = ["_id", "k1", "k2", "n_shingles", "band", "hits", "places", "ranges", "odd"]
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = _first_seen(batch, seen, 1)
            if len(seen) > SEEN:
                seen.clear()
            for a, b in K.slices(batch.column(3), SLICE):
                s = Shingles(batch.column(3).slice(a, b - a), width, order.value)
                at, place = s.prefixes(num, den)
                hit = repeated.value(s.v[at]) & fresh[a:b][s.row[at]]
                at, place = at[hit], place[hit]
                first = np.searchsorted(s.row[at], np.arange(b - a + 1))
                none = np.diff(first) == 0
                edge = pa.array(first.astype(np.int32), mask=np.append(none, False))
                lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (s.v[at].view(np.int64), place.astype(np.int32))]
                ranges = pa.array([None if x else r for x, r in zip(none.tolist(), s.ranges(), strict=True)], pa.binary())
                eight = pa.array(np.arange(b - a + 1, dtype=np.int32) * ODD, mask=np.append(none, False))
                odd = pa.ListArray.from_arrays(eight, pa.array(s.odd().view(np.int64).ravel()))
                band = pa.array(np.searchsorted(bands, s.size, "right").astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(s.size.astype(np.int64)), band, *lists, ranges, odd], names=names)

    schema = f"_id {kind}, k1 long, k2 long, n_shingles long, band int, hits array<long>, places array<int>, ranges binary, odd array<long>"
    sized = materialise(keyed.mapInArrow(K.frugal(sized_and_partnered), schema), "join-sizes")
    classes = sized.where("hits is not null").select("k1", "k2", F.col("n_shingles").cast("int").alias("size"), "band", "hits", "places", "ranges", "odd").dropDuplicates(["k1", "k2"])
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")

    # The pivot of a shingle is the text most of whose prefix is shared: what near copies were made from rather than one
    # of them, as they may be near to it and not to each other.
    length = F.col("size") - F.ceil(F.col("size") * num / F.lit(den)) + 1
    weight = (F.size("hits") * 1000 / length).cast("int")
    posting = ["v", "node", "size", "place", "before", "band"]
    listed = F.posexplode(F.arrays_zip(F.col("hits").alias("v"), F.col("places").alias("place"))).alias("before", "hit")
    postings = classes.select("node", "size", "band", weight.alias("weight"), listed).select("node", "size", "band", "weight", "before", "hit.v", "hit.place")
    pivots = postings.groupBy("v").agg(F.max(F.struct("weight", "node", "size", "place", "before")).alias("p"), F.count("*").alias("n")).where("n > 1")
    pivots = materialise(pivots.select("v", "n", "p.node", "p.size", "p.place", "p.before"), "join-pivots")
    lists = postings.alias("p").join(pivots.alias("q"), "v").where("p.node <> q.node")
    near = _may_link("p", "q", num, den)
    other = F.when(near, F.col("q.node")).alias("pivot")
    lists = materialise(lists.where(near | F.expr("q.n > 2")).select("v", "p.node", "p.size", "p.place", "p.before", "p.band", "q.n", other), "join-lists")

    features = classes.select("node", "k1", "k2", "size", "ranges")

    def suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            need = least_overlap(batch.column("a_size").to_numpy().astype(np.int64), batch.column("b_size").to_numpy(), num, den)
            keep = [most_common(p, q) >= n for p, q, n in zip(x, y, need.tolist(), strict=True)]
            yield batch.select(["a", "a1", "a2", "b", "b1", "b2"]).filter(pa.array(keep, pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by pivot and part, the pivot first; its set is held until the next one's."""
        held = np.empty(0, np.uint64)
        for batch in batches:
            b, pivot, node, column = batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            linked = np.zeros(len(batch), bool)
            for low, high in K.slices(column, SLICE):
                s = Shingles(column.slice(low, high - low), width)
                for i in range(high - low):
                    mine = s.v[s.first[i] : s.first[i + 1]]
                    if pivot[low + i]:
                        held = mine.copy()
                    elif len(held) and len(mine):
                        common = int((held[np.minimum(np.searchsorted(held, mine), len(held) - 1)] == mine).sum())
                        linked[low + i] = common * den >= num * (len(held) + len(mine) - common)
            yield pa.RecordBatch.from_arrays([node, b], names=["a", "b"]).filter(pa.array(linked))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among distinct candidate pairs ``a, b``; each pair is verified once, on whole sets."""
        pairs = materialise(pairs, "join-pairs")
        left, right = (features.select(*[F.col(c).alias(n) for c, n in zip(features.columns, names, strict=True)]) for names in (("a", "a1", "a2", "a_size", "x"), ("b", "b1", "b2", "b_size", "y")))
        both = pairs.join(left, "a").join(right, "b").select("a", "a1", "a2", "a_size", "x", "b", "b1", "b2", "b_size", "y")
        likely = materialise(both.mapInArrow(K.frugal(suffix_filter), "a long, a1 long, a2 long, b long, b1 long, b2 long"), "join-likely")
        # Texts meet their pivot's in parts, so that a pivot of many texts is verified by many tasks.
        parts = materialise(likely.groupBy("b").agg(F.ceil(F.count("*") / PER_PIVOT).alias("parts")), "join-parts")
        dealt = likely.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
        members = dealt.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "b", "part", F.lit(False).alias("pivot"), F.col("a").alias("node"))
        heads = dealt.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), "b", "part", F.lit(True).alias("pivot"), F.col("b").alias("node")).distinct()
        ends = materialise(members.unionByName(heads), "join-ends")
        needed = spark.sparkContext.broadcast(hash_filter(ends.select(F.col("k1").alias("v")).distinct()))

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                batch = batch.filter(pa.array(needed.value(batch.column(0).to_numpy().view(np.uint64))))
                if len(seen) > SEEN:
                    seen.clear()
                yield batch.filter(pa.array(_first_seen(batch, seen)))

        texts = keyed.select("k1", "k2", "_text").mapInArrow(K.frugal(wanted), "k1 long, k2 long, _text string")
        # Only rows whose text is asked for are shuffled, and once more to where their pivots are.
        texts = texts.groupBy("k1", "k2").agg(F.first("_text").alias("_text"))
        rows = ends.join(texts, ["k1", "k2"]).select("b", "pivot", "node", "_text", "part")
        rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("pivot"), "node").drop("part")
        links = materialise(rows.mapInArrow(K.frugal(verify), "a long, b long"), "join-links")
        discard(pairs, likely, parts, ends)
        return links

    # Each pair once, turned so that a pivot comes second.
    ends = [F.greatest("node", "pivot").alias("high"), F.least("node", "pivot").alias("low")]
    pairs = lists.where("pivot is not null").groupBy(*ends).agg(F.max("pivot").alias("b"))
    links = verified(pairs.select((F.col("high") + F.col("low") - F.col("b")).alias("a"), "b"))
    roots = components(links)

    # What a pivot leaves: shingles whose other texts are of several components. Two of them are compared if their bands
    # of sizes meet: the larger one also stands in the band below its own. As many near copies may meet here that are
    # near to none of them, the suffix filter is part of the join: sets differ by one at least in each range in which
    # only one of them has an odd number.
    named = lists.where("n > 2").select(*posting).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("v")
    odd = [F.get("odd", F.lit(i)).alias(f"odd{i}") for i in range(ODD)]
    open_ = materialise(named.join(mixed, "v", "left_semi").join(classes.select("node", *odd), "node"), "join-open")
    below = open_.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    apart = F.lit(0)
    for i in range(ODD):
        apart = apart + F.bit_count(F.col(f"p.odd{i}").bitwiseXOR(F.col(f"q.odd{i}")))
    both = F.col("p.size") + F.col("q.size")
    near = _may_link("p", "q", num, den) & (apart <= both - 2 * F.ceil(both * num / F.lit(num + den)))
    once = F.expr("p.root <> q.root and (p.size < q.size or p.size = q.size and p.node < q.node)")
    rest = open_.alias("p").join(below.alias("q"), ["v", "band"]).where(once & near)
    more = verified(rest.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")).distinct())

    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    root = final.unionByName(final.select(F.col("root").alias("node"), "root").distinct())
    linked = materialise(classes.select("node", "k1", "k2").join(root, "node").select("k1", "k2", "root"), "join-linked")
    discard(classes, pivots, lists, links, open_, more, roots, final)
    return sized.select("_id", "k1", "k2", "n_shingles"), linked


def _first_seen(batch: pa.RecordBatch, seen: set[tuple[int, int]], at: int = 0) -> np.ndarray:
    """Whether each row's text key, in the columns ``at`` and the next, is new to ``seen``."""
    out = np.zeros(len(batch), bool)
    for i, key in enumerate(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)):
        if key not in seen:
            seen.add(key)
            out[i] = True
    return out


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Length and positional filters on two postings of one shingle.

    Of the shingles before it only those may be shared that stand in several prefixes (``before``): what both sets hold
    and one of them holds before the shingle is in both prefixes. So edits, which make rare shingles, tell texts apart.
    """
    low, high = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    most = F.least(F.col(f"{a}.size") - F.col(f"{a}.place"), F.col(f"{b}.size") - F.col(f"{b}.place"))
    before = F.least(f"{a}.before", f"{b}.before")
    return (low * den >= high * num) & (most + before >= F.ceil((low + high) * num / F.lit(num + den)))


def _with_components(rows: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k1, k2``, ``first``: a text's least id (null ids last) and how many rows repeat that, and ``chosen``: the same of
    its component, with the text's key behind it; and the table that this reads besides ``rows``."""
    ids = rows.groupBy("k1", "k2", "_id").agg(F.count("*").alias("n"))
    own = ids.groupBy("k1", "k2").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "n")).alias("first"))
    # Texts without a partner stay out of the join by component: they would all meet in one task.
    grouped = materialise(linked.join(own, ["k1", "k2"]), "join-grouped")
    best = materialise(grouped.groupBy("root").agg(F.min(F.struct("first", "k1", "k2")).alias("chosen")), "join-chosen")
    joint = materialise(grouped.select("k1", "k2", "root").join(best, "root"), "join-joint")
    discard(grouped, best)
    return own.join(joint.drop("root"), ["k1", "k2"], "left").withColumn("chosen", F.coalesce("chosen", F.struct("first", "k1", "k2"))), joint


def jaccard_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
) -> DataFrame:
    """Link texts whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are split at space and the ASCII controls 9 to 13, A-Z count as a-z. Returns one row per document: id,
    ``n_shingles`` (size of its set) and ``component_id`` (the smallest id that links reach, its own included).

    1. Shingles are ordered by frequency, rarest first: as counted for the ``HEAVY`` most frequent of those that tasks
       see repeat, as expected from their words' counts for all others. Two linked sets share a shingle of their
       prefixes.
    2. Prefix shingles are counted by text in one pre-aggregated shuffle. A filter of bounded size of those in several
       texts leaves few; equal texts become one class, a row with those shingles and their places.
    3. Each prefix shingle pairs its texts with one of them, the pivot, by length and positional filter. Distinct pairs
       meet the suffix filter: sets are cut at fixed places of the hash, and two of them share no more in a range than
       the smaller count there. What is left is verified once on whole sets, and links become components.
    4. Shingles whose other texts still belong to several components pair these within bands of sizes, filtered and
       verified alike, so no link between components is lost, and none inside one needs to be made. There a shingle of
       n texts that are near to none of each other costs n * n comparisons of some 100 bytes in the join, without rows.

    A group of copies or near copies, whatever its size, thus costs a pair a text. No step gathers rows by a shingle.
    Null text, empty text and white space have no set and link with nothing. A null id joins the component of its
    text; it is smallest only where all are null. Rows that repeat are kept. An empty table gives an empty result;
    other columns are ignored.
    """
    rows, linked = _found(docs, id_col, text_col, width, percent)
    own, joint = _with_components(rows, linked)
    own = materialise(own.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("chosen.first.id").alias("least")), "join-least")
    out = rows.join(own, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select(
        F.col("_id").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("_id")).alias("component_id"),
    )
    out = materialise(out, "join-result")
    discard(rows, linked, joint, own)
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of :func:`jaccard_classes`, and all rows without a word.

    The row with the smallest id stays, null ids last; of rows that share id and text, one of them, whichever. All
    columns stay as they are.
    """
    rows, linked = _found(docs, id_col, text_col, width, percent)
    own, joint = _with_components(rows, linked)
    # A row goes unless it has the chosen text and id; what repeats both is kept once below.
    chosen = own.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "chosen")
    told = rows.where("n_shingles > 0").join(chosen, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
    is_it = F.expr("k1 = chosen.k1 and k2 = chosen.k2 and _id <=> chosen.first.id")
    told = told.select("_id", "k1", "k2", is_it.alias("again"), F.col("chosen.first.n").alias("n")).where("not again or n > 1").drop("n").distinct()
    told = materialise(told, "join-gone")
    discard(rows, linked, joint)
    k1, k2, l1, l2, lid = (free_name(docs, x) for x in ("_k1", "_k2", "_l1", "_l2", "_lid"))
    key = text_key(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({k1: key[0], k2: key[1]})
    same = (F.col(k1) == F.col(l1)) & (F.col(k2) == F.col(l2)) & F.col(id_col).eqNullSafe(F.col(lid))
    listed = told.select(F.col("_id").alias(lid), F.col("k1").alias(l1), F.col("k2").alias(l2), "again")
    # Most rows' texts have no key that is listed, as a filter of bounded size tells; only the others are shuffled.
    spark, maybe, docs_columns = docs.sparkSession, free_name(docs, "_maybe"), docs.columns
    keys = spark.sparkContext.broadcast(hash_filter(told.select(F.col("k1").alias("v")).distinct()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = keys.value(batch.column(len(docs_columns)).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, maybe])

    marked = keyed.mapInArrow(K.frugal(mark), T.StructType([*keyed.schema.fields, T.StructField(maybe, T.BooleanType())]))
    out = marked.where(~F.col(maybe)).unionByName(marked.where(maybe).join(listed.drop("again"), same, "left_anti")).select(*docs_columns)
    again = listed.where("again").drop("again")
    if again.isEmpty():
        return out
    some = keyed.join(again, same, "left_semi")
    return out.unionByName(some.dropDuplicates([id_col, k1, k2]).select(*docs.columns))
