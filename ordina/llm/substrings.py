"""Substring dedup: Rabin-Karp hashes of all fixed-length word windows, counted; repeated windows become intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .common import WORD, HashFilter, hash_filter, materialise, text_key

#: Words of an anchor: the run of the smallest hash in a window.
ANCHOR = 16
_MOST = np.uint64(2**64 - 1)
#: Bytes of text that a Python worker takes at a time (or one whole text): its arrays hold some 30 times as many.
SLICE = 1 << 20


class Windows:
    """The windows of the rows of one string column, and the anchor of each."""

    def __init__(self, column: pa.Array, width: int):
        self.width = width
        self.data, offsets = K.text_bytes(column)
        self.starts, self.ends, self.first = K.words(self.data, offsets)
        self.tokens = K.word_hashes(self.data, self.starts, self.ends)
        n, self.room = len(self.tokens), K.room(self.first)
        self.size = min(ANCHOR, width)
        self.runs = np.full(n, _MOST)
        found = K.rolling(self.tokens, self.size, seed=3)
        self.runs[: len(found)] = found
        self.runs[self.room < self.size] = _MOST
        self.span = width - self.size + 1
        self.valid = self.room[: max(0, n - self.span + 1)] >= width
        self.low = self._lowest(self.runs)

    def _lowest(self, values: np.ndarray) -> np.ndarray:
        return K.sliding(values, self.span, np.minimum) if len(values) >= self.span else values[:0]

    def anchors(self) -> np.ndarray:
        """Places of all runs whose hash is the smallest of a window that they are in."""
        if not len(self.low):
            return np.empty(0, np.int64)
        edge = np.zeros(self.span - 1, np.uint64)
        high = K.sliding(np.concatenate([edge, np.where(self.valid, self.low, np.uint64(0)), edge]), self.span, np.maximum)
        return np.flatnonzero((high == self.runs) & (high > 0))

    def candidates(self, maybe: HashFilter) -> np.ndarray:
        """Places of the windows whose smallest run may occur elsewhere."""
        if not len(self.low):
            return np.empty(0, np.int64)
        kept = np.where(maybe(self.runs), self.runs, _MOST)
        return np.flatnonzero((self._lowest(kept) == self.low) & self.valid)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


def _kept(w: Windows, gone: np.ndarray, lost: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space; null for rows that lose nothing."""
    out: list[bytes | None] = [None] * len(lost)
    for i in np.flatnonzero(lost).tolist():
        places = np.flatnonzero(~gone[w.first[i] : w.first[i + 1]]) + w.first[i]
        out[i] = b" ".join(bytes(w.data[s:e]) for s, e in zip(w.starts[places].tolist(), w.ends[places].tolist(), strict=True))
    return pa.array(out, pa.binary()).cast(pa.string())


def _intervals(w: Windows, gone: np.ndarray) -> pa.Array:
    """For each row the maximal runs of its words that go, as places in the row, end exclusive."""
    begins, ends = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1]
    ends[:-1] &= ~gone[1:]
    edge = w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(gone))]
    begins[edge] |= gone[edge]
    ends[edge - 1] |= gone[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = w.row_of(start)
    runs = pa.StructArray.from_arrays([pa.array((x - w.first[row]).astype(np.int32)) for x in (start, end)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(w.first))).astype(np.int32)), runs)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 35, finish: Callable[[Column], Column] = lambda kept: kept) -> DataFrame:
    """Remove every word that a repeated window of ``width`` words covers.

    Returns one row per document: id, ``n_words, n_removed, kept`` (the remaining words joined by one space) and
    ``removed`` (maximal intervals of word places, end exclusive). ``finish`` is applied to the remaining text before it
    is shuffled; a digest there saves moving the texts. A window is repeated if its words also start
    anywhere else, in the same text or another; windows are judged on the input.

    1. Equal texts are one class. A class of two or more rows is removed whole if it has a window at all.
    2. Each window's anchor is its run of ``ANCHOR`` words with the smallest hash; equal windows have equal anchors.
       Anchors (a tenth of all words) are counted; a filter of bounded size of those that repeat tells the windows that
       may repeat. Most texts have none and their bytes are not shuffled.
    3. The Rabin-Karp hashes (96 bits) of all windows that may repeat are counted in one pre-aggregated shuffle. What
       occurs once sends back its text and place; all others are repeated and merge into intervals.

    No step gathers rows by a hash, so a passage that a third of all texts share costs one row a task. A text's own
    places are all that meet in one row. Null text: no words. Null ids and rows that repeat keep their row. Texts
    shorter than ``width`` words lose nothing. An empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = rows.select("_id", *text_key(F.col("_text")), "_text")

    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, column = batch.column(0).to_numpy(), batch.column(1)
            for a, b in K.slices(column, SLICE):
                w = Windows(column.slice(a, b - a), width)
                at = w.anchors()
                row, v = w.row_of(at), w.runs[at]
                order = np.lexsort((v, row))
                row, v = row[order], v[order]
                new = np.ones(len(v), bool)
                new[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
                begin = np.flatnonzero(new)
                many = np.diff(np.append(begin, len(v))) > 1
                yield pa.RecordBatch.from_arrays([_long(v[begin]), _long(k1[a:b][row[begin]]), pa.array(many)], names=["v", "k1", "many"])

    anchors = keyed.select("k1", "_text").mapInArrow(K.frugal(emit_anchors), "v long, k1 long, many boolean")
    twice = anchors.groupBy("v").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("many").alias("m")).where("a <> b or m")
    bitmap = spark.sparkContext.broadcast(hash_filter(twice))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            for a, b in K.slices(column, SLICE):
                w = Windows(column.slice(a, b - a), width)
                found = np.zeros(b - a, bool)
                found[w.row_of(w.candidates(bitmap.value))] = True
                yield batch.slice(a, b - a).filter(pa.array(found))

    texts = keyed.select("k1", "k2", "_text")
    marked = texts.mapInArrow(K.frugal(some), texts.schema).groupBy("k1", "k2").agg(F.first("_text").alias("_text"))
    classes = materialise(marked.withColumn("cid", F.monotonically_increasing_id()), "repeat-texts")

    def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, column = batch.column(0).to_numpy(), batch.column(1)
            for a, b in K.slices(column, SLICE):
                w = Windows(column.slice(a, b - a), width)
                at = w.candidates(bitmap.value)
                row = w.row_of(at)
                h1, h2 = K.rolling(w.tokens, width, seed=4), K.rolling(K.mix(w.tokens), width, seed=5)
                yield pa.RecordBatch.from_arrays(
                    [_long(h1[at]), pa.array((h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(cid[a:b][row]), pa.array((at - w.first[row]).astype(np.int32))],
                    names=["h1", "h2", "cid", "place"],
                )

    windows = classes.select("cid", "_text").mapInArrow(K.frugal(emit_windows), "h1 long, h2 int, cid long, place int")
    once = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("cid").alias("cid"), F.min("place").alias("place")).where("n = 1")
    single = once.groupBy("cid").agg(F.collect_list("place").alias("single"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(2), SLICE):
                rows = batch.slice(a, b - a)
                w = Windows(rows.column(2), width)
                repeated = np.zeros(len(w.tokens), bool)
                repeated[w.candidates(bitmap.value)] = True
                single = rows.column(3)
                n = pc.fill_null(pc.list_value_length(single), 0).to_numpy()
                repeated[np.repeat(w.first[:-1], n) + single.flatten().to_numpy()] = False
                # A word goes if one of the ``width`` windows up to its own place is repeated.
                total = np.concatenate([np.zeros(width, np.int32), np.cumsum(repeated, dtype=np.int32)])
                gone = total[width:] > total[:-width]
                before = np.concatenate([[0], np.cumsum(gone)])
                lost = before[w.first[1:]] - before[w.first[:-1]]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lost, pa.int64()), _kept(w, gone, lost), _intervals(w, gone)], names=["k1", "k2", "lost", "cut_text", "cuts"])

    cuts = (
        classes.join(single, "cid", "left")
        .select("k1", "k2", "_text", "single")
        .mapInArrow(K.frugal(cut), "k1 long, k2 long, lost long, cut_text string, cuts array<struct<start:int,end:int>>")
        .withColumn("cut_text", finish(F.col("cut_text")))
    )
    copies = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    found = cuts.join(copies, ["k1", "k2"], "full").withColumnsRenamed({"k1": "c1", "k2": "c2"})
    facts = keyed.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).select(
        "_id", "k1", "k2", F.size("_words").cast("long").alias("n_words"), finish(F.array_join("_words", " ")).alias("plain")
    )
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_words") >= width)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    out = facts.join(found, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).alias("n_removed"),
        F.when(whole, finish(F.lit(""))).otherwise(F.coalesce("cut_text", "plain")).alias("kept"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(F.coalesce("cuts", none)).alias("removed"),
    )
