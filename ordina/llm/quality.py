"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import kernels as K

#: Word slots (words are hashed), numbers in a vector, non-zero numbers in an index vector, words of context each side.
SLOTS, SIZE, ONES, REACH = 1 << 14, 32, 4, 2
FEATURES = SIZE + 1
#: Labelled rows that the network is fitted on, the smallest by hash.
SAMPLE = 20_000
_CHUNK = 1 << 20


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each slot the places and signs of the non-zero numbers of its random index vector."""
    h = K.mix(np.arange(1, SLOTS * ONES + 1, dtype=np.uint64) * np.uint64(K._GOLDEN)).reshape(SLOTS, ONES)
    return (h % np.uint64(SIZE)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word; a word that repeats the one before it counts as slot 0, a word ``again``."""
    data, offsets = K.text_bytes(column)
    starts, ends, first = K.pieces(data, offsets)
    slot = (K.word_hashes(data, starts, ends, seed=9) >> np.uint64(50)).astype(np.int64)
    again = np.zeros(len(slot), bool)
    again[1:] = slot[1:] == slot[:-1]
    again[first[:-1][np.diff(first) > 0]] = False
    return np.where(again, 0, slot), first


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random indexing over all texts: each word's vector is the sum of the index vectors of the words around it.

    Each task adds up a table of fixed size and hands over its rows; Spark sums them by slot. The result is as large
    whatever the corpus (2 MB). Rows are scaled to length 1 and get half of their own index vector.
    """
    names = [f"d{i}" for i in range(SIZE)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(SLOTS * SIZE)
        for batch in batches:
            for a, b in K.slices(batch.column(0), _CHUNK):
                slot, first = _slots(batch.column(0).slice(a, b - a))
                row = np.repeat(np.arange(b - a), np.diff(first))
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(row[step:] == row[:-step]) if len(row) > step else np.empty(0, np.int64)
                    left, right = slot[near], slot[near + step]
                    for k in range(ONES):
                        total += np.bincount(left * SIZE + place[right, k], sign[right, k], SLOTS * SIZE)
                        total += np.bincount(right * SIZE + place[left, k], sign[left, k], SLOTS * SIZE)
        table = total.reshape(SLOTS, SIZE)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, i].astype(np.float32)) for i in range(SIZE))], names=["slot", *names])

    parts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(K.frugal(gather), "slot int, " + ", ".join(f"{x} float" for x in names))
    summed = parts.groupBy("slot").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # at most SLOTS rows
    out = np.zeros((SLOTS, SIZE))
    out[summed.column("slot").to_numpy()] = np.stack([summed.column(x).to_numpy() for x in names], axis=1)
    place, sign = index_vectors()
    own = np.zeros((SLOTS, SIZE))
    for k in range(ONES):
        np.add.at(own, (np.arange(SLOTS), place[:, k]), sign[:, k])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1) + 0.5 * own / np.sqrt(ONES)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A text's features: the mean vector of its words, and how many there are. All 0 for a text without words."""
    out = np.zeros((len(column), FEATURES), np.float32)
    for a, b in K.slices(column, _CHUNK):
        slot, first = _slots(column.slice(a, b - a))
        n = np.diff(first)
        some = np.flatnonzero(n)
        for c in range(0, len(some), 256):
            rows = some[c : c + 256]
            low, high = first[rows[0]], first[rows[-1] + 1]
            for_row = np.add.reduceat(vectors[slot[low:high]], first[rows] - low, axis=0)
            out[a + rows, :SIZE] = for_row / n[rows, None]
        out[a:b, SIZE] = np.log1p(n) / 10
    return out


@dataclass(frozen=True)
class Network:
    """Two layers over scaled features; the logit is divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, rounds: int = 600, seed: int = 0) -> Network:
    """Fit by Adam on nine rows of ten and calibrate the temperature on the tenth; the rows' order must be fixed.

    Without rows of both labels the result is the share of label 1 (a half without rows) for any input.
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(y) < 20 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        zero = np.zeros((FEATURES, 1))
        return Network(np.zeros(FEATURES), np.ones(FEATURES), zero, np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    check = np.arange(len(y)) % 10 == 9
    train, goal = z[~check], y[~check]
    rng = np.random.default_rng(seed)
    state = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for t in range(1, rounds + 1):
        pick = rng.integers(0, len(goal), min(len(goal), 1024))
        a, g = train[pick], goal[pick]
        h = np.tanh(a @ state[0] + state[1])
        d = (1 / (1 + np.exp(-np.clip(h @ state[2] + state[3], -40, 40))) - g) / len(g)
        back = np.outer(d, state[2]) * (1 - h * h)
        for i, grad in enumerate((a.T @ back + 1e-5 * state[0], back.sum(0), h.T @ d + 1e-5 * state[2], np.array([d.sum()]))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            state[i] -= 0.01 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, state[0], state[1], state[2], float(state[3][0]), 1.0)
    logit, truth = net.logits(x[check]), y[check]
    options = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in options]
    return Network(mean, scale, state[0], state[1], state[2], float(state[3][0]), float(options[int(np.argmin(loss))]))


@dataclass(frozen=True)
class Classifier:
    vectors: np.ndarray
    network: Network


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from the fit: crc32 of the id as text is a multiple of 5. False for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Word vectors over all texts, and a network on at most ``sample`` labelled rows that are not held out.

    The sample (ids of a documented bound, the smallest by hash) is broadcast to the texts; only its pooled vectors
    come to the driver. Labels other than 0 and 1 are ignored. Ids that repeat count once a row, up to the bound.
    """
    ship(docs.sparkSession)
    vectors = word_vectors(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(2), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["key", "label", "x"])

    key = F.xxhash64(F.col(id_col).cast("string"))
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), key.alias("key"))
        .orderBy("key", "label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("key", "label", "text").mapInArrow(K.frugal(features), "key long, label int, x array<float>")
    got = rows.orderBy("key", "label", F.xxhash64("x")).limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    return Classifier(vectors, fit_network(x, got.column("label").to_numpy()))


def score(docs: DataFrame, model: Classifier, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text in a new column; one pass, no shuffle.

    Null and empty texts and texts of white space get the score of no words. Rows that repeat are scored each and
    columns of other types pass through; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).fill_null("")
            p = held.value.network.probabilities(pooled(column, held.value.vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return docs.mapInArrow(K.frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
