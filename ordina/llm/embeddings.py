"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import components, discard, materialise

#: Vectors of a block; a tile compares two blocks, so a task holds two blocks whatever the group.
BLOCK = 1024
#: Fewest and most leading dimensions that cells are laid over, by the size of the largest group; dimensions that are added
#: at a step.
CELL_DIMS, STEP = (2, 5), 8
#: Tiles hold single precision, which moves a product of unit vectors by 2 ** -23 at most; products this close to the
#: threshold are worked out again from the whole vectors.
CLOSE = 1e-6


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column as unit vectors, by their number of dimensions: places and matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, first = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        x = flat[first[rows][:, None] + np.arange(n)]
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal axes by falling second moment of the vectors in column ``v`` that have ``dims`` numbers, at unit length.

    Each task hands over one matrix of fixed size, summed by element: dims * dims numbers come to the driver.
    """

    def moment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for _, x in _unit(batch.column(0)):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims, dtype=np.int32)), pa.array(total.ravel())], names=["at", "sum"])

    got = vectors.where(F.size("v") == dims).select("v").mapInArrow(moment, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).toArrow()
    square = np.zeros(dims * dims)
    square[got.column("at").to_numpy()] = got.column("sum").to_numpy()
    _, axes = np.linalg.eigh(square.reshape(dims, dims))
    return axes[:, ::-1]


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the pairs of rows of rotated unit vectors whose product may reach ``threshold``, and whether it surely does.

    Products are added up over the leading dimensions first. What the rest can add is at most the product of the
    rests' lengths; rows and columns that no open pair needs are left out, and the walk stops when none is open.
    """
    rows, cols = np.arange(len(a)), np.arange(len(b))
    dims = a.shape[1]
    rest_a, rest_b = (np.sqrt(np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1]) for x in (a, b))
    sums, open_ = np.zeros((len(a), len(b))), np.ones((len(a), len(b)), bool)
    for d in range(0, dims, STEP):
        e = min(dims, d + STEP)
        sums += a[rows, d:e] @ b[cols, d:e].T
        bound = sums + (np.outer(rest_a[rows, e], rest_b[cols, e]) if e < dims else 0)
        open_ &= bound >= threshold - CLOSE
        keep_r, keep_c = open_.any(axis=1), open_.any(axis=0)
        if not keep_r.any():
            return rows[:0], cols[:0], np.empty(0, bool)
        if keep_r.mean() < 0.8 or keep_c.mean() < 0.8:
            rows, cols = rows[keep_r], cols[keep_c]
            sums, open_ = sums[np.ix_(keep_r, keep_c)], open_[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(open_)
    return rows[i], cols[j], sums[i, j] >= threshold + CLOSE


def _lowest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label reachable from each of ``len(label)`` places by the links ``i``-``j``."""
    label = label.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (label == before).all():
            return label


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
) -> DataFrame:
    """Link vectors of equal labels whose cosine, in double precision, is ``threshold`` or more.

    Returns one row per vector: id, ``n_links`` (other vectors linked directly), ``component_id`` (the smallest id that
    links reach, its own included) and ``kept`` (whether that is its own).

    1. Equal vectors of a label are one class with a number of copies. The classes are written once.
    2. Vectors are scaled to length 1 and rotated to principal axes. Linked vectors are at most sqrt(2 - 2 threshold)
       apart, so on a grid of that width over the leading axes only neighbouring cells can hold links. The grid has more
       axes where a label has more vectors.
    3. Cells are dealt into blocks of about ``BLOCK`` vectors; each two blocks of neighbouring cells are a tile, a row
       of a small table that is joined with the rotated vectors, in single precision. A tile holds two blocks, however
       large the label or cell.
    4. A tile adds up products from the leading axis on, bounds what is left by the lengths of the rests, and stops
       where no pair can reach the threshold. It hands over numbers of links and one link to a representative for
       each class, never all pairs; pairs too close to the threshold to tell are compared in double precision.

    Vectors that are null, zero, or hold null or non-finite components, and rows without label or id, link with
    nothing. Vectors link with those of as many dimensions only, each number of dimensions being a label of its own;
    the axes are those of the most common one and others keep theirs. Rows that repeat are vectors of their own that
    share an id. An empty table gives an empty result; other columns are ignored.
    """
    ship(vectors.sparkSession)
    types = dict(vectors.dtypes)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("_v"))
    good = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("_v", lambda x: x != 0)
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)) & F.col("_label").isNotNull() & F.col("_id").isNotNull())
    # -0.0 and 0.0 are equal components.
    rows = rows.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0)))
    usable = rows.where("_good").withColumns({"k1": F.xxhash64("_label", "_v"), "k2": F.xxhash64(F.lit(1), "_label", "_v")})
    classes = usable.groupBy("k1", "k2").agg(F.first("_label").alias("label"), F.first("_v").alias("v"), F.count("*").alias("copies"), F.min("_id").alias("least"))
    # Scaled by the largest component, so that squares neither overflow nor vanish.
    classes = classes.withColumns({"v": F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y)))), "n": F.size("v"), "node": F.monotonically_increasing_id()})
    classes = materialise(classes, "vectors")

    spark = vectors.sparkSession
    by_size = classes.groupBy("label", "n").count()
    common = by_size.groupBy("n").agg(F.sum("count").alias("all"), F.max("count").alias("most")).orderBy(F.desc("all"), "n").first()
    dims, most = (common.n, common.most) if common else (1, 1)
    axes = spark.sparkContext.broadcast(principal_axes(classes, dims))
    width = float(np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6)
    # A further axis leaves about a fourth of a cell's vectors in it.
    grid = min(CELL_DIMS[1], max(CELL_DIMS[0], math.ceil(math.log(most / (4 * BLOCK), 4))))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            edge = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            spun, cells = np.empty(edge[-1], np.float32), np.zeros((len(batch), grid), np.int32)
            for rows, x in _unit(column):
                x = x @ axes.value if x.shape[1] == dims else x
                cells[rows, : x.shape[1]] = np.floor(x[:, :grid] / width)
                spun[edge[rows][:, None] + np.arange(x.shape[1])] = x
            cell = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * grid), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), cell, pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(spun))], names=["node", "copies", "label", "n", "cell", "r"])

    spun = classes.select("node", "copies", "label", "n", "v").mapInArrow(rotate, f"node long, copies long, label {types[label_col]}, n int, cell array<int>, r array<float>")
    spun = materialise(spun, "vectors-rotated")
    cell = ["label", "n", "cell"]
    number = materialise(spun.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "vector-cells")
    placed = spun.join(number, cell).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    steps = F.array(*[F.array(*map(F.lit, x)) for x in itertools.product((-1, 0, 1), repeat=grid) if x >= (0,) * grid])
    near = number.select("label", "n", F.col("cell").alias("a"), F.col("blocks").alias("a_blocks"), F.explode(steps).alias("step"))
    near = near.select("*", F.zip_with("a", "step", lambda x, y: x + y).alias("cell"))
    tiles = near.join(number, cell).select("*", F.explode(F.expr("sequence(0, a_blocks - 1)")).alias("i")).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
    tiles = materialise(tiles.where("cell <> a or i <= j").select(*cell, "a", "i", "j", F.monotonically_increasing_id().alias("tile")), "vector-tiles")
    sides = tiles.select("tile", F.lit(0).alias("side"), "label", "n", F.col("a").alias("cell"), F.col("i").alias("block")).unionByName(
        tiles.where("cell <> a or i <> j").select("tile", F.lit(1).alias("side"), "label", "n", "cell", F.col("j").alias("block"))
    )
    dealt = placed.join(sides, [*cell, "block"]).select("tile", "side", "node", "copies", "r")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        left, right = group[group.side == 0], group[group.side == 1]
        alone = right.empty
        right = left if alone else right
        if left.empty:
            return pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "head": np.empty(0, np.int64)})
        a = np.stack(left.r.to_numpy()).astype(np.float64)
        b = a if alone else np.stack(right.r.to_numpy()).astype(np.float64)
        i, j, sure = near_pairs(a, b, threshold)
        if alone:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        ids = left.node.to_numpy() if alone else np.concatenate([left.node.to_numpy(), right.node.to_numpy()])
        copies = left.copies.to_numpy() if alone else np.concatenate([left.copies.to_numpy(), right.copies.to_numpy()])
        j = j if alone else j + len(left)
        unsure = pd.DataFrame({"node": ids[i[~sure]], "links": np.zeros(int((~sure).sum()), np.int64), "head": ids[j[~sure]]})
        i, j = i[sure], j[sure]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = links > 0
        return pd.concat([unsure, pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "head": _lowest(i, j, ids)[some]})])

    # Rows without links are pairs to be compared again.
    met = materialise(dealt.groupBy("tile").applyInPandas(compare, "node long, links long, head long"), "vector-links")
    left, right = (classes.select(F.col("node").alias(k), F.col("v").alias(f"v{k}"), F.col("copies").alias(f"n{k}")) for k in "ab")
    again = met.where("links = 0").select(F.col("node").alias("a"), F.col("head").alias("b")).join(left, "a").join(right, "b")

    def product(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    told = materialise(again.where(product("va", "vb") / F.sqrt(product("va", "va") * product("vb", "vb")) >= threshold).select("a", "b", "na", "nb"), "vector-close")
    links = met.where("links > 0").select("node", "links").union(told.select("a", "nb")).union(told.select("b", "na"))
    edges = met.where("links > 0 and node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).union(told.select("a", "b"))
    roots = components(edges)

    # Only linked vectors take part in the join by component.
    root = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = materialise(classes.select("node", "least").join(root, "node"), "vector-groups")
    best = materialise(grouped.groupBy("root").agg(F.min("least").alias("component")), "vector-least")
    joint = materialise(grouped.select("node", "root").join(best, "root").select("node", "component"), "vector-joint")
    found = classes.select("k1", "k2", "node", "copies", "least").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(joint, "node", "left")
    found = found.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    found = materialise(found, "vector-found")
    keys = rows.where("_good").select("_id", F.xxhash64("_label", "_v").alias("k1"), F.xxhash64(F.lit(1), "_label", "_v").alias("k2"))
    linked = keys.join(found, ["k1", "k2"]).select("_id", "n_links", "component")
    alone = rows.where("not _good").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component"))
    out = linked.unionByName(alone)
    out = out.select(F.col("_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("_id"), F.lit(True)).alias("kept"))
    out = materialise(out, "vector-result")
    discard(classes, spun, number, tiles, met, told, roots, grouped, best, joint, found)
    return out
