"""Whitening of embeddings by a tiled covariance matrix.

The matrix is cut into tiles: pairs (i, j), i <= j, of blocks of ``TILE`` dimensions.  Each task cuts its
rows into row-blocks of ``ROWS`` vectors and each of those into column blocks; column blocks are
shuffled by their row-block (and by the group of tiles that needs them, where the matrix has more than
``GROUP`` tiles), the tile pairs of a row-block are multiplied after centring, the products are summed
per tile, and the matrix, assembled from its tiles, is decomposed on the driver.  Nothing there grows with
the rows: sums are one number per dimension, the matrix has one number per pair of dimensions.

Components are quantised first: ``x = floor(scale * c) + shift``.  Sums and deviations are exact integers.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are those
of another length than most (ties: the shorter); zero vectors and rows without an id stay, repeated rows count
each time.  Quantised components beyond +-2^48 are taken as that.  A deviation that no long holds is null.
Where fewer than ``components`` dimensions exist there are fewer components; one whose eigenvalue is zero (to rounding)
has null ``whitened``.  Empty tables give no rows.  Columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import shared_table, table

TILE = 32
#: Tiles that one task sums at most.
GROUP = 64
ROWS = 2048
COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 48)


def finite(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


def vectors_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part; floats stay single, since they are widened without loss where they are read."""
    v = F.col(vector)
    if df.schema[vector].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def quantised(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.clip(np.floor(c.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64) + shift


def _sums(size: int, scale: int, shift: int):
    """One row a task: its vectors and the sums of their quantised components, as exact decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, dtype=object)
        for batch in batches:
            x = quantised(matrix_of(K.string_column(batch, "v"), size), scale, shift)
            for a in range(0, len(x), 1 << 13):  # 2^13 numbers of 48 bits fit
                total = total + x[a : a + (1 << 13)].sum(0).astype(object)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "sums"])

    return run


def _tile_groups(size: int, tile: int) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Tiles by group, and for each column block the groups that need it."""
    side = -(-size // tile)
    tiles = [(i, j) for i in range(side) for j in range(i, side)]
    groups = [tiles[a : a + GROUP] for a in range(0, len(tiles), GROUP)]
    return groups, [[g for g, some in enumerate(groups) if any(c in t for t in some)] for c in range(side)]


def _column_blocks(size: int, tile: int, rows: int):
    """Column blocks of each row-block, once for each group of tiles that needs them."""
    needed = _tile_groups(size, tile)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            v = matrix_of(K.string_column(batch, "v"), size)
            for a in range(0, len(v), rows):
                out = [(block, g, c, v[a : a + rows, c * tile : (c + 1) * tile].tobytes()) for c, groups in enumerate(needed) for g in groups]
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["row_block", "tile_group", "col", "data"])

    return run


def _products(size: int, tile: int, kind: str, mean: np.ndarray, scale: int, shift: int):
    """Products of the tile pairs of one row-block, centred first."""
    groups = _tile_groups(size, tile)[0]

    def run(got: pa.Table) -> pa.Table:
        held = {}
        for col, data in zip(got["col"].to_pylist(), got["data"].to_pylist(), strict=True):
            at = slice(col * tile, (col + 1) * tile)
            width = len(mean[at])
            held[col] = quantised(np.frombuffer(data, dtype=kind).reshape(-1, width), scale, shift) - mean[at]
        tiles = groups[got["tile_group"][0].as_py()]
        return pa.table({"i": pa.array([i for i, _ in tiles], pa.int32()), "j": pa.array([j for _, j in tiles], pa.int32()), "cells": pa.array([(held[i].T @ held[j]).ravel() for i, j in tiles], pa.list_(pa.float64()))})

    return run


class Whitening:
    """Sums and covariance of ``n`` quantised vectors, decomposed: eigenvalues fall, ``vectors`` has a column for each."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int, scale: int, shift: int):
        self.n, self.sums, self.covariance, self.scale, self.shift = n, sums, covariance, scale, shift
        self.mean = np.array([s / n for s in sums])
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]
        self.vectors = self.vectors * np.where(np.take_along_axis(self.vectors, np.abs(self.vectors).argmax(0)[None], 0) < 0, -1, 1)
        self.real = self.values > len(sums) * np.finfo(np.float64).eps * max(values.max(), 0)
        trace = float(np.trace(covariance))
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]


def _sides(df: DataFrame) -> tuple[int, int] | None:
    found = df.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return (found["size"], found["count"]) if found else None


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, tile: int = TILE, block_rows: int = ROWS) -> Whitening | None:
    """Fitted to all of ``rows`` (see :func:`vectors_of`); None without any."""
    found = _sides(rows)
    if found is None:
        return None
    size = found[0]
    rows = rows.where(F.size("v") == size)
    parts = rows.select("v").mapInArrow(_sums(size, scale, shift), "n long, sums array<string>")
    # try_sum: a total beyond 38 digits is null, and no sum of 48-bit numbers gets there
    got = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.try_sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    n, sums = got[0]["n"], [int(r["s"]) for r in got]
    mean = np.array([s / n for s in sums])
    kind = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    blocks = rows.select("v").mapInArrow(_column_blocks(size, tile, block_rows), "row_block long, tile_group int, col int, data binary")
    tiles = blocks.groupBy("row_block", "tile_group").applyInArrow(_products(size, tile, kind, mean, scale, shift), "i int, j int, cells array<double>")
    cells = tiles.select("i", "j", F.posexplode("cells").alias("at", "cell")).groupBy("i", "j", "at").agg(F.sum("cell").alias("cell")).groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda c: c["cell"]).alias("cells"))
    whole = np.zeros((size, size))
    for r in cells.toLocalIterator():
        at = slice(r["i"] * tile, (r["i"] + 1) * tile), slice(r["j"] * tile, (r["j"] + 1) * tile)
        part = np.array(r["cells"]).reshape(whole[at].shape)
        whole[at] = part
        whole[at[::-1]] = part.T
    return Whitening(n, sums, whole / n, components, scale, shift)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of squares of n*x - S, exact; null beyond a long."""
    rough = n * x.astype(np.float64) - np.array(sums, dtype=np.float64)
    if not len(x) or (rough * rough).sum(1).max() < 2.0**62 and n * np.abs(x).max() < 2.0**62:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, dtype=object)
    return [s if s < 1 << 63 else None for s in (d * d).sum(1).tolist()]


def _whitened(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = shared.value
        for batch in batches:
            x = quantised(matrix_of(K.string_column(batch, "v"), size), m.scale, m.shift)
            centred, w = x - m.mean, np.zeros((len(x), len(m.values)))
            for j in range(size):  # in the order of the dimensions, so equal vectors get equal results in any batch
                w += centred[:, j, None] * m.vectors[j]
            w = np.divide(w, np.sqrt(m.values), out=np.full_like(w, np.nan), where=m.real)
            parts = pa.array(w.ravel(), mask=~np.tile(m.real, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([K.string_column(batch, "id"), pa.array(_deviation(x, m.n, m.sums), pa.int64()), lists], names=["id", "deviation", "w"])

    return run


def apply_whitening(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, w) of ``rows``; w has a number for each component."""
    size = len(model.sums)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.where(F.size("v") == size).select("id", "v").mapInArrow(_whitened(shared, size), "id long, deviation long, w array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest entry, by size, of the covariance of ``whitened`` minus the identity; components without variance are left out."""
    real = np.flatnonzero(model.real).tolist()
    if not real:
        return None
    w = [F.col("w")[i] for i in real]
    pairs = [F.abs(F.covar_pop(w[a], w[b]) - float(a == b)) for a in range(len(w)) for b in range(a, len(w))]
    return whitened.agg(F.array_max(F.array(*pairs)).alias("worst")).first()["worst"]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, **how) -> DataFrame:
    """A row for each vector that takes part and each component."""
    rows = vectors_of(vectors, key, vector)
    model = fit_whitening(rows, components, **how)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    out = shared_table(apply_whitening(rows, model), "whitened")
    worst = identity_error(out, model)
    explained = F.array(*(F.lit(e).cast("double") for e in model.explained))
    out = out.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(worst).cast("double").alias("identity_error"),
    )


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
