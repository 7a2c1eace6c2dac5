"""Approximate nearest neighbours by inner product: stable projections indexed by a kd-tree.

Vectors get one more component that makes all norms equal, so the largest inner product is the
nearest point.  A Gaussian matrix projects every vector to ``DIMS`` numbers.  The top of a kd-tree over
the projections is laid out from a bounded sample of them (``SAMPLE`` vectors, those of the smallest
hashes) and divides all vectors into shards; each shard's own kd-tree is built once and its leaves are
the rows of a table, the index.  A query is searched in the shard it falls in first, and then, with the
k-th best score found there, in those shards alone whose box it cannot rule out.  Leaves are visited in
the order of their distance in the projection, and of their vectors those are verified in the original
space, in double precision, that are near enough in the projection: as the squared ratio of projected
to true distance is chi-square distributed, a vector (or leaf, or shard) is passed over once the chance
that it beats the k-th best falls under ``MISS``.  Every vector is indexed.

Equal vectors are one point with their ids in order, of which no query can need more than the k + 1
smallest.  A shard holds about ``SHARD_ROWS`` points and is sent to one task with the queries that reach
it, which are read one batch at a time.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those of another length than most; a query's own id is no candidate of it; ties go to the smaller
id; rows that repeat an id and vector are one query and candidates each.  Empty tables and queries
without candidates give no rows.  Columns not named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import blocks, even_keys, partitions, shared_table, table

DIMS = 16
#: Chance at which a vector, leaf or shard may be passed over although it beats the k-th best; measured recall is in the README.
MISS = 0.05
LEAF = 48
SHARD_ROWS = 1 << 12
SAMPLE = 1 << 14
K_BEST = 20
SEED = 3

LEAVES = "shard int, sub int, low array<double>, high array<double>, ids binary, times binary, first binary, vectors binary"
FOUND = "query_id long, key long, vec_id long, score double, verified long"

def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """By bisection of the distribution function, which is elementary for an even number of dimensions."""
    if dims % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over projected points: points in the order of the leaves, and each leaf's box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, begin = [], [0]
        work = [np.arange(len(points))]
        while work:
            rows = work.pop()
            spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
            if len(rows) <= leaf or not spread.max():
                order.append(rows)
                begin.append(begin[-1] + len(rows))
                continue
            axis, half = int(spread.argmax()), len(rows) // 2
            rows = rows[np.argpartition(points[rows, axis], half)]
            work += [rows[half:], rows[:half]]
        self.order, self.begin = np.concatenate(order), np.array(begin)
        at = self.begin[:-1]
        self.low = np.minimum.reduceat(points[self.order], at)
        self.high = np.maximum.reduceat(points[self.order], at)


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on: equal vectors have equal scores anywhere."""
    s = np.zeros(len(vectors))
    for x, y in zip(vectors.T, q, strict=True):
        s += x * y
    return s


def projection(size: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size + 1, dims))


def projected(vectors: np.ndarray, matrix: np.ndarray, square: float) -> np.ndarray:
    """Projections of vectors, lengthened to the square of the norm ``square``."""
    rest = np.sqrt(np.maximum(0, square - (vectors**2).sum(1)))
    return np.column_stack([vectors, rest]) @ matrix


def box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of ``q`` from each box."""
    d = np.maximum(0, np.maximum(low - q, q - high))
    return (d * d).sum(1)


class Top:
    """The upper levels of the tree: splits at medians of a sample; ``of`` gives the shard of any point."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        work = [(1, sample)]
        while work:
            node, rows = work.pop()
            if node >= 1 << depth:
                continue
            if len(rows):
                self.axis[node] = int(np.ptp(rows, axis=0).argmax())
                self.value[node] = float(np.median(rows[:, self.axis[node]]))
            right = rows[:, self.axis[node]] > self.value[node]
            work += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return (node - (1 << self.depth)).astype(np.int32)


class Shard:
    """A shard of points in the order of its leaves; ``first`` cuts ids and their multiplicities by point, ``begin`` points by leaf."""

    def __init__(self, leaves: list[tuple], matrix: np.ndarray, square: float):
        size = len(matrix) - 1
        low, high, ids, times, first, vectors = zip(*leaves, strict=True)
        self.low, self.high = np.stack(low), np.stack(high)
        self.ids, self.times = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in part]) for part in (ids, times))
        counts = [np.frombuffer(x, dtype=np.int64) for x in first]
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in counts])])
        self.vectors = np.concatenate([np.frombuffer(x, dtype=np.float64) for x in vectors]).reshape(-1, size)
        self.single = self.vectors.astype(np.float32)
        self.points = projected(self.vectors, matrix, square)
        self.matrix, self.square = matrix, square

    def search(self, q: np.ndarray, own: int, k: int, stop: float, bound: float = -math.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, points verified): at most k candidates, best first, none below ``bound``."""
        at_q = q @ self.matrix[:-1]
        distance = box_distance(self.low, self.high, at_q)
        order = np.argsort(distance, kind="stable")
        norm = float(q @ q) + self.square
        single = q.astype(np.float32)
        slack = 1e-6 * len(q) * (1 + norm)  # more than single precision can be wrong by
        best_s, best_i, verified = np.zeros(0), np.zeros(0, dtype=np.int64), 0
        at, step = 0, 4
        while at < len(order):
            least = max(bound, best_s[-1] if len(best_s) == k else -math.inf)
            reach = stop * max(0.0, norm - 2 * least)
            if distance[order[at]] > reach:
                break
            some = order[at : at + step]
            at, step = at + len(some), step * 2
            size = self.begin[some + 1] - self.begin[some]
            rows = np.repeat(self.begin[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            if reach < math.inf:
                away = self.points[rows] - at_q
                rows = rows[np.einsum("ij,ij->i", away, away) <= reach]
            verified += len(rows)
            rough = self.single[rows] @ single
            if least > -math.inf:
                rows = rows[rough >= least - slack]
            elif len(rough) > 2 * k + 2:  # the k + 1 best points hold the k best candidates besides the query's own
                rows = rows[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - slack]
            s = products(self.vectors[rows], q)
            few = self.first[rows + 1] - self.first[rows]
            at_id = np.repeat(self.first[rows] - (np.cumsum(few) - few), few) + np.arange(few.sum())
            ids, s, times = self.ids[at_id], np.repeat(s, few), self.times[at_id]
            keep = (ids != own) & (s >= bound)
            ids, s = (np.repeat(x[keep], np.minimum(times[keep], k)) for x in (ids, s))
            best_i, best_s = np.concatenate([best_i, ids]), np.concatenate([best_s, s])
            keep = np.lexsort((best_i, -best_s))[:k]
            best_i, best_s = best_i[keep], best_s[keep]
        return best_i, best_s, verified


def _matrix_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _placed(shared, size: int, square: float):
    """Rows with the shard that their vector falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, matrix = shared.value, projection(size)
        for batch in batches:
            shard = top.of(projected(_matrix_of(K.string_column(batch, "v"), size), matrix, square))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    return run


def _leaves_of(size: int, square: float):
    """The leaves of each shard's tree; rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now, held = projection(size), None, []

        def built():
            ids, times, v = (np.concatenate(x) for x in zip(*held, strict=True))
            vectors, inverse = np.unique(v, axis=0, return_inverse=True)
            order = np.lexsort((ids, inverse.ravel()))
            ids, times = ids[order], times[order]
            first = np.searchsorted(inverse.ravel()[order], np.arange(len(vectors) + 1))
            tree = Tree(projected(vectors, matrix, square))
            out = []
            for a, b, low, high in zip(tree.begin, tree.begin[1:], tree.low, tree.high, strict=False):
                points = tree.order[a:b]
                at = np.concatenate([np.arange(first[p], first[p + 1]) for p in points])
                out.append((*now, low, high, ids[at].tobytes(), times[at].tobytes(), np.diff(first)[points].tobytes(), vectors[points].tobytes()))
            types = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["shard", "sub", "low", "high", "ids", "times", "first", "vectors"])

        for batch in batches:
            place = np.stack([K.string_column(batch, c).to_numpy() for c in ("shard", "sub")], 1)
            cut = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if now != tuple(place[a]) and held:
                    yield built()
                    held = []
                now = tuple(place[a].tolist())
                part = batch.slice(a, b - a)
                held.append((K.string_column(part, "id").to_numpy(), K.string_column(part, "times").to_numpy(), _matrix_of(K.string_column(part, "v"), size)))
        if held:
            yield built()

    return run


def _searched(size: int, square: float, k: int, stop: float):
    """Queries of each shard after its leaves; rows sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now, leaves, shard = projection(size), None, [], None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if (r["shard"], r["sub"]) != now:
                    now, leaves, shard = (r["shard"], r["sub"]), [], None
                if r["q"] is None:
                    leaves.append((r["low"], r["high"], r["ids"], r["times"], r["first"], r["vectors"]))
                elif leaves:
                    shard = shard or Shard(leaves, matrix, square)
                    found, scores, verified = shard.search(np.array(r["q"], dtype=np.float64), r["query_id"], k, stop, -math.inf if r["bound"] is None else r["bound"])
                    out.append((r["query_id"], r["key"], None, None, verified))
                    out += [(r["query_id"], r["key"], a, s, 0) for a, s in zip(found.tolist(), scores.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "key", "vec_id", "score", "verified"])

    return run


def _routed(shared, size: int, square: float, stop: float):
    """Queries with the shards, but their own, that their bound does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (shards, low, high), matrix = shared.value, projection(size)
        for batch in batches:
            reached = []
            for q, home, bound in zip(_matrix_of(K.string_column(batch, "q"), size), K.string_column(batch, "shard").to_numpy(), K.string_column(batch, "bound").to_pylist(), strict=True):
                reach = math.inf if bound is None else stop * max(0.0, float(q @ q) + square - 2 * bound)
                reached.append(shards[(box_distance(low, high, q @ matrix[:-1]) <= reach) & (shards != home)])
            names = [n for n in batch.schema.names if n != "shard"]
            yield pa.RecordBatch.from_arrays([*(K.string_column(batch, n) for n in names), pa.array(reached, pa.list_(pa.int32()))], names=[*names, "shards"])

    return run


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Vectors placed in shards; ``leaves`` is a table of the leaves of all shards' trees."""

    def __init__(self, leaves: DataFrame, top: Top, size: int, square: float, subs: int):
        self.leaves, self.top, self.size, self.square, self.subs = leaves, top, size, square, subs


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    if df.schema[vector].dataType.simpleString() != "array<float>":  # floats are widened where they are used
        v = v.cast("array<double>")
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())


def _dealt(rows: DataFrame, subs: int) -> DataFrame:
    """Shards dealt to tasks in turn."""
    n = partitions(rows.sparkSession)
    to = F.element_at(F.array(*map(F.lit, even_keys(rows.sparkSession, n))), F.pmod(F.col("shard") * subs + F.col("sub"), F.lit(n)) + 1)
    return rows.withColumn("_to", to).repartition(n, "_to").drop("_to")


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K_BEST) -> Index | None:
    """The index for searches of up to ``k`` neighbours; None without usable vectors."""
    spark = vectors.sparkSession
    base = _rows(vectors, key, vector)
    square = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    found = base.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), square.alias("square")).orderBy(F.desc("n"), "size").first()
    if found is None:
        return None
    size, n, square = found["size"], found["n"], found["square"] * (1 + 1e-12)
    points = base.where(F.size("v") == size).groupBy("v", "id").agg(F.count("*").alias("times"))
    points = points.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    sample = [r["v"] for r in base.where(F.size("v") == size).orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").collect()]
    depth = min(max(0, math.ceil(math.log2(n / SHARD_ROWS))), int(math.log2(max(1, len(sample) // 8)))) if n > SHARD_ROWS else 0
    top = Top(projected(np.array(sample, dtype=np.float64), projection(size), square), depth)
    subs = blocks(n, SHARD_ROWS << (depth + 1))  # where the sample cannot divide further
    placed = points.drop("place").mapInArrow(_placed(spark.sparkContext.broadcast(top), size, square), f"v {points.schema['v'].dataType.simpleString()}, id long, times long, shard int")
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("v"), F.lit(subs)).cast("int"))
    dealt = _dealt(placed, subs).sortWithinPartitions("shard", "sub")
    return Index(shared_table(dealt.mapInArrow(_leaves_of(size, square), LEAVES), "leaves"), top, size, square, subs)


def _search(index: Index, queries: DataFrame, k: int, stop: float) -> DataFrame:
    """What the shards of ``queries`` (query_id, key, q, bound, shard) hold for them."""
    asked = queries.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(index.subs - 1))))
    both = index.leaves.unionByName(asked, allowMissingColumns=True)
    both = _dealt(both, index.subs).sortWithinPartitions("shard", "sub", F.col("q").isNotNull())
    return both.mapInArrow(_searched(index.size, index.square, k, stop), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K_BEST, miss: float = MISS) -> DataFrame:
    """All that the shards return: query_id, key (of its vector), vec_id and score, and in rows without vec_id the points verified."""
    spark = queries.sparkSession
    stop = chi_square_quantile(1 - miss)
    asked = _rows(queries, key, vector).where(F.size("v") == index.size).dropDuplicates(["id", "v"])
    asked = asked.select(F.col("id").alias("query_id"), F.xxhash64("id", "v").alias("key"), "v")
    placed = asked.mapInArrow(_placed(spark.sparkContext.broadcast(index.top), index.size, index.square), f"query_id long, key long, v {asked.schema['v'].dataType.simpleString()}, shard int")
    placed = shared_table(placed.select("query_id", "key", F.col("v").cast("array<double>").alias("q"), F.lit(None).cast("double").alias("bound"), "shard"), "queries")
    near = shared_table(_search(index, placed, k, stop), "near")
    bound = _best(near, k).where(F.col("rank") == k).select("query_id", "key", F.col("score").alias("bound"))
    # a box for each shard; their number is bounded by the sample
    low, high = ([f(F.col(c)[i]).alias(f"{c}{i}") for i in range(DIMS)] for c, f in (("low", F.min), ("high", F.max)))
    boxes = index.leaves.groupBy("shard").agg(*low, *high).collect()
    shared = spark.sparkContext.broadcast((np.array([b[0] for b in boxes], dtype=np.int32), np.array([b[1 : DIMS + 1] for b in boxes]), np.array([b[DIMS + 1 :] for b in boxes])))
    routed = placed.drop("bound").join(bound, ["query_id", "key"], "left").select("query_id", "key", "q", "bound", "shard")
    routed = routed.mapInArrow(_routed(shared, index.size, index.square, stop), "query_id long, key long, q array<double>, bound double, shards array<int>")
    routed = routed.withColumn("shard", F.explode("shards")).drop("shards")
    return near.unionByName(_search(index, routed, k, stop))


def nearest(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K_BEST, miss: float = MISS) -> DataFrame:
    """For each row of ``queries`` its k nearest of ``vectors``: query_id, rank, vec_id and score."""
    index = build_index(vectors, key, vector, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _best(search(index, queries, key, vector, k, miss), k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors)
